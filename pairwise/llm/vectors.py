"""Link near-equal vectors of a label by cross-polytope hashing.

A vector of length one is spun by three rounds of random signs and a fast Hadamard transform; its
hash is the index and sign of its largest coordinate, that is the nearest corner of the cross
polytope. ``parts`` such hashes make the key of one table, and ``parts`` grows with the logarithm
of the number of vectors, so that unlike vectors rarely share a bucket. Besides its own bucket a vector is put
into the ``PROBES - 1`` next likely ones, where the loss to the largest coordinate is smallest. The
number of tables follows from a simulation of pairs exactly at the threshold: together they
miss such a pair with probability ``MISS`` at most.

Keys are first counted without their vectors; only members of buckets with two rows or more fetch
them. All pairs within a bucket are measured in double precision. Buckets of up to ``SMALL`` rows, which are
nearly all, stream through a task in order, and the pairs of many of them are measured at once. From a
larger bucket only counts and spanning links leave a task. It is cut into blocks of ``BLOCK_ROWS`` rows and each
pair of blocks is a task of its own, so no bucket has to fit anywhere and none is capped. A pair
that meets in several buckets is counted in the first of them, which both rows can tell from
their own key lists; whole blocks are tested for an earlier shared bucket, table by table, until
no pair is left. Equal vectors of a label are one node with a weight before anything else; nodes
are numbered, so rows that share an id but not a vector stay apart.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing and form their own component; vectors of different lengths
never link; rows that share an id are rows of their own, each with the links of its own vector (the
other rows of its id among them where they are near); a row without
an id is reported with null component; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwise.llm.components import components
from pairwise.llm.neighbours import usable
from pairwise.session import via_table

PROBES = 4
MISS = 1e-5
LOAD = 0.05                 # vectors in a bucket if labels and hashes were even
BLOCK_ROWS = 512
SMALL = 64
SPINS = 3
SEED = 7


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    out, width = rows.copy(), 1
    while width < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), -1)
        width *= 2
    return out / math.sqrt(out.shape[1])


def corners(unit: np.ndarray, table: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest corners of each row after a random spin, and how much farther the second is."""
    size = 1 << max(1, (unit.shape[1] - 1).bit_length())
    spun = np.zeros((len(unit), size))
    spun[:, :unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, table, part]).choice([-1.0, 1.0], (SPINS, size))
    for turn in signs:
        spun = hadamard(spun * turn)
    size_of = np.abs(spun)
    order = np.argpartition(size_of, -2, axis=1)[:, -2:]
    values = np.take_along_axis(size_of, order, axis=1)
    first = np.argmax(values, axis=1)
    take = np.arange(len(unit))
    near = np.stack([order[take, first], order[take, 1 - first]], axis=1)
    sign = np.take_along_axis(spun, near, axis=1) < 0
    return near * 2 + sign, values[take, first] - values[take, 1 - first]


def bucket_keys(unit: np.ndarray, tables: int, parts: int) -> np.ndarray:
    """Keys of the buckets of each row, ``tables * PROBES`` of them, tables in order.

    A probe swaps the corner of the parts where that costs least; there are at most ``2 ** parts``
    different ones, and a key that comes up again is repeated.
    """
    out = np.zeros((len(unit), tables * PROBES), dtype=np.int64)
    for table in range(tables):
        near, gaps = zip(*(corners(unit, table, part) for part in range(parts)), strict=True)
        loss = np.stack(gaps, axis=1)
        cheap = np.argsort(loss, axis=1)
        wide = int(PROBES - 1).bit_length()
        for probe in range(PROBES):
            swapped = np.zeros((len(unit), parts), dtype=np.int64)
            for bit in range(min(wide, parts)):
                if probe >> bit & 1:
                    swapped[np.arange(len(unit)), cheap[:, bit]] = 1
            key = np.full(len(unit), table, dtype=np.int64)
            for part in range(parts):
                own = np.take_along_axis(near[part], swapped[:, part:part + 1], axis=1)[:, 0]
                key = key * 2 * unit.shape[1] * 2 + own
            out[:, table * PROBES + probe] = key
    return out


def table_count(dims: int, threshold: float, parts: int) -> int:
    """Tables needed so that a pair at the threshold meets, from simulated pairs."""
    draw = np.random.default_rng(SEED)
    a = draw.standard_normal((2000, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.standard_normal((2000, dims))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-300)[:, None]
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b
    left, right = bucket_keys(a, 4, parts), bucket_keys(b, 4, parts)
    meets = [(left[:, None, t * PROBES:(t + 1) * PROBES] == right[:, t * PROBES:(t + 1) * PROBES, None]).any(axis=(1, 2))
             for t in range(4)]
    rate = min(0.999, float(np.mean(meets)))
    if rate == 0:
        raise ValueError(f"no pair at {threshold} in {dims} dimensions met in the simulation; use a higher threshold")
    return max(2, math.ceil(math.log(MISS) / math.log(1 - rate)))


def _hashed(tables: dict[int, int], parts: int):
    def run(batches):
        for batch in batches:
            for dims, part in batch.groupby(batch["vector"].map(len)):
                rows = np.stack(part["vector"].to_numpy())
                # scaled by the largest part first: squares of extreme numbers leave the range of doubles
                rows = rows / np.abs(rows).max(axis=1)[:, None]
                unit = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
                keys = bucket_keys(unit, tables[dims], parts)
                yield pd.DataFrame({
                    "node": part["node"].array, "label": part["label"].array,
                    "weight": part["weight"].array, "dims": dims, "unit": list(unit), "keys": list(keys),
                    "packed": [k.astype("<i8").tobytes() for k in keys]})
    return run


def _local_roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches by the links of one block."""
    roots = ids.copy()
    while True:
        seen = np.where(linked, roots[None, :], np.iinfo(np.int64).max).min(axis=1)
        low = np.minimum(roots, seen)
        back = np.where(linked, low[:, None], np.iinfo(np.int64).max).min(axis=0)
        low = np.minimum(low, back)
        if (low == roots).all():
            return roots
        roots = low


def _first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first key of each pair's left list that the right list has as well; lists are tables of ``PROBES`` keys."""
    out = np.empty(len(left), dtype=np.int64)
    for low in range(0, len(left), 4096):
        mine, other = (x[low:low + 4096].reshape(-1, x.shape[1] // PROBES, PROBES) for x in (left, right))
        same = (mine[:, :, :, None] == other[:, :, None, :]).any(axis=3).reshape(len(mine), -1)
        at = same.argmax(axis=1)
        out[low:low + 4096] = left[np.arange(low, low + len(at)), at]
    return out


def _compare(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, one, two = int(key[2]), int(key[3]), int(key[4])
        rows = rows.sort_values("node", kind="stable")
        near, far = rows[rows["part"] == one], rows[rows["part"] == two]
        nothing = pd.DataFrame({"node": [], "links": [], "other": []})
        if near.empty or far.empty:
            return nothing
        a, b = np.stack(near["unit"].to_numpy()), np.stack(far["unit"].to_numpy())
        linked = a @ b.T >= threshold
        if one == two:
            linked = np.triu(linked, 1)
        if not linked.any():
            return nothing
        ids_a, ids_b = near["node"].to_numpy(), far["node"].to_numpy()
        keys_a, keys_b = (np.stack([np.frombuffer(k, dtype="<i8") for k in side["keys"]]) for side in (near, far))
        # most pairs share their own bucket of an earlier table, which is cheap to see
        for table in range(np.flatnonzero(keys_a[0] == bucket)[0] // PROBES):
            linked &= keys_a[:, table * PROBES, None] != keys_b[None, :, table * PROBES]
            if not linked.any():
                return nothing
        i, j = np.nonzero(linked)
        # tables are in order in a key list; the list of the smaller node is searched for the first shared key
        swap = ids_a[i] > ids_b[j]
        left = np.where(swap[:, None], keys_b[j], keys_a[i])
        right = np.where(swap[:, None], keys_a[i], keys_b[j])
        mine = _first_shared(left, right) == bucket
        i, j = i[mine], j[mine]
        linked = np.zeros_like(linked)
        linked[i, j] = True
        if one == two:
            linked[j, i] = True
        weight_a, weight_b = near["weight"].to_numpy(), far["weight"].to_numpy()
        counts_a = linked @ weight_b
        if one == two:
            roots = _local_roots(ids_a, linked)
            out = pd.DataFrame({"node": ids_a, "links": counts_a, "other": roots})
        else:
            ids = np.concatenate([ids_a, ids_b])
            square = np.zeros((len(ids), len(ids)), dtype=bool)
            square[:len(ids_a), len(ids_a):] = linked
            square[len(ids_a):, :len(ids_a)] = linked.T
            roots = _local_roots(ids, square)
            out = pd.DataFrame({"node": ids, "links": np.concatenate([counts_a, linked.T @ weight_a]), "other": roots})
        return out[(out["links"] > 0) | (out["other"] != out["node"])]
    return run


def _small_buckets(threshold: float):
    """Links within small buckets; rows come bucket by bucket."""
    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        where = rows.groupby(["label", "dims", "bucket"], sort=False).ngroup().to_numpy()
        node, weight, bucket = (rows[c].to_numpy() for c in ("node", "weight", "bucket"))
        found = []
        for _, same in rows.groupby("dims").indices.items():     # vectors of one length at a time
            at = np.sort(same)
            unit = np.stack(rows["unit"].to_numpy()[at])
            keys = np.stack([np.frombuffer(k, dtype="<i8") for k in rows["keys"].to_numpy()[at]])
            for step in range(1, min(SMALL, len(at))):
                i = np.flatnonzero(where[at[:-step]] == where[at[step:]])
                if not len(i):
                    break
                i = i[np.einsum("ij,ij->i", unit[i], unit[i + step]) >= threshold]
                j = i + step
                swap = (node[at[i]] > node[at[j]])[:, None]
                own = _first_shared(np.where(swap, keys[j], keys[i]), np.where(swap, keys[i], keys[j]))
                mine = own == bucket[at[i]]
                found.append(np.stack([at[i[mine]], at[j[mine]]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=int)
        least = np.minimum(node[a], node[b])
        return pd.DataFrame({"node": np.concatenate([node[a], node[b]]), "links": np.concatenate([weight[b], weight[a]]),
                             "other": np.concatenate([least, least])})

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = rows[["label", "dims", "bucket"]]
            last = (key == key.iloc[-1]).all(axis=1).to_numpy()
            held = rows[last]        # the last bucket may go on in the next batch
            yield linked(rows[~last].reset_index(drop=True))
        if held is not None:
            yield linked(held.reset_index(drop=True))
    return run


def near_equal(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    able = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    nodes = via_table(
        able.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = nodes.groupBy(F.size("vector").alias("dims")).count().collect()
    total = sum(r["count"] for r in sizes)
    labels = max(1, nodes.select("label").distinct().count())
    corner_count = 2 * max((r["dims"] for r in sizes), default=1)
    parts = max(1, math.ceil(math.log(max(2.0, total / labels * PROBES / LOAD)) / math.log(max(2, corner_count))))
    tables = {r["dims"]: table_count(r["dims"], threshold, parts) for r in sizes}
    hashed = via_table(
        nodes.mapInPandas(_hashed(tables, parts), _schema(nodes)), "vector-hashes")
    linked = via_table(_links(hashed, threshold), "vector-links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    return _reported(rows, nodes, counts, joined)


def _schema(nodes: DataFrame) -> str:
    return (f"node long, label {nodes.schema['label'].dataType.simpleString()}, weight long, dims int, "
            "unit array<double>, keys array<long>, packed binary")


def _links(hashed: DataFrame, threshold: float) -> DataFrame:
    """``node, links, other``: counts and spanning links found in each pair of blocks of a bucket."""
    group = ["label", "dims", "bucket"]
    spread = hashed.select("node", "label", "dims", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = spread.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    members = spread.join(sizes, group)
    carried = hashed.select("node", "weight", "unit", F.col("packed").alias("keys"))
    few = members.where(F.col("size") <= SMALL).select(*group, "node").join(carried, "node")
    small = few.repartition(*group).sortWithinPartitions(*group).mapInPandas(
        _small_buckets(threshold), "node long, links long, other long")
    split = (
        members.where(F.col("size") > SMALL)
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK_ROWS).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("part")).alias("one"), F.greatest(x, F.col("part")).alias("two")))
    paired = split.withColumn("pair", F.explode(others)).select(
        *group, F.col("pair.one").alias("one"), F.col("pair.two").alias("two"), "part", "node")
    large = paired.join(carried, "node").groupBy(*group, "one", "two").applyInPandas(
        _compare(threshold), "node long, links long, other long")
    return small.unionByName(large)


def _reported(rows: DataFrame, nodes: DataFrame, counts: DataFrame, joined: DataFrame) -> DataFrame:
    """Node results back on the rows: an equal vector is a link, and a component is named by its smallest id."""
    placed = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("smallest"))
    told = (
        placed.join(counts, "node", "left").join(smallest, "component")
        .select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "smallest")
    )
    shaped = rows.withColumn("able", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    return (
        shaped.alias("r").join(
            told.alias("t"), F.col("r.able") & (F.col("r.label") == F.col("t.label")) & (F.col("r.vector") == F.col("t.vector")), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("smallest", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
