"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its weighted set of five-word shingles (a shingle's weight is its count). Every
shingle sends arrivals of a Poisson process with its weight as rate into ``BANDS * ROWS``
registers; a register keeps its earliest arrival. Rounds of arrivals end early for a document once
no open shingle can still beat its latest register. Two documents agree in a register with
probability equal to their probability Jaccard similarity, so documents that agree in all
registers of a band are candidates, and candidates are verified on the exact similarity.

Pairs within a bucket are not enumerated. Equal texts are one node. Each node is compared with
the first node of one of its buckets, then with the first nodes of the other buckets where that
would join two components. What is left are buckets that still hold several components. The
nodes of such buckets form families, and the nodes outside a family's largest component are
compared with the whole family, block against block: a matrix product over the shingles of two
blocks bounds all similarities, and pairs that may reach the threshold are measured. Only pairs
within one component are left out, as they cannot change it.

Edge cases: texts are lower-cased and cut at white space; a text of one to four words is one
shingle; null texts and texts without words stay alone; rows equal in text are one class, also
with equal ids; a null ``doc_id`` never names a class unless the class has no other id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwise.llm.components import components
from pairwise.session import via_table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 6         # a pair at 0.8 shares no band once in 5,000
LEFT_ROWS, RIGHT_ROWS = 256, 512  # of a block of nodes outside their family's core, and of the family
COLUMNS = 8192              # shingles of a pair of blocks that are multiplied at a time
PIECE = 1 << 18             # characters worked on at a time

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts, their counts, and beside each the place of its text."""
    pieces = [b" " + " ".join(t.lower().split()).encode("utf-8", "replace") + b" " for t in texts]
    chars = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    blank = chars == 32
    edge = np.flatnonzero(np.diff(blank.astype(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    powers = np.cumprod(np.full(len(chars), _GOLD, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
    back = np.cumprod(np.full(len(chars), _BACK, dtype=np.uint64))
    words = _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    of = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])[starts]
    size = len(words) - SHINGLE + 1
    ids, places = [], []
    if size > 0:
        joined = np.zeros(size, dtype=np.uint64)
        for step in range(SHINGLE):
            joined = joined * _GOLD + words[step:size + step]
        whole = np.flatnonzero(of[:size] == of[SHINGLE - 1:])
        ids.append(_mix(joined[whole]))
        places.append(of[whole])
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    lengths = np.diff(np.concatenate([first, [len(of)]]))
    for at, length in zip(first[lengths < SHINGLE], lengths[lengths < SHINGLE], strict=True):
        short = np.array([length], dtype=np.uint64)
        for word in words[at:at + length]:
            short = _mix(short * _GOLD + word)
        ids.append(short)
        places.append(of[at:at + 1])
    ids, places = np.concatenate(ids), np.concatenate(places)
    # texts are few at a time: their number and the upper bits of the hash sort in one key
    order = np.argsort((places.astype(np.uint64) << np.uint64(44)) | (ids >> np.uint64(20)), kind="stable")
    ids, places = ids[order], places[order]
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])]))
    return ids[new], np.diff(np.concatenate([new, [len(ids)]])), places[new]


def signatures(ids: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """The shingle that each register of each text keeps: ``texts`` rows of ``BANDS * ROWS`` hashes."""
    registers = BANDS * ROWS
    times = np.full((texts, registers), np.inf)
    kept = np.zeros((texts, registers), dtype=np.uint64)
    now = np.zeros(len(ids))
    ids, weights, owner, turn = ids.copy(), weights.astype(np.float64), owner.copy(), 0
    flat_times, flat_kept = times.reshape(-1), kept.reshape(-1)
    with np.errstate(over="ignore"):
        while len(ids):
            # few open shingles send several arrivals a round; arrivals nobody waits for change nothing
            ahead = np.arange(turn, turn + min(64, max(1, 8192 // len(ids))), dtype=np.uint64)
            draw = _mix(ids[:, None] + (np.uint64(2) * ahead + np.uint64(1)) * _GOLD)
            gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53) / weights[:, None]
            when = now[:, None] + np.cumsum(gaps, axis=1)
            which = _mix(ids[:, None] + (np.uint64(2) * ahead + np.uint64(2)) * _GOLD) % np.uint64(registers)
            slot = (owner[:, None] * registers + which.astype(np.int64)).ravel()
            np.minimum.at(flat_times, slot, when.ravel())
            won = np.flatnonzero(flat_times[slot] == when.ravel())
            flat_kept[slot[won]] = ids[won // len(ahead)]
            now, turn = when[:, -1], turn + len(ahead)
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            latest = times[owner[new]].max(axis=1)
            open_ = now < latest[np.cumsum(new) - 1]
            ids, weights, owner, now = ids[open_], weights[open_], owner[open_], now[open_]
    return kept


def band_keys(kept: np.ndarray) -> np.ndarray:
    out = np.zeros((len(kept), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(kept), band, dtype=np.uint64)
            for row in range(ROWS):
                key = _mix(key * _GOLD + kept[:, band * ROWS + row])
            out[:, band] = key
    return out.view(np.int64)


def _batches(texts: pd.Series) -> Iterator[tuple[list[int], list[str]]]:
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        rows.append(row)
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(texts: pd.Series) -> pd.Series:
    out: list = [None] * len(texts)
    for rows, held in _batches(texts):
        ids, weights, owner = shingles(held)
        keys = band_keys(signatures(ids, weights, owner, len(held)))
        for place in np.unique(owner):
            out[rows[place]] = keys[place]
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())]))
def _shingle_set(texts: pd.Series) -> pd.DataFrame:
    ids_out, counts_out = [b""] * len(texts), [b""] * len(texts)
    for rows, held in _batches(texts):
        ids, weights, owner = shingles(held)
        ends = np.searchsorted(owner, np.arange(len(held) + 1))
        for place, row in enumerate(rows):
            own = slice(ends[place], ends[place + 1])
            ids_out[row] = ids[own].tobytes()
            if (weights[own] > 1).any():
                counts_out[row] = weights[own].astype("<u4").tobytes()
    return pd.DataFrame({"ids": ids_out, "counts": counts_out})


def probability_jaccard(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray) -> float:
    """Sum over shared elements of 1 / sum of max(a_j / a_i, b_j / b_i); elements sorted by id.

    With r = a_i / b_i the inner sum is (1 / a_i) sum of max(a_j, r b_j), the same for all shared
    elements of one ratio, and there are few ratios.
    """
    at = np.searchsorted(ids_b, ids_a)
    shared = np.zeros(len(ids_a), dtype=bool)
    inside = at < len(ids_b)
    shared[inside] = ids_b[at[inside]] == ids_a[inside]
    x, y = a[shared].astype(np.float64), b[at[shared]].astype(np.float64)
    if not len(x):
        return 0.0
    alone_a, alone_b = float(a.sum() - x.sum()), float(b.sum() - y.sum())
    total = 0.0
    ratios, which = np.unique(x / y, return_inverse=True)
    weight = np.bincount(which, weights=x)
    for ratio, share in zip(ratios, weight, strict=True):
        total += share / (alone_a + ratio * alone_b + np.maximum(x, ratio * y).sum())
    return total


def _pair_similarity(a: dict, b: dict) -> float:
    def unpack(x: dict) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(x["ids"], dtype=np.uint64)
        return own, np.frombuffer(x["counts"], dtype="<u4") if x["counts"] else np.ones(len(own), dtype=np.uint32)

    return probability_jaccard(*unpack(a), *unpack(b))


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    left, right = a.to_dict("records"), b.to_dict("records")
    return pd.Series([_pair_similarity(x, y) for x, y in zip(left, right, strict=True)], dtype=float)


class _Graph:
    """Nodes that share a bucket, the links verified so far and the components they make."""

    def __init__(self, sets: DataFrame, threshold: float):
        self.sets, self.threshold = sets, threshold
        self.links: DataFrame | None = None
        self.parts: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> None:
        """Measures pairs ``a, b`` and takes those above the threshold into the links."""
        left = self.sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        right = self.sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        measured = pairs.join(left, "a").join(right, "b")
        self.take(measured.where(_similarity("set_a", "set_b") >= self.threshold).select("a", "b"))

    def take(self, links: DataFrame) -> None:
        found = via_table(links, "near-links")
        self.links = found if self.links is None else self.links.union(found)
        self.parts = via_table(components(self.links), "near-components")

    def placed(self, members: DataFrame) -> DataFrame:
        """Adds ``part``: the component of each member."""
        return members.join(self.parts, "node", "left").select(
            members["*"], F.coalesce("component", "node").alias("part"))


def _bucketed(spread: DataFrame) -> DataFrame:
    """``key, node, leader`` of the buckets with several nodes; the leader is the smallest node."""
    groups = (spread.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
              .where("leader <> last").drop("last"))
    return spread.join(groups, "key").select("key", "node", "leader")


def _leaders_across(graph: _Graph, members: DataFrame) -> DataFrame:
    """Pairs of a node and the leader of one of its buckets that lie in different components."""
    pairs = members.where("node <> leader").select("node", "leader").distinct()
    own = graph.placed(pairs)
    other = graph.parts.select(F.col("node").alias("leader"), F.col("component").alias("led"))
    return (own.join(other, "leader", "left").where(F.col("part") != F.coalesce("led", "leader"))
            .select(F.col("node").alias("a"), F.col("leader").alias("b")))


def _families(graph: _Graph, members: DataFrame) -> DataFrame:
    """``node, part, family, outside``: the nodes of buckets that hold several components.

    A family is what such buckets join; its largest component is its core, and ``outside`` marks
    the nodes that are not in it.
    """
    placed = graph.placed(members)
    kinds = (placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
             .where("low <> high").select("key"))
    mixed = via_table(placed.join(kinds, "key").select("node", "leader", "part").distinct(), "near-mixed")
    joined = components(mixed.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    nodes = mixed.select("node", "part").distinct().join(
        joined.withColumnRenamed("component", "family"), "node")
    sizes = nodes.groupBy("family", "part").agg(F.count("*").alias("n"))
    core = sizes.groupBy("family").agg(F.max_by("part", F.struct("n", "part")).alias("core"))
    return nodes.join(core, "family").select("node", "part", "family", (F.col("part") != F.col("core")).alias("outside"))


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all rows end to end, their shares of the row's weight, and the row of each."""
    ids = [np.frombuffer(x["ids"], dtype=np.uint64) for x in rows["set"]]
    counts = [np.frombuffer(x["counts"], dtype="<u4").astype(np.float64) if x["counts"] else np.ones(len(k))
              for x, k in zip(rows["set"], ids, strict=True)]
    shares = [c / max(c.sum(), 1.0) for c in counts]
    return np.concatenate(ids), np.concatenate(shares), np.repeat(np.arange(len(ids)), [len(k) for k in ids])


def _overlap_bounds(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """An upper bound of the similarity of every row of ``left`` with every row of ``right``.

    An element adds at most its share of either side, so the smaller of the two sums of shares over
    shared elements bounds the similarity. Where no shingle repeats, the counts give it exactly.
    """
    ids_a, share_a, row_a = _unpacked(left)
    ids_b, share_b, row_b = _unpacked(right)
    both = np.intersect1d(ids_a, ids_b)
    total_a, total_b = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    keep_a, keep_b = np.isin(ids_a, both), np.isin(ids_b, both)
    at_a, at_b = np.searchsorted(both, ids_a[keep_a]), np.searchsorted(both, ids_b[keep_b])
    share_a, row_a, share_b, row_b = share_a[keep_a], row_a[keep_a], share_b[keep_b], row_b[keep_b]
    for low in range(0, len(both), COLUMNS):
        in_a, in_b = (at_a >= low) & (at_a < low + COLUMNS), (at_b >= low) & (at_b < low + COLUMNS)
        width = min(COLUMNS, len(both) - low)
        weight_a, weight_b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        weight_a[row_a[in_a], at_a[in_a] - low] = share_a[in_a]
        weight_b[row_b[in_b], at_b[in_b] - low] = share_b[in_b]
        total_a += weight_a @ (weight_b > 0).T.astype(np.float32)
        total_b += (weight_a > 0).astype(np.float32) @ weight_b.T
    size_a, size_b = (np.array([len(x["ids"]) // 8 for x in rows["set"]], np.float32) for rows in (left, right))
    plain_a, plain_b = (np.array([not x["counts"] for x in rows["set"]]) for rows in (left, right))
    shared = total_a * size_a[:, None]
    exact = shared / np.maximum(size_a[:, None] + size_b - shared, 1)
    return np.where(plain_a[:, None] & plain_b, exact, np.minimum(total_a, total_b))


def _met(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["left"]], rows[~rows["left"]]
        found = []
        if len(left) and len(right):
            part_a, part_b = left["part"].to_numpy(), right["part"].to_numpy()
            close = _overlap_bounds(left, right) >= threshold - 1e-4
            sets_a, sets_b = left["set"].tolist(), right["set"].tolist()
            for i in range(len(left)):
                done = {part_a[i]}
                for j in np.flatnonzero(close[i]):
                    # one link to a component is enough
                    if part_b[j] not in done and _pair_similarity(sets_a[i], sets_b[j]) >= threshold:
                        done.add(part_b[j])
                        found.append((left["node"].iat[i], right["node"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"])
    return run


def _links_outside(graph: _Graph, families: DataFrame) -> DataFrame:
    """Links ``a, b`` between components of a family: each node outside the core meets the whole family.

    Nodes outside and whole families are dealt to blocks, and each pair of blocks is a task of its
    own, so neither has to fit anywhere; at most one link a node and component leaves a task.
    """
    sized = families.groupBy("family").agg(
        F.ceil(F.count("*") / RIGHT_ROWS).alias("rights"),
        F.ceil(F.sum(F.col("outside").cast("int")) / LEFT_ROWS).alias("lefts"))
    dealt = families.join(sized, "family")
    places = F.xxhash64("node")
    left = dealt.where("outside").select(
        "node", "part", "family", F.lit(True).alias("left"), F.pmod(places, F.col("lefts")).alias("lb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("rb"))
    right = dealt.select(
        "node", "part", "family", F.lit(False).alias("left"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("lb"), F.pmod(places, F.col("rights")).alias("rb"))
    rows = left.unionByName(right).join(graph.sets, "node")
    return rows.groupBy("family", "lb", "rb").applyInPandas(_met(graph.threshold), "a long, b long")


def linked_texts(sets: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``node, component`` of the nodes that have a verified link."""
    graph = _Graph(sets, threshold)
    counted = members.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    best = counted.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("leader"))
    graph.verify(best.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    graph.verify(_leaders_across(graph, members))
    graph.take(_links_outside(graph, via_table(_families(graph, members), "near-families")))
    return graph.parts


def _text_id(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_id")


def _classes(stored: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and the distinct texts with what they reach.

    ``stored``: ``place, doc_id, text``, written with a number for each row, so that rows are told
    apart whatever their ids are. Of the texts: ``first``, the row that stands for a text
    (``unnamed, doc_id, text_id, place``; a null id comes last), and ``component``.
    """
    named = stored.select("place", "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"), "text")
    signed = via_table(named.select("place", "doc_id", "text_id", _bands("text").alias("keys")), "near-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_id", "place")
    # a distinct text is a node; its number is half as long as its hash
    texts = via_table(
        signed.where(F.col("keys").isNotNull()).groupBy("text_id").agg(F.min(order).alias("first"))
        .select("first", F.col("first.place").alias("place"), F.monotonically_increasing_id().alias("node")), "near-texts")
    firsts = texts.select("place", "node")
    signs = signed.select("place", "keys").join(firsts, "place").select("node", "keys")
    members = via_table(_bucketed(signs.select("node", F.explode("keys").alias("key"))), "near-buckets")
    wanted = members.select("node").distinct().join(firsts, "node")
    sets = via_table(
        named.select("place", "text").join(wanted, "place").select("node", _shingle_set("text").alias("set")),
        "near-shingles")
    parts = linked_texts(sets, members, threshold)
    return signed, texts.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, class_id, kept``.

    ``class_id`` is the smallest ``doc_id`` among the documents that the document reaches over
    links of the threshold and more, itself included; ``kept`` marks the document of that id.
    """
    stored = via_table(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")), "near-documents")
    signed, grouped = _classes(stored, threshold)
    smallest = grouped.groupBy("component").agg(F.min("first").alias("least"))
    classes = grouped.join(smallest, "component").select(
        F.col("first.text_id").alias("text_id"), F.col("least.doc_id").alias("class_id"))
    return (
        signed.select("doc_id", "text_id").join(classes, "text_id", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near duplicates, and all rows without words.

    The row of the smallest id stays, a null id comes last; ids need not be there or be unique, as
    rows are told apart by the place at which they were written.
    """
    stored = via_table(
        docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "near-documents")
    signed, grouped = _classes(
        stored.select("place", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), threshold)
    firsts = grouped.groupBy("component").agg(F.min("first").alias("first")).select("first.place")
    staying = firsts.union(signed.where(F.col("keys").isNull()).select("place"))
    return stored.join(staying, "place", "left_semi").select("row.*")


def similarity(a: Column, b: Column) -> Column:
    """Probability Jaccard similarity of two text columns."""
    return _similarity(_shingle_set(a), _shingle_set(b))
