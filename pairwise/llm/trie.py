"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards and cut into blocks of positions. A shard's block is turned on
its side: for every (position, turn) the set of its conversations is one bitmap. From the
conversations that entered the block at one node, a depth-first walk intersects the bitmap of a
node with those of the turns at the next position; each intersection is a child, its bits are
counted, and the conversations that end there are listed. A node of one conversation is a chain
and is written out without further intersections.

Nodes of different shards meet on their key, the XOR of 128-bit hashes of (position, turn) along
the path, so a block can start without the blocks before it: its entry keys are XORs of whole
blocks. A prefix that a third of all conversations share is one row per shard when it is merged.

Sums over subtrees take no pass over levels. A node belongs to its smallest member, so a
conversation owns the end of its own path. What a conversation owns is below every other node
that it passes; so a subtree has what its members own, less what its own member owns above the
node. The members' sums come from the same bitmaps.

Edge cases: null roles and texts are empty; rows without a ``conv_id`` belong to no conversation;
turns with one number are ordered by role and text; equal rows are turns of their own; a
conversation of any length is walked in blocks of ``BLOCK`` turns; an empty table gives no node,
not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise.llm.numbering import numbered
from pairwise.session import via_table

BLOCK = 256                 # positions walked in one task
SHARD_ROWS = 1 << 14        # rows that a shard has on average
ENDS = 16                   # ids that differ in these lower bits only are joined into one text first

STEPS = "conv_id long, pos long, s1 long, s2 long, bytes long, last boolean"
NODES = "a long, b long, pa long, pb long, depth long, n long, least long, bytes long, ends array<long>"
SUMS = "a long, b long, saved long, leaves long"


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, no, size, k1, k2, bytes``: turns numbered from 1, a 128-bit key and the bytes of their texts."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("turn"), "role", "text").alias("k2"),
            F.octet_length("text").cast("long").alias("bytes")]
    turn = F.col("turn").asc_nulls_first()
    placed = numbered(turns, ["conv_id"], [turn, "role", "text"], "no", "size",
                      ranges=[turn, F.substring("role", 1, 64), F.substring("text", 1, 64)], keep=["conv_id", *keys])
    return via_table(placed.withColumn("no", F.col("no") + 1), "trie-ordered")


def spliced(turns: DataFrame, family: int, shared: Column) -> DataFrame:
    """Conversations that begin with turns of another one; ``turns`` as ``ordered`` gives them.

    Conversation c gets the first h turns of the conversation c - c % ``family`` (all of them if it
    has fewer, none if there is no such), then its own turns after its first h. ``shared`` is h, an
    expression over ``conv_id``. Returns ``conv_id, no, k1, k2, bytes``; a conversation without
    turns has one row without ``no``.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    ids = via_table(turns.where("no = 1").select("conv_id", base.alias("base"), shared.alias("h"), "size"), "conv-ids")
    own = turns.withColumn("h", shared).where(F.col("no") > F.col("h"))
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    lent = ids.join(sizes, "base", "left").select("conv_id", "base", "h", "size",
                                                  F.least("h", F.coalesce("base_size", F.lit(0))).alias("lent"))
    lent = via_table(lent, "conv-lent")
    tail = own.drop("h", "size").join(lent.select("conv_id", "h", "lent"), "conv_id").select(
        "conv_id", (F.col("no") - F.col("h") + F.col("lent")).alias("no"), "k1", "k2", "bytes")
    most = ids.agg(F.max("h")).first()[0] or 0
    heads = turns.where(F.col("no") <= most).select(F.col("conv_id").alias("base"), "no", "k1", "k2", "bytes")
    head = lent.select("conv_id", "base", "lent").join(heads, "base").where(F.col("no") <= F.col("lent"))
    none = lent.where((F.col("lent") == 0) & (F.col("size") <= F.col("h"))).select("conv_id")
    for column, kind in [("no", "long"), ("k1", "long"), ("k2", "long"), ("bytes", "long")]:
        none = none.withColumn(column, F.lit(None).cast(kind))
    columns = ["conv_id", "no", "k1", "k2", "bytes"]
    return head.select(*columns).unionByName(tail.select(*columns)).unionByName(none)


def steps(turns: DataFrame) -> DataFrame:
    """Rows of the walk: position 0 for the root, then the turns, hashed together with their position.

    ``turns``: ``conv_id, no, k1, k2, bytes``, a conversation without turns as in ``spliced``.
    """
    turns = via_table(turns, "trie-turns")
    lengths = turns.groupBy("conv_id").agg(F.coalesce(F.max("no"), F.lit(0)).alias("length"))
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("s1"),
                           F.lit(0).cast("long").alias("s2"), F.lit(0).cast("long").alias("bytes"),
                           (F.col("length") == 0).alias("last"))
    rows = turns.where("no IS NOT NULL").join(lengths, "conv_id").select(
        "conv_id", F.col("no").alias("pos"), F.xxhash64("no", "k1", "k2").alias("s1"),
        F.xxhash64(F.lit("step"), "no", "k2", "k1").alias("s2"), "bytes", (F.col("no") == F.col("length")).alias("last"))
    return roots.unionByName(rows)


def sharded(walked: DataFrame) -> DataFrame:
    """Adds shard, block and the key with which a conversation enters the block."""
    walked = via_table(walked, "trie-steps")
    shards = walked.count() // SHARD_ROWS + 1
    walked = walked.withColumns({"shard": F.pmod(F.xxhash64(F.lit("shard"), "conv_id"), F.lit(shards)),
                                 "block": F.floor(F.col("pos") / BLOCK)})
    if (walked.agg(F.max("block")).first()[0] or 0) == 0:
        return walked.withColumns({"e1": F.lit(0).cast("long"), "e2": F.lit(0).cast("long")})
    totals = walked.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("t1"), F.bit_xor("s2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entries = totals.select("conv_id", "block", *[
        F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0)).alias(f"e{i}") for i in (1, 2)])
    return walked.join(entries, ["conv_id", "block"])


class _Bitmaps:
    """The (position, turn) index of one shard and block, and the walk over it."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["conv_id", "pos"], ignore_index=True)
        self.convs, self.start = np.unique(rows["conv_id"].to_numpy(), return_index=True)
        self.end = np.append(self.start[1:], len(rows))
        self.pos, self.bytes = rows["pos"].to_numpy(), rows["bytes"].to_numpy()
        self.s1, self.s2 = rows["s1"].to_numpy(), rows["s2"].to_numpy()
        self.last = rows["last"].to_numpy()
        self.first = int(self.pos.min())
        who = np.repeat(np.arange(len(self.convs)), self.end - self.start)
        pairs = np.stack([self.s1, self.s2, self.pos], axis=1)
        _, self.turn = np.unique(pairs, axis=0, return_inverse=True)
        self.turn = self.turn.ravel()
        self.posting = self._sets(self.turn, who)
        self.present = self._sets(self.pos - self.first, who)
        self.ended = self._sets((self.pos - self.first)[self.last], who[self.last])
        entry = np.stack([rows["e1"].to_numpy(), rows["e2"].to_numpy()], axis=1)[self.start]
        self.entries, into = np.unique(entry, axis=0, return_inverse=True)
        self.entered = self._sets(into.ravel(), np.arange(len(self.convs)))

    @staticmethod
    def _sets(keys: np.ndarray, members: np.ndarray) -> dict[int, int]:
        """One bitmap of members for every key."""
        found: dict[int, int] = {}
        for key, member in zip(keys.tolist(), members.tolist(), strict=True):
            found[key] = found.get(key, 0) | (1 << member)
        return found

    def walk(self) -> Iterator[tuple]:
        """Nodes with several members: ``row, key, parent key, members, ends``; chains of one member:
        ``rows, key, parent key, member``. Depth first, from every entry."""
        stack = [(members, self.first, *map(int, self.entries[key])) for key, members in self.entered.items()]
        while stack:
            members, pos, a, b = stack.pop()
            rest = members & self.present.get(pos - self.first, 0)
            while rest:
                who = (rest & -rest).bit_length() - 1
                row = int(self.start[who]) + pos - self.first
                child = rest & self.posting[int(self.turn[row])]
                rest ^= child
                key = (a ^ int(self.s1[row]), b ^ int(self.s2[row]))
                if child & (child - 1):
                    yield row, key, (a, b), child, child & self.ended.get(pos - self.first, 0)
                    stack.append((child, pos + 1, *key))
                else:
                    yield slice(row, int(self.end[who])), key, (a, b), who, None


def members_of(bitmap: int) -> np.ndarray:
    raw = np.frombuffer(bitmap.to_bytes(bitmap.bit_length() // 8 + 1, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _chain(index: _Bitmaps, rows: slice, parent: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Keys along a chain, the parent's first."""
    return tuple(
        np.bitwise_xor.accumulate(np.concatenate([np.array([start], dtype=np.int64), steps[rows]]))
        for start, steps in zip(parent, (index.s1, index.s2), strict=True))


def _local_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a shard's block: keys, members counted, the smallest member, who ends there."""
    index = _Bitmaps(rows)
    parts: list[list] = [[] for _ in range(9)]
    for at, key, parent, members, ends in index.walk():
        if isinstance(at, slice):
            a, b = _chain(index, at, parent)
            n = len(a) - 1
            conv = int(index.convs[members])
            ended = [None] * n
            if index.last[at.stop - 1]:
                ended[-1] = [conv]
            new = [a[1:], b[1:], a[:-1], b[:-1], index.pos[at], np.ones(n, int), np.full(n, conv), index.bytes[at], ended]
        else:
            least = int(index.convs[(members & -members).bit_length() - 1])
            new = [[key[0]], [key[1]], [parent[0]], [parent[1]], [index.pos[at]], [members.bit_count()], [least],
                   [index.bytes[at]], [index.convs[members_of(ends)].tolist() if ends else None]]
        for part, values in zip(parts, new, strict=True):
            part.extend(values)
    return pd.DataFrame(dict(zip(["a", "b", "pa", "pb", "depth", "n", "least", "bytes", "ends"], parts, strict=True)))


def _local_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """What the members of every node own, summed over each node's bitmap."""
    index = _Bitmaps(rows)
    rows = rows.sort_values(["conv_id", "pos"], ignore_index=True)
    owned = [rows[c].to_numpy()[index.start] for c in ("saved", "leaves")]
    parts: list[list] = [[] for _ in range(4)]
    for at, key, parent, members, _ in index.walk():
        if isinstance(at, slice):
            a, b = _chain(index, at, parent)
            new = [a[1:], b[1:], *[np.full(len(a) - 1, w[members]) for w in owned]]
        else:
            who = members_of(members)
            new = [[key[0]], [key[1]], *[[w[who].sum()] for w in owned]]
        for part, values in zip(parts, new, strict=True):
            part.extend(values)
    return pd.DataFrame(dict(zip(["a", "b", "saved", "leaves"], parts, strict=True)))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of ids, sorted by node and block of ids, into one digest per node; holds one text at a time."""
    key, digest = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(batch["a"].tolist(), batch["b"].tolist(), batch["ids"], strict=True):
            if key != (a, b):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(done, columns=["a", "b", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["a", "b", "ends_sha256"])


def ends_digest(local: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the ascending ids that end at a node.

    Ids are first joined in blocks of 2^``ENDS`` neighbouring numbers, which many tasks do; only
    finished texts of a node meet in one task, and stream through it.
    """
    ids = local.where("ends IS NOT NULL").select("a", "b", F.explode("ends").alias("id"))
    texts = ids.groupBy("a", "b", F.shiftright("id", ENDS).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return (texts.repartition("a", "b").sortWithinPartitions("a", "b", "range")
            .mapInPandas(_hashed, "a long, b long, ends_sha256 string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (``conv_id, no, k1, k2, bytes``).

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the node's ``last_bytes``.
    """
    rows = via_table(sharded(steps(turns)), "trie-shards")
    local = via_table(rows.groupBy("shard", "block").applyInPandas(_local_nodes, NODES), "trie-local")
    nodes = via_table(local.groupBy("a", "b").agg(
        F.min("least").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"),
        F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"),
                         (F.col("depth") + 1).alias("depth"))
    full = via_table(
        nodes.join(children, ["a", "b"], "left").join(above, ["pa", "pb", "depth"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumns({"own_saved": (F.col("n_convs") - 1) * F.col("bytes"),
                      "own_leaves": (F.col("n_children") == 0).cast("long")}), "trie-full")
    owned = full.groupBy("conv_id").agg(F.sum("own_saved").alias("saved"), F.sum("own_leaves").alias("leaves"))
    zero = F.lit(0).cast("long")
    weighed = rows.join(owned, "conv_id", "left").withColumns(
        {"saved": F.coalesce("saved", zero), "leaves": F.coalesce("leaves", zero)})
    sums = (weighed.groupBy("shard", "block").applyInPandas(_local_sums, SUMS)
            .groupBy("a", "b").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    higher = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        full.withColumns({f"up_{c}": F.coalesce(F.sum(f"own_{c}").over(higher), zero) for c in ("saved", "leaves")})
        .join(sums, ["a", "b"]).join(ends_digest(local), ["a", "b"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                (F.col("leaves") - F.col("up_leaves")).alias("n_leaves"),
                (F.col("saved") - F.col("up_saved")).alias("saved_tokens"),
                F.coalesce("ends_sha256", none).alias("ends_sha256"), F.col("bytes").alias("last_bytes")))
