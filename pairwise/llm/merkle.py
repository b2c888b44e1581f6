"""Merkle manifest of a dataset by slot pivots: roots, inclusion proofs and checks of rows.

Rows are the leaves of one tree per group; the roots of the groups, in order of group, are the
leaves of the tree above them. Every ``FANOUT`` consecutive nodes make a parent: conditional
aggregates spread a parent's children into ``FANOUT`` columns, the hash of the concatenated
columns is the parent, and the columns without a child's own slot are its siblings. A level is
one aggregation on (tree, parent number), so trees of any size spread over the cluster, and a
level is a sixteenth of the one below.

Proofs come down the same tables: a parent hands its children the siblings of the levels above,
so the long texts are joined once per sixteen rows and multiplied only in the last projection,
after the last shuffle.

Edge cases: a null column is hashed as ``-``, an empty one as ``0:``; groups ascend by UTF-8
bytes, null first; in a group null ids come first, and rows with one id ascend by leaf; equal
rows are leaves of their own with their own proofs; a group of one row has its leaf as root; an
empty table gives an empty result. Other columns are ignored unless listed, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwise.llm.numbering import numbered
from pairwise.session import via_table

FANOUT = 16
SLOTS = [f"slot{i}" for i in range(FANOUT)]
PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pivot tables from the leaves up, and the top of every tree (``tree, digest``).

    ``nodes``: ``tree, no, size, digest, load``, numbers from 0 in each tree of ``size`` nodes.
    ``load`` is carried into the row of the leaf's parent, with its slot (``loads``).
    """
    most = nodes.agg(F.max("size")).first()[0] or 0
    level, tables, tops = nodes, [], [nodes.where("size = 1").select("tree", "digest")]
    while most > 1:
        slot = (F.col("no") % FANOUT).cast("int")
        spread = [F.max(F.when(F.col("slot") == i, F.col("digest"))).alias(s) for i, s in enumerate(SLOTS)]
        if not tables:
            spread.append(F.collect_list(F.struct("slot", "load")).alias("loads"))
        parents = via_table(
            level.where("size > 1").withColumn("slot", slot)
            .groupBy("tree", F.floor(F.col("no") / FANOUT).alias("no"), F.ceil(F.col("size") / FANOUT).alias("size"))
            .agg(*spread), f"merkle-{len(tables)}")
        tables.append(parents)
        level = parents.select("tree", "no", "size", F.sha2(F.concat_ws("", *SLOTS), 256).alias("digest"))
        tops.append(level.where("size = 1").select("tree", "digest"))
        most = -(-most // FANOUT)
    return tables, reduce(DataFrame.unionByName, tops)


def _step(slot: Column) -> Column:
    """The siblings of a slot: every other column, in two texts."""
    def others(side) -> Column:
        return F.concat_ws("", *[F.when(side(F.lit(i), slot), F.col(s)) for i, s in enumerate(SLOTS)])

    return F.struct(others(lambda i, own: i < own).alias("before"), others(lambda i, own: i > own).alias("after"))


def descend(tables: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """``tree, load, path`` of every leaf: the siblings of each level, from the leaf to its top."""
    alone = nodes.where("size = 1").select("tree", "load", F.array().cast(PATH).alias("path"))
    above = None
    for depth in range(len(tables) - 1, -1, -1):
        parents = tables[depth]
        if above is None:
            placed = parents.withColumn("upper", F.array().cast(PATH))
        else:
            known = above.select(F.col("tree").alias("_tree"), F.col("no").alias("_no"), F.col("path").alias("upper"))
            # the tops of smaller trees have no parents
            placed = parents.join(
                known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("no") == F.col("_no")), "left"
            ).withColumn("upper", F.coalesce("upper", F.array().cast(PATH)))
        path = F.concat(F.array(_step(F.col("slot"))), "upper").cast(PATH).alias("path")
        if depth:
            filled = F.filter(F.array(*[F.when(F.col(s).isNotNull(), F.lit(i)) for i, s in enumerate(SLOTS)]),
                              lambda x: x.isNotNull())
            above = placed.withColumn("slot", F.explode(filled)).select(
                "tree", (F.col("no") * FANOUT + F.col("slot")).alias("no"), path)
        else:
            leaves = placed.withColumn("own", F.explode("loads")).withColumn("slot", F.col("own.slot"))
            return leaves.select("tree", F.col("own.load").alias("load"), path).unionByName(alone)
    return alone


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(leaves: DataFrame) -> DataFrame:
    """``tree, load, leaf, top, root, path`` of every leaf.

    ``leaves``: ``tree`` (the group, may be null), ``key`` (the order in it, nulls first), ``leaf``
    (its digest) and ``load`` (any column to carry along). ``path`` leads from the leaf to ``root``.
    """
    nodes = via_table(
        numbered(leaves, ["tree"], [F.col("key").asc_nulls_first(), "leaf"], "no", "size")
        .select("tree", "no", "size", F.col("leaf").alias("digest"), F.struct("leaf", "load").alias("load")),
        "merkle-leaves")
    tables, tops = climb(nodes)
    tops = tops.select(F.lit(0).alias("all"), F.col("tree").alias("group"), "digest")
    crown = via_table(
        numbered(tops, ["all"], [F.col("group").asc_nulls_first()], "no", "size")
        .select(F.col("all").alias("tree"), "no", "size", "digest", F.struct("group", "digest").alias("load")),
        "merkle-tops")
    upper_tables, root = climb(crown)
    upper = descend(upper_tables, crown).select(
        F.col("load.group").alias("group"), F.col("load.digest").alias("top"), F.col("path").alias("upper"))
    upper = upper.crossJoin(root.select(F.col("digest").alias("root")))  # one row
    low = descend(tables, nodes)
    return (
        low.join(upper, F.col("tree").eqNullSafe(F.col("group")))
        .select("tree", F.col("load.load").alias("load"), F.col("load.leaf").alias("leaf"), "top", "root",
                F.concat("path", "upper").alias("path")))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def verify_documents(docs: DataFrame, seen: Column) -> DataFrame:
    """Manifest of ``docs`` and the check of what was ``seen`` of each text against it.

    Returns ``doc_id, leaf, subroot, root, path, folded_root, verified``: the digests are those of
    ``docs``; ``folded_root`` follows the leaf made with ``seen`` along the original siblings.
    """
    def digest(text: Column) -> Column:
        return leaf_digest(*[F.col(c) for c in COLUMNS[:-1]], text)

    changed = F.when(~seen.eqNullSafe(F.col("text")), digest(seen))
    found = manifest(docs.select(
        F.col("source").alias("tree"), F.col("doc_id").alias("key"), digest(F.col("text")).alias("leaf"),
        F.struct("doc_id", changed.alias("changed")).alias("load")))
    return found.select(
        F.col("load.doc_id").alias("doc_id"), "leaf", F.col("top").alias("subroot"), "root", "path",
        folded(F.coalesce("load.changed", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
