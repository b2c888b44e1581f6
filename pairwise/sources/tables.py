"""Parquet tables in, Parquet tables out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwise.session import via_table


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save_table(df: DataFrame, path: str, *partition_by: str) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def save_bucketed(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """Stores a table in ``buckets`` by ``keys``, sorted inside, and returns it.

    Windows, groups and joins of such tables on the same keys read bucket by bucket and need no
    shuffle. Take buckets so that one fits an executor's memory a few times over. The table is
    external, under a name of its own in the session's catalog.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys)     # one file per bucket
    placed.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished table is at ``path`` on whatever file system it names."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


def load_or_build(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """Reuse the table at ``path`` unless it is missing or a rebuild is asked for."""
    if rebuild or not table_exists(spark, path):
        save_table(build(), path)
    return load_table(spark, path)


def fingerprints(df: DataFrame, parts: list[str]) -> DataFrame:
    """One row per part: ``_rows`` and ``_print``, which change with any value, row or column of the part."""
    columns = sorted(df.columns)
    each = F.xxhash64(F.lit(",".join(columns)), *[F.col(c).isNull() for c in columns], *columns)
    # a sum of numbers below 2^62 in decimals does not depend on the order of the rows
    return df.groupBy(*parts).agg(F.count("*").alias("_rows"), F.sum(F.shiftright(each, 2).cast("decimal(38,0)")).alias("_print"))


def load_or_build_parts(
    spark: SparkSession, path: str, inputs: DataFrame, parts: list[str], build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """A cache of ``build(inputs)`` under ``path`` that knows what it was built from.

    ``build`` must treat the ``parts`` of its input apart and keep their columns. A manifest holds
    the fingerprint of every part; only parts that are new or changed are built again, into a version
    of their own, and parts that are gone leave the result. ``_version`` tells which run built a row.
    Inputs are read twice at most; a run that is cut short leaves the earlier versions valid.
    """
    prints = fingerprints(inputs, parts)
    latest, known = -1, None
    while table_exists(spark, f"{path}/manifest-{latest + 1}"):
        latest += 1
    if latest >= 0:
        known = load_table(spark, f"{path}/manifest-{latest}")
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*parts, "_rows", "_print"]]
    if known is None:
        marked = prints.withColumn("_version", F.lit(0))
    else:
        marked = prints.alias("n").join(known.alias("o"), same, "left").select(
            "n.*", F.coalesce("o._version", F.lit(latest + 1)).alias("_version"))
    version = latest + 1
    marked = via_table(marked, "fingerprints")
    stale = marked.filter(F.col("_version") == version)
    changed = not stale.isEmpty()
    if changed:
        inside = [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in parts]
        fresh = inputs.alias("i").join(stale.alias("s"), inside, "left_semi")
        save_table(build(fresh), f"{path}/version={version}")
    if changed or known is None or known.count() != marked.count():
        save_table(marked, f"{path}/manifest-{version}")
    whole = None
    for (number,) in marked.select("_version").distinct().orderBy("_version").collect():     # a row per version in use
        part = load_table(spark, f"{path}/version={number}").withColumn("_version", F.lit(number))
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        return build(inputs).withColumn("_version", F.lit(version))
    now = [F.col(f"w.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*parts, "_version"]]
    return whole.alias("w").join(marked.alias("m"), now, "left_semi")

