"""Positions inside groups of any size, from range partitions.

Rows are range-sorted by group and order, so a group with a third of all rows lies in many
partitions. A row's position is its place in its partition plus what earlier partitions hold of
the same group. Only one row per group and partition is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise.session import via_table


def numbered(df: DataFrame, groups: list[str], order: list[Column | str], position: str, size: str,
             ranges: list[Column | str] | None = None, keep: list[Column | str] | None = None) -> DataFrame:
    """Adds the 0-based ``position`` of a row in its group and the ``size`` of the group.

    Null group values are a group of their own. Rows equal in every key are spread by where they
    were read, and get positions in that order. ``ranges`` replaces ``order`` where rows are dealt
    to partitions: keys no finer than ``order``, short ones for long texts. Only ``keep`` is
    written (all columns without it).
    """
    first = [F.col(g).asc_nulls_first() for g in groups]
    sort = [*first, *order, "_tie"]
    dealt = [*first, *ranges] if ranges else sort
    table = via_table(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*dealt).sortWithinPartitions(*sort)
        .select(*(keep or df.columns), F.monotonically_increasing_id().alias("_at")), "numbered")
    part = F.shiftright("_at", 33)  # the upper bits of the id are the partition
    pieces = table.groupBy(*groups, part.alias("_part")).agg(
        F.count("*").alias("_count"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], "_part",
        (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_count").over(whole).alias(size))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return (
        table.join(starts, [*same, part == F.col("_part")])
        .withColumn(position, F.col("_at") + F.col("_shift"))
        .drop("_at", "_shift", "_part", *[f"_g_{g}" for g in groups]))
