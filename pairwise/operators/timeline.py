"""Running totals along timelines that never gather a key.

A timeline is the rows of one key in order. Rows are summed per day first, so that one row per
key and day remains; the day totals are accumulated, and the rows of each day add their own
part. The work on a key is spread over its days, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame, source: DataFrame, keys: list[str], day: str, order: list[str],
    sums: dict[str, Column], peaks: dict[str, Column] | None = None,
    latest: dict[str, tuple[str, Column]] | None = None,
    early: dict[str, tuple[Column, int]] | None = None,
) -> DataFrame:
    """Add exclusive running sums and maxima to ``df``.

    Days are summed from ``source``: the rows of ``df`` before any step added columns to them, so
    that a plan of many steps reads its input once more for each and does not double.
    ``latest`` maps a name to a name in ``sums`` and a condition: what that sum is just after the
    latest row that meets it, if each such row adds one. ``early`` maps a name to a value and a
    number of days: its sum over the days that are further back.
    """
    peaks, latest, early = peaks or {}, latest or {}, early or {}
    same_day, earlier = _before(keys + [day], order), _before(keys, [day])
    for name, (count, condition) in latest.items():
        place = F.coalesce(F.sum(sums[count]).over(same_day), F.lit(0)) + 1
        source = source.withColumn(f"_p_{name}", F.when(condition, place))
    daily = source.groupBy(*keys, day).agg(
        *[F.sum(x).alias(name) for name, x in sums.items()],
        *[F.max(x).alias(name) for name, x in peaks.items()],
        *[F.max(f"_p_{name}").alias(f"_p_{name}") for name in latest],
        *[F.sum(x).alias(f"_e_{name}") for name, (x, _) in early.items()],
    )
    daily = daily.select(
        *keys, day, *[f"_p_{name}" for name in latest],
        *[F.sum(name).over(earlier).alias(f"_d_{name}") for name in sums],
        *[F.max(name).over(earlier).alias(f"_d_{name}") for name in peaks],
        *[F.coalesce(F.sum(f"_e_{name}").over(Window.partitionBy(*keys).orderBy(day).rangeBetween(
            Window.unboundedPreceding, -(days + 1))), F.lit(0)).alias(name) for name, (_, days) in early.items()],
    )
    for name, (count, _) in latest.items():
        at = F.coalesce(f"_d_{count}", F.lit(0)) + F.col(f"_p_{name}")
        daily = daily.withColumn(f"_d_{name}", F.max(at).over(earlier)).drop(f"_p_{name}")
    # a key may hold nulls, which are a value of their own here
    renamed = daily.withColumnsRenamed({k: f"_k_{k}" for k in keys + [day]})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys + [day]]
    joined = df.join(renamed, same).drop(*[f"_k_{k}" for k in keys + [day]])
    columns = {
        name: F.coalesce(f"_d_{name}", F.lit(0)) + F.coalesce(F.sum(x).over(same_day), F.lit(0))
        for name, x in sums.items()
    } | {name: F.greatest(f"_d_{name}", F.max(x).over(same_day)) for name, x in peaks.items()}
    joined = joined.withColumns(columns)
    joined = joined.withColumns({
        name: F.greatest(f"_d_{name}", F.max(F.when(condition, F.col(count) + 1)).over(same_day))
        for name, (count, condition) in latest.items()})
    return joined.drop(*[f"_d_{n}" for n in [*sums, *peaks, *latest]])


def in_chunks(df: DataFrame, position: str, counted: Column, span: int, size: int) -> DataFrame:
    """Cut timelines into chunks of ``size`` positions for frames of at most ``span``.

    Rows within ``span`` of a chunk's end are copied into the next chunk as context
    (``_context``).
    """
    if size < span:
        raise ValueError("a chunk must be at least as long as the frame")
    chunk = F.floor(F.col(position) / size)
    following = F.floor((F.col(position) + span) / size)
    chunks = F.when(counted & (following > chunk), F.array(chunk, following)).otherwise(F.array(chunk))
    return df.withColumn("_chunks", chunks).select(
        "*", F.posexplode("_chunks").alias("_copy", "_chunk")
    ).withColumn("_context", F.col("_copy") > 0).drop("_chunks", "_copy")
