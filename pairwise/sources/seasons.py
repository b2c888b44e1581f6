"""Season CSV files: a glob per tour, every column read as text and coerced later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwise.operators.clean import EVENT_FIELDS, PLAYER_FIELDS, SERVE_FIELDS, normalise
from pairwise.sources.layouts import read_layouts
from pairwise.sources.tables import save_table

RAW_COLUMNS = EVENT_FIELDS + [
    f"{side}_{name}" for side in ("winner", "loser") for name in PLAYER_FIELDS
] + [f"{letter}_{name}" for letter in ("w", "l") for name in SERVE_FIELDS]

# --- fixed values: names of the charting tables ----------------------------------
CHARTING_TABLES = [
    "matches", "stats-Overview", "stats-ServeBasics", "stats-ServeDirection",
    "stats-ServeInfluence", "stats-ReturnOutcomes", "stats-ReturnDepth",
    "stats-RallyOutcomes", "stats-ShotTypes", "stats-ShotDirection", "stats-NetPoints",
    "stats-KeyPointsServe", "stats-KeyPointsReturn", "stats-SnV",
]


def read_csv(spark: SparkSession, pattern: str) -> DataFrame | None:
    """Files of one pattern with columns matched by header name; None when there are none.

    Files may differ in columns and order, so each header layout is parsed on its own, and the
    layouts are united by name.
    """
    out = None
    for part in read_layouts(spark, pattern, ["tourney_id", "match_id"]):
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def load_matches(spark: SparkSession, root: str, tour: str) -> DataFrame | None:
    """Raw rows of a tour from ``root/sackmann/<tour>`` or the older ``root/<tour>``."""
    for folder in (f"{root}/sackmann/{tour}", f"{root}/{tour}"):
        raw = read_csv(spark, f"{folder}/{tour}_matches_*.csv")
        if raw is not None:
            return raw
    return None


def load_charting(spark: SparkSession, root: str, table: str, gender: str = "m"):
    return read_csv(spark, f"{root}/charting/charting-{gender}-{table}.csv")


def build_match_table(spark: SparkSession, root: str, tours: list[str]) -> DataFrame | None:
    """All tours normalised and united; write it partitioned by tour to keep it."""
    out = None
    for tour in tours:
        raw = load_matches(spark, root, tour)
        if raw is None:
            continue
        part = normalise(raw, F.lit(tour), "_file", "_start", "_row")
        out = part if out is None else out.unionByName(part)
    return out


def save_match_table(matches: DataFrame, path: str) -> str:
    """Stores a match table by tour, each tour in order over its files."""
    order = ["tour", "match_date", "tourney_id", "match_num"]
    ordered = matches.repartitionByRange(*order).sortWithinPartitions(*order)
    return save_table(ordered, path, "tour")


def stored_order(table: DataFrame) -> DataFrame:
    """Adds ``place``, counted from 1: where a row of a stored match table stands in its tour."""
    # files are named in the order of the ranges; rows of a file are read in order
    placed = table.withColumns({"_name": F.col("_metadata.file_name"), "_at": F.monotonically_increasing_id()})
    pieces = placed.groupBy("tour", "_name").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("tour").orderBy("_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy("tour", "_name").orderBy("_at"))
    return placed.join(starts, ["tour", "_name"]).withColumn("place", F.col("_before") + inside).drop("_name", "_at", "_before")


def to_raw_rows(matches: DataFrame) -> DataFrame:
    """Match rows in the raw season layout (used to publish season files)."""
    columns = {
        "tourney_id": F.col("tourney_id"), "tourney_name": F.col("tourney_name"),
        "surface": F.when(F.col("surface") != "Unknown", F.col("surface")).otherwise("Other"),
        "draw_size": F.col("draw_size").cast("int"), "tourney_level": F.col("level"),
        "tourney_date": F.date_format("match_date", "yyyyMMdd"),
        "match_num": F.col("match_num"), "score": F.col("score"),
        "best_of": F.col("best_of"), "round": F.col("round"),
        "minutes": F.col("minutes").cast("int"),
    }
    for side, letter in (("winner", "w"), ("loser", "l")):
        for theirs, ours in PLAYER_FIELDS.items():
            name = f"{side}_{ours}"
            columns[f"{side}_{theirs}"] = (
                F.col(name) if name in matches.columns else F.lit(None).cast("string"))
        first = F.floor(F.col(f"{side}_spw") * 0.6)
        serve = {"svpt": F.col(f"{side}_svpt"), "1stWon": first,
                 "2ndWon": F.col(f"{side}_spw") - first,
                 "bpSaved": F.col(f"{side}_bp_saved"), "bpFaced": F.col(f"{side}_bp_faced")}
        for theirs in SERVE_FIELDS:
            value = serve.get(theirs, F.lit(None).cast("string"))
            columns[f"{letter}_{theirs}"] = value
    return matches.select(*[c.alias(n) for n, c in columns.items()])
