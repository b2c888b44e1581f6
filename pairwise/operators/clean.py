"""Raw season rows to the clean match table: projections only, plus one dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise import settings as S
from pairwise.functions.numeric import known, lookup, number, ratio, strip, whole
from pairwise.functions.score import parse_score, score_fields
from pairwise.operators.venues import attach_venues

MATCH_ORDER = ["match_date", "tour", "tourney_id", "match_num"]

# --- fixed values: column names of the raw season files -> ours ------------------
PLAYER_FIELDS = {
    "id": "id", "name": "name", "hand": "hand", "ht": "height_cm", "ioc": "ioc",
    "age": "age", "rank": "rank", "rank_points": "rank_points", "seed": "seed",
    "entry": "entry",
}
SERVE_FIELDS = {
    "ace": "ace", "df": "df", "svpt": "svpt", "1stIn": "first_in", "1stWon": "first_won",
    "2ndWon": "second_won", "SvGms": "sv_gms", "bpSaved": "bp_saved", "bpFaced": "bp_faced",
}
NUMERIC_PLAYER_FIELDS = ["height_cm", "age", "rank", "rank_points"]
EVENT_FIELDS = [
    "tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "tourney_date",
    "match_num", "score", "best_of", "round", "minutes",
]


def clean_surface(surface: Column, missing: str = "Hard") -> Column:
    text = F.initcap(strip(surface))
    return (
        F.when(surface.isNull(), missing).when(text.isin(S.SURFACES), text).otherwise("Unknown")
    )


def clean_level(level: Column) -> Column:
    return F.substring(strip(F.coalesce(level, F.lit("A"))), 1, 1)


def level_weight(level: Column) -> Column:
    return lookup(S.LEVEL_WEIGHTS, level, S.DEFAULT_LEVEL_WEIGHT)


def clean_hand(hand: Column) -> Column:
    letter = F.substring(F.upper(F.coalesce(hand, F.lit("U"))), 1, 1)
    return F.when(letter == "A", "L").otherwise(letter)


def compact_date(value: Column) -> Column:
    digits = number(value).cast("bigint").cast("string")
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def round_order(name: Column) -> Column:
    return lookup(S.ROUNDS, name, S.DEFAULT_ROUND)


def approximate_date(start: Column, round_name: Column, draw_size: Column) -> Column:
    """Event start plus a day offset growing with the round, so finals come last."""
    draw = F.coalesce(draw_size, F.lit(32.0))
    step = F.when(draw >= 96, 1.4).when(draw >= 48, 1.1).otherwise(0.9)
    raw = (round_order(round_name) - 7) * step + 1
    days = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(14.0), raw))).cast("int")
    return F.date_add(start, days)


def match_key(tour: Column, event: Column, number_: Column) -> Column:
    return F.concat_ws("-", tour, event.cast("string"), number_.cast("string"))


def from_season_rows(raw: DataFrame, tour: Column) -> DataFrame:
    """Rename, coerce and default the columns of raw rows (any may be absent)."""
    have = set(raw.columns)

    def source(name: str) -> Column:
        return F.col(f"`{name}`") if name in have else F.lit(None).cast("string")

    columns: dict[str, Column] = {
        "tour": F.lower(tour),
        "tourney_id": source("tourney_id").cast("string"),
        "tourney_name": source("tourney_name"),
        "tourney_date": compact_date(source("tourney_date")),
        "match_num": whole(source("match_num"), 0),
        "surface": clean_surface(source("surface")),
        "level": clean_level(source("tourney_level")),
        "round": F.coalesce(source("round").cast("string"), F.lit("R32")),
        "best_of": whole(source("best_of"), 3).cast("int"),
        "draw_size": number(source("draw_size")),
        "minutes": number(source("minutes")),
        "score": source("score").cast("string"),
    }
    for side, letter in (("winner", "w"), ("loser", "l")):
        for theirs, ours in PLAYER_FIELDS.items():
            value = source(f"{side}_{theirs}")
            if ours == "id":
                value = number(value).cast("bigint")
            elif ours == "hand":
                value = clean_hand(value)
            elif ours in NUMERIC_PLAYER_FIELDS:
                value = number(value)
            columns[f"{side}_{ours}"] = value
        for theirs, ours in SERVE_FIELDS.items():
            columns[f"{side}_{ours}"] = number(source(f"{letter}_{theirs}"))
        columns[f"{side}_spw"] = columns[f"{side}_first_won"] + columns[f"{side}_second_won"]

    keep = [c for c in raw.columns if c.startswith("_")]
    clean = raw.select(*[value.alias(name) for name, value in columns.items()], *keep)
    return clean.filter(F.col("tourney_date").isNotNull()).withColumns({
        "match_date": approximate_date(
            F.col("tourney_date"), F.col("round"), F.col("draw_size")),
        "match_id": match_key(F.col("tour"), F.col("tourney_id"), F.col("match_num")),
    })


def first_per_match(df: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """Keep the first row of each key.

    The rank limit runs before the shuffle too, so a key with very many copies sends one
    row per input partition.
    """
    keys = [key] if isinstance(key, str) else key
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")
    )


def derive_serve(matches: DataFrame) -> DataFrame:
    """Return points, break chances, guarded rates and the usable-statistics flag."""
    columns: dict[str, Column] = {}
    for side, other in (("winner", "loser"), ("loser", "winner")):
        svpt, spw = F.col(f"{side}_svpt"), F.col(f"{side}_spw")
        faced, saved = F.col(f"{other}_bp_faced"), F.col(f"{other}_bp_saved")
        played, theirs = F.col(f"{other}_svpt"), F.col(f"{other}_spw")
        columns |= {
            f"{side}_rtpt": played,
            f"{side}_rpw": played - theirs,
            f"{side}_bp_opps": faced,
            f"{side}_bp_conv": faced - saved,
            f"{side}_spw_pct": ratio(spw, svpt),
            f"{side}_rpw_pct": ratio(played - theirs, played),
        }
    usable = F.lit(True)
    for side in ("winner", "loser"):
        svpt, spw = F.col(f"{side}_svpt"), F.col(f"{side}_spw")
        usable = usable & known(svpt > 0) & known((spw >= 0) & (spw <= svpt))
    columns["has_serve_stats"] = usable
    return matches.withColumns(columns)


def derive_score(matches: DataFrame) -> DataFrame:
    parsed = matches.withColumn("_parsed", parse_score(F.col("score"), F.col("best_of")))
    return parsed.withColumns(score_fields(F.col("_parsed"))).drop("_parsed")


def finish_matches(clean: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Everything derived from clean columns: score, serve, level weight, venue."""
    weighted = clean.withColumn("level_weight", level_weight(F.col("level")))
    return attach_venues(derive_serve(derive_score(weighted)), names)


def normalise(raw: DataFrame, tour: Column, *file_order: str) -> DataFrame:
    """Raw season rows to the match table, first copy of each match kept."""
    rows = from_season_rows(raw, tour)
    clean = first_per_match(rows, "match_id", *file_order)
    clean = clean.drop(*[c for c in clean.columns if c.startswith("_")])
    return finish_matches(clean, rows.select("tourney_name"))


def chronological(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*MATCH_ORDER)


def ingest_report(matches: DataFrame) -> DataFrame:
    return matches.groupBy("tour").agg(
        F.count(F.lit(1)).alias("matches"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
        F.avg(F.col("has_serve_stats").cast("double")).alias("serve_coverage"),
    )
