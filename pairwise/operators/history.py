"""Strictly earlier history of both sides of each contest, as window expressions.

Every match becomes two appearances. Totals are taken per player and day and accumulated over
days; frames over recent rows run in chunks of a player's timeline. The result returns to one
row per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise import settings as S
from pairwise.functions.numeric import flag, lookup
from pairwise.operators.timeline import in_chunks, running
from pairwise.session import freeing_shuffles, remove_path, scratch_path

PLAYER = ["tour", "player_id"]
LATER = ["tourney_id", "match_num"]
CHUNK = 4096

FORM = [f"form_win_pct_{n}" for n in S.FORM_WINDOWS] + ["form_decayed", "form_quality"]
FATIGUE = [f"{what}_{d}d" for what in ("minutes", "matches", "sets") for d in S.WORK_DAYS] + [
    "days_since_last", "rest_deviation", "is_returning", "recent_retirements"]
CLUTCH = ["bp_saved_pct", "bp_conv_pct", "tiebreak_pct", "decider_pct"]
SURFACE = ["surface_win_pct", "surface_matches", "surface_recency"]
RECORD = ["career_matches", "career_win_pct", "win_streak", "loss_streak"]
HEAD_TO_HEAD = ["h2h_matches", "h2h_win_pct", "h2h_surface_matches", "h2h_surface_win_pct"]
FEATURES = FORM + FATIGUE + CLUTCH + ["bp_faced_sample"] + SURFACE + RECORD + HEAD_TO_HEAD


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def appearances(matches: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Two rows per match. ``ratings`` adds w_elo and l_elo by match_id."""
    df = matches
    if ratings is not None:
        df = df.join(ratings.select("match_id", "w_elo", "l_elo"), "match_id", "left")
    elif "w_elo" not in df.columns:
        df = df.withColumns({"w_elo": F.lit(S.START_RATING), "l_elo": F.lit(S.START_RATING)})

    def side(letter: str, mine: str, other: str, other_letter: str) -> Column:
        won = letter == "w"
        return F.struct(
            F.lit(letter).alias("side"),
            F.col(f"{mine}_id").alias("player_id"),
            F.col(f"{other}_id").alias("opponent_id"),
            F.lit(int(won)).alias("won"),
            F.col(f"{other_letter}_elo").alias("opponent_elo"),
            *[F.col(f"{mine}_{x}").cast("double").alias(x)
              for x in ("bp_saved", "bp_faced", "bp_conv", "bp_opps", "tiebreaks_won")],
            (flag(F.col("retirement")) * F.lit(int(not won))).alias("gave_up"),
        )

    both = F.array(side("w", "winner", "loser", "l"), side("l", "loser", "winner", "w"))
    return df.select(
        "match_id", "tour", "match_date", "tourney_id", "match_num", "surface",
        day_number(F.col("match_date")).alias("day"),
        (1 - flag(F.col("walkover"))).alias("live"),
        F.lit(1).alias("seen"),
        F.when(F.col("minutes") != 0, F.col("minutes")).alias("minutes"),
        F.coalesce(F.col("sets_played"), F.lit(0)).alias("sets"),
        F.coalesce(F.col("tiebreaks_played"), F.lit(0)).alias("tiebreaks"),
        flag(F.col("went_to_decider")).alias("decider"),
        F.inline(both),
    )


def asked(requests: DataFrame) -> DataFrame:
    """Appearances that only read: rows (match_id, side, tour, player, opponent, surface,
    match_date) that see all history before the date and leave no trace themselves."""
    return requests.select(
        "match_id", "side", "tour", "player_id", "opponent_id", "surface", "match_date",
        day_number(F.col("match_date")).alias("day"),
        F.lit("~").alias("tourney_id"), F.lit(2**62).alias("match_num"),
        F.lit(0).alias("live"), F.lit(0).alias("seen"), F.lit(0).alias("won"),
        F.lit(0).alias("gave_up"),
    )


def _sums() -> dict[str, Column]:
    live, won = F.col("live"), F.col("won")

    def when_live(x: Column) -> Column:
        return F.when(live == 1, F.coalesce(x, F.lit(0.0))).otherwise(0.0)

    faced, chances = F.col("bp_faced").isNotNull(), F.col("bp_opps").isNotNull()
    sums = {
        "_n": live, "_wins": live * won,
        "_saved": when_live(F.when(faced, F.col("bp_saved"))),
        "_faced": when_live(F.col("bp_faced")),
        "_conv": when_live(F.when(chances, F.col("bp_conv"))),
        "_opps": when_live(F.col("bp_opps")),
        "_tb": when_live(F.col("tiebreaks").cast("double")),
        "_tbw": when_live(F.when(F.col("tiebreaks") > 0, F.col("tiebreaks_won"))),
        "_dec": live * F.coalesce("decider", F.lit(0)),
        "_decw": live * F.coalesce("decider", F.lit(0)) * won,
    }
    return sums


def history(timeline: DataFrame, chunk: int = CHUNK, wanted: list[str] | None = None, staged: bool = False) -> DataFrame:
    """All history features of every appearance (columns ``FEATURES``), or those ``wanted``.

    ``chunk`` is how many live rows of a player stand in one window for the frames over recent
    rows; the result does not depend on it. The timeline is read once for each kind of total that
    the features need: store one that is dear to compute. With ``staged`` rows are stored after each
    kind, so that the shuffle files of one kind go before the next: for many kinds on large timelines.
    """
    wanted = wanted or FEATURES
    df = timeline
    live, won = F.col("live"), F.col("live") * F.col("won")

    def needs(*groups: list[str]) -> bool:
        return any(name in group for group in groups for name in wanted)

    stored: list[str] = []

    def stage(rows: DataFrame, *later: str) -> DataFrame:
        """The rows so far as a table, with the totals and what ``later`` kinds read; it replaces the one before."""
        if not staged:
            return rows
        own = {*KEPT, "day", *[c for kind in later for c in READ_BY[kind]]}
        rows = rows.select(*[c for c in rows.columns if c in own or c.startswith("_")])
        spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "totals")
        with freeing_shuffles(spark):
            rows.write.parquet(path)
        if stored:
            remove_path(spark, stored.pop())
        stored.append(path)
        return spark.read.schema(rows.schema).parquet(path)

    if needs(FORM, FATIGUE, CLUTCH, ["bp_faced_sample"], SURFACE, RECORD):
        own = {"_n", "_wins"}
        if needs(CLUTCH, ["bp_faced_sample"]):
            own |= {"_saved", "_faced", "_conv", "_opps", "_tb", "_tbw", "_dec", "_decw"}
        sums = {name: x for name, x in _sums().items() if name in own}
        peaks, latest, early = {}, {}, {}
        if needs(FATIGUE):
            peaks["_last_day"] = F.when(F.col("seen") == 1, F.col("day"))
            sums["_ret"] = F.col("gave_up")
            early["_ret_early"] = (F.col("gave_up"), S.RETIRE_DAYS)
        if needs(RECORD):
            latest = {"_last_win": ("_n", (live == 1) & (F.col("won") == 1)),
                      "_last_loss": ("_n", (live == 1) & (F.col("won") == 0))}
        df = running(df, timeline, PLAYER, "day", LATER, sums, peaks, latest, early)
        df = stage(df, "recent", "surface", "pairs")
    if needs(SURFACE):
        df = running(df, timeline, PLAYER + ["surface"], "day", LATER, {"_sn": live, "_swins": won})
        df = stage(df, "recent", "pairs")
    # meetings of two players are few: both kinds of totals run where a pair's rows lie
    for keys, count, wins, features in (
        (PLAYER + ["opponent_id"], "_hn", "_hwins", HEAD_TO_HEAD[:2]),
        (PLAYER + ["opponent_id", "surface"], "_hsn", "_hswins", HEAD_TO_HEAD[2:]),
    ):
        if needs(features):
            before = Window.partitionBy(*keys).orderBy("day", *LATER).rowsBetween(Window.unboundedPreceding, -1)
            df = df.withColumns({n: F.coalesce(F.sum(x).over(before), F.lit(0)) for n, x in ((count, live), (wins, won))})
    if needs(HEAD_TO_HEAD):
        df = stage(df, "recent")
    if needs(FORM, FATIGUE, SURFACE):
        df = _recent(df, chunk)
    return df.select(*KEPT, *[value.alias(name) for name, value in _features().items() if name in wanted])


KEPT = ["match_id", "side", "tour", "player_id", "opponent_id", "match_date", "surface"]
#: What later kinds of totals read of a row.
READ_BY = {
    "recent": ["day", "live", "won", "minutes", "sets", "opponent_elo"],
    "surface": ["day", "live", "won", *LATER], "pairs": ["day", "live", "won", *LATER]}


def _recent(df: DataFrame, chunk: int) -> DataFrame:
    """Frames over the last live rows: by position (_n) and by day."""
    live = F.col("live") == 1
    df = in_chunks(df, "_n", live, S.RESULT_QUEUE, chunk)
    part = Window.partitionBy(*PLAYER, "_chunk")
    by_position, by_day = part.orderBy("_n"), part.orderBy("day")
    start = Window.unboundedPreceding
    minutes = F.when(live, F.coalesce("minutes", F.lit(0.0))).otherwise(0.0)
    measures = {
        "count": F.col("live").cast("double"),
        "minutes": minutes,
        "sets": F.when(live, F.col("sets").cast("double")).otherwise(0.0),
        "wins": (F.col("live") * F.col("won")).cast("double"),
    }
    for surface in S.ANY_SURFACE:
        measures[f"on_{surface}"] = F.when(live & (F.col("surface") == surface), 1.0).otherwise(0.0)

    def total(name: str, window) -> Column:
        return F.coalesce(F.sum(measures[name]).over(window), F.lit(0.0))

    columns: dict[str, Column] = {}
    for name in measures:
        columns[f"_all_{name}"] = total(name, by_position.rangeBetween(start, -1))

    def older_than(n: int) -> Window:
        return by_position.rangeBetween(start, -(n + 1))

    for n in S.FORM_WINDOWS:
        columns[f"_old{n}_wins"] = total("wins", older_than(n))
    for name in ("minutes", "sets", "count"):
        columns[f"_queue_{name}"] = total(name, older_than(S.WORK_QUEUE))
    on_surface = [m for m in measures if m.startswith("on_")]
    for name in on_surface + ["count"]:
        columns[f"_squeue_{name}"] = total(name, older_than(S.SURFACE_QUEUE))

    weight = F.when(live, F.pow(F.lit(2.0), F.col("day") / S.FORM_HALF_LIFE))
    quality = F.when(F.col("won") == 1, F.col("opponent_elo") - 1500.0).otherwise(
        F.col("opponent_elo") - 1700.0)
    last = by_position.rangeBetween(-S.RESULT_QUEUE, -1)
    columns["_w"] = F.sum(weight).over(last)
    columns["_ww"] = F.sum(weight * F.col("won")).over(last)
    columns["_wq"] = F.sum(weight * quality).over(last)
    df = df.withColumns(columns)

    columns = {}
    for days in S.WORK_DAYS:
        before = by_day.rangeBetween(start, -(days + 1))
        for name in ("minutes", "sets", "count"):
            columns[f"_day{days}_{name}"] = total(name, before)
    before = by_day.rangeBetween(start, -(S.SURFACE_DAYS + 1))
    for name in on_surface + ["count"]:
        columns[f"_sday_{name}"] = total(name, before)
    return df.withColumns(columns).filter(~F.col("_context"))


def _latest(name: str, day_prefix: str, queue_prefix: str, size: int) -> Column:
    """Total over the rows that are both recent by day and within the bounded queue.

    Both sets are the newest part of the history, so their overlap is the smaller one.
    """
    recent = F.col("_all_count") - F.col(f"{day_prefix}_count")
    return F.when(
        recent <= size, F.col(f"_all_{name}") - F.col(f"{day_prefix}_{name}")
    ).otherwise(F.col(f"_all_{name}") - F.col(f"{queue_prefix}_{name}"))


def _features() -> dict[str, Column]:
    n, wins = F.col("_n"), F.col("_wins")
    some = n > 0
    out: dict[str, Column] = {}
    for size in S.FORM_WINDOWS:
        out[f"form_win_pct_{size}"] = F.when(
            some, (F.col("_all_wins") - F.col(f"_old{size}_wins")) / F.least(n, F.lit(size)))
    out["form_decayed"] = F.when(F.col("_w") > 0, F.col("_ww") / F.col("_w"))
    out["form_quality"] = F.when(F.col("_w") > 0, F.col("_wq") / F.col("_w"))

    for what, name in (("minutes", "minutes"), ("matches", "count"), ("sets", "sets")):
        for days in S.WORK_DAYS:
            out[f"{what}_{days}d"] = _latest(name, f"_day{days}", "_queue", S.WORK_QUEUE)
    idle = (F.col("day") - F.col("_last_day")).cast("double")
    out["days_since_last"] = idle
    out["rest_deviation"] = F.abs(F.log1p(idle) - F.log1p(F.lit(S.BEST_REST_DAYS)))
    out["is_returning"] = F.when(
        idle.isNull() | (idle > S.RETURN_AFTER_DAYS), 1.0).otherwise(0.0)
    out["recent_retirements"] = F.least(
        F.col("_ret") - F.col("_ret_early"), F.lit(S.RETIRE_QUEUE)).cast("double")

    saved = lookup({t: r[0] for t, r in S.BREAK_RATES.items()}, F.col("tour"),
                   S.BREAK_RATES["atp"][0])
    converted = lookup({t: r[1] for t, r in S.BREAK_RATES.items()}, F.col("tour"),
                       S.BREAK_RATES["atp"][1])

    def shrunk(made: str, tried: str, rate, prior: float) -> Column:
        return (F.col(made) + rate * prior) / (F.col(tried) + prior)

    out["bp_saved_pct"] = shrunk("_saved", "_faced", saved, S.BREAK_PRIOR)
    out["bp_conv_pct"] = shrunk("_conv", "_opps", converted, S.BREAK_PRIOR)
    out["tiebreak_pct"] = shrunk("_tbw", "_tb", F.lit(0.5), S.TIEBREAK_PRIOR)
    out["decider_pct"] = shrunk("_decw", "_dec", F.lit(0.5), S.DECIDER_PRIOR)
    out["bp_faced_sample"] = F.col("_faced")

    overall = F.when(some, wins / n).otherwise(0.5)
    out["surface_win_pct"] = (F.col("_swins") + S.SURFACE_PRIOR * overall) / (
        F.col("_sn") + S.SURFACE_PRIOR)
    out["surface_matches"] = F.col("_sn").cast("double")
    here = F.lit(None).cast("double")
    for surface in S.ANY_SURFACE:
        here = F.when(
            F.col("surface") == surface,
            _latest(f"on_{surface}", "_sday", "_squeue", S.SURFACE_QUEUE),
        ).otherwise(here)
    recent = _latest("count", "_sday", "_squeue", S.SURFACE_QUEUE)
    out["surface_recency"] = F.when(recent > 0, here / recent)

    out["career_matches"] = n.cast("double")
    out["career_win_pct"] = F.when(some, wins / n)
    out["win_streak"] = (n - F.coalesce("_last_loss", F.lit(0))).cast("double")
    out["loss_streak"] = (n - F.coalesce("_last_win", F.lit(0))).cast("double")

    prior = S.HEAD_TO_HEAD_PRIOR
    out["h2h_matches"] = F.col("_hn").cast("double")
    out["h2h_win_pct"] = (F.col("_hwins") + 0.5 * prior) / (F.col("_hn") + prior)
    out["h2h_surface_matches"] = F.col("_hsn").cast("double")
    out["h2h_surface_win_pct"] = (F.col("_hswins") + 0.5 * prior) / (F.col("_hsn") + prior)
    return out


def per_match(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Appearance features back to one row per match, prefixed w_ and l_."""
    names = names or FEATURES
    return features.groupBy("match_id").agg(*[
        F.max(F.when(F.col("side") == letter, F.col(name))).alias(f"{letter}_{name}")
        for letter in ("w", "l") for name in names
    ])
