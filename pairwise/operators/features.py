"""The antisymmetric matrix: one row per contest seen from player 1.

Training and prediction both go through ``assemble``; only the orientation differs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwise import settings as S
from pairwise.functions import pointmodel
from pairwise.functions.numeric import clip, flag, logit, strict
from pairwise.operators import history, ratings, skill
from pairwise.operators.clean import round_order
from pairwise.session import via_table

META = ["match_id", "match_date", "tour", "surface", "tourney_name", "round",
        "p1_id", "p2_id", "p1_name", "p2_name", "label"]
RATING_GAPS = ["elo", "elo_surface", "elo_blend", "elo_points", "elo_games", "elo_peak"]
SKILL_GAPS = ["serve_skill", "return_skill", "serve_skill_surface", "return_skill_surface"]
HISTORY_GAPS = history.FORM + history.FATIGUE + history.CLUTCH + history.SURFACE + history.RECORD
PEAK_AGE = 26.0
OTHER_ANTISYMMETRIC = ["lefty_edge", "home_edge", "markov_logit"]

# Antisymmetric columns by kind of evidence; every one belongs to exactly one group.
GROUPS = {
    "ratings": [f"d_{n}" for n in RATING_GAPS] + ["d_elo_vs_peak"],
    "serve_return": [f"d_{n}" for n in SKILL_GAPS] + [
        "d_serve_dominance", "d_exp_spw", "markov_logit"],
    "surface": [f"d_{n}" for n in history.SURFACE],
    "form": [f"d_{n}" for n in history.FORM] + ["d_win_streak", "d_loss_streak"],
    "fatigue": [f"d_{n}" for n in history.FATIGUE],
    "clutch": [f"d_{n}" for n in history.CLUTCH],
    "h2h": ["d_h2h_win_pct", "d_h2h_surface_win_pct"],
    "experience": ["d_career_matches", "d_career_win_pct", "d_log_rank", "d_log_rank_points"],
    "physical": ["d_age", "d_age_from_peak", "d_height_cm", "lefty_edge"],
    "context": ["home_edge"],
}


def first_is_winner(match_id: Column) -> Column:
    """A stable coin per match: parity of the last hex digit of its hash."""
    return F.conv(F.right(F.md5(match_id), F.lit(1)), 16, 10).cast("int") % 2 == 0


def assemble(frame: DataFrame, first: Column | None = None) -> DataFrame:
    """Meta columns and 75 features. ``frame`` has winner_/loser_ and w_/l_ columns.

    ``first`` tells whether player 1 sits in the winner's place (default: the coin).
    """
    coin = first_is_winner(F.col("match_id")) if first is None else first
    frame = frame.withColumn("_first", coin)
    first = F.col("_first")

    def pick(w: str, l: str, one: bool = True) -> Column:
        a, b = (F.col(w), F.col(l)) if one else (F.col(l), F.col(w))
        return F.when(first, a).otherwise(b)

    def one(name: str) -> Column:
        return pick(f"w_{name}", f"l_{name}")

    def two(name: str) -> Column:
        return pick(f"w_{name}", f"l_{name}", False)

    def signed(w: Column, l: Column) -> Column:
        return F.when(first, w - l).otherwise(l - w)

    def gap(name: str) -> Column:
        return signed(F.col(f"w_{name}"), F.col(f"l_{name}"))

    frame = frame.withColumns({"_p": one("exp_spw"), "_q": two("exp_spw")})
    frame = frame.withColumnsRenamed({"_p": "p1_spw", "_q": "p2_spw"})
    frame = pointmodel.with_point_model(frame, "p1_spw", "p2_spw", "best_of")

    out: dict[str, Column] = {
        **{c: F.col(c) for c in META[:6]},
        "p1_id": pick("winner_id", "loser_id"), "p2_id": pick("winner_id", "loser_id", False),
        "p1_name": pick("winner_name", "loser_name"),
        "p2_name": pick("winner_name", "loser_name", False),
        "label": first.cast("int"),
    }
    for name in RATING_GAPS:
        out[f"d_{name}"] = gap(name)
    for name in ("elo_matches", "elo_surface_matches", "sr_points"):
        out[f"min_{name}"] = strict(F.least, F.col(f"w_{name}"), F.col(f"l_{name}"))
    out["d_elo_vs_peak"] = gap("elo") - gap("elo_peak")
    for name in SKILL_GAPS:
        out[f"d_{name}"] = gap(name)
    edge_1 = one("serve_skill_surface") - two("return_skill_surface")
    edge_2 = two("serve_skill_surface") - one("return_skill_surface")
    out["d_serve_dominance"] = edge_1 - edge_2
    out["match_serve_level"] = edge_1 + edge_2
    p, q, chance = F.col("p1_spw"), F.col("p2_spw"), F.col("pm_match")
    out["d_exp_spw"] = p - q
    out["mean_exp_spw"] = 0.5 * (p + q)
    out["markov_prob"] = chance
    out["markov_logit"] = logit(chance, 1e-4)
    for name in HISTORY_GAPS + ["h2h_win_pct", "h2h_surface_win_pct"]:
        out[f"d_{name}"] = gap(name)
    out["h2h_matches"] = one("h2h_matches")
    out["h2h_surface_matches"] = one("h2h_surface_matches")

    for name in ("age", "height_cm"):
        w, l = F.col(f"winner_{name}"), F.col(f"loser_{name}")
        out[f"d_{name}"] = signed(w, l)
        out[f"mean_{name}"] = 0.5 * (w + l)
    w, l = (F.abs(F.col(f"{s}_age") - PEAK_AGE) for s in ("winner", "loser"))
    out["d_age_from_peak"] = signed(w, l)
    out["mean_age_from_peak"] = 0.5 * (w + l)
    for name, sign in (("rank", -1.0), ("rank_points", 1.0)):
        out[f"d_log_{name}"] = sign * signed(
            F.log1p(f"winner_{name}"), F.log1p(f"loser_{name}"))
    hand_1 = pick("winner_hand", "loser_hand")
    hand_2 = pick("winner_hand", "loser_hand", False)
    out["lefty_edge"] = (flag((hand_1 == "L") & (hand_2 == "R"))
                         - flag((hand_1 == "R") & (hand_2 == "L"))).cast("double")
    ioc_1, ioc_2 = (pick("winner_ioc", "loser_ioc", side) for side in (True, False))
    out["home_edge"] = (flag(ioc_1 == F.col("host")) - flag(ioc_2 == F.col("host"))).cast("double")

    for surface in S.SURFACES:
        out[f"surface_{surface.lower()}"] = flag(F.col("surface") == surface).cast("double")
    for name in ("indoor", "altitude_m", "best_of", "draw_size", "level_weight"):
        out[name] = F.col(name).cast("double")
    out["round_order"] = round_order(F.col("round")).cast("double")
    out["is_slam"] = flag(F.col("level") == "G").cast("double")
    out["tour_is_wta"] = flag(F.col("tour") == "wta").cast("double")
    return frame.select(*[value.alias(name) for name, value in out.items()])


def model_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in META]


def antisymmetric(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith("d_") or c in OTHER_ANTISYMMETRIC]


def flipped(columns: list[str]) -> dict[str, Column]:
    """Each model column as seen from player 2."""
    swap = set(antisymmetric(columns))
    return {
        c: -F.col(c) if c in swap else (1.0 - F.col(c) if c == "markov_prob" else F.col(c))
        for c in columns
    }


def build(matches: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Feature matrix of all matches, and the tables a prediction needs later.

    ``matches`` should be a stored table: four operators read it.
    """
    # refits need no ratings: both go on side by side
    with ThreadPoolExecutor(1) as pool:
        fitted = pool.submit(lambda: via_table(skill.fit_rolling(matches, read=True), "fits"))
        rated = via_table(ratings.kept(ratings.rate(matches)), "rated")
        before = ratings.pre_match(rated)
        fits = fitted.result()
    # every part is stored on its own: the shuffle files of one go before the next
    past = history.history(via_table(history.appearances(matches, before), "timeline"), staged=True)
    past = via_table(history.per_match(past), "past")
    skills = via_table(skill.rolling_features(matches, fits), "skills")
    wide = (
        matches.drop("w_elo", "l_elo")
        .join(before, "match_id")
        .join(skills, "match_id", "left")
        .join(past, "match_id", "left")
    )
    return assemble(wide), {"rated": rated, "before": before, "fits": fits}


# ------------------------------------------------------------------ envelope
def envelope(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """First and last percentile of every feature, symmetric where the feature flips;
    features without a spread are left out."""
    from pairwise.operators.metrics import column_quantiles

    q = column_quantiles(matrix, columns, [0.01, 0.99])
    low, high = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    both_ways = F.col("feature").isin(antisymmetric(columns))
    limit = F.greatest(F.abs(low), F.abs(high))
    return q.filter(high > low).select(
        "feature", F.when(both_ways, -limit).otherwise(low).alias("low"),
        F.when(both_ways, limit).otherwise(high).alias("high"))


def clamped(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items() if c in df.columns})


