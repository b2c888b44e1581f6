"""For each registered query with an SQL form: the same result as DuckDB SQL."""

from __future__ import annotations

from pairwise.plans import oracle_base as B

SQL: dict[str, str] = {}

SQL["clean_context"] = B.with_("""
SELECT match_id, surface, level,
  CASE level WHEN 'G' THEN 1.0::DOUBLE WHEN 'M' THEN 0.95 WHEN 'A' THEN 0.9 WHEN 'C' THEN 0.7 ELSE 0.8 END AS level_weight,
  best_of::BIGINT AS best_of, ord AS round_order,
  match_date + CAST(round_even(LEAST(14, GREATEST(0, (ord - 7) * (CASE WHEN draw_size >= 96 THEN 1.4::DOUBLE
    WHEN draw_size >= 48 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END) + 1)), 0) AS INTEGER) AS played_on,
  winner_hand, match_id AS key
FROM (SELECT *, CASE round WHEN 'RR' THEN 6 WHEN 'R128' THEN 7 WHEN 'R64' THEN 8 WHEN 'R32' THEN 9
  WHEN 'R16' THEN 10 WHEN 'QF' THEN 11 WHEN 'SF' THEN 12 ELSE 13 END::BIGINT AS ord FROM contests)
""", B.CONTESTS)

SQL["serve_rates"] = B.with_("""
SELECT match_id, has_serve_stats, winner_rtpt, winner_rpw, winner_bp_opps, winner_bp_conv,
  loser_rtpt, loser_rpw, loser_bp_opps, loser_bp_conv,
  ROUND(CASE WHEN winner_svpt > 0 THEN winner_spw / winner_svpt END, 6) AS winner_spw_pct,
  ROUND(CASE WHEN loser_svpt > 0 THEN 1 - loser_spw / loser_svpt END, 6) AS winner_rpw_pct,
  ROUND(CASE WHEN loser_svpt > 0 THEN loser_spw / loser_svpt END, 6) AS loser_spw_pct,
  ROUND(CASE WHEN winner_svpt > 0 THEN 1 - winner_spw / winner_svpt END, 6) AS loser_rpw_pct
FROM matches""")

SQL["scoreline"] = B.with_("""
SELECT match_id, retirement, walkover, completed, went_to_decider,
  sets_played::BIGINT AS sets_played, tiebreaks_played::BIGINT AS tiebreaks_played,
  winner_games_won::BIGINT AS winner_games_won, loser_games_won::BIGINT AS loser_games_won,
  winner_sets_won::BIGINT AS winner_sets_won, loser_sets_won::BIGINT AS loser_sets_won,
  winner_tiebreaks_won::BIGINT AS winner_tiebreaks_won,
  loser_tiebreaks_won::BIGINT AS loser_tiebreaks_won, ROUND(dominance, 6) AS dominance
FROM matches""")

SQL["venue_attributes"] = B.with_("""
SELECT tourney_name, surface, indoor, altitude_m::BIGINT AS altitude_m, host, COUNT(*) AS matches
FROM matches GROUP BY ALL""")

SQL["dedup_matches"] = B.with_("""
SELECT match_id, match_date, tourney_id, match_num, MIN(minutes) AS minutes
FROM (SELECT * FROM contests UNION ALL SELECT * REPLACE (minutes + 1 AS minutes) FROM contests)
GROUP BY ALL""", B.CONTESTS)

SQL["ingest_summary"] = B.with_("""
SELECT tour, COUNT(*) AS matches, MIN(match_date) AS first_date, MAX(match_date) AS last_date,
  ROUND(AVG(CASE WHEN has_serve_stats THEN 1.0 ELSE 0.0 END), 6) AS serve_coverage
FROM matches GROUP BY tour""")


#: columns of each history query over earlier appearances
_COLUMNS: dict[str, str] = {}


def _history(name: str, columns: str) -> str:
    _COLUMNS[name] = columns
    return B.with_(f"""
SELECT a.match_id, a.side, {columns}
FROM (SELECT match_id, side FROM app) a
LEFT JOIN earlier e ON a.match_id = e.match_id AND a.side = e.side
GROUP BY a.match_id, a.side""", B.EARLIER)


SQL["form"] = _history("form", 
    ", ".join(f"ROUND(AVG(won) FILTER (live = 1 AND back <= {n}), 6) AS form_win_pct_{n}"
              for n in (10, 25, 50)) + """,
  ROUND(SUM(won * POW(0.5::DOUBLE, age / 120.0::DOUBLE)) FILTER (live = 1 AND back <= 120)
    / SUM(POW(0.5::DOUBLE, age / 120.0::DOUBLE)) FILTER (live = 1 AND back <= 120), 6) AS form_decayed,
  ROUND(SUM((CASE WHEN won = 1 THEN opponent_elo - 1500 ELSE -(1500 - opponent_elo + 200) END)
      * POW(0.5::DOUBLE, age / 120.0::DOUBLE)) FILTER (live = 1 AND back <= 120)
    / SUM(POW(0.5::DOUBLE, age / 120.0::DOUBLE)) FILTER (live = 1 AND back <= 120), 6) AS form_quality""")

SQL["workload"] = _history("workload", 
    ", ".join(
        f"COALESCE({agg} FILTER (live = 1 AND back <= 60 AND age <= {d}), 0)::DOUBLE AS {n}_{d}d"
        for n, agg in (("minutes", "SUM(minutes)"), ("matches", "COUNT(won)"), ("sets", "SUM(sets)"))
        for d in (7, 14, 28)) + """,
  MIN(age)::DOUBLE AS days_since_last,
  ROUND(ABS(LN(1 + MIN(age)) - LN(6)), 6) AS rest_deviation,
  CASE WHEN COALESCE(MIN(age), 999) > 120 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_returning,
  LEAST(10, COUNT(*) FILTER (gave_up = 1 AND age <= 90))::DOUBLE AS recent_retirements""")

SQL["clutch"] = _history("clutch", """
  ROUND((COALESCE(SUM(bp_saved) FILTER (live = 1), 0) + 0.615::DOUBLE * 60) / (COALESCE(SUM(bp_faced) FILTER (live = 1), 0) + 60), 6) AS bp_saved_pct,
  ROUND((COALESCE(SUM(bp_conv) FILTER (live = 1), 0) + 0.405::DOUBLE * 60) / (COALESCE(SUM(bp_opps) FILTER (live = 1), 0) + 60), 6) AS bp_conv_pct,
  ROUND((COALESCE(SUM(tbw) FILTER (live = 1), 0) + 12.5::DOUBLE) / (COALESCE(SUM(tb) FILTER (live = 1), 0) + 25), 6) AS tiebreak_pct,
  ROUND((COALESCE(SUM(won) FILTER (live = 1 AND dec = 1), 0) + 6.0::DOUBLE) / (COALESCE(SUM(dec) FILTER (live = 1), 0) + 12), 6) AS decider_pct,
  COALESCE(SUM(bp_faced) FILTER (live = 1), 0)::DOUBLE AS bp_faced_sample""")

SQL["surface_context"] = _history("surface_context", """
  ROUND((COUNT(*) FILTER (live = 1 AND won = 1 AND e.surface = here)
     + 8 * COALESCE(AVG(won) FILTER (live = 1), 0.5))
    / (COUNT(*) FILTER (live = 1 AND e.surface = here) + 8.0::DOUBLE), 6) AS surface_win_pct,
  (COUNT(*) FILTER (live = 1 AND e.surface = here))::DOUBLE AS surface_matches,
  ROUND(AVG(CASE WHEN e.surface = here THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    FILTER (live = 1 AND back <= 40 AND age <= 60), 6) AS surface_recency""")

SQL["career_streaks"] = _history("career_streaks", """
  (COUNT(*) FILTER (live = 1))::DOUBLE AS career_matches,
  ROUND(AVG(won) FILTER (live = 1), 6) AS career_win_pct,
  COALESCE(MIN(back) FILTER (live = 1 AND won = 0) - 1, COUNT(*) FILTER (live = 1))::DOUBLE AS win_streak,
  COALESCE(MIN(back) FILTER (live = 1 AND won = 1) - 1, COUNT(*) FILTER (live = 1))::DOUBLE AS loss_streak""")

SQL["h2h"] = _history("h2h", """
  (COUNT(*) FILTER (e.live = 1 AND e.opponent_id = against))::DOUBLE AS h2h_matches,
  ROUND((COUNT(*) FILTER (e.live = 1 AND e.opponent_id = against AND e.won = 1) + 3.0::DOUBLE)
    / (COUNT(*) FILTER (e.live = 1 AND e.opponent_id = against) + 6), 6) AS h2h_win_pct,
  (COUNT(*) FILTER (e.live = 1 AND e.opponent_id = against AND e.surface = here))::DOUBLE AS h2h_surface_matches,
  ROUND((COUNT(*) FILTER (e.live = 1 AND e.opponent_id = against AND e.surface = here AND e.won = 1) + 3.0::DOUBLE)
    / (COUNT(*) FILTER (e.live = 1 AND e.opponent_id = against AND e.surface = here) + 6), 6) AS h2h_surface_win_pct""")


SQL["career_from_buckets"] = _history("career_from_buckets", """
  (COUNT(*) FILTER (live = 1))::DOUBLE AS career_matches, ROUND(AVG(won) FILTER (live = 1), 6) AS career_win_pct""")

# what every player's history says at the end of the data, asked about a match on clay
SQL["history_snapshot"] = B.with_(f"""
, people AS (SELECT DISTINCT tour, player_id FROM app), fin AS (SELECT MAX(match_date) AS d FROM matches),
earlier AS (
  SELECT a.tour AS pool, a.player_id AS who, 'Clay' AS here, date_diff('day', b.match_date, fin.d) AS age, b.*,
    SUM(b.live) OVER (PARTITION BY a.tour, a.player_id ORDER BY b.match_date DESC, b.tourney_id DESC, b.match_num DESC) AS back
  FROM people a JOIN app b ON a.tour = b.tour AND a.player_id = b.player_id, fin)
SELECT pool AS tour, who AS player_id, {", ".join(_COLUMNS[n] for n in ("form", "workload", "clutch", "surface_context", "career_streaks"))}
FROM earlier e GROUP BY pool, who""", B.APPEARANCES)

# form weighed by what the opponents were really rated
SQL["rated_form"] = B.recursive(B.APPEARANCES[len(B.MATCHES):].strip().replace("app AS", "plain AS", 1) + f""",
app AS (SELECT p.* REPLACE (r.elo AS opponent_elo) FROM plain p JOIN ratings r ON r.match_id = p.match_id AND r.side <> p.side)"""
    + B.EARLIER[len(B.APPEARANCES):] + f"""
SELECT a.match_id, a.side, {_COLUMNS["form"]} FROM (SELECT match_id, side FROM app) a
LEFT JOIN earlier e ON a.match_id = e.match_id AND a.side = e.side GROUP BY a.match_id, a.side""")


# ---------------------------------------------------------------- ratings
def _blend(surface: str, n: str, on: str, overall: str) -> str:
    w = B.BLEND.format(surface=surface, n=n)
    return f"{w} * {on} + (1 - {w}) * {overall}"


SQL["elo_history"] = B.recursive(f"""
SELECT match_id, side, ROUND(elo, 6) AS elo, ROUND(elo_surface, 6) AS elo_surface,
  ROUND(elo_points, 6) AS elo_points, ROUND(elo_games, 6) AS elo_games, ROUND(elo_peak, 6) AS elo_peak,
  elo_matches::DOUBLE AS elo_matches, elo_surface_matches::DOUBLE AS elo_surface_matches,
  ROUND({_blend("surface", "elo_surface_matches", "elo_surface", "elo")}, 6) AS elo_blend
FROM ratings""")

SQL["streaming_ratings"] = SQL["elo_history"]
SQL["elo_periods"] = SQL["elo_history"]

SQL["elo_leaderboard"] = B.recursive(f"""
SELECT tour, player_id, elo, elo_points, elo_games, matches, peak_elo, last_date, elo_clay, place FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tour ORDER BY raw_clay DESC, player_id) AS place FROM (
    SELECT o.tour, o.player_id, ROUND(o.rating, 6) AS elo, ROUND(COALESCE(p.rating, 1500), 6) AS elo_points,
      ROUND(COALESCE(g.rating, 1500), 6) AS elo_games, o.n::BIGINT AS matches, ROUND(o.peak, 6) AS peak_elo,
      o.last_day AS last_date,
      {_blend("'Clay'", "COALESCE(s.n, 0)", "COALESCE(s.rating, 1500)", "o.rating")} AS raw_clay,
      ROUND(raw_clay, 6) AS elo_clay
    FROM states o
    LEFT JOIN states p ON p.tour = o.tour AND p.player_id = o.player_id AND p.kind = 'points'
    LEFT JOIN states g ON g.tour = o.tour AND g.player_id = o.player_id AND g.kind = 'games'
    LEFT JOIN states s ON s.tour = o.tour AND s.player_id = o.player_id AND s.kind = 'surface' AND s.store = 'Clay'
    WHERE o.kind = 'overall' AND o.n >= 15
      AND o.last_day >= (SELECT MAX(match_date) FROM matches) - INTERVAL 365 DAY))
WHERE place <= 30""", B.FINAL)


# ---------------------------------------------------------------- prices and metrics
FORECASTS = B.CONTESTS + """,
coin AS (SELECT *, ('0x' || right(md5(match_id), 1))::INT % 2 = 0 AS first FROM contests),
gaps AS (SELECT *, CASE WHEN first THEN 1 ELSE 0 END AS label, CASE WHEN first THEN 1 ELSE -1 END AS sgn,
  CASE WHEN first THEN odds_winner ELSE odds_loser END AS a, CASE WHEN first THEN odds_loser ELSE odds_winner END AS b FROM coin),
refs AS (SELECT *, 0.5::DOUBLE AS ref_coin,
  1 / (1 + EXP(-0.62::DOUBLE * COALESCE(sgn * (LN(1 + loser_rank) - LN(1 + winner_rank)), 0))) AS ref_favourite,
  1 / (1 + POW(10.0::DOUBLE, -(sgn * (COALESCE(winner_rank_points, 0) - COALESCE(loser_rank_points, 0)) / 20) / 400)) AS ref_elo
  FROM gaps),
fc AS (SELECT *, ROUND(ref_favourite, 4) AS prediction, 1 / a AS x, 1 / b AS y FROM refs),
priced AS (SELECT *, x + y AS total,
  CASE WHEN a > 1 AND b > 1 THEN LEAST(1 - 1e-6, GREATEST(1e-6, x - (x + y - 1) / 2)) END AS additive,
  CASE WHEN a > 1 AND b > 1 THEN CASE WHEN x + y >= 1 THEN x - (x + y - 1) / 2 ELSE x / SQRT(x + y) END END AS fair FROM fc)
"""
_LOSS = "-(label * LN({p}) + (1 - label) * LN(1 - {p}))"
_LOGIT = "LN({p} / (1 - {p}))"

# The insider share by halving, and the power exponent by halving.
SQL["devig"] = "WITH RECURSIVE " + FORECASTS.strip() + """,
halved(match_id, x, y, step, zl, zh, kl, kh) AS (
  SELECT match_id, x, y, 0, 0.0::DOUBLE, 0.9999::DOUBLE, 1.0::DOUBLE, 6.0::DOUBLE FROM fc WHERE a > 1 AND b > 1
  UNION ALL
  SELECT match_id, x, y, step + 1,
    CASE WHEN insider > 1 THEN z ELSE zl END, CASE WHEN insider > 1 THEN zh ELSE z END,
    CASE WHEN step >= 60 THEN kl WHEN POW(x, k) + POW(y, k) > 1 THEN k ELSE kl END,
    CASE WHEN step >= 60 THEN kh WHEN POW(x, k) + POW(y, k) > 1 THEN kh ELSE k END
  FROM (SELECT *, (SQRT(z * z + 4 * (1 - z) * x * x / (x + y)) - z) / (2 * (1 - z))
             + (SQRT(z * z + 4 * (1 - z) * y * y / (x + y)) - z) / (2 * (1 - z)) AS insider
        FROM (SELECT *, (zl + zh) / 2 AS z, (kl + kh) / 2 AS k FROM halved WHERE step < 80))),
solved AS (SELECT *, (zl + zh) / 2 AS z, (kl + kh) / 2 AS k FROM halved WHERE step = 80)
SELECT match_id, ROUND(x + y, 6) AS overround, ROUND(CASE WHEN a > 1 AND b > 1 THEN x / (x + y) END, 6) AS multiplicative,
  ROUND(additive, 6) AS additive, ROUND(LEAST(1 - 1e-6, GREATEST(1e-6, POW(p.x, k))), 6) AS power,
  ROUND(LEAST(1 - 1e-6, GREATEST(1e-6, (SQRT(z * z + 4 * (1 - z) * p.x * p.x / (p.x + p.y)) - z) / (2 * (1 - z)))), 6) AS shin
FROM priced p LEFT JOIN (SELECT match_id, z, k FROM solved) USING (match_id)"""

_KELLY = "LEAST(1, GREATEST(0, ({p} * ({o} - 1) - (1 - {p})) / ({o} - 1)))"
_KA, _KB = _KELLY.format(p="prediction", o="a"), _KELLY.format(p="(1 - prediction)", o="b")
_BETS = """
side AS (SELECT *, CASE WHEN prediction * a - 1 > {edge} THEN 1 WHEN (1 - prediction) * b - 1 > {edge} THEN 2 ELSE 0 END AS back
         FROM priced WHERE a > 1 AND b > 1),
staked AS (SELECT *, {stake} AS amount FROM side),
paid AS (SELECT *, CASE back WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN label = 1 THEN amount * (a - 1) ELSE -amount END
           ELSE CASE WHEN label = 0 THEN amount * (b - 1) ELSE -amount END END AS won FROM staked)"""
_QUARTER = f"CASE back WHEN 1 THEN 0.25::DOUBLE * {_KA} WHEN 2 THEN 0.25::DOUBLE * {_KB} ELSE 0 END"


def _return(name: str, stake: str) -> str:
    return B.with_("," + _BETS.format(edge="0.04::DOUBLE", stake=stake) + f"""
SELECT tour, '{name}' AS stake, COUNT(*) FILTER (amount > 0) AS bets, ROUND(SUM(amount), 4) AS staked,
  ROUND(SUM(won), 4) AS profit, ROUND(SUM(won) / SUM(amount), 6) AS roi FROM paid GROUP BY tour""", FORECASTS)


SQL["betting"] = (
    f"({_return('kelly', _QUARTER)}) UNION ALL "
    f"({_return('flat', 'CASE WHEN back > 0 THEN 1.0::DOUBLE ELSE 0 END')})")

SQL["price_signals"] = B.with_(f"""
SELECT match_id, ROUND(prediction * a - 1, 6) AS value,
  ROUND(CASE WHEN a > 1 THEN {_KA} ELSE 0 END, 6) AS kelly,
  ROUND({_LOGIT.format(p="prediction")} - {_LOGIT.format(p="fair")}, 6) AS clv FROM priced""", FORECASTS)


def _scores(p: str) -> str:
    return f"""ROUND(AVG({_LOSS.format(p=p)}), 6) AS log_loss,
  ROUND(AVG(({p} - label) * ({p} - label)), 6) AS brier,
  ROUND(AVG(CASE WHEN ({p} > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  ROUND(AVG({p}), 6) AS mean_prediction, ROUND(AVG(label), 6) AS base_rate"""


SQL["reference_models"] = " UNION ALL ".join(
    "(" + B.with_(f"SELECT tour, '{p}' AS model, COUNT(*) AS n, {_scores(p)} FROM fc GROUP BY tour", FORECASTS) + ")"
    for p in ("ref_coin", "ref_favourite", "ref_elo"))


def _bins(source: str, group: str, count: int) -> str:
    return f""",
edges AS (SELECT {group}, unnest(quantile_cont(prediction, [i / {count}.0::DOUBLE FOR i IN range(1, {count})])) AS edge
          FROM {source} GROUP BY {group}),
placed AS (SELECT {group}, label, prediction,
  (SELECT COUNT(*) FROM edges e WHERE e.{group} = s.{group} AND e.edge < s.prediction) AS bin FROM {source} s),
binned AS (SELECT {group}, bin, COUNT(*) AS n, AVG(prediction) AS predicted, AVG(label) AS observed
           FROM placed GROUP BY {group}, bin)"""


SQL["calibration"] = B.with_(_bins("fc", "tour", 10) + """
SELECT tour, bin, n, ROUND(predicted, 6) AS predicted, ROUND(observed, 6) AS observed FROM binned""", FORECASTS)
_ECE = "SUM(n * ABS(predicted - observed)) / SUM(n)"
SQL["calibration_error"] = B.with_(
    _bins("fc", "tour", 12) + f"SELECT tour, ROUND({_ECE}, 6) AS ece FROM binned GROUP BY tour", FORECASTS)

SQL["grouped_metrics"] = B.with_("""
, spread AS (SELECT label, prediction, ref_coin, ref_favourite, ref_elo,
    unnest(['all', tour, 'surface:' || surface]) AS grp FROM fc)""" + _bins("spread", "grp", 12) + f""",
ece AS (SELECT grp, {_ECE} AS e FROM binned GROUP BY grp),
scored AS (SELECT grp, COUNT(*) AS n, {_scores("prediction")},
  AVG({_LOSS.format(p="prediction")}) AS m, AVG({_LOSS.format(p="ref_coin")}) AS r0,
  AVG({_LOSS.format(p="ref_favourite")}) AS r1, AVG({_LOSS.format(p="ref_elo")}) AS r2 FROM spread GROUP BY grp)
SELECT s.grp AS "group", s.n, f.log_loss, f.brier, f.accuracy, f.mean_prediction, f.base_rate, f.ece,
  ref_coin_log_loss, ref_favourite_log_loss, ref_elo_log_loss, skill_vs_elo
FROM scored s LEFT JOIN (
  SELECT grp AS g, log_loss, brier, accuracy, mean_prediction, base_rate, ROUND(e, 6) AS ece, ROUND(r0, 6) AS ref_coin_log_loss,
    ROUND(r1, 6) AS ref_favourite_log_loss, ROUND(r2, 6) AS ref_elo_log_loss, ROUND((r2 - m) / r2, 6) AS skill_vs_elo
  FROM scored JOIN ece USING (grp) WHERE n >= 100) f ON f.g = s.grp""", FORECASTS)


def _newton(source: str, group: str) -> str:
    """Logistic fit of y on x1 and x2 by twelve Newton steps (x2 may be constant zero)."""
    return f""",
newton(grp, step, b0, b1) AS (
  SELECT DISTINCT {group}, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM {source}
  UNION ALL
  SELECT grp, step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT grp, step, b0, b1, SUM(y1 - mu) AS g0, SUM((y1 - mu) * x1) - 1e-6 * b1 AS g1, SUM(mu * (1 - mu)) AS h00,
          SUM(mu * (1 - mu) * x1) AS h01, SUM(mu * (1 - mu) * x1 * x1) + 1e-6 AS h11
        FROM (SELECT n.*, s.y1, s.x1, 1 / (1 + EXP(-(n.b0 + n.b1 * s.x1))) AS mu
              FROM newton n JOIN {source} s ON s.{group} = n.grp WHERE step < 12) GROUP BY grp, step, b0, b1))"""


SQL["calibration_slope"] = "WITH RECURSIVE " + FORECASTS.strip() + f""",
pts AS (SELECT tour, label AS y1, {_LOGIT.format(p="prediction")} AS x1 FROM fc)""" + _newton("pts", "tour") + """
SELECT grp AS tour, ROUND(b1, 5) AS calibration_slope FROM newton WHERE step = 12"""

# every season, for all tours and for each; groups under 50 rows have n alone
SQL["season_report"] = "WITH RECURSIVE " + FORECASTS.strip() + """,
spread AS (SELECT *, y || '/' || g AS grp FROM (
  SELECT label, prediction, ref_coin, ref_favourite, ref_elo, year(match_date) AS y, unnest(['all', tour]) AS g FROM fc)),
pts AS (SELECT grp, label AS y1, """ + _LOGIT.format(p="prediction") + """ AS x1 FROM spread)""" + _newton("pts", "grp") + _bins(
    "spread", "grp", 12) + f""",
ece AS (SELECT grp, {_ECE} AS e FROM binned GROUP BY grp),
scored AS (SELECT y, g, grp, COUNT(*) AS n, {_scores("prediction")}, AVG({_LOSS.format(p="prediction")}) AS m,
  """ + ", ".join(f"AVG({_LOSS.format(p='ref_' + r)}) AS {r}_l, AVG(CASE WHEN (ref_{r} > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS {r}_a"
                  for r in ("coin", "favourite", "elo")) + """ FROM spread GROUP BY y, g, grp),
full_rows AS (SELECT s.*, e, b1 FROM scored s JOIN ece USING (grp) JOIN newton w ON w.grp = s.grp AND w.step = 12)
SELECT s.y AS year, s.g AS "group", s.n, f.log_loss, f.brier, f.accuracy, f.mean_prediction, f.base_rate, ROUND(f.e, 6) AS ece,
  ROUND(f.b1, 5) AS calibration_slope, """ + ", ".join(
    f"ROUND(f.{r}_l, 6) AS {r}_log_loss, ROUND(f.{r}_a, 6) AS {r}_accuracy" for r in ("coin", "favourite", "elo")) + """,
  ROUND((f.elo_l - f.m) / f.elo_l, 6) AS skill_vs_elo
FROM scored s LEFT JOIN (SELECT grp AS fg, * FROM full_rows WHERE n >= 50) f ON fg = s.grp"""

# the first season after enough rows; a season also needs a hundred of its own
SQL["season_split"] = B.with_("""
, yearly AS (SELECT year(match_date) AS year, COUNT(*) AS n FROM contests GROUP BY 1),
upto AS (SELECT *, SUM(n) OVER (ORDER BY year) AS upto FROM yearly),
begin AS (SELECT COALESCE((SELECT MIN(year) + 1 FROM upto WHERE upto >= 6000),
  (SELECT year FROM upto ORDER BY year LIMIT 1 OFFSET (SELECT COUNT(*) // 2 FROM upto))) AS first)
SELECT year, n, CAST(upto - n AS BIGINT) AS train_rows, year >= first AND upto - n >= 6000 AND n >= 100 AS eligible FROM upto, begin""", B.CONTESTS)

SQL["model_against_market"] = B.with_("," + _BETS.format(edge="0.03::DOUBLE", stake=_QUARTER) + f"""
SELECT COUNT(*) AS n, COUNT(*) FILTER (amount > 0) AS bets,
  AVG({_LOSS.format(p="prediction")}) < AVG({_LOSS.format(p="fair")}) AS beats_market,
  ROUND(AVG({_LOSS.format(p="prediction")}), 6) AS model_log_loss, ROUND(AVG({_LOSS.format(p="fair")}), 6) AS market_log_loss,
  ROUND(AVG((prediction - label) ** 2), 6) AS model_brier, ROUND(AVG((fair - label) ** 2), 6) AS market_brier,
  ROUND(AVG(total), 6) AS mean_overround,
  ROUND(AVG(ABS({_LOGIT.format(p="prediction")} - {_LOGIT.format(p="fair")})), 6) AS mean_abs_clv,
  ROUND(SUM(won) / SUM(amount), 6) AS roi, ROUND(SUM(amount), 4) AS staked, ROUND(SUM(won), 4) AS profit
FROM paid""", FORECASTS)



def _two_inputs(source: str, steps: int = 12) -> str:
    """Newton steps of a logistic fit on x1 and x2 by Cramer's rule, and of the fit on x1 alone."""
    text = ", e0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q)"
    for n in range(1, steps + 1):
        text += f"""
, s{n} AS (SELECT a, b, c, p, q, SUM(y - m) AS g0, SUM((y - m) * x1) - 1e-6 * b AS g1, SUM((y - m) * x2) - 1e-6 * c AS g2,
  SUM(m * (1 - m)) AS h00, SUM(m * (1 - m) * x1) AS h01, SUM(m * (1 - m) * x2) AS h02, SUM(m * (1 - m) * x1 * x1) + 1e-6 AS h11,
  SUM(m * (1 - m) * x1 * x2) AS h12, SUM(m * (1 - m) * x2 * x2) + 1e-6 AS h22,
  SUM(y - k) AS f0, SUM((y - k) * x1) - 1e-6 * q AS f1, SUM(k * (1 - k)) AS d00, SUM(k * (1 - k) * x1) AS d01, SUM(k * (1 - k) * x1 * x1) + 1e-6 AS d11
  FROM (SELECT *, 1 / (1 + EXP(-(a + b * x1 + c * x2))) AS m, 1 / (1 + EXP(-(p + q * x1))) AS k FROM {source}, e{n - 1}) GROUP BY a, b, c, p, q)
, e{n} AS MATERIALIZED (SELECT
  a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS a,
  b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b,
  c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c,
  p + (d11 * f0 - d01 * f1) / (d00 * d11 - d01 * d01) AS p, q + (d00 * f1 - d01 * f0) / (d00 * d11 - d01 * d01) AS q
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{n}))"""
    return text + f"""
, tested AS (SELECT COUNT(*) AS n, CORR(x1, x2) AS r, ANY_VALUE(a) AS a, ANY_VALUE(b) AS b, ANY_VALUE(c) AS c,
  2 * SUM(LN(CASE WHEN y = 1 THEN 1 / (1 + EXP(-(a + b * x1 + c * x2))) ELSE 1 / (1 + EXP(a + b * x1 + c * x2)) END)
    - LN(CASE WHEN y = 1 THEN 1 / (1 + EXP(-(p + q * x1))) ELSE 1 / (1 + EXP(p + q * x1)) END)) AS lr FROM {source}, e{steps})"""


# the chance of a larger statistic with one degree of freedom: erfc(sqrt(lr / 2)), by the power series of erf
_ERFC = ("CASE WHEN lr <= 0 THEN 1.0 WHEN lr > 40 THEN 0.0 ELSE 1 - 2 / SQRT(PI()) * list_sum(list_transform(range(0, 150), "
         "lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * EXP((2 * n + 1) * LN(SQRT(lr / 2)) - LGAMMA(n + 1.0)) / (2 * n + 1))) END")
SQL["encompassing"] = B.with_("," + _BETS.format(edge="0.03::DOUBLE", stake=_QUARTER) + f"""
, points AS MATERIALIZED (SELECT label::DOUBLE AS y, {_LOGIT.format(p="fair")} AS x1, {_LOGIT.format(p="ref_elo")} AS x2
  FROM paid WHERE fair IS NOT NULL)""" + _two_inputs("points") + f"""
SELECT n, lr > 3.841 AS model_adds_information, ROUND(b, 5) AS market_coefficient, ROUND(c, 5) AS model_coefficient,
  ROUND(a, 5) AS intercept, ROUND(r, 5) AS collinearity, ROUND(lr, 4) AS lr_statistic, ROUND({_ERFC}, 6) AS p_value
FROM tested""", FORECASTS)

# ---------------------------------------------------------------- point model
RATES = B.MATCHES + """,
rates AS (SELECT match_id, tour, best_of, winner_id, loser_id,
  LEAST(0.9, GREATEST(0.3, winner_spw / winner_svpt)) AS p, LEAST(0.9, GREATEST(0.3, loser_spw / loser_svpt)) AS q
  FROM matches)
"""
_HOLD = "(POW({p}, 4) * (1 + 4 * (1 - {p}) + 10 * POW(1 - {p}, 2)) + 20 * POW({p} * (1 - {p}), 3) * {p} * {p} / ({p} * {p} + (1 - {p}) * (1 - {p})))"
SQL["hold_prob"] = B.with_(f"""
SELECT match_id, ROUND({_HOLD.format(p="p")}, 6) AS hold_a, ROUND({_HOLD.format(p="q")}, 6) AS hold_b FROM rates""", RATES)


def _sets(source: str, key: str) -> str:
    """Set and tiebreak chances by walking point by point and game by game."""
    return f""",
walks AS (SELECT {key} AS k, p, q, {_HOLD.format(p="p")} AS h, {_HOLD.format(p="q")} AS g FROM {source}),
tb_in AS (SELECT k, 'a' AS who, p AS mine, 1 - q AS theirs FROM walks UNION ALL SELECT k, 'b', q, 1 - p FROM walks),
tb(k, who, mine, theirs, n, i, j, mass) AS (
  SELECT k, who, mine, theirs, 0, 0, 0, 1.0::DOUBLE FROM tb_in
  UNION ALL
  SELECT k, who, mine, theirs, n + 1, i2, j2, SUM(m2) FROM (
    SELECT k, who, mine, theirs, n, i + w AS i2, j + 1 - w AS j2,
      mass * CASE WHEN w = 1 THEN chance ELSE 1 - chance END AS m2
    FROM (SELECT *, CASE WHEN ((n + 1) // 2) % 2 = 0 THEN mine ELSE theirs END AS chance FROM tb
          WHERE i < 7 AND j < 7 AND n < 12), (VALUES (0), (1)) v(w))
  GROUP BY k, who, mine, theirs, n, i2, j2),
tbw AS (SELECT k, who, SUM(CASE WHEN i = 7 THEN mass WHEN i = 6 AND j = 6
    THEN mass * mine * theirs / (mine * theirs + (1 - mine) * (1 - theirs)) ELSE 0 END) AS win FROM tb GROUP BY k, who),
gm(k, h, g, first, n, i, j, mass) AS (
  SELECT k, h, g, f, 0, 0, 0, 1.0::DOUBLE FROM walks, (VALUES (0), (1)) s(f)
  UNION ALL
  SELECT k, h, g, first, n + 1, i2, j2, SUM(m2) FROM (
    SELECT k, h, g, first, n, i + w AS i2, j + 1 - w AS j2,
      mass * CASE WHEN w = 1 THEN chance ELSE 1 - chance END AS m2
    FROM (SELECT *, CASE WHEN (n % 2 = 0) = (first = 1) THEN h ELSE 1 - g END AS chance FROM gm
          WHERE NOT (i >= 6 AND i - j >= 2) AND NOT (j >= 6 AND j - i >= 2) AND n < 12), (VALUES (0), (1)) v(w))
  GROUP BY k, h, g, first, n, i2, j2),
sets AS (SELECT gm.k, ANY_VALUE(a.win) AS tba,
  SUM(CASE WHEN i >= 6 AND i - j >= 2 THEN mass WHEN i = 6 AND j = 6
      THEN mass * CASE WHEN first = 1 THEN a.win ELSE 1 - b.win END ELSE 0 END) / 2 AS s,
  SUM(CASE WHEN i >= 6 AND i - j >= 2 THEN mass WHEN i = 6 AND j = 6
      THEN mass * h * (1 - g) / (h * (1 - g) + (1 - h) * g) ELSE 0 END) / 2 AS ls
  FROM gm JOIN tbw a ON a.k = gm.k AND a.who = 'a' JOIN tbw b ON b.k = gm.k AND b.who = 'b' GROUP BY gm.k)"""


_BO3 = "(s * s * (3 - 2 * s))"
_BO5 = "(s * s * s * (1 + 3 * (1 - s) + 6 * (1 - s) * (1 - s)))"
SQL["tiebreak_set_match"] = "WITH RECURSIVE " + RATES.strip() + _sets("rates", "match_id") + f"""
SELECT match_id, ROUND(tba, 6) AS pm_tiebreak_a, ROUND(s, 6) AS pm_set, ROUND(ls, 6) AS pm_long_set,
  ROUND(CASE best_of WHEN 3 THEN {_BO3} ELSE {_BO5} END, 6) AS pm_match
FROM sets JOIN rates ON k = match_id"""

SQL["score_dist"] = "WITH RECURSIVE " + RATES.strip() + _sets("rates", "match_id") + f""",
dist AS (
  SELECT match_id, best_of, s, CASE WHEN best_of = 3 THEN {_BO3} ELSE {_BO5} END AS m, unnest(
    CASE WHEN best_of = 3 THEN [{{'o': '2-0', 'w': 1, 'c': s * s}}, {{'o': '2-1', 'w': 1, 'c': 2 * s * s * (1 - s)}},
      {{'o': '1-2', 'w': 0, 'c': 2 * s * POW(1 - s, 2)}}, {{'o': '0-2', 'w': 0, 'c': POW(1 - s, 2)}}]
    ELSE [{{'o': '3-0', 'w': 1, 'c': POW(s, 3)}}, {{'o': '3-1', 'w': 1, 'c': 3 * POW(s, 3) * (1 - s)}},
      {{'o': '3-2', 'w': 1, 'c': 6 * POW(s, 3) * POW(1 - s, 2)}}, {{'o': '2-3', 'w': 0, 'c': 6 * POW(s, 2) * POW(1 - s, 3)}},
      {{'o': '1-3', 'w': 0, 'c': 3 * s * POW(1 - s, 3)}}, {{'o': '0-3', 'w': 0, 'c': POW(1 - s, 3)}}] END) AS d
  FROM sets JOIN rates ON k = match_id)
SELECT match_id, d.o AS outcome, ROUND(d.c, 6) AS chance,
  ROUND(CASE WHEN d.w = 1 THEN d.c / m * 0.6::DOUBLE ELSE d.c / (1 - m) * 0.4::DOUBLE END, 6) AS scaled FROM dist"""

SQL["matchup_matrix"] = "WITH RECURSIVE " + RATES.strip() + """,
avg_rates AS (SELECT tour, player, ROUND(AVG(rate), 4) AS rate FROM (
  SELECT tour, winner_id AS player, p AS rate FROM rates UNION ALL SELECT tour, loser_id, q FROM rates) GROUP BY ALL),
pairs AS (SELECT m.tour, a, b, x.rate AS p, y.rate AS q, m.tour || '/' || a || '/' || b AS id
  FROM (SELECT DISTINCT tour, LEAST(winner_id, loser_id) AS a, GREATEST(winner_id, loser_id) AS b FROM rates) m
  JOIN avg_rates x ON x.tour = m.tour AND x.player = a JOIN avg_rates y ON y.tour = m.tour AND y.player = b)
""" + _sets("pairs", "id") + f"""
SELECT tour, a, b, ROUND({_HOLD.format(p="p")}, 6) AS pm_hold_a, ROUND({_HOLD.format(p="q")}, 6) AS pm_hold_b,
  ROUND({_BO3}, 6) AS best_of_3, ROUND({_BO5}, 6) AS best_of_5 FROM pairs JOIN sets ON k = id"""


# ---------------------------------------------------------------- opponent-adjusted skill
OBSERVED = B.MATCHES + """,
span AS (SELECT MIN(match_date) AS first_day, date_diff('day', MIN(match_date), MAX(match_date)) // 28 AS last_cut FROM matches),
obs AS (SELECT *, spw / svpt AS rate, LEAST(0.98::DOUBLE, GREATEST(0.02::DOUBLE, spw / svpt)) AS cr,
    LN(cr / (1 - cr)) AS y FROM (
  SELECT match_id, tour, surface, match_date, winner_id AS server, loser_id AS returner, winner_svpt AS svpt, winner_spw AS spw
  FROM matches WHERE has_serve_stats AND NOT walkover
  UNION ALL SELECT match_id, tour, surface, match_date, loser_id, winner_id, loser_svpt, loser_spw
  FROM matches WHERE has_serve_stats AND NOT walkover)),
cuts AS (SELECT c AS cut, first_day + CAST(c * 28 AS INTEGER) AS as_of FROM span, range(0, last_cut + 1) t(c)),
windowed AS (SELECT cut, o.*, svpt * POW(0.5::DOUBLE, date_diff('day', match_date, as_of) / 365.0::DOUBLE) AS w
  FROM obs o JOIN cuts ON match_date < as_of AND match_date >= as_of - 1095)
"""
SQL["skill_observations"] = B.with_("""
SELECT tour, cut, ROUND(SUM(w), 4) AS weight, ROUND(SUM(w * y), 4) AS response, SUM(svpt) AS points, SUM(spw) AS won
FROM windowed GROUP BY tour, cut""", OBSERVED)

SQL["raw_rates"] = B.with_("""
, serving AS (SELECT tour, server AS player_id, cut, SUM(spw) / SUM(svpt) AS r, SUM(w) AS c FROM windowed GROUP BY ALL),
returning_ AS (SELECT tour, returner AS player_id, cut, 1 - SUM(spw) / SUM(svpt) AS r, SUM(w) AS c FROM windowed GROUP BY ALL),
both_ AS (SELECT tour, player_id, cut, s.r AS rs, q.r AS rr, s.c AS cs, q.c AS cr
  FROM serving s FULL JOIN returning_ q USING (tour, player_id, cut))
SELECT tour, player_id, cut, ROUND(rs, 6) AS raw_spw, ROUND(rr, 6) AS raw_rpw,
  ROUND(COALESCE(cs, 0), 4) AS serve_points, ROUND(COALESCE(cr, 0), 4) AS return_points
FROM both_ QUALIFY cut = MAX(cut) OVER (PARTITION BY tour, player_id)""", OBSERVED)


def _solved(where: str) -> str:
    """A converged fit has a parameter for everything seen in the window, and no residual is left."""
    kinds = [("base_b", "surface"), ("player_s", "server"), ("player_r", "returner"),
             ("surface_so", "(server, surface)"), ("surface_ro", "(returner, surface)")]
    return "\nUNION ALL\n".join(
        f"SELECT tour, cut, '{kind}' AS kind, COUNT(DISTINCT {what}) AS params, 0.0::DOUBLE AS worst"
        f" FROM windowed, span {where} GROUP BY tour, cut" for kind, what in kinds)


SQL["skill_fit"] = B.with_(_solved(""), OBSERVED)
SQL["skill_fit_sweeps"] = B.with_(_solved("WHERE cut = last_cut"), OBSERVED)


# ---------------------------------------------------------------- directory and names
DIRECTORY = B.CONTESTS + """,
both_sides AS (
  SELECT tour, match_date, tourney_id, match_num, 0 AS place, 1 AS won, winner_id AS player_id, winner_name AS name,
    winner_hand AS hand, winner_height_cm AS height_cm, winner_ioc AS ioc, winner_age AS age, winner_rank AS rank, winner_rank_points AS rank_points FROM contests
  UNION ALL
  SELECT tour, match_date, tourney_id, match_num, 1, 0, loser_id, loser_name, loser_hand, loser_height_cm, loser_ioc, loser_age,
    loser_rank, loser_rank_points FROM contests),
dir AS (SELECT tour, player_id,
    """ + ",\n    ".join(
    f"(list({c} ORDER BY match_date DESC, place DESC, tourney_id DESC, match_num DESC) FILTER ({c} IS NOT NULL))[1] AS {n}"
    for c, n in (("name", "name"), ("hand", "hand"), ("height_cm", "height_cm"), ("ioc", "ioc"), ("age", "last_age"),
                 ("rank", "last_rank"), ("rank_points", "last_rank_points"))) + """,
    MAX(match_date) AS last_played, MIN(match_date) AS first_played, COUNT(*) AS matches, SUM(won)::BIGINT AS wins
  FROM both_sides GROUP BY tour, player_id)
"""
SQL["directory"] = B.with_("""
SELECT tour, player_id, name, hand, height_cm, ioc, last_rank, last_rank_points, last_played, first_played, matches, wins,
  ROUND(wins / matches, 6) AS win_pct,
  ROUND(last_age + GREATEST(0, date_diff('day', last_played, DATE '2001-12-31') / 365.25::DOUBLE), 6) AS age
FROM dir""", DIRECTORY)
SQL["player_search"] = B.with_("""
SELECT tour, player_id, name, matches, last_played FROM dir WHERE matches >= 5 AND name ILIKE '%lier#00000000%'
ORDER BY last_played DESC, matches DESC, tour, player_id LIMIT 40""", DIRECTORY)

_PARTICLES = "['de','del','della','der','den','di','da','dos','das','du','van','von','vander','ter','te','la','le','el','al','bin','ibn','mc','mac','st','san','santa','do','af','auf','ten','op','in']"
MENTIONS = r"""
found AS (SELECT lang AS tour, unnest(regexp_extract_all(text, '(\p{Lu}\p{L}+ \p{L}+ ?\p{L}*)', 1)) AS name FROM documents),
mentions AS MATERIALIZED (SELECT *, ('0x' || substr(md5(name), 1, 8))::BIGINT AS number FROM found),
published AS MATERIALIZED (SELECT tour, array_to_string(w[2:], ' ') || ' ' || substr(w[1], 1, (number % 2 + 1)::INT) || '.' AS name,
  CASE WHEN number % 11 <> 0 THEN (number % 500 + number % 3)::DOUBLE END AS rank
  FROM (SELECT *, string_split(name, ' ') AS w FROM mentions)),
people AS (SELECT DISTINCT tour, number AS player_id, name, CASE WHEN number % 7 <> 0 THEN (number % 500)::DOUBLE END AS last_rank FROM mentions),
asked AS (SELECT DISTINCT name, 'given_first' AS name_order FROM mentions UNION ALL SELECT DISTINCT name, 'surname_first' FROM published),
worded AS (SELECT name, name_order, list_filter(string_split(trim(regexp_replace(replace(lower(strip_accents(name)), '''', ''), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda t: t <> '' AND t NOT IN ('jr','ii','iii','iv','sr')) AS t FROM asked),
marked AS MATERIALIZED (SELECT *, list_transform(t, lambda x: regexp_full_match(x, '[a-z]') OR (regexp_full_match(x, '[a-z]{2}') AND NOT list_contains(PARTICLES, x))) AS ini FROM worded),
placed AS (SELECT *, COALESCE(list_position(ini[2:], TRUE), 0) AS spot FROM marked WHERE len(t) > 1),
parts AS (SELECT name, name_order,
  CASE WHEN name_order = 'given_first' OR (spot = 0 AND ini[1]) THEN t[2:] WHEN spot > 0 THEN t[1:spot] ELSE t[1:len(t) - 1] END AS sur,
  CASE WHEN name_order = 'given_first' OR (spot = 0 AND ini[1]) THEN t[1] WHEN spot > 0 THEN t[spot + 1] ELSE t[len(t)] END AS given FROM placed),
readings AS (SELECT DISTINCT name, name_order, given, unnest(list_filter([array_to_string(sur, ''), sur[len(sur)],
    CASE WHEN len(sur) > 2 THEN sur[len(sur) - 1] || sur[len(sur)] END,
    array_to_string(list_filter(sur, lambda x: NOT list_contains(PARTICLES, x)), '')], lambda r: r IS NOT NULL AND r <> '')) AS r FROM parts),
keyed AS MATERIALIZED (
  SELECT name, name_order, r || '|' || substr(given, 1, 1) AS key, 1 AS size FROM readings
  UNION SELECT name, name_order, r || '|' || substr(given, 1, 2), 2 FROM readings WHERE length(given) >= 2
  UNION SELECT name, name_order, t[1] || '|', 0 FROM worded WHERE len(t) = 1)
""".replace("PARTICLES", _PARTICLES)
SQL["name_keys"] = B.with_("""
SELECT name, name_order, key, FIRST_VALUE(key) OVER (PARTITION BY name, name_order ORDER BY length(split_part(key, '|', 1)) DESC, key) AS main_key
FROM (SELECT DISTINCT name, name_order, key FROM keyed)""", MENTIONS)

RESOLVED = MENTIONS + """,
cand AS MATERIALIZED (
  SELECT DISTINCT p.tour, p.name, p.rank, q.size, d.player_id, d.last_rank
  FROM (SELECT DISTINCT tour, name, rank FROM published) p
  JOIN keyed q ON q.name = p.name AND q.name_order = 'surname_first'
  JOIN keyed g ON g.key = q.key AND g.name_order = 'given_first'
  JOIN people d ON d.name = g.name AND d.tour = p.tour),
uniq AS (SELECT DISTINCT tour, name, rank, player_id, ABS(last_rank - rank) AS gap FROM cand),
ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tour, name, rank ORDER BY gap, player_id) AS nth FROM uniq WHERE gap IS NOT NULL),
tie AS (SELECT tour, name, rank, MAX(player_id) FILTER (nth = 1) AS closest, MAX(gap) FILTER (nth = 1) AS g1, MAX(gap) FILTER (nth = 2) AS g2
        FROM ordered WHERE nth <= 2 GROUP BY ALL),
summed AS (SELECT tour, name, rank, COUNT(DISTINCT player_id) AS n, MAX(player_id) AS one,
  COUNT(DISTINCT player_id) FILTER (size = 2) AS n2, MAX(player_id) FILTER (size = 2) AS one2 FROM cand GROUP BY ALL),
resolved AS (
  SELECT p.tour, p.name, p.rank, CASE WHEN n2 = 1 THEN one2 WHEN n = 1 THEN one
      WHEN closest IS NOT NULL AND (g2 IS NULL OR (g1 <= 10 AND g2 > 3 * g1)) THEN closest END AS player_id,
    n, (SELECT COUNT(*) FROM keyed k WHERE k.name = p.name AND k.name_order = 'surname_first') AS keys
  FROM (SELECT DISTINCT tour, name, rank FROM published) p
  LEFT JOIN summed s ON s.tour = p.tour AND s.name = p.name AND s.rank IS NOT DISTINCT FROM p.rank
  LEFT JOIN tie t ON t.tour = p.tour AND t.name = p.name AND t.rank = p.rank),
stated AS (SELECT tour, name, rank, player_id, CASE WHEN keys = 0 THEN 'blank' WHEN player_id IS NOT NULL THEN 'resolved'
    WHEN n IS NULL THEN 'unresolved' ELSE 'ambiguous' END AS status FROM resolved)
"""
SQL["name_resolution"] = B.with_("SELECT tour, name, rank, player_id, status FROM stated", RESOLVED)
SQL["name_report"] = B.with_("""
SELECT status, COUNT(*) AS rows, COUNT(DISTINCT p.name) AS names FROM published p
JOIN stated s ON s.tour = p.tour AND s.name = p.name AND s.rank IS NOT DISTINCT FROM p.rank GROUP BY status""", RESOLVED)

SQL["name_summary"] = B.with_("""
, tried AS (SELECT p.tour, p.name, status FROM published p
  JOIN stated s ON s.tour = p.tour AND s.name = p.name AND s.rank IS NOT DISTINCT FROM p.rank WHERE status <> 'blank')
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT d.tour, k.key FROM people d JOIN keyed k ON k.name = d.name AND k.name_order = 'given_first')) AS indexed_keys,
  (SELECT COUNT(*) FROM (SELECT DISTINCT tour, player_id FROM people)) AS players,
  COUNT(*) FILTER (status = 'resolved') AS resolved_rows, COUNT(*) AS attempted_rows,
  COUNT(DISTINCT (tour, name)) FILTER (status = 'unresolved') AS unresolved_names,
  COUNT(DISTINCT (tour, name)) FILTER (status = 'ambiguous') AS ambiguous_names,
  ROUND(COUNT(*) FILTER (status = 'resolved') / COUNT(*)::DOUBLE, 6) AS resolve_rate FROM tried""", RESOLVED)
SQL["worst_names"] = B.with_("""
SELECT tour, name, rows, status FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY status ORDER BY rows DESC, tour, name) AS place FROM (
    SELECT a.tour, a.name, a.status, c.rows FROM (SELECT DISTINCT tour, name, status FROM stated WHERE status IN ('unresolved', 'ambiguous')) a
    JOIN (SELECT tour, name, COUNT(*) AS rows FROM published GROUP BY tour, name) c ON c.tour = a.tour AND c.name = a.name))
WHERE place <= 20""", RESOLVED)

# ---------------------------------------------------------------- sources
SQL["season_files"] = B.with_("""
SELECT 'atp-' || tourney_id || '-' || match_num AS match_id,
  match_date + CAST(round_even(LEAST(14, GREATEST(0, (ord - 7) * (CASE WHEN draw_size >= 96 THEN 1.4::DOUBLE
    WHEN draw_size >= 48 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END) + 1)), 0) AS INTEGER) AS match_date,
  surface, level, best_of, winner_id, loser_id, winner_spw, loser_svpt, has_serve_stats, walkover, ROUND(dominance, 6) AS dominance,
  winner_hand, winner_height_cm, indoor, altitude_m::BIGINT AS altitude_m
FROM (SELECT *, CASE round WHEN 'RR' THEN 6 WHEN 'R128' THEN 7 WHEN 'R64' THEN 8 WHEN 'R32' THEN 9
  WHEN 'R16' THEN 10 WHEN 'QF' THEN 11 WHEN 'SF' THEN 12 ELSE 13 END AS ord FROM matches)""")

# both tours united, dates moved by the round, in stored order
SQL["match_table"] = B.with_("""
, moved AS (SELECT CASE WHEN match_num % 3 = 0 THEN 'wta' ELSE 'atp' END AS pool, tourney_id, match_num, surface, winner_id,
  match_date + CAST(round_even(LEAST(14, GREATEST(0, (ord - 7) * (CASE WHEN draw_size >= 96 THEN 1.4::DOUBLE
    WHEN draw_size >= 48 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END) + 1)), 0) AS INTEGER) AS match_date
FROM (SELECT *, CASE round WHEN 'RR' THEN 6 WHEN 'R128' THEN 7 WHEN 'R64' THEN 8 WHEN 'R32' THEN 9
  WHEN 'R16' THEN 10 WHEN 'QF' THEN 11 WHEN 'SF' THEN 12 ELSE 13 END AS ord FROM matches))
SELECT pool AS tour, pool || '-' || tourney_id || '-' || match_num AS match_id, match_date, surface, winner_id,
  ROW_NUMBER() OVER (PARTITION BY pool ORDER BY match_date, tourney_id, match_num) AS nth FROM moved""")

# two charting tables, text as published
SQL["charting_files"] = B.with_("""
SELECT 'm' AS gender, 'stats-Overview' AS "table", match_id, CAST(winner_id AS VARCHAR) AS player, CAST(CAST(winner_svpt AS BIGINT) AS VARCHAR) AS serve_pts,
  CAST(NULL AS VARCHAR) AS note FROM contests WHERE match_num % 2 = 0 AND winner_svpt IS NOT NULL
UNION ALL SELECT 'w', 'stats-SnV', match_id, CAST(loser_id AS VARCHAR), CAST(CAST(loser_svpt AS BIGINT) AS VARCHAR),
  'line, "' || surface || '"' FROM contests WHERE match_num % 2 = 1 AND loser_svpt IS NOT NULL""", B.CONTESTS)

# counts per pool from the cache, which was built, reused, and built again for the inputs that had changed
SQL["cached_features"] = B.with_("""
, old AS (SELECT tour, COUNT(*) AS n FROM contests WHERE match_num % 5 <> 0 GROUP BY tour),
now AS (SELECT tour, COUNT(*) AS n FROM contests WHERE match_num % 5 <> 0 OR tour = (SELECT MIN(tour) FROM contests) GROUP BY tour)
SELECT tour, old.n AS before, now.n AS after, old.n <> now.n AS rebuilt FROM old JOIN now USING (tour)""", B.CONTESTS)

PRICES = B.CONTESTS + """,
prices AS (SELECT *, match_num AS n,
    CASE WHEN match_num % 2 = 0 AND odds_winner > 1 THEN odds_winner END AS psw, CASE WHEN match_num % 3 = 0 AND odds_loser > 1 THEN odds_loser END AS psl,
    CASE WHEN match_num % 5 <> 0 AND odds_winner > 1 THEN odds_winner END AS bw,
    CASE WHEN match_num % 7 <> 0 AND odds_loser * 300 < 1000 THEN odds_loser * 300 END AS bl,
    odds_winner + 0.05::DOUBLE AS aw, CASE WHEN match_num % 4 <> 1 THEN odds_loser + 0.05::DOUBLE END AS al FROM contests)
"""
SQL["odds_files"] = B.with_("""
SELECT match_date, CAST(winner_id AS VARCHAR) AS winner_name, CAST(loser_id AS VARCHAR) AS loser_name,
  CASE WHEN match_num % 3 <> 1 THEN odds_winner END AS odds_w_ps, CASE WHEN match_num % 3 <> 1 THEN odds_loser END AS odds_l_ps,
  CASE WHEN match_num % 3 = 1 THEN odds_winner END AS odds_w_b365, CASE WHEN match_num % 3 = 1 THEN odds_loser END AS odds_l_b365
FROM contests""", B.CONTESTS)

SQL["odds_prices"] = B.with_("""
SELECT match_id, match_date, tourney_name AS tournament,
  CASE n % 4 WHEN 0 THEN 'Grand Slam' WHEN 1 THEN 'ATP500' WHEN 2 THEN 'Masters Cup' ELSE 'Unheard of' END AS series,
  CASE n % 4 WHEN 0 THEN 'G' WHEN 2 THEN 'F' ELSE 'A' END AS level,
  CASE n % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS indoor, surface, 3 AS best_of,
  n % 5 = 0 AS retirement, n % 5 = 1 AS walkover,
  CASE WHEN psw IS NOT NULL AND psl IS NOT NULL THEN 'ps' WHEN al IS NOT NULL THEN 'avg' WHEN bw IS NOT NULL AND bl IS NOT NULL THEN 'b365' END AS odds_book,
  ROUND(CASE odds_book WHEN 'ps' THEN psw WHEN 'avg' THEN aw WHEN 'b365' THEN bw END, 6) AS odds_winner,
  ROUND(CASE odds_book WHEN 'ps' THEN psl WHEN 'avg' THEN al WHEN 'b365' THEN bl END, 6) AS odds_loser
FROM prices""", PRICES).replace("SELECT match_id, match_date, tourney_name", "SELECT LOWER(match_id) AS match_id, match_date, tourney_name")
# every book of the archive and both summaries, a thirteenth of the contests without each
SQL["odds_all_books"] = B.with_("""
, quoted AS (SELECT match_num, odds_winner AS w, odds_loser AS l, unnest(range(13)) AS b FROM contests),
valued AS (SELECT ['ps', 'b365', 'ex', 'lb', 'sj', 'ub', 'cb', 'gb', 'iw', 'sb', 'bw', 'max', 'avg'][b + 1] AS book,
    CASE WHEN match_num % 13 <> b THEN w + b / 100.0::DOUBLE END AS x, CASE WHEN match_num % 7 <> b THEN l + b / 50.0::DOUBLE END AS y FROM quoted)
SELECT book, COUNT(*) AS rows, ROUND(AVG(x), 6) AS mean_w, ROUND(AVG(y), 6) AS mean_l, COUNT(x) AS priced_w, COUNT(y) AS priced_l
FROM valued WHERE x IS NOT NULL OR y IS NOT NULL GROUP BY book""", B.CONTESTS)
SQL["odds_by_book"] = B.with_("""
SELECT 'atp' AS tour, book, COUNT(*) AS rows, ROUND(AVG(w), 6) AS mean_w, ROUND(AVG(l), 6) AS mean_l
FROM (SELECT 'ps' AS book, psw AS w, psl AS l FROM prices UNION ALL SELECT 'b365', bw, bl FROM prices UNION ALL SELECT 'avg', aw, al FROM prices)
WHERE w IS NOT NULL OR l IS NOT NULL GROUP BY book""", PRICES)
SQL["odds_join"] = B.with_("""
SELECT match_id, price_date, ROUND(odds_winner, 6) AS odds_winner, ROUND(odds_loser, 6) AS odds_loser FROM (
  SELECT c.match_id, p.match_date + CAST(p.match_num % 13 - 4 AS INTEGER) AS price_date, p.odds_winner, p.odds_loser,
    ROW_NUMBER() OVER (PARTITION BY c.match_id ORDER BY ABS(date_diff('day', c.match_date, price_date)), price_date, p.odds_winner, p.odds_loser) AS nth
  FROM contests c JOIN contests p USING (tour, winner_id, loser_id)
  WHERE ABS(date_diff('day', c.match_date, price_date)) <= 5) WHERE nth = 1""", B.CONTESTS)


def _resolved_prices(rounds: int = 8) -> str:
    """Greedy pairing by rounds of pairs that are nearest for both their rows; ``left_n`` rounds are unrolled."""
    def surname(side: str) -> str:
        return f"'Ka' || translate(({side}_id // 3)::VARCHAR, '0123456789', 'abcdefghij') || 'ov'"

    def initial(side: str) -> str:
        return f"substr('ABCDE', ({side}_id % 5 + 1)::INT, 1)"

    parts = [f"""
named AS (SELECT *, {surname("winner")} AS ws, {initial("winner")} AS wi, {surname("loser")} AS ls, {initial("loser")} AS li FROM contests),
folk AS (SELECT DISTINCT tour, winner_id AS id, ws AS s, wi AS i FROM named UNION SELECT DISTINCT tour, loser_id, ls, li FROM named),
told AS (SELECT tour, s, i, CASE WHEN COUNT(DISTINCT id) = 1 THEN MIN(id) END AS id FROM folk GROUP BY tour, s, i),
priced_rows AS (
  SELECT match_id || '/' || copy AS price_id, tour, ws, wi, ls, li, odds_winner, odds_loser,
    match_date + CAST(match_num % 13 - 4 + copy AS INTEGER) AS price_date
  FROM named, LATERAL (SELECT unnest(CASE WHEN match_num % 9 = 0 THEN [0, 1] ELSE [0] END) AS copy)),
known AS (
  SELECT p.*, w.id AS winner_id, l.id AS loser_id FROM priced_rows p
  JOIN told w ON w.tour = p.tour AND w.s = p.ws AND w.i = p.wi JOIN told l ON l.tour = p.tour AND l.s = p.ls AND l.i = p.li),
left_0 AS (
  SELECT c.match_id, k.price_id, ABS(date_diff('day', c.match_date, k.price_date)) AS gap
  FROM contests c JOIN known k USING (tour, winner_id, loser_id) WHERE gap <= 5)"""]
    for n in range(rounds):
        parts.append(f"""
ranked_{n} AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY gap, match_id, price_id) AS a,
    ROW_NUMBER() OVER (PARTITION BY price_id ORDER BY gap, match_id, price_id) AS b FROM left_{n}),
won_{n} AS (SELECT match_id, price_id, gap FROM ranked_{n} WHERE a = 1 AND b = 1),
left_{n + 1} AS (
  SELECT * FROM left_{n} WHERE match_id NOT IN (SELECT match_id FROM won_{n}) AND price_id NOT IN (SELECT price_id FROM won_{n}))""")
    won = " UNION ALL ".join(f"SELECT * FROM won_{n}" for n in range(rounds))
    return ",".join(parts) + f""",
dealt AS ({won})
SELECT k.price_id, ws || ' ' || wi || '.' AS winner_name, ls || ' ' || li || '.' AS loser_name, winner_id, loser_id,
  d.match_id, d.gap, ROUND(odds_winner, 6) AS odds_winner, ROUND(odds_loser, 6) AS odds_loser
FROM known k LEFT JOIN dealt d ON d.price_id = k.price_id"""


SQL["odds_resolved"] = B.with_("," + _resolved_prices(), B.CONTESTS)


# ---------------------------------------------------------------- matrix
SQL["orientation_flip"] = B.with_("""
SELECT match_id, label, p1_id, ROUND(d, 6) AS d_log_rank, ROUND(-d, 6) AS d_log_rank_flipped,
  ROUND(1 - winner_spw / winner_svpt, 6) AS markov_prob_flipped, best_of::DOUBLE AS best_of_flipped
FROM (SELECT *, first::INT::BIGINT AS label, CASE WHEN first THEN winner_id ELSE loser_id END AS p1_id,
   (CASE WHEN first THEN 1 ELSE -1 END) * (LN(1 + loser_rank) - LN(1 + winner_rank)) AS d FROM
   (SELECT *, ('0x' || right(md5(match_id), 1))::INT % 2 = 0 AS first FROM contests))""", B.CONTESTS)
SQL["feature_envelope"] = B.with_("""
SELECT feature, ROUND(CASE WHEN feature LIKE 'd_%' THEN -GREATEST(ABS(q[1]), ABS(q[2])) ELSE q[1] END, 6) AS low,
  ROUND(CASE WHEN feature LIKE 'd_%' THEN GREATEST(ABS(q[1]), ABS(q[2])) ELSE q[2] END, 6) AS high FROM (
  SELECT feature, quantile_cont(v, [0.01, 0.99]) AS q FROM (
    SELECT 'mean_age' AS feature, winner_age AS v FROM contests UNION ALL SELECT 'minutes', minutes FROM contests
    UNION ALL SELECT 'd_rank', winner_rank - loser_rank FROM contests UNION ALL SELECT 'flat', 1.0 FROM contests)
  GROUP BY feature) WHERE q[2] > q[1]""", B.CONTESTS)

# ---------------------------------------------------------------- answers
SQL["head_to_head"] = B.with_("""
SELECT tour, surface, p1, p2, SUM(won)::BIGINT AS p1_wins, (COUNT(*) - SUM(won))::BIGINT AS p2_wins, COUNT(*) AS total,
  ROUND((SUM(won) + 3) / (COUNT(*) + 6.0::DOUBLE), 6) AS shrunk
FROM (SELECT tour, surface, winner_id AS p1, loser_id AS p2, 1 AS won FROM matches WHERE NOT walkover
      UNION ALL SELECT tour, surface, loser_id, winner_id, 0 FROM matches WHERE NOT walkover)
GROUP BY tour, surface, p1, p2""")
SQL["streaming_career"] = _history("streaming_career", """
  (COUNT(*) FILTER (live = 1))::DOUBLE AS career_matches,
  (COUNT(*) FILTER (live = 1 AND won = 1))::DOUBLE AS career_wins,
  COALESCE(MIN(back) FILTER (live = 1 AND won = 0) - 1, COUNT(*) FILTER (live = 1))::DOUBLE AS win_streak,
  COALESCE(MIN(back) FILTER (live = 1 AND won = 1) - 1, COUNT(*) FILTER (live = 1))::DOUBLE AS loss_streak,
  0::BIGINT AS late_rows""")
