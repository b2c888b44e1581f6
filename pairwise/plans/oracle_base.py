"""SQL for DuckDB that derives the contests and the match table independently."""

from __future__ import annotations

from pairwise.sources.contests import EVENT_COLUMNS, PLAYER_COLUMNS

SIDES = """
sides AS (
  SELECT l_orderkey AS ok, l_suppkey AS sk,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt,
         CAST(SUM(l_quantity) AS DOUBLE) AS svpt,
         CAST(FLOOR(SUM(CAST(l_quantity AS DECIMAL(18,2)) * CAST(0.5 + 2 * l_tax AS DECIMAL(6,2)))) AS DOUBLE) AS spw,
         CAST(COUNT(*) AS DOUBLE) AS bp_faced,
         CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS bp_saved
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ok ORDER BY amt DESC, sk) AS rn FROM sides)
"""


def _player(side: str, alias: str) -> str:
    parts = [f"CAST({alias}.sk AS BIGINT) AS {side}_id"]
    for name, sql in PLAYER_COLUMNS.items():
        for field in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"):
            sql = sql.replace(field, f"s{alias}.{field}")
        parts.append(f"{sql} AS {side}_{name}")
    parts += [f"{alias}.{n} AS {side}_{n}" for n in ("svpt", "spw", "bp_faced", "bp_saved")]
    return ", ".join(parts)


CONTESTS = SIDES + f""",
contests AS (
  SELECT {", ".join(f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items())},
         {_player("winner", "w")}, {_player("loser", "l")}
  FROM orders o
  JOIN customer ON o.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN ranked w ON w.ok = o.o_orderkey AND w.rn = 1
  JOIN ranked l ON l.ok = o.o_orderkey AND l.rn = 2
  JOIN supplier sw ON sw.s_suppkey = w.sk JOIN supplier sl ON sl.s_suppkey = l.sk)
"""

# Worked out by hand for the strings the contests carry.
SCORES = """
score_rows(score_text, wg, lg, ws, ls, sets, tb, wtb, decider, ret, wo, completed) AS (VALUES
  ('6-4 6-3',              12, 7, 2, 0, 2, 0, 0, FALSE, FALSE, FALSE, TRUE),
  ('7-6(5) 6-7(3) 7-6(4)', 20, 19, 2, 1, 3, 3, 2, TRUE, FALSE, FALSE, TRUE),
  ('6-2 2-0 RET',          8, 2, 1, 0, 2, 0, 0, FALSE, TRUE, FALSE, FALSE),
  ('W/O',                  0, 0, 0, 0, 0, 0, 0, FALSE, FALSE, TRUE, FALSE),
  ('6-3 6-7(5) [10-8]',    13, 10, 2, 1, 3, 2, 1, TRUE, FALSE, FALSE, TRUE),
  ('7-5 6-7(4) 7-6(10-8)', 20, 18, 2, 1, 3, 2, 1, TRUE, FALSE, FALSE, TRUE),
  ('6-0 6-0',              12, 0, 2, 0, 2, 0, 0, FALSE, FALSE, FALSE, TRUE),
  ('6-4 3-6 7-5',          16, 15, 2, 1, 3, 0, 0, TRUE, FALSE, FALSE, TRUE),
  ('6-1 6-2',              12, 3, 2, 0, 2, 0, 0, FALSE, FALSE, FALSE, TRUE),
  ('60-0 6-4 6-4',         12, 8, 2, 0, 2, 0, 0, FALSE, FALSE, FALSE, TRUE),
  ('6-7(5) 6-3 6-4',       18, 14, 2, 1, 3, 1, 0, TRUE, FALSE, FALSE, TRUE))
"""

VENUES = """
venue_rows(venue, roof, metres, host_code) AS (VALUES
  ('Roland Garros', FALSE, 0, 'FRA'), ('Madrid Masters', FALSE, 667, 'ESP'),
  ('Bogota', FALSE, 2640, 'COL'), ('Quito', FALSE, 2850, 'ECU'),
  ('Wimbledon', FALSE, 0, 'GBR'), ('Paris Masters', TRUE, 0, 'FRA'),
  ('Rotterdam', TRUE, 0, 'NED'), ('Mexico City', FALSE, 2240, 'MEX'),
  ('Neutral Court', FALSE, 0, NULL), ('Monte Carlo Masters', FALSE, 0, 'MON'),
  ('Lyon', FALSE, 0, 'FRA'), ('Lyon Indoor', TRUE, 0, 'FRA'),
  ('St. Petersburg', TRUE, 0, 'RUS'), ('''s-Hertogenbosch', FALSE, 0, 'NED'),
  ('Queen''s Club', FALSE, 0, NULL), ('US Open', FALSE, 0, 'USA'),
  ('Indian Wells Masters', FALSE, 0, 'USA'), ('Kitzbuhel', FALSE, 762, 'AUT'),
  ('Stuttgart', TRUE, 0, 'GER'), ('Canada Masters', FALSE, 0, 'CAN'),
  ('Bogota Open', FALSE, 2640, 'COL'), ('Tokyo', FALSE, 0, 'JPN'),
  ('Nur-Sultan', TRUE, 0, 'KAZ'), ('Sao Paulo', FALSE, 760, 'BRA'),
  ('Acapulco', FALSE, 0, 'MEX'))
"""

MATCHES = CONTESTS + "," + SCORES + "," + VENUES + """,
matches AS (
  SELECT c.*,
    CASE level WHEN 'G' THEN 1.0::DOUBLE WHEN 'M' THEN 0.95::DOUBLE WHEN 'A' THEN 0.9::DOUBLE
         WHEN 'C' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS level_weight,
    COALESCE(ret, FALSE) AS retirement, COALESCE(wo, FALSE) AS walkover,
    COALESCE(completed, FALSE) AS completed, COALESCE(sets, 0) AS sets_played,
    COALESCE(decider, FALSE) AS went_to_decider, COALESCE(tb, 0) AS tiebreaks_played,
    COALESCE(wg, 0) AS winner_games_won, COALESCE(lg, 0) AS loser_games_won,
    COALESCE(ws, 0) AS winner_sets_won, COALESCE(ls, 0) AS loser_sets_won,
    COALESCE(wtb, 0) AS winner_tiebreaks_won, COALESCE(tb - wtb, 0) AS loser_tiebreaks_won,
    CASE WHEN COALESCE(sets, 0) = 0 THEN 0.5::DOUBLE
         ELSE 0.5::DOUBLE * (wg::DOUBLE / (wg + lg)) + 0.5::DOUBLE * (0.5::DOUBLE + (ws - ls)::DOUBLE / sets / 2) END AS dominance,
    loser_svpt AS winner_rtpt, loser_svpt - loser_spw AS winner_rpw,
    winner_svpt AS loser_rtpt, winner_svpt - winner_spw AS loser_rpw,
    loser_bp_faced AS winner_bp_opps, loser_bp_faced - loser_bp_saved AS winner_bp_conv,
    winner_bp_faced AS loser_bp_opps, winner_bp_faced - winner_bp_saved AS loser_bp_conv,
    winner_svpt > 0 AND loser_svpt > 0 AND winner_spw BETWEEN 0 AND winner_svpt
      AND loser_spw BETWEEN 0 AND loser_svpt AS has_serve_stats,
    surface = 'Carpet' OR roof AS indoor, metres AS altitude_m, host_code AS host
  FROM contests c LEFT JOIN score_rows ON score = score_text
  JOIN venue_rows ON tourney_name = venue)
"""


def _appearance(mine: str, other: str, letter: str) -> str:
    won = 1 if letter == "w" else 0
    return f"""
  SELECT match_id, '{letter}' AS side, tour, match_date, tourney_id, match_num, surface,
    {mine}_id AS player_id, {other}_id AS opponent_id, {won} AS won,
    CASE WHEN walkover THEN 0 ELSE 1 END AS live, minutes, sets_played AS sets,
    1500 + COALESCE({other}_rank_points, 0)::DOUBLE / 20 AS opponent_elo,
    {mine}_bp_saved AS bp_saved, {mine}_bp_faced AS bp_faced, {mine}_bp_conv AS bp_conv,
    {mine}_bp_opps AS bp_opps, tiebreaks_played AS tb, {mine}_tiebreaks_won AS tbw,
    CASE WHEN went_to_decider THEN 1 ELSE 0 END AS dec,
    CASE WHEN retirement THEN {1 - won} ELSE 0 END AS gave_up
  FROM matches"""


APPEARANCES = MATCHES + f""",
app AS ({_appearance("winner", "loser", "w")} UNION ALL {_appearance("loser", "winner", "l")})
"""

# Every earlier appearance of the same player, numbered backwards among the live ones.
EARLIER = APPEARANCES + """,
earlier AS (
  SELECT a.match_id, a.side, a.surface AS here, a.opponent_id AS against,
         date_diff('day', b.match_date, a.match_date) AS age, b.* EXCLUDE (match_id, side),
         SUM(b.live) OVER (PARTITION BY a.match_id, a.side
             ORDER BY b.match_date DESC, b.tourney_id DESC, b.match_num DESC) AS back
  FROM app a JOIN app b ON a.tour = b.tour AND a.player_id = b.player_id
   AND (b.match_date, b.tourney_id, b.match_num) < (a.match_date, a.tourney_id, a.match_num))
"""


def with_(body: str, base: str = MATCHES) -> str:
    return "WITH " + base.strip() + body


# Every store's matches in order, replayed one match per pool and step.
RATED = MATCHES + """,
store_rows AS (
  SELECT tour || '|overall|' AS pool, match_id, match_date, tourney_id, match_num, winner_id AS a, loser_id AS b,
    NOT walkover AS upd, TRUE AS stamp, 1.0::DOUBLE AS actual, base * mov AS weight, 1.0::DOUBLE AS factor
  FROM weighted
  UNION ALL SELECT tour || '|surface|' || surface, match_id, match_date, tourney_id, match_num, winner_id, loser_id,
    NOT walkover, FALSE, 1.0, base * mov, 1.15 FROM weighted
  UNION ALL SELECT tour || '|points|', match_id, match_date, tourney_id, match_num, winner_id, loser_id,
    NOT walkover AND has_serve_stats, FALSE, stretch(pts), base, 1.0 FROM weighted
  UNION ALL SELECT tour || '|games|', match_id, match_date, tourney_id, match_num, winner_id, loser_id,
    NOT walkover AND winner_games_won + loser_games_won > 0, FALSE, stretch(gms), base, 1.0 FROM weighted),
seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY match_date, tourney_id, match_num) AS i
        FROM store_rows),
run(pool, id, step, rating, n, peak, last_day) USING KEY (pool, id) AS (
  SELECT DISTINCT pool, 'clock', 0::BIGINT, 0.0::DOUBLE, 0::BIGINT, 0.0::DOUBLE, NULL::DATE FROM seq
  UNION
  SELECT pool, r.id, r.step, r.rating, r.n, r.peak, r.last_day FROM (
    SELECT pool, unnest([
      {'id': 'clock', 'step': i, 'rating': 0.0::DOUBLE, 'n': 0::BIGINT, 'peak': 0.0::DOUBLE, 'last_day': NULL::DATE},
      {'id': match_id || '/w', 'step': i, 'rating': ra, 'n': na, 'peak': pa, 'last_day': match_date},
      {'id': match_id || '/l', 'step': i, 'rating': rb, 'n': nb, 'peak': pb, 'last_day': match_date},
      {'id': a::VARCHAR, 'step': i, 'rating': CASE WHEN upd THEN new_a ELSE ra END, 'n': na + upd::INT,
       'peak': CASE WHEN upd THEN GREATEST(pa, new_a) ELSE pa END,
       'last_day': CASE WHEN upd OR stamp THEN match_date ELSE la END},
      {'id': b::VARCHAR, 'step': i, 'rating': CASE WHEN upd THEN new_b ELSE rb END, 'n': nb + upd::INT,
       'peak': CASE WHEN upd THEN GREATEST(pb, new_b) ELSE pb END,
       'last_day': CASE WHEN upd OR stamp THEN match_date ELSE lb END}]) AS r
    FROM (
      SELECT *, xa + 250 * factor * weight / POW(na + 5, 0.4::DOUBLE) * gain AS new_a,
                xb - 250 * factor * weight / POW(nb + 5, 0.4::DOUBLE) * gain AS new_b
      FROM (
        SELECT *, actual - 1 / (1 + POW(10.0::DOUBLE, (xb - xa) / 400)) AS gain FROM (
          SELECT *, idle(ra, date_diff('day', la, match_date)) AS xa,
                    idle(rb, date_diff('day', lb, match_date)) AS xb FROM (
            SELECT s.*, COALESCE(p.rating, 1500) AS ra, COALESCE(q.rating, 1500) AS rb,
                   COALESCE(p.n, 0) AS na, COALESCE(q.n, 0) AS nb,
                   COALESCE(p.peak, 1500) AS pa, COALESCE(q.peak, 1500) AS pb,
                   p.last_day AS la, q.last_day AS lb
            FROM (SELECT pool, step FROM run WHERE id = 'clock') c
            JOIN seq s ON s.pool = c.pool AND s.i = c.step + 1
            LEFT JOIN recurring.run p ON p.pool = s.pool AND p.id = s.a::VARCHAR
            LEFT JOIN recurring.run q ON q.pool = s.pool AND q.id = s.b::VARCHAR)))))),
ratings AS (
  SELECT split_part(id, '/', 1) AS match_id, split_part(id, '/', 2) AS side,
    MAX(CASE WHEN kind = 'overall' THEN rating END) AS elo,
    MAX(CASE WHEN kind = 'surface' THEN rating END) AS elo_surface,
    MAX(CASE WHEN kind = 'points' THEN rating END) AS elo_points,
    MAX(CASE WHEN kind = 'games' THEN rating END) AS elo_games,
    MAX(CASE WHEN kind = 'overall' THEN peak END) AS elo_peak,
    MAX(CASE WHEN kind = 'overall' THEN n END) AS elo_matches,
    MAX(CASE WHEN kind = 'surface' THEN n END) AS elo_surface_matches,
    MAX(CASE WHEN kind = 'surface' THEN store END) AS surface
  FROM (SELECT *, split_part(pool, '|', 2) AS kind, split_part(pool, '|', 3) AS store FROM run)
  WHERE id LIKE '%/_' GROUP BY 1, 2),
states AS (
  SELECT split_part(pool, '|', 1) AS tour, split_part(pool, '|', 2) AS kind, split_part(pool, '|', 3) AS store,
    id::BIGINT AS player_id, rating, n, peak, last_day
  FROM run WHERE id NOT LIKE '%/_' AND id <> 'clock')
"""
_WEIGHTED = """,
weighted AS (
  SELECT *, level_weight * CASE WHEN walkover THEN 0 WHEN retirement THEN 0.55::DOUBLE ELSE 1 END AS base,
    0.75::DOUBLE + 0.6::DOUBLE * LEAST(1, 2 * ABS(CASE WHEN dominance = 0 THEN 0.5::DOUBLE ELSE dominance END - 0.5::DOUBLE)) AS mov,
    (winner_spw + winner_rpw) / (winner_svpt + loser_svpt) AS pts,
    winner_games_won::DOUBLE / NULLIF(winner_games_won + loser_games_won, 0) AS gms
  FROM matches),"""
RATED = RATED.replace(",\nstore_rows", _WEIGHTED + "\nstore_rows", 1)
for _x in ("pts", "gms"):
    RATED = RATED.replace(
        f"stretch({_x})",
        f"LEAST(0.98::DOUBLE, GREATEST(0.02::DOUBLE, 0.5::DOUBLE + ({_x} - 0.5::DOUBLE) * 2.6::DOUBLE))")
for _r in ("a", "b"):
    RATED = RATED.replace(
        f"idle(r{_r}, date_diff('day', l{_r}, match_date))",
        f"CASE WHEN date_diff('day', l{_r}, match_date) > 90 THEN r{_r} + (1500 - r{_r}) * LEAST(0.45::DOUBLE, "
        f"0.28::DOUBLE * ((date_diff('day', l{_r}, match_date) - 90) / 365.25::DOUBLE)) ELSE r{_r} END")

# Without the rows kept per match, for queries that only need the final ratings.
FINAL = "\n".join(line for line in RATED.splitlines() if "match_id || '/" not in line)

BLEND = """(CASE {surface} WHEN 'Hard' THEN 0.55::DOUBLE WHEN 'Clay' THEN 0.68 WHEN 'Grass' THEN 0.7 ELSE 0.6 END
   * {n} / ({n} + 12.0::DOUBLE))"""


def recursive(body: str, base: str = RATED) -> str:
    return "WITH RECURSIVE " + base.strip() + body
