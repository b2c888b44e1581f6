"""Distributed forms against the single-task forms, and no look-ahead."""

import pytest
from pyspark.sql import functions as F

from pairwise.operators import features, history, ratings, skill
from pairwise.session import scratch_path
from pairwise.streaming import live


def as_dict(df, key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def same(a, b, key, tolerance=1e-9):
    left, right = as_dict(a, key), as_dict(b, key)
    assert left.keys() == right.keys() and left
    for k, row in left.items():
        for column in a.columns:
            x, y = row[column], right[k][column]
            if isinstance(x, float) and y is not None:
                assert x == pytest.approx(y, abs=tolerance), (k, column)
            else:
                assert x == y, (k, column)


def test_chunks_do_not_matter(matches):
    timeline = history.appearances(matches.filter(F.col("tour") == "asia"))
    same(history.history(timeline), history.history(timeline, chunk=120), ["match_id", "side"])


def test_history_reads_its_timeline_once_for_each_kind_of_total(matches):
    rows = history.history(history.appearances(matches))
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 6
    narrow = history.history(history.appearances(matches), wanted=history.HEAD_TO_HEAD)
    assert narrow._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 3
    same(narrow, rows.select(*narrow.columns), ["match_id", "side"])


def test_players_followed_as_arrays_match_one_by_one():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    lengths = [1, 7, 40, 2, 3] * 8
    player = np.repeat(np.arange(len(lengths)), lengths)
    size = len(player)
    rows = pa.RecordBatch.from_pydict({
        "tour": ["atp"] * size, "kind": ["overall"] * size, "store": [""] * size, "player": player,
        "turn": np.ones(size, "int32"), "day": np.concatenate([np.cumsum(draw.integers(0, 200, n)) for n in lengths]),
        "updates": draw.random(size) < 0.8, "stamps": draw.random(size) < 0.5, "actual": draw.random(size),
        "weight": draw.random(size), "factor": np.ones(size), "other_rating": draw.normal(1500, 200, size),
        **{f"s_{n}": pa.nulls(size, pa.float64()) for n in ratings.STATE}})
    expected, one = [], ratings._Follower()
    for r in rows.to_pylist():
        if one.key != r["player"]:
            one.turn_to(r["player"])
        expected.append(one.after_idling(r["day"]))
        if r["updates"]:
            one.play(r["day"], expected[-1], r["other_rating"], r["actual"], r["weight"], r["factor"])
        elif r["stamps"]:
            one.last = r["day"]
    for cut in (1, 9, 100, size):       # batches end inside a player
        carried = ratings._Follower()
        parts = [ratings._followed(rows.slice(at, cut), carried) for at in range(0, size, cut)]
        assert np.concatenate(parts) == pytest.approx(expected, abs=1e-9)


def test_ratings_go_on_from_a_state(few):
    middle = few.agg(F.percentile_approx("match_date", 0.5)).first()[0]
    rows = ratings.store_rows(few)
    early = few.filter(F.col("match_date") <= middle)
    state = ratings.rate(early).filter("match_id IS NULL")
    late = ratings.rate_rows(rows.join(early.select("match_id"), "match_id", "left_anti"), state)
    whole = ratings.rate(few).filter(F.col("match_id").isNotNull()).join(
        early.select("match_id"), "match_id", "left_anti")
    same(late.filter(F.col("match_id").isNotNull()), whole.select(*late.columns), ratings.POOL + ["match_id", "a"])


def plain_ratings(rows):
    """One pass in date order: ratings of both players before each row, and the last ones."""
    state, read = {}, {}

    def rested(key, day):
        rating, _, _, last = state.get(key, (1500.0, 0, 1500.0, None))
        idle = 0 if last is None else day - last - 90
        return rating + (1500.0 - rating) * min(.45, .28 * idle / 365.25) if idle > 0 else rating

    for r in sorted(rows, key=lambda r: (r.day, r.tourney_id, r.match_num, r.match_id)):
        keys = [(r.tour, r.kind, r.store, p) for p in (r.a, r.b)]
        now = [state.get(k, (1500.0, 0, 1500.0, None)) for k in keys]
        read[r.tour, r.kind, r.store, r.match_id] = [v for n in now for v in n[:3]]
        if r.updates:
            a, b = (rested(k, r.day) for k in keys)
            likely = 1 / (1 + 10 ** ((b - a) / 400))
            for key, base, sign, n in zip(keys, (a, b), (1, -1), now, strict=True):
                new = base + sign * 250 * r.factor * r.weight * (r.actual - likely) / (n[1] + 5) ** .4
                state[key] = (new, n[1] + 1, max(n[2], new), r.day)
        elif r.stamps:
            for key, n in zip(keys, now, strict=True):
                state[key] = (*n[:3], r.day)
    return read, state


def test_sweeps_equal_one_pass(matches):
    some = matches.filter(F.col("tour").isin("asia"))
    rows = ratings.store_rows(some).collect()
    read, state = plain_ratings(rows)
    for found in (ratings.rate(some).collect(), ratings.rate(some, period_days=900).collect()):
        before = {(r.tour, r.kind, r.store, r.match_id): [r.a_rating, r.a_played, r.a_peak, r.b_rating, r.b_played, r.b_peak]
                  for r in found if r.match_id is not None}
        after = {(r.tour, r.kind, r.store, r.a): (r.a_rating, r.a_played, r.a_peak, r.last_day)
                 for r in found if r.match_id is None}
        assert before.keys() == read.keys() and after.keys() == state.keys() and len(read) > 100
        for wanted, got in ((read, before), (state, after)):
            for key, values in wanted.items():
                assert got[key] == pytest.approx(values, abs=1e-7), key


def test_skill_fit_solves_its_equations(matches):
    first = matches.agg(F.min("match_date")).first()[0]
    year = matches.filter(F.col("match_date") < F.date_add(F.lit(first), 200))
    start, last = skill.calendar(year)
    cells = skill.cells(skill.observations(year), start)
    fits = skill.fit_rolling(year)
    worst = skill.worst_residuals(cells, fits, last).agg(F.max("worst"), F.count("*")).first()
    assert worst[1] > 0 and worst[0] < 1e-8
    only = skill.fit_rolling(year, [last])
    same(only, fits.filter(F.col("cut") == last), ["kind", "tour", "player_id", "surface"])


def test_first_contest_reads_start_values(matches):
    rated = ratings.pre_match(ratings.rate(matches))
    first = rated.filter("w_elo_matches = 0 AND l_elo_matches = 0").agg(
        F.min("w_elo"), F.max("w_elo"), F.min("l_elo_peak")).first()
    assert tuple(first) == (1500.0, 1500.0, 1500.0)


def test_a_result_does_not_change_its_own_features(few):
    one = few.orderBy(F.desc("match_date"), F.desc("match_num")).first()["match_id"]
    hit = F.col("match_id") == one
    swap = {}
    for c in few.columns:
        if c.startswith("winner_"):
            other = c.replace("winner_", "loser_")
            if other in few.columns:
                swap[c] = F.when(hit, F.col(other)).otherwise(F.col(c))
                swap[other] = F.when(hit, F.col(c)).otherwise(F.col(other))
    turned = few.withColumns(swap)
    a = ratings.pre_match(ratings.rate(few)).filter(hit).first()
    b = ratings.pre_match(ratings.rate(turned)).filter(hit).first()
    assert a["w_elo"] == b["l_elo"] and a["l_elo_points"] == b["w_elo_points"]


def test_rating_formulas(spark):
    row = spark.range(1).select(
        ratings.expected(F.lit(1900.0), F.lit(1500.0)).alias("e"),
        ratings.k_factor(F.lit(0)).alias("k0"), ratings.k_factor(F.lit(100)).alias("k100"),
        (ratings.stretched(F.lit(.56)) + ratings.stretched(F.lit(.44))).alias("s"),
        ratings.idle_regressed(F.lit(2000.0), F.lit(0), F.lit(4000)).alias("idle"),
        ratings.blended(F.lit("Clay"), F.lit(1600.0), F.lit(1800.0), F.lit(0)).alias("b")).first()
    assert row["e"] == pytest.approx(10 / 11) and row["k0"] > row["k100"]
    assert row["s"] == pytest.approx(1) and row["idle"] == pytest.approx(1775)
    assert row["b"] == 1600.0


def test_rating_stream_equals_batch(spark, few):
    path = scratch_path(spark, "live")
    step = live.rating_step(spark, path)
    middle = few.agg(F.percentile_approx("match_date", 0.5)).first()[0]
    step(few.filter(F.col("match_date") <= middle), 0)
    step(few.filter(F.col("match_date") > middle), 1)
    key = ratings.POOL + ["a"]
    final = ratings.rate(few).filter("match_id IS NULL").drop("match_id", "b")
    same(final, spark.read.parquet(f"{path}/state-1").drop("match_id", "b"), key)


def test_groups_partition_the_antisymmetric_columns():
    listed = [c for group in features.GROUPS.values() for c in group]
    assert len(listed) == len(set(listed)) == 52
    assert [len(g) for g in features.GROUPS.values()] == [7, 7, 3, 7, 13, 4, 2, 4, 4, 1]


def test_sweeps_carry_numbers_in_place_of_names(few):
    told = ratings._sides(ratings._linked(ratings.store_rows(few)), None)
    assert "string" not in {kind for _, kind in told.dtypes}
    # a store's player has one number, whatever the side, and no two share it
    linked = ratings._linked(ratings.store_rows(few))
    sides = linked.select(*ratings.POOL, F.inline(F.array(*[
        F.struct(F.col(c).alias("player"), F.col(f"{c}_node").alias("node")) for c in "ab"]))).distinct().collect()
    assert len(sides) == len({r["node"] for r in sides}) == len({tuple(r)[:4] for r in sides})


def test_reading_out_does_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    lengths = [1, 9, 30, 2] * 7
    player, size = np.repeat(np.arange(len(lengths)), lengths), sum(lengths)
    rows = pa.RecordBatch.from_pydict({
        "turn": np.ones(size, "int32"), "player": player, "contest": np.arange(size),
        "day": np.concatenate([np.cumsum(draw.integers(0, 200, n)) for n in lengths]).astype("int32"),
        "is_a": draw.random(size) < 0.5, "updates": draw.random(size) < 0.7, "stamps": draw.random(size) < 0.5,
        "actual": draw.random(size), "weight": draw.random(size), "other_rating": draw.normal(1500, 200, size)})
    expected, states, one = [], {}, ratings._Follower()
    for r in rows.to_pylist():
        if one.key != r["player"]:
            one.turn_to(r["player"])
        expected.append((r["contest"], one.rating, one.played, one.peak))
        if r["updates"]:
            one.play(r["day"], one.after_idling(r["day"]), r["other_rating"], r["actual"], r["weight"], 1.0)
        elif r["stamps"]:
            one.last = r["day"]
        if one.last is not None:
            states[r["player"]] = (one.rating, one.played, one.peak, one.last)
    for cut in (4, 33, size):
        out = [r for b in ratings._read_out(rows.slice(at, cut) for at in range(0, size, cut)) for r in b.to_pylist()]
        read = [(r["contest"], r["rating"], r["played"], r["peak"]) for r in out if r["contest"] is not None]
        final = {r["player"]: (r["rating"], r["played"], r["peak"], r["last_day"]) for r in out if r["contest"] is None}
        assert final.keys() == states.keys()
        for found, wanted in [*zip(sorted(read), expected), *((final[k], states[k]) for k in states)]:
            assert found == pytest.approx(wanted, abs=1e-9)


def test_residuals_of_the_tasks_are_those_of_the_cells(matches):
    year = matches.filter("year(match_date) = 1995")
    start, last = skill.calendar(year)
    cells = skill.cells(skill.observations(year), start)
    same(skill.residuals(year), skill.worst_residuals(cells, skill.fit_rolling(year), last), ["tour", "cut", "kind"])


def test_skill_fits_leave_a_task_refit_by_refit(monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw, size = np.random.default_rng(2), 300
    batch = pa.RecordBatch.from_pydict({
        "bucket": draw.integers(0, 4, size), "tail": np.zeros(size, bool), "server": draw.integers(0, 9, size),
        "returner": draw.integers(9, 19, size), "surface": draw.choice(["Hard", "Clay"], size), "w": 1 + draw.random(size),
        "wy": draw.random(size), "svpt": np.full(size, 50.0), "spw": np.full(size, 30.0)})
    key = (pa.scalar("atp"), pa.scalar(0))

    def solved() -> list:
        fit = skill._block_fitter([2, 3, 4], skill._fit_rows)
        return list(fit(key, iter([batch.slice(at, 70) for at in range(0, size, 70)])))

    whole = solved()
    assert [set(b.column("cut").to_pylist()) for b in whole] == [{2}, {3}, {4}]
    monkeypatch.setattr(skill, "STEP", 64)
    for a, b in zip(whole, solved(), strict=True):
        assert a.select(["kind", "player_id", "surface"]) == b.select(["kind", "player_id", "surface"])
        assert np.allclose(a.column("serve").to_pandas(), b.column("serve").to_pandas(), equal_nan=True, atol=1e-9)


class Held:
    """What a group's state looks like to the function that counts."""
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def plain_counts(batches):
    """One row after another: counters before each match, rows older than the player's state counted and dropped."""
    state, out = {}, []
    for rows in batches:
        late = {}
        for r in sorted(rows, key=lambda r: (r["day"], r["tourney_id"], r["match_num"])):
            n, wins, up, down, last, missed = state.get(r["player_id"], (0, 0, 0, 0, -10**6, 0))
            if r["day"] < last and r["player_id"] not in late:
                late[r["player_id"]] = sum(x["day"] < last for x in rows if x["player_id"] == r["player_id"])
                state[r["player_id"]] = (n, wins, up, down, last, missed + late[r["player_id"]])
            if r["day"] < last:
                continue
            out.append((r["player_id"], r["match_id"], n, wins, up, down, missed))
            if r["live"]:
                n, wins, up, down = n + 1, wins + r["won"], (up + 1) * r["won"], (down + 1) * (1 - r["won"])
            state[r["player_id"]] = (n, wins, up, down, r["day"], missed)
    return sorted(out, key=str)


def test_a_block_of_players_counts_like_one_by_one():
    import numpy as np
    import pandas as pd

    draw, held, found, batches = np.random.default_rng(4), Held(), [], []
    for batch in range(4):
        size = 90
        rows = pd.DataFrame({
            "tour": "atp", "match_id": [f"{batch}/{i}" for i in range(size)], "day": 100 * batch + draw.integers(-40, 100, size),
            "tourney_id": draw.choice(["a", "b"], size), "match_num": draw.permutation(size),
            "live": (draw.random(size) < 0.8).astype(int), "side": "w", "player_id": draw.choice([64, 70, 80 + batch, 127], size),
            "won": draw.integers(0, 2, size)})
        batches.append(rows.to_dict("records"))
        for part in live._count(("atp", 1), iter([rows[:50], rows[50:]]), held):
            found += list(part[["player_id", "match_id", "career_matches", "career_wins", "win_streak", "loss_streak",
                                "late_rows"]].itertuples(index=False, name=None))
    wanted = plain_counts(batches)
    assert sorted([tuple(map(int, (r[0], *r[2:]))) for r in found]) == sorted((r[0], *r[2:]) for r in wanted)
    assert {r[1]: tuple(map(int, r[2:])) for r in found} == {r[1]: r[2:] for r in wanted}
    assert max(r[-1] for r in wanted) > 0


def test_stream_keeps_rows_without_a_player(spark):
    import datetime

    def batch(day, number, loser):
        return spark.createDataFrame(
            [("atp", f"m{number}", datetime.date(2020, 1, day), "e", number, 2**60 + 1, loser, False)],
            "tour string, match_id string, match_date date, tourney_id string, match_num long, winner_id long, "
            "loser_id long, walkover boolean")

    root = scratch_path(spark, "no-player")
    for day, loser in ((1, None), (2, 2**60 + 2), (3, None)):
        like = batch(day, day, loser)
        like.coalesce(1).write.mode("append").parquet(f"{root}/matches")
    stream = live.career_stream(live.open_matches(spark, f"{root}/matches", like, 1))
    rows = {(r.match_id, r.side): (r.player_id, r.career_matches, r.career_wins, r.win_streak, r.loss_streak, r.late_rows)
            for r in live.run_to_table(stream, f"{root}/out", f"{root}/checkpoint").collect()}
    first, second = 2**60 + 1, 2**60 + 2
    assert rows == {
        ("m1", "w"): (first, 0, 0, 0, 0, 0), ("m2", "w"): (first, 1, 1, 1, 0, 0), ("m3", "w"): (first, 2, 2, 2, 0, 0),
        ("m1", "l"): (None, 0, 0, 0, 0, 0), ("m2", "l"): (second, 0, 0, 0, 0, 0), ("m3", "l"): (None, 1, 0, 0, 1, 0)}
