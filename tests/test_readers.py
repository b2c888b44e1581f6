"""CSV files with unlike headers, and price dates."""

import datetime

import pytest
from pyspark.sql import functions as F

from pairwise.sources import layouts, odds, seasons


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_season_files_with_unlike_headers(spark, tmp_path):
    write(tmp_path, "atp_matches_1.csv", '"tourney_id","match_num","winner_name"\n"a",1,"Smith, J."\n')
    write(tmp_path, "atp_matches_2.csv", "\ufefftourney_id,match_num,surface\nb,2,Clay\n\nb,3,\n")
    write(tmp_path, "atp_matches_3.csv", "tourney_date,tourney_id,match_num\n20200101,c,4\n20200102,match_id,5\n")
    write(tmp_path, "atp_matches_4.csv", "tourney_id,match_num,surface\n")
    rows = seasons.read_csv(spark, str(tmp_path / "atp_matches_*.csv")).orderBy("match_num").collect()
    assert [(r.tourney_id, r.match_num, r.winner_name, r.surface, r.tourney_date) for r in rows] == [
        ("a", "1", "Smith, J.", None, None), ("b", "2", None, "Clay", None), ("b", "3", None, None, None),
        ("c", "4", None, None, "20200101"), ("match_id", "5", None, None, "20200102")]
    assert seasons.read_csv(spark, str(tmp_path / "wta_*.csv")) is None


def test_a_file_without_a_header_is_an_error(spark, tmp_path):
    write(tmp_path, "x.csv", "1,2,3\n4,5,6\n")
    with pytest.raises(ValueError, match="no header"):
        layouts.read_layouts(spark, str(tmp_path / "x.csv"), ["tourney_id"])


def test_price_files_keep_winner_and_loser(spark, tmp_path):
    write(tmp_path, "1.csv", "Date,Winner,Loser,PSW,PSL\n2021-02-15,A,B,1.5,2.5\n")
    write(tmp_path, "2.csv", '"Date","Loser","Winner","B365W","B365L"\n"15/02/2021","D","C",1.2,4\n"soon","F","E",1.1,3\n')
    rows = {r.winner_name: r for r in odds.load(spark, str(tmp_path / "*.csv"), "ATP").collect()}
    assert set(rows) == {"A", "C"} and rows["A"].loser_name == "B" and rows["C"].loser_name == "D"
    assert (rows["A"].odds_w_ps, rows["A"].odds_w_b365, rows["C"].odds_w_b365) == (1.5, None, 1.2)
    assert rows["C"].match_date == datetime.date(2021, 2, 15)
    report = odds.load_report(spark, str(tmp_path / "*.csv"), "ATP").agg(F.sum("rows"), F.sum("undated")).first()
    assert tuple(report) == (3, 1)


def test_both_tours_of_a_folder(spark, tmp_path):
    for tour, folder in (("atp", tmp_path / "sackmann" / "atp"), ("wta", tmp_path / "wta")):
        folder.mkdir(parents=True)
        write(folder, f"{tour}_matches_2020.csv",
              "tourney_id,tourney_name,tourney_date,match_num,winner_id,loser_id,winner_name,loser_name,score,best_of,round\n"
              f"t,Rome,20200510,1,1,2,{tour} A,{tour} B,6-4 6-3,3,F\n")
    table = seasons.build_match_table(spark, str(tmp_path), ["atp", "wta", "none"])
    assert sorted(r.tour for r in table.collect()) == ["atp", "wta"]


# ------------------------------------------------------------------ stored tables
def test_buckets_need_no_shuffle(spark, matches):
    from pairwise.operators import history
    from pairwise.plans import catalog
    from pairwise.session import scratch_path
    from pairwise.sources import tables

    order = ["match_date", "tourney_id", "match_num"]
    seen = history.appearances(matches).select("tour", "player_id", *order, "match_id", "side", "live", "won")
    stored = tables.save_bucketed(seen, scratch_path(spark, "buckets"), ["tour", "player_id"], order, 4)
    careers = catalog.careers(stored)
    plan = careers._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    joined = stored.groupBy("tour", "player_id").agg(F.count("*").alias("n")).join(stored.hint("merge"), ["tour", "player_id"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    key = ["match_id", "side", "career_matches"]
    assert sorted(map(tuple, careers.select(*key).collect())) == sorted(map(tuple, catalog.careers(seen).select(*key).collect()))


def test_the_cache_rebuilds_what_changed(spark, tmp_path):
    from pairwise.sources import tables

    built = []

    def build(part):
        built.append(sorted((r.g for r in part.select("g").distinct().collect()), key=str))
        return part.groupBy("g").agg(F.sum("v").alias("total"))

    def run(rows):
        df = spark.createDataFrame(rows, "g string, v long")
        out = tables.load_or_build_parts(spark, str(tmp_path / "cache"), df, ["g"], build)
        return {r.g: r.total for r in out.collect()}

    rows = [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    assert run(rows) == {"a": 3, "b": 3, None: 4}
    assert run(list(reversed(rows))) == {"a": 3, "b": 3, None: 4} and len(built) == 1
    assert run([("a", 1), ("a", 2), ("b", 5), (None, 4), ("c", 1)]) == {"a": 3, "b": 5, None: 4, "c": 1}
    assert built[1:] == [["b", "c"]]
    assert run([("b", 5), ("c", 1)]) == {"b": 5, "c": 1} and run(rows[:2]) == {"a": 3}
    assert built[2:] == [["a"]] or built[2:] == []
