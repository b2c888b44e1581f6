"""Prices dealt to contests one to one, and names resolved on both sides."""

import datetime
import random

from pyspark.sql import functions as F

from pairwise.functions import market
from pairwise.sources import odds

DAY = datetime.date(2020, 1, 1)


def test_assignment_is_one_to_one_and_nearest_first(spark):
    draw = random.Random(4)
    matches = [(f"m{i}", "atp", i % 3, 10 + i % 2, DAY + datetime.timedelta(days=draw.randint(0, 60))) for i in range(120)]
    prices = [(f"p{i}", "atp", i % 3, 10 + i % 2, DAY + datetime.timedelta(days=draw.randint(0, 60))) for i in range(150)]
    # a chain in which every row competes with the next
    matches += [(f"c{i}", "atp", 50, 51, DAY + datetime.timedelta(days=4 * i)) for i in range(6)]
    prices += [(f"d{i}", "atp", 50, 51, DAY + datetime.timedelta(days=4 * i + 2)) for i in range(6)]
    edges = sorted(
        (abs((m[4] - p[4]).days), m[0], p[0]) for m in matches for p in prices if m[1:4] == p[1:4] and abs((m[4] - p[4]).days) <= 5)
    used, wanted = set(), set()
    for gap, m, p in edges:
        if m not in used and p not in used:
            used |= {m, p}
            wanted.add((m, p, gap))
    found = odds.assign(
        spark.createDataFrame(matches, "match_id string, tour string, winner_id long, loser_id long, match_date date"),
        spark.createDataFrame(prices, "price_id string, tour string, winner_id long, loser_id long, match_date date"), 5)
    assert {(r.match_id, r.price_id, r.gap) for r in found.collect()} == wanted
    none = spark.createDataFrame([], "price_id string, tour string, winner_id long, loser_id long, match_date date")
    assert odds.assign(spark.createDataFrame(
        matches, "match_id string, tour string, winner_id long, loser_id long, match_date date"), none).count() == 0


def test_both_names_are_resolved(spark):
    directory = spark.createDataFrame(
        [("atp", 1, "Ana Kaov", 5.0), ("atp", 2, "Boris Kaov", None), ("atp", 3, "Carla Miran", 9.0), ("atp", 4, "Clara Miran", 200.0)],
        "tour string, player_id long, name string, last_rank double")
    prices = spark.createDataFrame(
        [("a", "atp", "Kaov A.", "Kaov B.", None, None), ("b", "atp", "Miran C.", "Nobody X.", 8.0, None),
         ("c", "atp", "Miran C.", "Kaov A.", None, 5.0)],
        "price_id string, tour string, winner_name string, loser_name string, winner_rank double, loser_rank double")
    rows = {r.price_id: (r.winner_id, r.loser_id) for r in odds.with_player_ids(prices, directory).collect()}
    assert rows == {"a": (1, 2), "b": (3, None), "c": (None, 1)}


def test_power_margin_is_searched_once(spark):
    prices = [(1.5, 2.6), (1.01, 1.02), (2.0, 2.0), (9.0, 1.05), (3.0, 3.0)]
    df = spark.createDataFrame(prices, "a double, b double")
    df = df.select("a", "b", market.implied_probability(F.col("a"), F.col("b"), "power").alias("p"))
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    for a, b, p in df.collect():
        low, high = 1.0, 6.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if a**-middle + b**-middle > 1 else (low, middle)
        assert abs(p - min(max(a ** -((low + high) / 2), 1e-6), 1 - 1e-6)) < 1e-9
