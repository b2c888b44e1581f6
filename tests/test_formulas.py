import math

import pytest
from pyspark.sql import functions as F

from pairwise.functions import market, pointmodel
from pairwise.operators import metrics


def test_hold_constants(spark):
    expected = {.50: .5000, .55: .6230, .60: .7357, .65: .8299, .70: .9008}
    df = spark.createDataFrame([(p,) for p in expected], "p double")
    for row in df.select("p", pointmodel.hold(F.col("p")).alias("h")).collect():
        assert row["h"] == pytest.approx(expected[row["p"]], abs=5e-4)


def test_point_model_is_symmetric(spark):
    pairs = [(.6, .65), (.65, .6), (.7, .7), (.3, .9), (.9, .3)]
    df = spark.createDataFrame(pairs, "p double, q double").withColumn("n", F.lit(5))
    got = {(r["p"], r["q"]): r for r in pointmodel.with_point_model(df, "p", "q", "n").collect()}
    for p, q in [(.6, .65), (.3, .9)]:
        for column in ("pm_set", "pm_long_set", "pm_match"):
            assert got[p, q][column] + got[q, p][column] == pytest.approx(1, abs=1e-12)
    assert got[.7, .7]["pm_match"] == pytest.approx(.5, abs=1e-12)
    assert got[.65, .6]["pm_match"] > got[.65, .6]["pm_set"] > .5


def test_scores_add_up(spark):
    df = spark.createDataFrame([(.62, 3, .4), (.62, 5, .9)], "s double, n int, p double")
    rows = df.select("p", F.explode(pointmodel.score_rows(F.col("s"), F.col("n"), F.col("p"))))
    for row in rows.groupBy("p").agg(
            F.sum("col.chance").alias("all"),
            F.sum(F.when(F.substring("col.outcome", 1, 1) > F.substring("col.outcome", 3, 1),
                         F.col("col.chance"))).alias("won")).collect():
        assert row["all"] == pytest.approx(1) and row["won"] == pytest.approx(row["p"])


def test_margin_removal(spark):
    df = spark.createDataFrame([(1.05, 11.0), (2.0, 2.0), (0.9, 2.0), (3.0, 3.0)], "a double, b double")
    got = df.select(*[market.implied_probability(F.col("a"), F.col("b"), m).alias(m)
                      for m in market.METHODS]).collect()
    assert got[0]["shin"] == pytest.approx(0.930736, abs=1e-6)
    assert got[0]["multiplicative"] < got[0]["shin"]
    assert all(v == pytest.approx(.5) for v in got[1])
    assert all(v is None for v in got[2])
    assert got[3]["shin"] == pytest.approx((1 / 3) / math.sqrt(2 / 3))
    with pytest.raises(ValueError):
        market.implied_probability(F.col("a"), F.col("b"), "guess")


def test_betting_and_kelly(spark):
    df = spark.createDataFrame([(1, .6, 3.0, 1.4), (0, .6, 3.0, 1.4)],
                               "y int, p double, a double, b double")
    flat = metrics.betting_return(df, [], "y", "p", "a", "b", scale=None).first()
    assert (flat["bets"], flat["profit"]) == (2, 1.0)
    stake = df.select(market.kelly(F.col("p"), F.col("a"))).first()[0]
    assert stake == pytest.approx(.4)


def test_coin_has_log_two(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("y"), F.lit(.5).alias("p"))
    row = metrics.evaluate(df, [], "y", "p").first()
    assert row["log_loss"] == pytest.approx(math.log(2)) and row["ece"] == pytest.approx(0)


def test_slope_tells_over_and_under_confidence(spark):
    base = spark.range(4000).select(
        ((F.col("id") * 7919 % 1000) / 1000 * .8 + .1).alias("t"),
        ((F.col("id") * 104729 + 13) % 4001 / 4001).alias("u"))
    base = base.withColumn("y", (F.col("u") < F.col("t")).cast("int"))
    x = F.log(F.col("t") / (1 - F.col("t")))
    for scale, low, high in ((2.0, .3, .7), (0.5, 1.5, 2.5), (1.0, .8, 1.2)):
        df = base.withColumn("p", 1 / (1 + F.exp(-scale * x)))
        slope = metrics.calibration_slope(df, [], "y", "p").first()[0]
        assert low < slope < high
