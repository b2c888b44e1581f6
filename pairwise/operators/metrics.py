"""Forecast metrics as grouped aggregates; quantile bins without collecting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise.functions import market
from pairwise.functions.numeric import clip, known, logit
from pairwise.operators.logistic import coefficients
from pairwise.session import settle

TINY = 1e-15


def row_log_loss(y: Column, p: Column) -> Column:
    p = clip(p, TINY, 1 - TINY)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def score_columns(y: Column, p: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(row_log_loss(y, p)).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(((p > 0.5) == (y == 1)).cast("double")).alias("accuracy"),
        F.avg(p).alias("mean_prediction"),
        F.avg(y.cast("double")).alias("base_rate"),
    ]


def reference_columns(d_log_rank: Column, d_elo_blend: Column) -> dict[str, Column]:
    """Coin, better-ranked favourite and pure rating as probabilities."""
    rank, elo = F.coalesce(d_log_rank, F.lit(0.0)), F.coalesce(d_elo_blend, F.lit(0.0))
    return {
        "ref_coin": F.lit(0.5),
        "ref_favourite": 1.0 / (1.0 + F.exp(-0.62 * rank)),
        "ref_elo": 1.0 / (1.0 + F.pow(F.lit(10.0), -elo / 400.0)),
    }


def skill_score(model: Column, reference: Column) -> Column:
    return F.when(reference > 0, (reference - model) / reference)


# ------------------------------------------------------------------ quantiles
def ranked_values(df: DataFrame, groups: list[str], value: str, sums: dict[str, Column]):
    """Distinct values of each group with their count, sums and rank range.

    Equal values collapse before the shuffle. The distinct values are range-partitioned; totals
    of the ranges are accumulated, then each range is ranked by itself, so ranks are exact and
    the ranges are as many as the session has partitions.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("_n"), *[s.alias(n) for n, s in sums.items()])
    cells = settle(cells.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()))
    totals = cells.groupBy(*groups, "_range").agg(F.sum("_n").alias("_rn"))
    over = Window.partitionBy(*groups)
    before = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({
        "_before": F.coalesce(F.sum("_rn").over(before), F.lit(0)),
        "_total": F.sum("_rn").over(over),
    }).drop("_rn")
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    keys = groups + ["_range"]
    return cells.join(totals, keys).withColumn(
        "_rank", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ).drop("_range", "_before")


def _with_groups(df: DataFrame, per_group: DataFrame, groups: list[str]) -> DataFrame:
    if groups:
        return df.join(per_group, groups)
    return df.crossJoin(F.broadcast(per_group))     # a single row


def quantiles_of(ranked: DataFrame, groups: list[str], value: str, probs: Column) -> DataFrame:
    """Linearly interpolated quantiles: one row per group with an array ``quantiles``.

    ``probs`` is an array column that may depend on ``_total``.
    """
    places = F.transform(probs, lambda p: p * (F.col("_total") - 1))
    end = F.col("_rank") + F.col("_n")

    def here(place: Column, rank: Column) -> Column:
        return (rank >= F.col("_rank")) & (rank < end)

    wanted = ranked.withColumn("_places", places).select(
        *groups, value, "_rank", "_n", F.posexplode("_places").alias("_i", "_place"))
    low, high = F.floor("_place"), F.ceil("_place")
    hit = wanted.filter(here(F.col("_place"), low) | here(F.col("_place"), high))
    points = hit.groupBy(*groups, "_i").agg(
        F.max("_place").alias("_place"),
        F.max(F.when(here(F.col("_place"), low), F.col(value))).alias("_low"),
        F.max(F.when(here(F.col("_place"), high), F.col(value))).alias("_high"))
    point = F.col("_low") + (F.col("_high") - F.col("_low")) * (
        F.col("_place") - F.floor("_place"))
    return points.groupBy(*groups).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", point.alias("v")))),
                    lambda s: s["v"]).alias("quantiles"))


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """``feature, quantiles``: exact quantiles of many columns, interpolated between neighbouring ranks.

    A sketch that merges gives a bracket around every quantile, all columns in one pass. The
    second pass counts what is below the brackets and ships only values inside them, equal ones
    together: a few ranks in ten thousand instead of every cell. A bracket that misses its rank
    is an error; the sketch's bound rules that out. Columns without values have no row.
    """
    spark = df.sparkSession
    value = {c: F.col(c).cast("double") for c in columns}
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    wide = {c: 3.0 / accuracy + 3.0 / max(counts[c], 1) for c in columns}
    rough = df.agg(*[
        F.percentile_approx(value[c], [edge for q in shares for edge in (max(0.0, q - wide[c]), min(1.0, q + wide[c]))],
                        accuracy).alias(c) for c in columns]).first()
    wanted = [(c, i, *rough[c][2 * i:2 * i + 2], q * (counts[c] - 1))
              for c in columns if counts[c] for i, q in enumerate(shares)]
    if not wanted:
        return spark.createDataFrame([], "feature string, quantiles array<double>")
    below = df.agg(*[F.sum((value[c] < low).cast("long")).alias(f"{c}/{i}") for c, i, low, _, _ in wanted]).first()
    cells = F.array(*[
        F.when(value[c].between(low, high), F.struct(F.lit(c).alias("feature"), F.lit(i).alias("share"), value[c].alias("value")))
        for c, i, low, high, _ in wanted])
    inside = df.select(F.inline(F.filter(cells, lambda x: x.isNotNull()))).groupBy("feature", "share", "value").agg(
        F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("feature", "share").orderBy("value"))
    # one row per column and share
    ranks = spark.createDataFrame(
        [(c, i, int(at) - below[f"{c}/{i}"], min(int(at) + 1, counts[c] - 1) - below[f"{c}/{i}"], at - int(at))
         for c, i, _, _, at in wanted], "feature string, share int, one long, two long, part double")
    found = (
        inside.withColumn("upto", upto).join(F.broadcast(ranks), ["feature", "share"])
        .groupBy("feature", "share", "part", "one").agg(
            F.min(F.when(F.col("upto") > F.col("one"), F.col("value"))).alias("low"),
            F.min(F.when(F.col("upto") > F.col("two"), F.col("value"))).alias("high")))
    met = F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("one") >= 0)
    between = F.when(met, F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).otherwise(
        F.raise_error(F.lit("a quantile is outside its bracket")).cast("double"))
    ordered = F.array_sort(F.collect_list(F.struct("share", between.alias("q"))))
    return found.groupBy("feature").agg(F.transform(ordered, lambda x: x["q"]).alias("quantiles"))


def calibration_bins(
    df: DataFrame, groups: list[str], y: str, p: str, bins: int, adaptive: bool = False
) -> DataFrame:
    """Equal-count bins (bin, n, predicted, observed); empty bins do not appear.

    With ``adaptive``, groups of fewer than five rows per bin get max(2, rows // 20) bins.
    """
    ranked = ranked_values(df, groups, p, {"_y": F.sum(F.col(y).cast("double"))})
    count = F.lit(bins)
    if adaptive:
        count = F.when(F.col("_total") < bins * 5, F.greatest(
            F.lit(2), F.floor(F.col("_total") / 20))).otherwise(bins)
    inner = F.transform(F.sequence(F.lit(1), count - 1), lambda i: i / count)
    edges = quantiles_of(ranked, groups, p, inner)
    binned = _with_groups(ranked, edges, groups).withColumn(
        "bin", F.size(F.filter("quantiles", lambda e: e < F.col(p))))
    return binned.groupBy(*groups, "bin").agg(
        F.sum("_n").alias("n"),
        (F.sum(F.col(p) * F.col("_n")) / F.sum("_n")).alias("predicted"),
        (F.sum("_y") / F.sum("_n")).alias("observed"))


def calibration_error(df: DataFrame, groups: list[str], y: str, p: str, bins: int = 12):
    binned = calibration_bins(df, groups, y, p, bins, adaptive=True)
    gap = F.abs(F.col("predicted") - F.col("observed")) * F.col("n")
    return binned.groupBy(*groups).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def calibration_slope(df: DataFrame, groups: list[str], y: str, p: str, steps: int = 100):
    """Slope of a one-variable logistic fit on the logit, by Newton steps.

    The rows are staged once; a step is one aggregate for all groups whose sums, a row per group,
    come back to the next as a small table, until no slope moves. Null for a group with a single
    outcome; a fit that still moves after ``steps`` steps is an error.
    """
    rows = settle(df.select(*groups, F.col(y).cast("double").alias("_y"), logit(F.col(p)).alias("_x")))
    both = rows.groupBy(*groups).agg(F.countDistinct("_y").alias("_k"))
    schema = both.select(*groups, "_k", F.lit(0.0).alias("_a"), F.lit(1.0).alias("_b")).schema
    state = [(*r[:-1], r["_k"], 0.0, 1.0) for r in both.collect()]
    spark, ridge = df.sparkSession, 1e-6
    for _ in range(steps):
        now = spark.createDataFrame(state, schema)
        mu = 1.0 / (1.0 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
        w, x, r = mu * (1.0 - mu), F.col("_x"), F.col("_y") - mu
        sums = _with_groups(rows, now, groups).groupBy(*groups, "_k", "_a", "_b").agg(
            F.sum(r).alias("ga"), F.sum(r * x).alias("gb"), F.sum(w).alias("haa"),
            F.sum(w * x).alias("hab"), F.sum(w * x * x).alias("hbb")).collect()
        state, moved = [], 0.0
        for s in sums:
            a, b, gb, hbb = s["_a"], s["_b"], s["gb"] - ridge * s["_b"], s["hbb"] + ridge
            det = s["haa"] * hbb - s["hab"] ** 2
            if det > 0 and s["_k"] > 1:
                a, b = a + (hbb * s["ga"] - s["hab"] * gb) / det, b + (s["haa"] * gb - s["hab"] * s["ga"]) / det
            state.append((*[s[g] for g in groups], s["_k"], a, b))
            moved = max(moved, abs(a - s["_a"]), abs(b - s["_b"]))
        if moved <= 1e-10:
            break
    else:
        raise RuntimeError(f"a calibration slope still moves by {moved} after {steps} steps")
    return spark.createDataFrame(state, schema).select(
        *groups, F.when(F.col("_k") > 1, F.col("_b")).alias("calibration_slope"))


def evaluate(df: DataFrame, groups: list[str], y: str, p: str, min_rows: int = 0) -> DataFrame:
    """The full metric set per group."""
    scores = df.groupBy(*groups).agg(*score_columns(F.col(y), F.col(p)))
    scores = scores.filter(F.col("n") >= min_rows)
    parts = [calibration_error(df, groups, y, p), calibration_slope(df, groups, y, p)]
    for part in parts:
        scores = scores.join(part, groups) if groups else _with_groups(scores, part, groups)
    return scores


def grouped(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """Repeat each row under the label of every grouping (a fixed, small number)."""
    labels = F.array(*named.values())
    return df.withColumn("group", F.explode(F.filter(labels, lambda g: g.isNotNull())))


def pooled_summary(predictions: DataFrame, min_rows: int = 100) -> DataFrame:
    """Metrics over all rows, per tour and per surface; a group of fewer rows has ``n`` and null metrics."""
    rows = grouped(predictions, {
        "all": F.lit("all"), "tour": F.col("tour"),
        "surface": F.concat(F.lit("surface:"), F.col("surface"))})
    y = F.col("label")
    losses = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(row_log_loss(y, F.col(r))).alias(f"{r}_log_loss")
          for r in ("ref_coin", "ref_favourite", "ref_elo")],
    )
    enough = F.col("n") >= min_rows
    losses = losses.select("group", "n", *[
        F.when(enough, F.col(c)).alias(c) for c in losses.columns if c not in ("group", "n")])
    table = losses.join(evaluate(rows, ["group"], "label", "prediction", min_rows).drop("n"), "group", "left")
    return table.withColumn(
        "skill_vs_elo", skill_score(F.col("log_loss"), F.col("ref_elo_log_loss")))


# ------------------------------------------------------------------ prices
def betting_return(
    df: DataFrame, groups: list[str], y: str, p: str, a: str, b: str,
    edge: float = 0.04, scale: float | None = 0.25,
) -> DataFrame:
    valid = known((F.col(a) > 1) & (F.col(b) > 1))
    bets = market.bets(F.col(y), F.col(p), F.col(a), F.col(b), edge, scale)
    rows = df.filter(valid).withColumns({"_stake": bets["stake"], "_profit": bets["profit"]})
    total = rows.groupBy(*groups).agg(
        F.sum((F.col("_stake") > 0).cast("long")).alias("bets"),
        F.sum("_stake").alias("staked"), F.sum("_profit").alias("profit"))
    return total.withColumn(
        "roi", F.when(F.col("staked") > 0, F.col("profit") / F.col("staked")))


def encompassing(df: DataFrame, y: str, model: str, market_p: str, min_rows: int = 200) -> DataFrame:
    """Does the model add to the market? One row with coefficients and the test."""
    import math

    spark = df.sparkSession
    rows = df.filter(
        F.col(y).isNotNull() & F.col(model).isNotNull() & F.col(market_p).isNotNull()
    ).select(F.col(y).cast("double").alias("_y"), logit(F.col(market_p)).alias("_market"),
             logit(F.col(model)).alias("_model"))
    n, kinds, corr = rows.agg(
        F.count(F.lit(1)), F.countDistinct("_y"), F.corr("_market", "_model")).first()
    schema = ("n long, market_coefficient double, model_coefficient double, intercept double, "
              "log_loss_gain double, lr_statistic double, p_value double, collinearity double, "
              "model_adds_information boolean")
    if n < min_rows or kinds < 2:
        return spark.createDataFrame([(n, *[None] * 8)], schema)
    rows = rows.persist()
    # the two fits are compared, so both are taken further than a forecast needs
    alone = coefficients(rows, F.col("_y"), [F.col("_market")], 1e6, 1e-12)
    both = coefficients(rows, F.col("_y"), [F.col("_market"), F.col("_model")], 1e6, 1e-12)

    def loss(beta, names):
        eta = sum((float(b) * F.col(c) for b, c in zip(beta[1:], names)), F.lit(float(beta[0])))
        return F.avg(row_log_loss(F.col("_y"), 1.0 / (1.0 + F.exp(-eta))))

    first, second = rows.agg(
        loss(alone, ["_market"]), loss(both, ["_market", "_model"])).first()
    rows.unpersist()
    gain = first - second
    statistic = 2.0 * n * gain
    chance = math.erfc(math.sqrt(max(statistic, 0.0) / 2.0))
    return spark.createDataFrame(
        [(n, float(both[1]), float(both[2]), float(both[0]), gain, statistic, chance, corr,
          bool(statistic > 3.841 and gain > 0))], schema)


def against_market(
    df: DataFrame, y: str, p: str, a: str, b: str, method: str = "shin",
    edge: float = 0.03, scale: float = 0.25,
) -> DataFrame:
    """Model and market scored on the rows with prices, plus the encompassing test."""
    rows = df.withColumn("_market", market.implied_probability(F.col(a), F.col(b), method))
    rows = rows.filter(
        F.col("_market").isNotNull() & F.col(p).isNotNull() & F.col(y).isNotNull())
    bets = market.bets(F.col(y), F.col(p), F.col(a), F.col(b), edge, scale)
    yy, m = F.col(y), F.col("_market")
    report = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(row_log_loss(yy, F.col(p))).alias("model_log_loss"),
        F.avg(row_log_loss(yy, m)).alias("market_log_loss"),
        F.avg((F.col(p) - yy) * (F.col(p) - yy)).alias("model_brier"),
        F.avg((m - yy) * (m - yy)).alias("market_brier"),
        F.avg(market.overround(F.col(a), F.col(b))).alias("mean_overround"),
        F.avg(F.abs(market.closing_line_value(F.col(p), m))).alias("mean_abs_clv"),
        F.sum((bets["stake"] > 0).cast("long")).alias("bets"),
        F.sum(bets["stake"]).alias("staked"), F.sum(bets["profit"]).alias("profit"),
    ).withColumns({
        "roi": F.when(F.col("staked") > 0, F.col("profit") / F.col("staked")),
        "beats_market": F.col("model_log_loss") < F.col("market_log_loss"),
    })
    return report.crossJoin(F.broadcast(encompassing(rows, y, p, "_market").drop("n")))
