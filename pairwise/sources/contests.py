"""Contests drawn from order tables, so that every operator can run on them.

For each order the two suppliers with the largest summed price become the sides; the pool
is the customer's region. Columns without a counterpart are plain functions of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwise.operators.clean import finish_matches
from pairwise.sources.tables import read_table

VENUES = [
    "Roland Garros", "Madrid Masters", "Bogota", "Quito", "Wimbledon", "Paris Masters",
    "Rotterdam", "Mexico City", "Neutral Court", "Monte Carlo Masters", "Lyon", "Lyon Indoor",
    "St. Petersburg", "'s-Hertogenbosch", "Queen's Club", "US Open", "Indian Wells Masters",
    "Kitzbuhel", "Stuttgart", "Canada Masters", "Bogota Open", "Tokyo", "Nur-Sultan",
    "Sao Paulo", "Acapulco",
]
COUNTRIES = [
    "FRA", "ESP", "COL", "ECU", "GBR", "ITA", "NED", "MEX", "USA", "MON", "GER", "SUI", "RUS",
    "AUT", "BEL", "SWE", "DEN", "CHN", "JPN", "CAN", "BRA", "ARG", "KAZ", "CHI", "AUS",
]
SCORES = [
    "6-4 6-3", "7-6(5) 6-7(3) 7-6(4)", "6-2 2-0 RET", "W/O", "6-3 6-7(5) [10-8]",
    "7-5 6-7(4) 7-6(10-8)", "6-0 6-0", "6-4 3-6 7-5", "6-1 6-2", None, "60-0 6-4 6-4",
    "6-7(5) 6-3 6-4",
]

#: Lines of orders that one task takes; a contest has about four.
LINES_A_TASK = 100_000


def by_number(key: str, values: list) -> str:
    """CASE over 0, 1, 2, ...; portable between SQL engines."""
    def quoted(value) -> str:
        if value is None:
            return "CAST(NULL AS VARCHAR(40))"
        return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"

    arms = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


# Expressions in terms of order, nation and region columns; valid in both engines.
EVENT_COLUMNS = {
    "match_num": "CAST(o_orderkey AS BIGINT)",
    "match_id": "CONCAT(LOWER(r_name), '-', n_name, '-', CAST(o_orderkey AS VARCHAR(20)))",
    "tour": "LOWER(r_name)",
    "tourney_id": "n_name",
    "tourney_name": by_number("n_nationkey", VENUES),
    "match_date": "CAST(o_orderdate AS DATE)",
    "surface": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Hard' WHEN '2-HIGH' THEN 'Clay' "
               "WHEN '3-MEDIUM' THEN 'Grass' WHEN '4-NOT SPECIFIED' THEN 'Carpet' "
               "ELSE 'Unknown' END",
    "level": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'G' WHEN 'BUILDING' THEN 'M' "
             "WHEN 'FURNITURE' THEN 'A' WHEN 'HOUSEHOLD' THEN 'C' ELSE 'Z' END",
    "best_of": "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 5 ELSE 3 END",
    "round": by_number("o_orderkey % 8", ["R128", "R64", "R32", "R16", "QF", "SF", "F", "RR"]),
    "draw_size": "CAST(" + by_number("o_orderkey % 3", [32, 64, 128]) + " AS DOUBLE)",
    "minutes": "CAST(60 + (o_orderkey * 7) % 120 AS DOUBLE)",
    "score": by_number("o_orderkey % 12", SCORES),
    "odds_winner": "CAST(101 + o_orderkey % 400 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "odds_loser": "CAST(101 + (o_orderkey * 13) % 300 AS DOUBLE) / CAST(100 AS DOUBLE)",
}

# Expressions in terms of s_suppkey, s_name, s_nationkey, s_acctbal, o_orderkey.
PLAYER_COLUMNS = {
    "name": "s_name",
    "hand": "CASE s_suppkey % 9 WHEN 0 THEN 'L' WHEN 1 THEN 'U' ELSE 'R' END",
    "height_cm": "CASE WHEN s_suppkey % 11 <> 3 THEN CAST(165 + s_suppkey % 40 AS DOUBLE) END",
    "ioc": by_number("s_nationkey", COUNTRIES),
    "age": "CASE WHEN s_suppkey % 13 <> 5 THEN CAST(17 + s_suppkey % 16 AS DOUBLE) "
           "+ CAST(o_orderkey % 3000 AS DOUBLE) / CAST(400 AS DOUBLE) END",
    "rank": "CASE WHEN o_orderkey % 17 <> 0 THEN "
            "CAST(1 + (s_suppkey * 31 + o_orderkey) % 400 AS DOUBLE) END",
    "rank_points": "CASE WHEN o_orderkey % 17 <> 0 THEN CAST(FLOOR(ABS(s_acctbal)) AS DOUBLE) END",
}


def _sides(lineitem: DataFrame, parts: int) -> DataFrame:
    """Two best-selling suppliers of each order, as one row.

    The lines of an order (a few) are brought together once, in ``parts`` partitions; totals, ranks
    and the one row of each order follow where they lie.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    points = (F.round(F.col("l_quantity") * 100).cast("bigint")
              * F.round(F.lit(50) + F.col("l_tax") * 200).cast("bigint"))
    lines = lineitem.select(
        "l_orderkey", "l_suppkey", "l_quantity", cents.alias("cents"), points.alias("points"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("open"))
    totals = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("cents").alias("amount"),
        F.sum("l_quantity").alias("svpt"),
        F.floor(F.sum("points") / 10000).cast("double").alias("spw"),
        F.count(F.lit(1)).cast("double").alias("bp_faced"),
        F.sum("open").cast("double").alias("bp_saved"),
    )
    window = Window.partitionBy("l_orderkey").orderBy(F.desc("amount"), "l_suppkey")
    top = totals.withColumn("nth", F.row_number().over(window)).filter("nth <= 2")
    fields = {"id": "l_suppkey"} | {n: n for n in ("svpt", "spw", "bp_faced", "bp_saved")}
    return (
        top.groupBy("l_orderkey")
        .agg(*[
            F.max(F.when(F.col("nth") == nth, F.col(source))).alias(f"{letter}_{name}")
            for nth, letter in ((1, "w"), (2, "l")) for name, source in fields.items()
        ])
        .filter("l_id IS NOT NULL")
    )


def contests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per contest with clean columns for both sides.

    Contests leave in as many partitions as their lines ask for, not in those that fit the size of a
    compressed shuffle: what a task holds does not grow with the tables. So customers, who may need a
    shuffle of their own, are joined before the lines.
    """
    suppliers, lineitem = read_table(spark, folder, "supplier"), read_table(spark, folder, "lineitem")
    parts = max(1, -(-lineitem.count() // LINES_A_TASK))

    def players(side: str) -> DataFrame:
        return suppliers.select(
            F.col("s_suppkey").alias(f"{side}_key"),
            F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal").alias(f"{side}_row"))

    joined = (
        read_table(spark, folder, "orders")
        .join(read_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .repartition(parts, "o_orderkey")
        .join(_sides(lineitem, parts), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(players("w"), F.col("w_id") == F.col("w_key"))
        .join(players("l"), F.col("l_id") == F.col("l_key"))
    )
    columns = [F.expr(sql).alias(name) for name, sql in EVENT_COLUMNS.items()]
    for side, letter in (("winner", "w"), ("loser", "l")):
        columns.append(F.col(f"{letter}_id").alias(f"{side}_id"))
        for name, sql in PLAYER_COLUMNS.items():
            for field in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"):
                sql = sql.replace(field, f"{letter}_row.{field}")
            columns.append(F.expr(sql).alias(f"{side}_{name}"))
        for name in ("svpt", "spw", "bp_faced", "bp_saved"):
            columns.append(F.col(f"{letter}_{name}").alias(f"{side}_{name}"))
    return joined.select(*columns)


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """The contests as a finished match table."""
    names = read_table(spark, folder, "nation").select(
        F.expr(EVENT_COLUMNS["tourney_name"]).alias("tourney_name"))
    return finish_matches(contests(spark, folder), names)
