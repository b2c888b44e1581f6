import pytest
from pyspark.sql import functions as F

from pairwise.functions.score import parse_score, score_fields
from pairwise.operators import clean, names, venues

FIELDS = ["winner_games_won", "loser_games_won", "winner_sets_won", "loser_sets_won",
          "sets_played", "tiebreaks_played", "winner_tiebreaks_won", "went_to_decider",
          "retirement", "walkover", "completed"]
CASES = {
    "6-4 6-3": (12, 7, 2, 0, 2, 0, 0, False, False, False, True),
    "7-6(5) 6-7(3) 7-6(4)": (20, 19, 2, 1, 3, 3, 2, True, False, False, True),
    "7-5 6-7(4) 7-6(10-8)": (20, 18, 2, 1, 3, 2, 1, True, False, False, True),
    "6-3 6-7(5) [10-8]": (13, 10, 2, 1, 3, 2, 1, True, False, False, True),
    "6-2 2-0 RET": (8, 2, 1, 0, 2, 0, 0, False, True, False, False),
    "W/O": (0, 0, 0, 0, 0, 0, 0, False, False, True, False),
    "Def.": (0, 0, 0, 0, 0, 0, 0, False, False, True, False),
    "walkover": (0, 0, 0, 0, 0, 0, 0, False, False, True, False),
    "6-4 W/O": (0, 0, 0, 0, 0, 0, 0, False, False, True, False),
    "60-0 6-4 6-4": (12, 8, 2, 0, 2, 0, 0, False, False, False, True),
    "": (0, 0, 0, 0, 0, 0, 0, False, False, False, False),
    "unknown": (0, 0, 0, 0, 0, 0, 0, False, False, False, False),
    None: (0, 0, 0, 0, 0, 0, 0, False, False, False, False),
}


def test_scorelines(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "score string")
    columns = score_fields(parse_score(F.col("score"), F.lit(3)))
    rows = df.select("score", *[columns[f].alias(f) for f in FIELDS]).collect()
    assert {r["score"]: tuple(r[f] for f in FIELDS) for r in rows} == CASES


def test_dominance_order(spark):
    df = spark.createDataFrame(
        [("6-0 6-0",), ("6-4 6-4",), ("7-6(5) 7-6(5)",), ("x",)], "score string")
    value = score_fields(parse_score(F.col("score"), F.lit(3)))["dominance"]
    a, b, c, unknown = [r[0] for r in df.select(value).collect()]
    assert 1.0 == a > b > c > 0.5 == unknown


def test_venues(spark):
    rows = [("Paris Masters", "Hard", True, 0, "FRA"), ("Rotterdam", "Hard", True, 0, "NED"),
            ("Anywhere", "Carpet", True, 0, None), ("Roland Garros", "Clay", False, 0, "FRA"),
            ("Wimbledon", "Grass", False, 0, "GBR"), ("Bogota", "Clay", False, 2640, "COL"),
            ("Quito", "Clay", False, 2850, "ECU"), ("Madrid Masters", "Clay", False, 667, "ESP"),
            ("Mexico City", "Hard", False, 2240, "MEX"), ("Nur-Sultan", "Hard", True, 0, "KAZ"),
            ("Lyon", "Clay", False, 0, "FRA"), (None, "Hard", False, 0, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "tourney_name string, surface string")
    got = venues.attach_venues(df).collect()
    found = {r["tourney_name"]: (r["indoor"], r["altitude_m"], r["host"]) for r in got}
    assert found == {r[0]: r[2:] for r in rows}


def test_half_even_dates(spark):
    # (12 - 7) * 1.1 + 1 = 6.5 rounds to the even 6.
    df = spark.createDataFrame([("2024-01-01", "SF", 64.0)], "d string, r string, n double")
    got = df.select(clean.approximate_date(F.to_date("d"), F.col("r"), F.col("n"))).first()[0]
    assert str(got) == "2024-01-07"


NAME_CASES = [
    ("Carlos Alcaraz", "given_first", {"alcaraz|c", "alcaraz|ca"}),
    ("Alcaraz C.", "surname_first", {"alcaraz|c"}),
    ("Alcaraz Carlos", "surname_first", {"alcaraz|c", "alcaraz|ca"}),
    ("Struff J.L.", "surname_first", {"struff|j"}),
    ("Jan-Lennard Struff", "given_first",
     {"lennardstruff|j", "lennardstruff|ja", "struff|j", "struff|ja"}),
    ("Felix Auger-Aliassime", "given_first",
     {"augeraliassime|f", "augeraliassime|fe", "aliassime|f", "aliassime|fe"}),
    ("Van de Zandschulp B.", "surname_first",
     {"vandezandschulp|b", "zandschulp|b", "dezandschulp|b"}),
    ("Pliskova Ka.", "surname_first", {"pliskova|k", "pliskova|ka"}),
    ("Šafářová L.", "surname_first", {"safarova|l"}),
    ("Ramos A.", "surname_first", {"ramosvinolas|a", "vinolas|a"}),
    ("Madonna", "given_first", {"madonna|"}), ("", "given_first", set()),
]


@pytest.mark.parametrize("order", ["given_first", "surname_first"])
def test_name_keys(spark, order):
    cases = {n: keys for n, o, keys in NAME_CASES if o == order}
    df = spark.createDataFrame([(n,) for n in cases], "name string")
    got = {r["name"]: set(r["keys"]) for r in names.with_keys(df, "name", order).collect()}
    assert got == cases


def test_resolution(spark):
    directory = spark.createDataFrame(
        [("wta", 1, "Karolina Pliskova", 5.0), ("wta", 2, "Kristyna Pliskova", 60.0),
         ("wta", 3, "Anna Smith", 7.0), ("wta", 4, "Alice Smith", 9.0),
         ("wta", 5, "Amy Smith", None)],
        "tour string, player_id long, name string, last_rank double")
    asked = spark.createDataFrame(
        [("wta", "Pliskova Ka.", None), ("wta", "Pliskova K.", 6.0), ("wta", "Pliskova K.", 33.0),
         ("wta", "Smith A.", 8.0), ("wta", "Smith A.", 7.0), ("wta", "Nobody X.", 1.0),
         ("wta", ".", 1.0)], "tour string, name string, rank double")
    got = {(r["name"], r["rank"]): (r["player_id"], r["status"])
           for r in names.resolve(asked, directory).collect()}
    assert got == {
        ("Pliskova Ka.", None): (1, "resolved"), ("Pliskova K.", 6.0): (1, "resolved"),
        ("Pliskova K.", 33.0): (None, "ambiguous"), ("Smith A.", 8.0): (None, "ambiguous"),
        ("Smith A.", 7.0): (3, "resolved"), ("Nobody X.", 1.0): (None, "unresolved"),
        (".", 1.0): (None, "blank")}


def test_resolution_takes_the_keys_of_a_name_once(spark):
    people = spark.createDataFrame([("atp", 1, "Rafael Nadal", 3.0)], "tour string, player_id long, name string, last_rank double")
    asked = spark.createDataFrame([("atp", "Nadal R.", 3.0)], "tour string, name string, rank double")
    resolved = names.resolve(asked, people)
    assert resolved.first()["player_id"] == 1
    # what reads keys reads a table of them: no text step is left in the plan
    assert "translate(" not in resolved._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_a_name_are_columns_of_their_own(spark):
    df = names.with_keys(spark.createDataFrame([("Juan Martin del Potro",)], "name string"), "name", names.SURNAME_FIRST)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 1 and plan.count("translate(") <= 2
