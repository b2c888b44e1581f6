import pytest

from pairwise.plans import catalog
from pairwise.sources import contests


@pytest.mark.parametrize("name", ["feature_envelope"])
def test_contests_are_drawn_once(spark, folder, monkeypatch, name):
    """Drawing the contests is the costly part: a query that reads them in several passes stores them first."""
    drawn = contests.contests(spark, folder)
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passes.add(len(batch))
            yield batch

    rows = drawn.count()
    monkeypatch.setattr(catalog.contests, "contests", lambda *_: drawn.mapInPandas(seen, drawn.schema))
    catalog.QUERIES[name](spark, folder).collect()
    assert passes.value == rows


def test_dedup_draws_the_contests_once(spark, folder):
    """Both files come from one drawing: its plan reads the lines of the orders once."""
    plan = catalog.QUERIES["dedup_matches"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") > 0 and plan.count("Relation [l_orderkey") == 1


def test_partitions_of_contests_follow_their_lines(spark, folder, monkeypatch):
    """Small shuffles are packed together again, unless the number of partitions is fixed."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    monkeypatch.setattr(contests, "LINES_A_TASK", 300)
    sizes = [n for n in contests.contests(spark, folder).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert len(sizes) == -(-lines // 300) and max(sizes) < 300


def test_directory_sums_up_a_player_in_few_places(spark, folder):
    """States of a player are wider than rows: they are built where at most a few hold the player, not in every partition."""
    from pairwise.operators import directory

    drawn = contests.contests(spark, folder).repartition(40)
    table = directory.build(drawn)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(hash(tourney_id" in plan and plan.index("Aggregate") < plan.index("RepartitionByExpression")
    sides = [(r.tour, r[f"{side}_id"], r.match_date) for r in drawn.collect() for side in ("winner", "loser")]
    found = {(r.tour, r.player_id): (r.matches, r.last_played) for r in table.collect()}
    wanted = {}
    for tour, player, day in sides:
        n, last = wanted.get((tour, player), (0, day))
        wanted[tour, player] = (n + 1, max(last, day))
    assert found == wanted
