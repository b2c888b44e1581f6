"""What stays on disk: shuffle files of stored tables, and fits that nobody reads."""

from glob import glob

from pyspark.sql import functions as F

from pairwise import session
from pairwise.operators import history, skill
from pairwise.session import FREED, via_table
from tests.test_state import same


def shuffled(spark) -> set:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in glob(f"{folder}/*/shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, own = shuffled(spark), spark.conf.get(FREED, None)
    stored = via_table(spark.range(10_000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counted")
    assert shuffled(spark) <= before
    assert stored.count() == 10 and spark.conf.get(FREED, None) == own


def test_fits_that_are_read_serve_every_match(matches):
    whole, read = (via_table(skill.fit_rolling(matches, read=r), "fits") for r in (False, True))
    assert read.count() < whole.count()
    same(skill.rolling_features(matches, read), skill.rolling_features(matches, whole), ["match_id"])
    last = F.col("cut") == skill.last_refit(matches)
    same(read.filter(last), whole.filter(last), ["kind", "tour", "player_id", "surface"])


def test_staged_history_is_the_same(matches, monkeypatch):
    timeline = history.appearances(matches)
    plain, kept = history.history(timeline), []
    monkeypatch.setattr(history, "remove_path", lambda spark, path: kept.append(path) or session.remove_path(spark, path))
    staged = history.history(timeline, staged=True)
    assert len(kept) == 2 and staged._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    same(staged, plain, ["match_id", "side"])


def test_meetings_of_a_pair_are_shuffled_once(matches):
    rows = history.history(history.appearances(matches), wanted=history.HEAD_TO_HEAD)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
