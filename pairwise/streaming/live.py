"""Incremental forms: per-player counters as a stateful stream, ratings per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pairwise.functions.numeric import flag
from pairwise.operators import ratings
from pairwise.operators.history import day_number
from pairwise.sources.tables import load_table, save_table, table_exists

COUNTED = ("tour string, player_id long, match_id string, side string, career_matches double, "
           "career_wins double, win_streak double, loss_streak double, late_rows long")
#: Players with neighbouring numbers share a group, whose fixed cost in Python is high, and a state.
PLAYERS_A_GROUP = 64
#: What the counters read of a match.
READ = ["tour", "match_id", "match_date", "tourney_id", "match_num", "winner_id", "loser_id", "walkover"]
#: One entry in each list for a player, in the order of ``player_id``.
STATE = ("player_id array<long>, n array<long>, wins array<long>, win_streak array<long>, "
         "loss_streak array<long>, last_day array<long>, late array<long>")
ORDER = ["day", "tourney_id", "match_num"]


def _added(x, reset, start, end, owner, carried):
    """What ``x`` adds up to since the latest reset of a player: before each row, and after the player's last.

    Rows lie player by player; player k has those from ``start[k]`` to ``end[k]`` and starts with
    ``carried[k]``, row i belongs to player ``owner[i]``.
    """
    import numpy as np

    total = np.concatenate([[0], np.cumsum(x)])
    since = np.maximum.accumulate(np.concatenate([[0], np.where(reset, np.arange(1, len(x) + 1), 0)]))

    def at(place, start, carried):
        fresh = since[place] > start
        return total[place] - total[np.where(fresh, since[place], start)] + np.where(fresh, 0, carried)

    return at(np.arange(len(x)), start[owner], carried[owner]), at(end, start, carried)


def _count(key, chunks: Iterator, state):
    """Counters before each match of a group's players; a row older than its player's state is late: it
    is counted and dropped. A group holds only this micro-batch's rows."""
    import numpy as np
    import pandas as pd

    rows = pd.concat(list(chunks))
    unknown = key[1] is None      # the group of the rows without a player
    numbers = np.zeros(len(rows), "int64") if unknown else rows["player_id"].to_numpy("int64")
    rows = rows.assign(_player=numbers, day=rows["day"].astype("int64"))     # no date is an error
    rows = rows.sort_values(["_player", *ORDER], kind="mergesort", ignore_index=True)
    held = np.array(state.get, "int64") if state.exists else np.zeros((7, 0), "int64")
    players = np.union1d(held[0], numbers)
    kept = np.zeros((7, len(players)), "int64")
    kept[0], kept[5] = players, -10**6
    kept[:, np.searchsorted(players, held[0])] = held
    late = rows["day"].to_numpy() < kept[5][np.searchsorted(players, rows["_player"])]
    np.add.at(kept[6], np.searchsorted(players, rows["_player"][late]), 1)
    rows = rows[~late]
    _, n, wins, up, down, last, missed = kept
    owner = np.searchsorted(players, rows["_player"])
    start, end = (np.searchsorted(owner, np.arange(len(players)), side) for side in ("left", "right"))
    live, won = rows["live"].to_numpy() != 0, rows["won"].to_numpy() != 0
    never, up_by, down_by = np.zeros(len(rows), bool), live & won, live & ~won
    before = {}
    for name, carried, add, reset in (("career_matches", n, live, never), ("career_wins", wins, up_by, never),
                                      ("win_streak", up, up_by, down_by), ("loss_streak", down, down_by, up_by)):
        read, after = _added(add, reset, start, end, owner, carried)
        before[name], carried[:] = read.astype("float64"), after
    seen = end > start
    last[seen] = rows["day"].to_numpy()[end[seen] - 1]
    state.update(tuple(values.tolist() for values in kept))
    yield pd.DataFrame({"tour": key[0], "player_id": None if unknown else rows["player_id"], "match_id": rows["match_id"],
                        "side": rows["side"], **before, "late_rows": missed[owner]})


def career_stream(matches: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Streaming matches to counters of both players before each match.

    Keyed by tour and block of players; the state of a player is six numbers and never expires.
    """
    timed = matches.withColumn("_time", F.col("match_date").cast("timestamp"))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{name}_id").alias("player_id"), F.lit(won).alias("won"))
                      for side, name, won in (("w", "winner", 1), ("l", "loser", 0))])
    rows = timed.withWatermark("_time", lateness).select(
        "tour", "match_id", day_number(F.col("match_date")).alias("day"), "tourney_id", "match_num",
        (1 - flag(F.col("walkover"))).alias("live"), F.inline(sides))
    block = F.floor(F.col("player_id") / PLAYERS_A_GROUP).alias("block")
    return rows.select("*", block).groupBy("tour", "block").applyInPandasWithState(
        _count, COUNTED, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available; each batch writes its own folder, so a retry replaces it."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def rating_step(spark: SparkSession, path: str):
    """A foreachBatch function that carries the rating tables from batch to batch.

    Batch n reads the state of batch n - 1 and writes its own ratings and state, so a
    repeated batch gives the same tables.
    Ratings are stored as ``ratings.kept`` has them.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        before = f"{path}/state-{epoch - 1}"
        state = load_table(spark, before) if table_exists(spark, before) else None
        if batch.isEmpty():
            if state is not None:
                save_table(state, f"{path}/state-{epoch}")
            return
        save_table(ratings.kept(ratings.rate_matches(batch, state)), f"{path}/rated/epoch={epoch}")
        final = load_table(spark, f"{path}/rated/epoch={epoch}").filter("match_id IS NULL")
        if state is not None:
            key = ratings.POOL + ["a"]
            final = final.unionByName(state.join(final, key, "left_anti"))
        save_table(final, f"{path}/state-{epoch}")

    return step


def run_ratings(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Follows what is available of a match stream; ratings and state are under ``path``."""
    stream.writeStream.foreachBatch(rating_step(stream.sparkSession, path)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def open_matches(spark: SparkSession, path: str, like: DataFrame, files: int) -> DataFrame:
    """Parquet files of a match table as a stream, oldest files first."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
