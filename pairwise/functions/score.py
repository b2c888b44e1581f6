"""Scoreline text to a struct of games, sets, tiebreaks and completion flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwise.functions.numeric import clip, known, strip

# --- fixed values: words found in scorelines ------------------------------------
RETIRED_WORDS = ["ret", "ret.", "retired", "rtd", "rtd."]
WALKOVER_WORDS = ["w/o", "wo", "walkover", "def", "def.", "default", "defaulted"]
SET_PATTERN = r"^(\d{1,2})-(\d{1,2})([\(\[][^\)\]]*[\)\]])?$"
TIEBREAK_PATTERN = r"^[\(\[](\d{1,2})-(\d{1,2})[\)\]]$"
MAX_GAMES = 30

COUNTERS = ["wg", "lg", "ws", "ls", "sets", "tb", "wtb"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _in(words: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))


def _reading(word: Column) -> Column:
    """One token as (decider, a, b, bracket); null when it is not a set score."""
    bare = word.rlike(TIEBREAK_PATTERN)
    first = F.when(bare, F.regexp_extract(word, TIEBREAK_PATTERN, 1)).otherwise(
        F.regexp_extract(word, SET_PATTERN, 1))
    second = F.when(bare, F.regexp_extract(word, TIEBREAK_PATTERN, 2)).otherwise(
        F.regexp_extract(word, SET_PATTERN, 2))
    return F.struct(
        bare.alias("decider"),
        first.cast("int").alias("a"),
        second.cast("int").alias("b"),
        word.rlike(r"[\)\]]$").alias("bracket"),
    )


def _step(acc: Column, item: Column) -> Column:
    a, b = item["a"], item["b"]
    high, low = F.greatest(a, b), F.least(a, b)
    decider = item["decider"]
    long_tiebreak = (high >= 10) & (acc["sets"] >= 2)
    finished = (
        ((high >= 6) & (high - low >= 2)) | ((high == 7) & low.isin(5, 6)) | long_tiebreak
    )
    tiebreak = decider | item["bracket"] | long_tiebreak | ((high == 7) & (low == 6))
    won, lost = a > b, b > a

    def add(name: str, amount: Column) -> Column:
        return (acc[name] + amount).cast("int").alias(name)

    def one(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return F.struct(
        add("wg", F.when(decider, one(won)).otherwise(a)),
        add("lg", F.when(decider, one(~won)).otherwise(b)),
        add("ws", one((decider | finished) & won)),
        add("ls", one((decider & ~won) | (finished & lost))),
        add("sets", F.lit(1)),
        add("tb", one(tiebreak)),
        add("wtb", one(tiebreak & won)),
        (acc["partial"] | (~decider & ~finished)).alias("partial"),
    )


def parse_score(score: Column, best_of: Column) -> Column:
    """Struct column; every field is set, also for missing or unreadable text."""
    text = F.coalesce(strip(score), F.lit(""))
    lowered = F.lower(text)
    called_off = (
        _in(_words(lowered), WALKOVER_WORDS)
        | lowered.contains("w/o")
        | lowered.startswith("def")
    )
    words = _words(F.regexp_replace(text, ",", " "))
    lower_words = F.transform(words, F.lower)
    retired = ~called_off & _in(lower_words, RETIRED_WORDS)
    walkover = called_off | _in(lower_words, WALKOVER_WORDS)

    readings = F.transform(
        F.filter(words, lambda w: w.rlike(SET_PATTERN) | w.rlike(TIEBREAK_PATTERN)), _reading
    )
    readings = F.filter(
        readings,
        lambda r: r["decider"] | ((r["a"] <= MAX_GAMES) & (r["b"] <= MAX_GAMES)),
    )
    zero = F.struct(
        *[F.lit(0).alias(name) for name in COUNTERS], F.lit(False).alias("partial")
    )
    played = F.when(called_off, zero).otherwise(F.aggregate(readings, zero, _step))
    return F.struct(
        played.alias("played"), retired.alias("retirement"), walkover.alias("walkover"),
        best_of.cast("int").alias("best_of"),
    )


def score_fields(parsed: Column) -> dict[str, Column]:
    """Columns of the match table that come from a parsed scoreline."""
    played = parsed["played"]
    sets, ls = played["sets"], played["ls"]
    readable = (sets > 0) | parsed["retirement"] | parsed["walkover"]
    completed = readable & ~parsed["retirement"] & ~parsed["walkover"]
    best_of = parsed["best_of"]
    by_format = known((best_of > 0) & (sets >= best_of))
    decider = F.when(by_format, completed & (sets == best_of)).otherwise(
        completed & sets.isin(3, 5) & (ls == F.floor(sets / 2))
    )
    return {
        "retirement": parsed["retirement"],
        "walkover": parsed["walkover"],
        "completed": completed,
        "sets_played": sets,
        "went_to_decider": decider,
        "tiebreaks_played": played["tb"],
        "winner_games_won": played["wg"],
        "loser_games_won": played["lg"],
        "winner_sets_won": played["ws"],
        "loser_sets_won": ls,
        "winner_tiebreaks_won": played["wtb"],
        "loser_tiebreaks_won": played["tb"] - played["wtb"],
        "dominance": _dominance(played, readable),
    }


def _dominance(played: Column, readable: Column) -> Column:
    games = played["wg"] + played["lg"]
    share = F.when(games > 0, played["wg"] / games).otherwise(0.5)
    margin = (played["ws"] - played["ls"]) / played["sets"]
    value = F.lit(0.5) * share + F.lit(0.5) * (F.lit(0.5) + margin / 2)
    return F.when(readable & (played["sets"] > 0), clip(value, 0.0, 1.0)).otherwise(0.5)
