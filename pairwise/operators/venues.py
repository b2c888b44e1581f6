"""Event names to altitude, roof and host country.

The word lists are small and fixed, so each distinct name is tested against them as an
array expression; the result joins back by equality.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwise.functions import venue_words
from pairwise.functions.numeric import known, strip


def clean_name(name: Column) -> Column:
    """Lower case, anything but letters, digits and spaces to a space, collapsed."""
    text = F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " ")
    return F.coalesce(strip(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def clean_word(word: str) -> str:
    """The same for a word list entry, so entries with punctuation can match."""
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", word.lower())).strip()


def _table(rows: list[tuple]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(clean_word(word)).alias("word"), F.lit(position).alias("position"),
            F.lit(value).alias("value"),
        )
        for position, (word, value) in enumerate(rows)
    ])


def _hits(key: Column, rows: list[tuple]) -> Column:
    return F.filter(_table(rows), lambda r: key.contains(r["word"]))


def altitude(key: Column) -> Column:
    first = F.get(_hits(key, list(venue_words.ALTITUDES.items())), 0)
    return F.coalesce(first["value"], F.lit(0))


def country(key: Column) -> Column:
    ranked = F.transform(
        _hits(key, list(venue_words.COUNTRIES.items())),
        lambda r: F.struct(
            F.length(r["word"]).alias("size"), (-r["position"]).alias("earlier"),
            r["value"].alias("value"),
        ),
    )
    return F.array_max(ranked)["value"]


def indoor_by_name(key: Column) -> Column:
    words = F.array(*[F.lit(clean_word(w)) for w in venue_words.INDOOR_WORDS])
    listed = F.exists(words, lambda w: key.contains(w))
    named = ~key.isin(venue_words.OUTDOOR_NAMES) & (key.contains("indoor") | listed)
    return named & (key != "")


def is_carpet(surface: Column) -> Column:
    return known(F.lower(strip(surface)) == "carpet")


def indoor(key: Column, surface: Column) -> Column:
    return is_carpet(surface) | indoor_by_name(key)


def attach_venues(matches: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add ``indoor``, ``altitude_m`` and ``host``; each distinct name is read once.

    ``names`` is any cheap source of the ``tourney_name`` values (default: the matches).
    The distinct names come from a pre-aggregated group-by; Spark chooses the join from
    their measured size, and the adaptive skew join splits a hot name.
    """
    key = clean_name(F.col("_name"))
    events = (
        (matches if names is None else names)
        .select(F.col("tourney_name").alias("_name")).distinct()
        .select("_name", indoor_by_name(key).alias("_indoor"),
                altitude(key).alias("altitude_m"), country(key).alias("host"))
    )
    joined = matches.join(events, F.col("tourney_name") == F.col("_name"), "left")
    return joined.withColumns({
        "indoor": is_carpet(F.col("surface")) | known(F.col("_indoor")),
        "altitude_m": F.coalesce("altitude_m", F.lit(0)),
    }).drop("_name", "_indoor")
