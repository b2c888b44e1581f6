"""Delete later copies of repeated runs of lines, found by prefix doubling over line ids.

A document is the sequence of its non-blank lines. The suffixes of all sequences are ranked by
their first line, then by their first two, four, ... lines: the rank of a suffix at depth 2h is
the place of the pair (its rank at depth h, the rank at depth h of the suffix h lines on). Groups
of equal rank are the longest-common-prefix intervals of that depth. A suffix that is alone in
its group repeats nothing from there on and leaves the work, so after the first round only
repeated lines are carried.

A run of lines counts as repeated when it has ``min_lines`` lines or ``min_words`` words and
stands earlier as well (in a smaller ``doc_id``, or before in the same document). Every line in
a later copy of such a run is deleted. A run longer than ``min_lines`` is the union of its
``min_lines``-line windows, so ordering deeper than that cannot change what is deleted and the
doubling stops there; runs come out maximal because neighbouring windows are joined.

Column functions only. Groups are counted with partial sums, so a line that a third of all
documents share is one row per task before it moves; joins on such a line are left to Spark's
skew handling. Ranks are row numbers of a range sort of the distinct groups.

Edge cases: a null text stays null and has no lines; blank lines are neither matched nor
deleted; rows equal in ``doc_id`` and text are one document and are changed alike; rows with the
same ``doc_id`` and other texts are in order of the text's hash; a null ``doc_id`` comes first; an
empty table gives an empty result; all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise.session import settle, via_table

MIN_LINES, MIN_WORDS = 3, 50
WORD = r"\S+"

PLACE = ["doc_id", "text_id", "no"]


def _text_id(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text)))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, text_id, no, at, line, words``: the non-blank lines of each distinct document.

    ``no`` counts them from 0, ``at`` is the place among all lines, ``line`` the 128-bit line id.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(
        i.alias("at"), F.unhex(F.md5(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    kept = F.filter(lines, lambda x: x["words"] > 0)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", _text_id().alias("text_id"), kept.alias("lines"))
    return found.select("doc_id", "text_id", F.posexplode("lines").alias("no", "x")).select(
        *PLACE, "x.at", "x.line", "x.words")


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank``: numbers in the order of ``keys``, from a range sort."""
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _intervals(suffixes: DataFrame, keys: list[str], ranked: bool) -> DataFrame:
    """The suffixes whose ``keys`` occur more than once, with the first place of their group."""
    groups = (
        suffixes.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first"))
        .where("n > 1").drop("n")
    )
    groups = _ranked(groups, keys) if ranked else groups
    return suffixes.join(groups, keys).drop(*keys)


def _pairs(level: DataFrame, shift: int) -> DataFrame:
    """The rank of each suffix and of the suffix ``shift`` lines on, where that is still in the work."""
    document = Window.partitionBy("doc_id", "text_id").orderBy("no").rangeBetween(shift, shift)
    return (level.drop("first").withColumn("second", F.first("rank").over(document))
            .where(F.col("second").isNotNull()).withColumnRenamed("rank", "own"))


def _window(column: str, length: int, how) -> Column:
    document = Window.partitionBy("doc_id", "text_id").orderBy("no").rangeBetween(0, length - 1)
    return how(column).over(document)


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_id, gone``: the places of the lines in later copies of repeated runs, in order."""
    lines = via_table(line_table(docs), "lines")
    # every line of a repeated run is repeated itself, so sums and places over repeated lines are enough
    level = via_table(
        _intervals(lines, ["line"], ranked=True).dropDuplicates(PLACE)
        .withColumn("run_words", F.array(*[_window("words", n, F.sum) for n in range(1, min_lines + 1)]))
        .withColumn("run_at", _window("at", min_lines, F.collect_list)).drop("words", "at"), "line-ranks")
    later, depth = None, 1
    while True:
        for length in range(depth, min(2 * depth, min_lines + 1)):
            repeated = level
            if length > depth:  # two windows of the known depth that overlap
                repeated = _intervals(_pairs(level, length - depth), ["own", "second"], ranked=False)
            if length < min_lines:
                repeated = repeated.where(F.element_at("run_words", length) >= min_words)
            copies = repeated.where(F.col("first") != F.struct(*PLACE)).select(
                "doc_id", "text_id", F.slice("run_at", 1, length).alias("run_at"))
            later = copies if later is None else later.unionByName(copies)
        if 2 * depth > min_lines:
            break
        level = via_table(_intervals(_pairs(level, depth), ["own", "second"], ranked=True), "line-ranks")
        depth = 2 * depth
    return (later.select("doc_id", "text_id", F.explode("run_at").alias("at"))
            .groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("at")).alias("gone")))


def mark(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``row, lines, gone``: each row as a struct, its lines, and the places of those to delete."""
    gone = repeated_lines(docs, min_lines, min_words)
    whole = docs.select(F.struct("*").alias("row")).withColumn("text_id", F.unhex(F.md5("row.text")))
    return (
        whole.alias("d").join(
            gone.alias("g"),
            F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_id") == F.col("g.text_id")), "left")
        .select("d.row", F.split("d.row.text", "\n", -1).alias("lines"),
                F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"))
    )


def remaining_text() -> Column:
    """The text of a row of ``mark`` without the lines to delete."""
    gone, size = F.col("gone"), F.size("gone")

    def stretch(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == size, F.size("lines")).otherwise(F.get(gone, i))
        return F.slice("lines", start + 1, end - start)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), size), stretch)), "\n")
    return F.when(size == 0, F.col("row.text")).otherwise(kept)


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later copies of repeated runs deleted from ``text``."""
    marked = mark(docs, min_lines, min_words)
    return marked.select(*[
        remaining_text().alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
