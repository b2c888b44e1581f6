"""Find secrets by pattern and judge each by who owns it across the corpus.

A pattern alone cannot tell a key that a hundred projects copied from one manual page from a
key that a single owner leaked. Every candidate value is hashed, and for every hash the distinct
repositories (documents) and owners (sources) that hold it are counted over the whole corpus. A
value with many owners is ``copied``, one that stays with few owners is ``live``. The counts also
admit a fourth kind of span, ``owned``: long mixed-case tokens without any keyword near them,
which are reported only when few owners hold them.

Column functions only. Positions come from splitting a text at a pattern: the lengths of the
pieces and of the matches between them add up to offsets in code points.

Edge cases: a null text counts as empty; a document without spans has counts 0, an empty string
of spans and the hash of the empty string; equal rows each give a row of their own (rows are told
apart by a number given when the spans are staged); an empty table gives an empty result; columns
other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwise.session import via_table

# --- fixed values: the patterns of the base kinds, in the order in which kinds are listed ---
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA and a run, 16 characters at least
HEX = r"[0-9a-f]{32,}"
LONG = r"[A-Za-z0-9+/_=-]{24,}"
LEAST_ASSIGNED = 8
KINDS = ["assign", "access", "hex", "owned"]


def spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """Matches of ``pattern``, leftmost first: an array of ``(start, end, value)`` in code points.

    With ``groups`` the value is that group of the match, else the whole match.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)) if groups else found
    zipped = F.arrays_zip(
        F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("all"))
    placed = F.aggregate(
        zipped, start,
        lambda state, x: F.struct(
            (state["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(state["all"], F.array(F.struct(
                (state["at"] + F.length(x["gap"])).alias("start"),
                (state["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
                x["value"].alias("value")))).alias("all")),
        lambda state: state["all"])
    # most texts have no match: a plain search is all they pay for
    return F.when(text.rlike(pattern), placed).otherwise(start["all"])


def _tagged(found: Column, number: int) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"),
        F.sha2(x["value"], 256).alias("hash")))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, source, row`` and all candidate spans with value hashes.

    A candidate of kind ``owned`` has a lower-case letter, an upper-case letter and a digit, and
    overlaps no span of another kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", "source", text.alias("text"))
    assign = F.filter(spans(F.col("text"), ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_ASSIGNED)
    mixed = F.filter(spans(F.col("text"), LONG), lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
                     & x["value"].rlike("[0-9]"))
    found = read.select(
        "doc_id", "source",
        F.concat(_tagged(assign, 0), _tagged(spans(F.col("text"), ACCESS), 1),
                 _tagged(spans(F.col("text"), HEX), 2)).alias("base"),
        _tagged(mixed, 3).alias("extra"))
    apart = F.filter("extra", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return found.select(
        "doc_id", "source", F.monotonically_increasing_id().alias("row"),
        F.array_sort(F.concat("base", apart)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners``: how many documents and sources hold each candidate value.

    Counted in two steps, so that a value held everywhere is summed before it is brought together.
    """
    held = found.select("doc_id", "source", "row", F.explode(F.array_distinct(F.transform("spans", lambda x: x["hash"]))).alias("hash"))
    by_owner = held.groupBy("hash", "source").agg(F.count("*").alias("docs"))
    return by_owner.groupBy("hash").agg(
        F.sum("docs").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, live_owners: int = 1) -> DataFrame:
    """One row per document with its judged spans.

    ``spans`` holds ``(start, kind, end, hash, n_repos, n_owners, live)`` in order of start and
    kind. Spans of the base kinds all stay; an ``owned`` candidate stays when at most
    ``live_owners`` sources hold its value.
    """
    staged = via_table(candidates(docs), "secret-candidates")
    counts = ownership(staged)
    each = staged.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    judged = (
        each.select("row", "s.*").join(counts, "hash")
        .withColumn("live", F.col("n_owners") <= live_owners)
        .where((F.col("kind") < 3) | F.col("live"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
            "start", "kind", "end", "hash", "n_repos", "n_owners", "live"))).alias("spans"))
    )
    return (
        staged.drop("spans").join(judged, "row", "left")
        .withColumn("spans", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)))
        .drop("row")
    )


def span_text(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
