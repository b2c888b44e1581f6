"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a hashed (shuffled) order, repeated up to
``max_passes`` times. An entry's virtual finish time is the number of words its queue has let
through when the entry ends, divided by the source's target. Serving entries by finish time
keeps all sources at the same share of their targets; the mix is cut at the total budget.

Prefix sums never gather a source: a source is cut into blocks of its hashed order (about
``ROWS_A_BLOCK`` rows), block totals give the offsets, and windows run inside blocks. The global
order is a range sort; only the range that holds the cut is looked at row by row.

Edge cases: a null text has size 0; entries of size 0 are never taken; the null source is a
source of its own, last in order; a source with no words gets target 0; rows that are equal in
every column are separate entries; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwise.session import settle, via_table

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_BLOCK = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, max_passes: int) -> DataFrame:
    """Water filling over the table of sources (one row each: ``source, source_size, n_docs``).

    With caps c and weights w, the sources in order of c/w are full up to some point; the level
    is what the others get per unit of weight. The excess reshared again and again ends there.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1).cast("int")
    listed = totals.withColumn("source_no", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1))
    listed = listed.withColumn("cap", F.col("source_size") * float(max_passes))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    listed = (
        listed.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("step", F.row_number().over(fill))
        .withColumn("level", (F.col("budget") - F.coalesce(before, F.lit(0.0))) / after)
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("found", F.min(F.when(F.col("fits"), F.struct("step", "level"))).over(everything))
    )
    target = F.when(F.col("found").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("found.level") * F.col("weight")))
    return listed.select(
        "source", "source_no", "source_size", target.alias("target"),
        F.ceil(F.col("n_docs") / ROWS_A_BLOCK).alias("blocks"))


def _queued(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``ahead``: the words of the same source before this row in the hashed order."""
    key = F.xxhash64(F.lit("mix"), "doc_id", "size")
    unit = F.shiftrightunsigned(key, 11) / float(1 << 53)
    rows = (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", "t.source_no", "t.source_size", "t.target", "t.blocks")
        .withColumn("key", key)
        .withColumn("block", F.floor(unit * F.col("blocks")))
    )
    totals = rows.groupBy("source_no", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "source_no", "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("source_no", "block").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.join(offsets, ["source_no", "block"])
        .withColumn("ahead", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .drop("offset", "block", "blocks")
    )


def _finish(number: int) -> Column:
    return (F.col("ahead") + F.col("size") + F.col("source_size") * number) / F.col("target")


def _cut(queued: DataFrame, max_passes: int, budget: float) -> tuple[float, int, int] | None:
    """The entry at which the mix is full: finish time, source and the words it still gives."""
    entries = (
        queued.where((F.col("size") > 0) & (F.col("target") > 0))
        .select(F.explode(F.array(*[_finish(i) for i in range(max_passes)])).alias("finish"), "source_no", "size")
    )
    ordered = settle(
        entries.repartitionByRange("finish", "source_no").withColumn("range", F.spark_partition_id()))
    ranges = ordered.groupBy("range").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.orderBy("range"))
    full = (ranges.withColumn("upto", running).where(F.col("upto") >= budget)
            .orderBy("range").select("range", F.col("upto") - F.col("words")).first())
    if full is None:
        return None
    place, base = full
    here = Window.orderBy("finish", "source_no")
    row = (
        ordered.where(F.col("range") == place)
        .withColumn("upto", F.sum("size").over(here) + F.lit(base))
        .where(F.col("upto") >= budget).orderBy("finish", "source_no")
        .select("finish", "source_no", F.col("size") - (F.col("upto") - F.lit(budget))).first())
    return None if row is None else (row[0], row[1], int(row[2]))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
        max_passes: int = 2) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``weights`` go to the sources in order of name, repeating. ``share`` is the budget as a part
    of all words; no target exceeds ``max_passes`` times its source. The document at the cut is
    taken in part, so that the mix has the budgeted number of words.
    """
    sized = via_table(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = via_table(source_targets(totals, weights, share, max_passes), "mix-targets")
    queued = via_table(_queued(sized, targets), "mix-queues")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    cut = _cut(queued, max_passes, budget) if budget > 0 else None
    taken = F.lit(0)
    for number in range(max_passes):
        entry = F.struct(_finish(number).alias("finish"), F.col("source_no").alias("source_no"))
        if cut is None:
            words = F.when(F.col("target") > 0, F.col("size")).otherwise(0)
        else:
            last = F.struct(F.lit(cut[0]).alias("finish"), F.lit(cut[1]).alias("source_no"))
            words = (F.when((F.col("target") > 0) & (F.col("size") > 0) & (entry < last), F.col("size"))
                     .when((F.col("size") > 0) & (entry == last), F.lit(cut[2])).otherwise(0))
        taken = taken + words
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def select_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 0.9) -> DataFrame:
    """The documents that a mix without repeats takes, whole, with all their columns.

    A document that the cut falls into is taken whole. Documents without words are left out. Rows
    that share an id go together.
    """
    chosen = mix(docs, weights, share, max_passes=1).where("taken > 0").select("doc_id").distinct()
    marked = docs.select(F.struct("*").alias("row")).alias("d").join(
        chosen.alias("c"), F.col("d.row.doc_id").eqNullSafe(F.col("c.doc_id")), "left_semi")
    return marked.select("row.*")
