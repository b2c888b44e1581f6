"""From raw documents to packed sequences, in five stages.

Each stage is a function of ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

1. quality     the classifier is fitted on the labels; documents below ``REJECT_BELOW`` go
2. lines       later copies of repeated runs of lines are deleted from the texts
3. near        one document of each group of near duplicates stays
4. mix         whole documents by weighted fair queueing, ``MIX_SHARE`` of all words, none twice
5. pack        the pieces of 4096-token sequences, in the order of the curve
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwise.llm import lines, mixing, near, packing, quality
from pairwise.session import scratch_path
from pairwise.sources.tables import read_table

REJECT_BELOW = 0.5
MIX_SHARE = 0.9
TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier finds likelier bad than good. Learns from the first fold only."""
    labels = read_table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return docs.where(quality.score(model, F.col("text")) >= REJECT_BELOW)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_documents(docs, share=MIX_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL cannot express the classifier or the tokenizer; tests/llm compares stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; between stages the result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
