"""CSV files that differ in their headers, read by column name.

The first line of every file is its header. Files with the same header are one layout; only the
distinct headers come to the driver, the assignment of files to layouts stays a table.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return bool(found)


def header_names(line: str) -> list[str]:
    """Column names of a header line: a byte-order mark goes, quotes are read, blanks are cut."""
    return [name.strip() for name in next(csv.reader([line.lstrip("﻿")]), [])]


def read_layouts(spark: SparkSession, pattern: str, needed: list[str]) -> list[DataFrame]:
    """One frame per header layout, all columns text, with ``_file``, ``_start`` and ``_row``.

    A file whose header has none of the ``needed`` names (in any case) is an error: its first
    line would be taken for a header and its rows for anything. So is a file that cannot be read to
    its end.
    """
    if not exists(spark, pattern):
        return []
    lines = spark.read.text(pattern).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"))
    # within a file the first block and its first line come first
    heads = lines.groupBy("_file").agg(F.min(F.struct("_start", "_row", "value")).alias("head"))
    out = []
    for (line,) in heads.select("head.value").distinct().orderBy("value").collect():
        names = header_names(line)
        if not {n.lower() for n in names} & {n.lower() for n in needed}:
            raise ValueError(f"no header with any of {needed} in files that begin with {line[:200]!r}")
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        files = heads.filter(F.col("head.value") == line).select("_file", "head")
        rows = lines.join(files, "_file").filter(
            (F.col("_row") != F.col("head._row")) & (F.length(F.trim("value")) > 0))
        parsed = F.from_csv(F.col("value"), schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "escape": '"'})
        kept = [(i, n) for i, n in enumerate(names) if n and n not in names[:i]]
        out.append(rows.withColumn("_parsed", parsed).select(
            *[F.col(f"_parsed.c{i}").alias(n) for i, n in kept], "_file", "_start", "_row"))
    return out
