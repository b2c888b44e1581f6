"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwise.session import via_table


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each end of a link reaches.

    ``links`` has columns ``a, b``. Alternates two steps until nothing changes: every node tells its
    larger neighbours about its smallest neighbour, then every node points its smaller neighbours
    at the smallest of them. Each step keeps a link per input link at most, and the number of steps
    grows with the logarithm of the longest chain. Groups are reduced by ``min`` with partial
    sums and joined back, so the neighbours of a node are never gathered. The links of a step are a
    written table, whose size Spark knows when it plans the joins of the next.
    """
    links = via_table(links.where("a <> b").select(
        F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(), "links")
    mark = None
    while True:
        # large step: links between a node and its larger neighbours move to its smallest neighbour
        both = links.union(links.select(F.col("small").alias("big"), F.col("big").alias("small"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        moved = via_table(both.where("other > node").join(least, "node").select(
            F.col("other").alias("big"), F.least("node", "least").alias("small")), "links-moved")
        # small step: the smaller neighbours of a node move to the smallest of them
        lowest = moved.groupBy("big").agg(F.min("small").alias("least"))
        pulled = moved.join(lowest, "big").select(F.col("small").alias("big"), F.col("least").alias("small")).where("big <> small")
        links = via_table(pulled.union(lowest.select("big", F.col("least").alias("small"))).distinct(), "links")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = links.select(F.col("small").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = links.select(F.col("big").alias("node"), F.col("small").alias("component"))
    return found.union(roots.join(found, "node", "left_anti"))
