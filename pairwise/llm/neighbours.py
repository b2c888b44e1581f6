"""Nearest neighbours by randomly rotated one-bit codes.

A vector is centred, scaled to length one and rotated; the signs of its coordinates are its code
and one correction number (the inner product of code and vector) goes with it. The inner product
of a query with a vector is estimated from the packed bits: the rotated query is rounded to
``PLANES``-bit numbers, and popcounts of code and query bit planes give the product. The estimate
has a known spread, so it comes with a lower and an upper bound of the distance. A vector is
measured exactly only where its lower bound does not exceed the k-th smallest upper bound.

All queries meet all vectors, in blocks: queries in blocks of ``QUERY_ROWS``, vectors in blocks
of about ``BLOCK_ROWS``; a task holds one of each and hands on at most k rows per query, which are
cut to k again before and after the shuffle. No block depends on a value, so no key can be hot.

The centre is the mean of a bounded sample (``SAMPLE_ROWS`` rows, first by hash). It only affects
how tight the bounds are; every vector is indexed.

Edge cases: rows without an id and vectors that are null, empty, zero, or hold a null or
non-finite component take no part; vectors of different lengths are never compared; a query has
fewer rows where there are fewer candidates; rows that share an id are one another's own rows and
never compared; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 8192, 1024
SAMPLE_ROWS = 4096
PLANES = 8
SPREAD = 3.5    # widths of the error bound; 3.5 leaves about 1 in 4,000 outside
SEED = 20


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    square = np.random.default_rng(SEED + dims).standard_normal((dims, dims))
    q, r = np.linalg.qr(square)
    return q * np.sign(np.diag(r))


def usable(vector: str):
    """Whether a vector can be compared at all."""
    return (F.col(vector).isNotNull() & (F.size(vector) > 0)
            & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean of a sample for each vector length. Lengths not in the sample are not centred."""
    sample = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
    by_length: dict[int, list[list[float]]] = {}
    for (row,) in sample.collect():
        by_length.setdefault(len(row), []).append(row)
    return {dims: np.mean(np.array(rows), axis=0) for dims, rows in by_length.items()}


def encode(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (64 to a word), lengths, and inner products of code and unit vector."""
    dims = rows.shape[1]
    norms = np.sqrt((rows * rows).sum(axis=1))
    turned = (rows / np.where(norms > 0, norms, 1)[:, None]) @ turn.T
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    padded = np.zeros((len(rows), -(-dims // 64) * 8), dtype=np.uint8)
    padded[:, :bits.shape[1]] = bits
    fit = np.abs(turned).sum(axis=1) / math.sqrt(dims)
    return padded.view(np.uint64), norms, np.where(norms > 0, fit, 1.0)


def estimate(codes: np.ndarray, ones: np.ndarray, fit: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a rotated unit query with the coded unit vectors, and their error bound."""
    dims, top = len(query), (1 << PLANES) - 1
    low, high = float(query.min()), float(query.max())
    step = (high - low) / top or 1.0
    levels = np.rint((query - low) / step).astype(np.int64)
    words = codes.shape[1]
    dot = np.zeros(len(codes), dtype=np.int64)
    for plane in range(PLANES):
        bits = np.zeros(words * 64, dtype=np.uint8)
        bits[:dims] = (levels >> plane) & 1
        mask = np.packbits(bits, bitorder="little").view(np.uint64)
        dot += np.bitwise_count(codes & mask).sum(axis=1, dtype=np.int64) << plane
    # code coordinates are +-1/sqrt(dims), so their product is twice the sum over set bits less the sum of all
    rounded = (2 * (step * dot + low * ones) - (step * levels.sum() + low * dims)) / math.sqrt(dims)
    spread = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit * SPREAD / math.sqrt(max(dims - 1, 1))
    rounding = math.sqrt(dims) * step / 2
    return rounded / fit, spread + rounding / fit


def search_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 centre: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of one block for each query, by exact distance."""
    turn = rotation(rows.shape[1])
    codes, norms, fit = encode(rows - centre, turn)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    out = []
    for query_id, query in zip(query_ids, queries, strict=True):
        moved = query - centre
        size = math.sqrt(float(moved @ moved))
        cosine, error = estimate(codes, ones, fit, (turn @ moved) / (size or 1.0))
        base, cross = norms * norms + size * size, 2 * norms * size
        other = ids != query_id
        upper = (base - cross * np.maximum(cosine - error, -1))[other]
        if len(upper) > k:
            bound = np.partition(upper, k - 1)[k - 1]
        else:
            bound = np.inf
        keep = np.flatnonzero(other & (base - cross * np.minimum(cosine + error, 1) <= bound * (1 + 1e-9) + 1e-12))
        gap = rows[keep] - query
        exact = np.sqrt((gap * gap).sum(axis=1))
        first = np.lexsort((ids[keep], exact))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[keep][first], "score": exact[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` nearest to each row of ``queries``.

    Both have ``vec_id`` and ``embedding``. Ties go to the smaller ``vec_id``.
    """
    def ready(df: DataFrame) -> DataFrame:
        return (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
                .where(F.col("vec_id").isNotNull() & usable("embedding"))
                .withColumn("dims", F.size("embedding")))

    base, asked = ready(vectors), ready(queries)
    middle = centres(base)
    blocks = max(1, math.ceil(base.count() / BLOCK_ROWS))
    rounds = max(1, math.ceil(asked.count() / QUERY_ROWS))
    hashed = F.xxhash64("vec_id")
    left = (base.withColumn("block", F.pmod(hashed, F.lit(blocks)))
            .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))))
    right = (asked.withColumn("round", F.pmod(hashed, F.lit(rounds)))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def meet(key: tuple, rows: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        dims = int(key[0])
        if rows.empty or against.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(
            rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()),
            against["vec_id"].to_numpy(), np.stack(against["embedding"].to_numpy()),
            middle.get(dims, np.zeros(dims)), k)

    keys = [F.col("dims").cast("long"), F.col("block").cast("long"), F.col("round").cast("long")]
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInPandas(meet, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

