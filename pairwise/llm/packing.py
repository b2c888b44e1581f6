"""Pack documents into fixed-length token sequences along a space-filling curve.

Every document gets a hashed bag-of-words vector, projected to ``DIMS`` numbers and placed on a
Hilbert curve, so that documents with the same words are near each other on the curve. A range
sort by the curve key is the packing order; a running sum of lengths over that order gives every
token a global position, and sequences are cut at multiples of ``length``. Only the last sequence
of all can be short: it is cut into powers of two, which need no padding.

Tokens are made once and staged as bytes. Order and offsets are worked out on
``(row, curve, n)`` alone, by a range sort and totals per range; the token bytes are then joined
to their offsets by row.

Edge cases: a null or empty text gives the end token alone; equal rows are separate documents
(each staged row has a number); a null ``doc_id`` is packed like any other; an empty table gives
an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwise.llm.tokens import BulkTokens
from pairwise.session import settle, via_table

LENGTH = 4096
END_ID = 2
DIMS, BITS = 4, 10          # of the curve
BUCKETS = 256               # of the hashed bag of words


_tokens: dict[str, BulkTokens] = {}


def _worker_tokens(path: str) -> BulkTokens:
    if path not in _tokens:
        _tokens[path] = BulkTokens(path)
    return _tokens[path]


def directions(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points with ``bits``-bit coordinates (rows of ``cells``).

    Works from the top bit down: the bits read so far say how the remaining cube is turned and
    mirrored, and the Gray-code rank of the next bits is the next digit of the key.
    """
    points, dims = cells.astype(np.int64).copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(dims):
            high = (points[:, axis] >> level) & 1 == 1
            points[high, 0] ^= low
            swap = np.where(high, 0, (points[:, 0] ^ points[:, axis]) & low)
            points[:, 0] ^= swap
            points[:, axis] ^= swap
    for axis in range(1, dims):
        points[:, axis] ^= points[:, axis - 1]
    turned = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((points[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    points ^= turned[:, None]
    key = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((points[:, axis] >> level) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Curve keys of documents given as arrays of token ids."""
    plane = directions()
    sums = np.zeros((len(ids), DIMS), dtype=np.float64)
    for place, own in enumerate(ids):
        mixed = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
        counts = np.bincount(mixed.astype(np.int64), minlength=BUCKETS).astype(np.float64)
        norm = np.sqrt((counts * counts).sum())
        sums[place] = (counts / norm) @ plane if norm else 0.0
    unit = 1.0 / (1.0 + np.exp(-1.7 * sums))
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _tokenized(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _worker_tokens(path)
        for batch in batches:
            for low in range(0, len(batch), 1024):
                part = batch.iloc[low:low + 1024]
                arrays = [np.append(own, np.uint32(END_ID)) for own in tokens.ids(part["text"].tolist())]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "curve": curve_keys(arrays), "n": [len(a) for a in arrays],
                    "ids": [a.astype("<u2" if a.max() < 65536 else "<u4").tobytes() for a in arrays]})
    return run


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``row, doc_id, curve, n, ids``: ids as little-endian bytes, two each where they fit, else four."""
    # ids travel as text: a column of numbers with a null would lose its last digits in pandas
    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = read.mapInPandas(_tokenized(tokenizer), "doc_id string, curve long, n long, ids binary")
    return via_table(made.select(F.col("doc_id").cast("long").alias("doc_id"), "curve", "n", "ids",
                                 F.monotonically_increasing_id().alias("row")), "pack-tokens")


def global_offsets(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``row, offset``: each document's place in the corpus along the curve, and the corpus length."""
    light = tokens.select("row", "curve", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "n")
    ordered = settle(
        light.repartitionByRange("curve", "doc_id", "row").withColumn("range", F.spark_partition_id()))
    totals = ordered.groupBy("range").agg(F.sum("n").alias("words"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range", "words", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = (Window.partitionBy("range").orderBy("curve", "doc_id", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = ordered.join(bases.drop("words"), "range").select(
        "row", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("offset"))
    return placed, totals.agg(F.sum("words")).first()[0] or 0


def sequence_ends(total: int, length: int) -> list[tuple[int, int]]:
    """The short sequences after the last full one: ``(start, end)``, each a power of two long."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        size = 1 << bit
        if (total - at) & size and size < length:
            out.append((at, at + size))
            at += size
    return out


def _pieces(total: int, length: int, with_ids: bool):
    full = total // length
    tail = sequence_ends(total, length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                rows = []
                part = batch.iloc[low:low + 256]
                for doc, offset, n, blob in zip(part["doc_id"].array, part["offset"], part["n"], part["ids"], strict=True):
                    ids = np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                    at = int(offset)
                    last = at + int(n)
                    while at < last:
                        number = at // length
                        first, stop = number * length, (number + 1) * length
                        if number >= full:
                            number, (first, stop) = next((full + k, x) for k, x in enumerate(tail) if x[0] <= at < x[1])
                        upto = min(stop, last)
                        own = ids[at - offset:upto - offset].tobytes()
                        rows.append((doc, at - offset, upto - at, zlib.crc32(own), n, number, at - first,
                                     own if with_ids else None))
                        at = upto
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                  "sequence_id", "offset", "ids"])
    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids``.

    ``start`` counts the ids of the same document before the piece, ``offset`` the ids before it
    in its sequence. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    tokens = tokenize(docs, tokenizer)
    placed, total = global_offsets(tokens)
    rows = tokens.join(placed, "row").select(F.col("doc_id").cast("string").alias("doc_id"), "offset", "n", "ids")
    schema = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, ids binary")
    return rows.mapInPandas(_pieces(total, length, with_ids), schema).withColumn("doc_id", F.col("doc_id").cast("long"))
