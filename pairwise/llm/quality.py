"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: its words, pairs of neighbouring words, a mark for every word
that repeats the one before, and the byte n-grams of each word with its borders. Every feature has
a learned vector; a text is the mean of its vectors, and a softmax layer gives the two labels.
Vectors and layer are trained together by stochastic gradient descent in numpy, one text a step
with a falling rate.

Fitting uses at most ``FIT_ROWS`` labelled rows, first by hash of the id; tasks turn them into
packed feature counts (at most ``BUCKETS`` numbers a text), so what reaches the driver is bounded.
Spark writes and orders them, and the driver reads them one after the other into flat arrays.
Scoring reads every whole text. Since the layer is linear, a feature's part of the score is one
number, and scoring is a table look-up per feature.

Edge cases: null and empty texts have no features and get the score of the bias alone; rows
without an id or a label are not learned from; of several labels for an id the smallest counts;
with one label only, or none, every score is the share of label 1 (one half without any); equal
rows get equal scores; an empty table gives an empty result; only ``text`` enters a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwise.session import via_table

FIT_ROWS = 3000
BITS, WIDTH = 17, 12
BUCKETS = (1 << BITS) + 1
NGRAMS = (3, 4, 5)
EPOCHS, RATE = 6, 2.0
SEED = 3
PIECE = 1 << 18             # bytes worked on at a time
REPEAT = BUCKETS - 1        # the feature of a word that repeats the one before

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BLANK = bytes(32 if x in b"\t\n\v\f\r " else x for x in range(256))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (((hashes ^ np.uint64(kind)) * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of some texts and, beside each, the place of its text in the list."""
    # a blank on either side of a text: windows over a border of texts have two blanks in a row
    joined = b"".join(b" " + t.translate(_BLANK) + b" " for t in texts)
    chars = np.frombuffer(joined, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    blank = chars == 32
    blanks = np.cumsum(blank)
    wide = chars.astype(np.uint64) + np.uint64(1)
    ids, places = [], []
    hashes, size = wide, len(chars)
    for n in range(2, max(NGRAMS) + 1):
        size = len(chars) - n + 1
        if size <= 0:
            break
        hashes = hashes[:size] * _BASE + wide[n - 1:]
        if n not in NGRAMS:
            continue
        inside = np.flatnonzero(blanks[n - 2:size + n - 2] == blanks[:size])
        ids.append(_bucket(hashes[inside], n))
        places.append(owner[inside])
    edge = np.flatnonzero(np.diff(blank.astype(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    if len(starts):
        powers = np.cumprod(np.full(len(chars), _BASE, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(wide * powers, dtype=np.uint64)])
        shift = np.cumprod(np.full(len(chars), _BACK, dtype=np.uint64))
        words = (total[ends] - total[starts]) * shift[starts]
        of = owner[starts]
        ids.append(_bucket(words, 1))
        places.append(of)
        same = np.flatnonzero(of[1:] == of[:-1])
        ids.append(_bucket(words[same] * _BASE + words[same + 1], 2))
        places.append(of[same])
        again = same[words[same] == words[same + 1]]
        ids.append(np.full(len(again), REPEAT, dtype=np.int64))
        places.append(of[again])
    if not ids:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(ids), np.concatenate(places)


def _pieces(text: str | None) -> Iterator[bytes]:
    """A text as bytes, long ones in pieces cut after a blank where there is one."""
    raw = (text or "").encode("utf-8", "replace")
    at = 0
    while len(raw) - at > PIECE:
        cut = raw.rfind(b" ", at + PIECE // 2, at + PIECE) + 1 or at + PIECE
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _grouped(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``features`` of a whole series, some pieces of about ``PIECE`` bytes at a time; places are rows."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            rows.append(row)
            size += len(piece)
            if size >= PIECE:
                ids, places = features(held)
                yield ids, np.array(rows)[places]
                held, rows, size = [], [], 0
    if held:
        ids, places = features(held)
        yield ids, np.array(rows)[places]


def _packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending feature numbers and their counts, as compressed differences and counts."""
    gaps = np.diff(ids, prepend=0)
    return zlib.compress(np.concatenate([gaps, counts]).astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), dtype="<u4")
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int32), both[half:].astype(np.float32)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for place, digest, label, text in zip(*(batch[c] for c in ("place", "digest", "label", "text")), strict=True):
            counts = np.zeros(BUCKETS, dtype=np.int64)
            for ids, _ in _grouped(pd.Series([text])):
                counts += np.bincount(ids, minlength=BUCKETS)
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"place": [place], "digest": [digest], "label": [label],
                                "counted": [_packed(used, counts[used])]})


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``place, digest, label, counted`` of at most ``rows`` labelled documents; the first two order them."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
        .withColumn("place", F.xxhash64("doc_id")))
    chosen = known.orderBy("place", "doc_id").limit(rows)
    # at most `rows` ids: the one side whose size is bounded by a parameter
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = read.select("place", F.md5("text").alias("digest"), F.col("label").cast("long").alias("label"), "text")
    return once.mapInPandas(_counted, "place long, digest string, label long, counted binary")


def train(texts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Per-feature part of the log odds of label 1, and the bias. ``texts``: label, ids, counts."""
    rate_of_one = np.mean([t[0] for t in texts]) if texts else 0.5
    if not texts or rate_of_one in (0.0, 1.0):
        odds = min(max(float(rate_of_one), 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS, dtype=np.float32), math.log(odds / (1 - odds))
    draw = np.random.default_rng(SEED)
    vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, step = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for place in draw.permutation(len(texts)):
            label, ids, counts = texts[place]
            rate = RATE * (1 - step / steps)
            step += 1
            share = counts / max(counts.sum(), 1)
            mean = share @ vectors[ids]
            logits = layer @ mean + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            # as a text has thousands of features with tiny shares, the vectors move by the root of the share
            pull = layer.T @ wrong
            layer -= rate * np.outer(wrong, mean)
            bias -= 0.02 * rate * wrong
            vectors[ids] -= np.outer(rate * np.sqrt(share), pull)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Trains on ``labels`` (``doc_id, label``) and the texts of ``docs``."""
    found = via_table(fit_sample(docs, labels, rows), "quality-sample").orderBy("place", "digest", "label")
    return train([(int(r["label"]), *_unpacked(r["counted"])) for r in found.select("label", "counted").toLocalIterator()])


def score(model: tuple[np.ndarray, float], text: Column) -> Column:
    """Probability of label 1."""
    parts, bias = model

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for ids, rows in _grouped(texts):
            total += np.bincount(rows, weights=parts[ids], minlength=len(texts))
            count += np.bincount(rows, minlength=len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -500, 500))))

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
