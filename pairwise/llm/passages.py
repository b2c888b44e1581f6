"""Remove repeated byte passages by prefix-free parsing.

A byte is removed when it lies in a string of ``LENGTH`` bytes that also starts earlier in the
corpus (in a smaller ``doc_id``, or before in the same document).

The parse cuts every document at triggers: in each window of ``LENGTH`` bytes the first
``TRIGGER``-byte string with the smallest rolling hash. Equal windows choose equal triggers at
equal offsets, so a copy is parsed like its original wherever it stands. Windows that choose the
same trigger position follow one another; together they are a phrase, which reaches
``LENGTH - 1`` bytes into its neighbours. Equal phrases are one entry of the dictionary, known by
the hashes of trigger and phrase.

Sorting the parse by trigger, phrase and place gives the dictionary and, for each entry, its first
occurrence; every later occurrence repeats it byte for byte. What is left are entries that share a
trigger but differ, where a copy begins or ends inside a phrase. Only for first occurrences of
such entries the suffixes are ordered, to the depth of ``LENGTH`` bytes that decides here, and in
two steps: first stretches of up to ``SEGMENT`` windows, which must share the bytes that all
windows at these offsets from the trigger have in common, then single windows of the stretches
that do. The result is that of a full suffix array of the corpus, but text that repeats nothing
stops at the first sort, and text that repeats whole phrases as well.

Skew: later occurrences of a phrase within one batch are known to be repeats at once and are not
sorted, so a passage that every document holds is one row per batch. Documents are shuffled once;
the joins that bring places back to texts use the same shuffle.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` are kept whole; rows with the
same ``doc_id`` are documents of their own in order of a hash of their text, so of rows that are
equal one is the first and the others repeat it; a null ``doc_id`` comes before all others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 100
TRIGGER = 32
SEGMENT = 17                # windows of a stretch: offsets from the trigger are cut at multiples of it
PACK = 128                  # a run of windows is one number: PACK times its first offset from the trigger, plus its length
PIECE = 1 << 20             # bytes worked on at a time
PLACE_BITS = 24             # of a trigger's place within a piece
RUN = "trigger long, phrase long, d long, at long, n long"
NO_ID = -(1 << 62)          # stands for a null id
PART_SHIFT = 40             # a place in the corpus: row number within the id, then the byte offset

_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_BACKS = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of any substring of a buffer, from prefix sums modulo 2**64."""

    _powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, chars: np.ndarray, kind: int):
        size = len(chars) + 1
        room = 1 << max(20, (size - 1).bit_length())
        if (kind, room) not in self._powers:
            self._powers[kind, room] = tuple(
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(room, b, dtype=np.uint64))])
                for b in (_BASES[kind], _BACKS[kind]))
        powers, self.back = self._powers[kind, room]
        self.sums = np.zeros(size, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[:size - 1], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, length: int) -> np.ndarray:
        size = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:size]) * self.back[:size])


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width``, by doubling."""
    least, span = keys, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def phrases(chars: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    """Phrases of some texts laid end to end: ``trigger, phrase, owner, at, n``.

    ``owner`` is the text of each byte and ``offset`` what to add to a place in the buffer to get
    a place in its text; ``n`` packs the number of windows. No window spans two texts.
    """
    total = len(chars) - LENGTH + 1
    if total <= 0:
        return pd.DataFrame({"trigger": [], "phrase": [], "owner": [], "at": [], "n": []}, dtype=np.int64)
    hashes = _Rolling(chars, 0)
    grams = hashes.windows(TRIGGER)
    # upper bits of the hash, then the place: the smallest key is the leftmost of the smallest hashes
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_least(keys, LENGTH - TRIGGER + 1) & mask).astype(np.int64)
    whole = owner[:total] == owner[LENGTH - 1:]
    change = np.ones(total, dtype=bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:total] != owner[:total - 1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], total) - 1
    real = whole[first]
    first, last = first[real], last[real]
    text = _Rolling(chars, 1)
    return pd.DataFrame({
        "trigger": grams[chosen[first]].view(np.int64), "phrase": text.between(first, last + LENGTH).view(np.int64),
        "owner": owner[first], "at": first + offset[first],
        "n": (chosen[first] - first) * PACK + last - first + 1})


def _laid_out(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end in pieces of about ``PIECE`` bytes; a long text is cut with an overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def lay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(b) for _, _, b in held]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return (np.frombuffer(b"".join(b for _, _, b in held), dtype=np.uint8),
                np.repeat([o for o, _, _ in held], lengths),
                np.repeat([at - b for (_, at, _), b in zip(held, begin, strict=True)], lengths))

    for owner, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            piece = text[at:at + PIECE + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if held and size + len(piece) > PIECE:
                yield lay()
                held, size = [], 0
            held.append((owner, at, piece))
            size += len(piece)
    if held:
        yield lay()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        docs, parts = batch["d"].to_numpy(), batch["part"].to_numpy().astype(np.int64)
        for chars, owner, offset in _laid_out([bytes(x) for x in batch["data"]]):
            found = phrases(chars, owner, offset)
            where = found.pop("owner").to_numpy().astype(np.int64)
            found["d"] = docs[where]
            found["at"] += parts[where] << PART_SHIFT
            # what stands later than an equal phrase of the same batch is a repeat, wherever else it occurs
            order = np.lexsort((found["at"], found["d"], found["phrase"], found["trigger"]))
            found = found.iloc[order]
            again = np.zeros(len(found), dtype=bool)
            again[1:] = ((found["trigger"].to_numpy()[1:] == found["trigger"].to_numpy()[:-1])
                         & (found["phrase"].to_numpy()[1:] == found["phrase"].to_numpy()[:-1]))
            found.loc[again, "n"] = -(found.loc[again, "n"] % PACK)
            found.loc[again, "trigger"] = found.loc[again, "at"] * 31 + found.loc[again, "d"]  # these may go anywhere
            yield found[["trigger", "phrase", "d", "at", "n"]]


def _split(width: int):
    """Cuts the listed phrases of each text into stretches of windows, or for width 1 into windows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[tuple[bytes, np.ndarray, np.ndarray, int, int]] = []
            size = 0
            for doc, data, ats, ns in zip(batch["d"], batch["data"], batch["ats"], batch["ns"], strict=True):
                text, at, n = bytes(data), np.asarray(ats, dtype=np.int64), np.asarray(ns, dtype=np.int64)
                part = int(at[0]) >> PART_SHIFT << PART_SHIFT
                at = at - part
                order = np.argsort(at)
                at, n = at[order], n[order]
                for low in range(0, len(text), PIECE):
                    own = slice(*np.searchsorted(at, [low, low + PIECE]))
                    if own.start == own.stop:
                        continue
                    # a phrase has less than LENGTH windows, so it ends within two lengths of its start
                    piece = text[low:low + PIECE + 2 * LENGTH]
                    held.append((piece, at[own] - low, n[own], doc, part + low))
                    size += len(piece)
                    if size > PIECE:
                        yield _stretches_of(held, width)
                        held, size = [], 0
            if held:
                yield _stretches_of(held, width)
    return run


def _stretches_of(held: list[tuple[bytes, np.ndarray, np.ndarray, int, int]], width: int) -> pd.DataFrame:
    """``_stretches`` of several texts laid end to end: text, places, packed runs, id, offset of the text."""
    begin = np.concatenate([[0], np.cumsum([len(h[0]) for h in held])[:-1]])
    counts = [len(h[1]) for h in held]
    found = _stretches(
        np.frombuffer(b"".join(h[0] for h in held), dtype=np.uint8),
        np.concatenate([h[1] + b for h, b in zip(held, begin, strict=True)]), np.concatenate([h[2] for h in held]), width)
    of = np.repeat(np.arange(len(held)), counts)[found.pop("run").to_numpy()]
    found["d"] = np.array([h[3] for h in held], dtype=np.int64)[of]
    found["at"] += (np.array([h[4] for h in held], dtype=np.int64) - begin)[of]
    return found[["trigger", "phrase", "d", "at", "n"]]


def _stretches(chars: np.ndarray, at: np.ndarray, packed: np.ndarray, width: int) -> pd.DataFrame:
    """``trigger, phrase, run, at, n`` of the stretches of some phrases; windows are hashed twice instead."""
    n, ahead = packed % PACK, packed // PACK
    run = np.repeat(np.arange(len(at)), n)
    step = np.arange(len(run)) - (np.cumsum(n) - n)[run]
    start, delta = at[run] + step, ahead[run] - step
    one, two = _Rolling(chars, 0), _Rolling(chars, 1)
    if width == 1:
        return pd.DataFrame({
            "trigger": one.between(start, start + LENGTH).view(np.int64),
            "phrase": two.between(start, start + LENGTH).view(np.int64), "run": run, "at": start, "n": 1})
    band = delta // width
    new = np.flatnonzero((step == 0) | np.concatenate([[True], band[1:] != band[:-1]]))
    last = np.append(new[1:], len(start)) - 1
    first, off, level = start[new], delta[new], band[new]
    # what every window at an offset of the band has in common
    common = first + off - level * width
    key = one.between(common, common + LENGTH - width + 1) + _mix(level.astype(np.uint64))
    whole = two.between(first, start[last] + LENGTH) + _mix(off.astype(np.uint64))
    return pd.DataFrame({
        "trigger": key.view(np.int64), "phrase": whole.view(np.int64), "run": run[new], "at": first,
        "n": off * PACK + last - new + 1})


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint stretches that cover the same bytes, in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low in range(0, len(batch), 128):
            out = []
            piece = batch.iloc[low:low + 128]
            for doc_id, data, ats, ns in zip(piece["d"], piece["data"], piece["ats"], piece["ns"], strict=True):
                text, spans = bytes(data), []
                if ats is not None and len(ats):
                    at = np.asarray(ats, dtype=np.int64) & ((1 << PART_SHIFT) - 1)
                    spans = list(zip(*(x.tolist() for x in _merged(at, at + np.asarray(ns, dtype=np.int64) - 1 + LENGTH)), strict=True))
                kept, upto = [], 0
                for start, end in spans:
                    kept.append(text[upto:start])
                    upto = end
                kept.append(text[upto:])
                out.append((doc_id, len(text), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans],
                            b"".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _listed(runs: DataFrame) -> DataFrame:
    """``d, in_part, ats, ns``: the runs of each text as two arrays."""
    grouped = runs.groupBy("d", F.shiftright("at", PART_SHIFT).cast("int").alias("in_part")).agg(
        F.collect_list(F.struct("at", "n")).alias("listed"))
    return grouped.select("d", "in_part", F.transform("listed", lambda x: x["at"]).alias("ats"),
                          F.transform("listed", lambda x: x["n"]).alias("ns"))


def _with_texts(texts: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Joins on ``d`` alone, which the texts are already dealt by: the row number is no join key."""
    own = listed.withColumnRenamed("d", "of")
    return texts.join(own, (F.col("d") == F.col("of")) & (F.col("part") - F.col("in_part") == 0), how).drop("of", "in_part")


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs ``d, at, n`` that repeat an earlier equal one, and the runs still open: firsts of
    their kind whose trigger others share."""
    entry = Window.partitionBy("trigger", "phrase").orderBy("d", "at")
    same = Window.partitionBy("trigger")
    # a plain mark instead of a rank: both branches then read one and the same shuffle
    ordered = rows.repartition("trigger").withColumn("first", F.lag("d").over(entry).isNull())
    repeats = ordered.where("n < 0 or not first").select("d", "at", F.pmod(F.abs("n"), F.lit(PACK)).alias("n"))
    unsure = (
        ordered.where("n > 0 and first")
        .withColumn("differ", F.min("phrase").over(same) != F.max("phrase").over(same))
        .where("differ").select("d", "at", "n")
    )
    return repeats, unsure


def repeated_places(texts: DataFrame) -> DataFrame:
    """``d, at, n``: runs of ``n`` windows from ``at`` on that all start earlier as well."""
    rows = texts.select("d", "part", "data").where(F.length("data") >= LENGTH).mapInPandas(_parse, RUN)
    found = None
    for width in (SEGMENT, 1, None):
        repeats, unsure = _settled(rows)
        found = repeats if found is None else found.unionByName(repeats)
        if width:
            rows = _with_texts(texts, _listed(unsure), "inner").select("d", "data", "ats", "ns").mapInPandas(_split(width), RUN)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, spans, kept``.

    ``spans`` are the removed stretches of bytes, in order, ``kept`` the bytes that remain.
    """
    # nothing but key and bytes, so that all three uses of the shuffled texts are one shuffle
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
        F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("data")).repartition("d")
    texts = keyed.withColumn("part", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("data"))))
    told = _with_texts(texts, _listed(repeated_places(texts)), "left").select("d", "data", "ats", "ns")
    cut = told.mapInPandas(
        _cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
