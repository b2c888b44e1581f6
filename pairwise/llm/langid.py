"""Language identification by cross-parsing entropy.

For every language a suffix automaton accepts what occurs in its labelled text. A text is parsed
against each automaton into longest matches: a phrase goes on while the automaton has a transition
and a new one starts where it has none, so the phrases are as few as they can be. Phrases times
the logarithm of the labelled length, divided by the characters, estimates the cross entropy;
the language with the smallest figure wins.

Letters are compared in lower case; whatever is not a letter is a blank, and blanks in a row are
one. A letter that a language's text does not have is a phrase of its own. Automata learn from a
bounded sample: at most ``FIT_DOCS`` documents a language, first by hash of the id, cut into
pieces of ``FIT_PIECE`` characters, of which the first ``FIT_PIECES`` by hash are kept; an
automaton has at most two states a character. They are built by one task a language. Every
document is parsed whole. Parsing works on lanes of ``LANE`` characters side by side in numpy, and
a phrase does not cross from one lane of a text into the next, for texts of every length.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is every text when
nothing could be learned; rows without an id, a text with letters or a language are not learned
from; rows with one id and language count as one, the text that sorts first; ties go to the
language that sorts first; equal texts get equal answers; an empty table gives an empty result;
columns other than ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT_DOCS = 64               # documents a language
FIT_PIECE = 1024            # characters of a piece of labelled text
FIT_PIECES = 24             # pieces a language
SHARES = 64                 # a language is ranked in so many parts first
LANE = 1024                 # characters of a parsed stretch
LANES = 2048                # stretches parsed side by side
SHARPNESS = 2.0             # of the score, per bit a character
NONE = "und"

BLANK, OTHER = 0, 1         # codes; the letters of all languages follow
POINTS = 0x110000
ANSWER = "lang string, score double"


@dataclass
class Model:
    """Names, one table of transitions for all languages, where each starts, and the cost of a phrase in bits."""

    langs: list[str]
    codes: np.ndarray
    symbols: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def plain(text: str) -> str:
    """Lower-case letters with single blanks between the words and around the text."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


# ------------------------------------------------------------------ learning
def sample(labelled: DataFrame, docs: int = FIT_DOCS, piece: int = FIT_PIECE, pieces: int = FIT_PIECES) -> DataFrame:
    """``lang, pieces``: the bounded sample that a language's automaton is built from."""
    known = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(
        F.col("text").rlike(r"\p{L}"))
    # the first of each share of a language, then the first of those: no task ranks a whole language
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).alias("share")).distinct()
    for keys in (["lang", "share"], ["lang"]):
        place = Window.partitionBy(*keys).orderBy(*order)
        ids = ids.withColumn("place", F.row_number().over(place)).where(F.col("place") <= docs)
    ids = ids.select("lang", "doc_id")
    # at most `docs` ids a language
    texts = known.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(
        F.min("text").alias("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int")))
    cut = texts.select("lang", "doc_id", "text", F.explode(starts).alias("no")).select(
        "lang", "doc_id", "no", F.substring("text", F.col("no") * piece + 1, F.lit(piece)).alias("piece"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "no"), "doc_id", "no")
    return (cut.withColumn("place", F.row_number().over(first)).where(F.col("place") <= pieces)
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces")))


def automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence, ``states x symbols``; -1 where there is none.

    ``BLANK`` to ``symbols`` - 1 are symbols; -1 in ``codes`` separates pieces: nothing matches over it.
    """
    go, link, length, last = [{}], [-1], [0], 0
    for code in codes:
        state = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and code not in go[at]:
            go[at][code] = state
            at = link[at]
        if at != -1:
            to = go[at][code]
            if length[at] + 1 == length[to]:
                link[state] = to
            else:
                copy = len(go)
                go.append(dict(go[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at != -1 and go[at].get(code) == to:
                    go[at][code] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
    table = np.full((len(go), symbols), -1, dtype=np.int32)
    for state, edges in enumerate(go):
        for code, to in edges.items():
            if code >= 0:
                table[state, code] = to
    return table


def _alphabet(texts: list[str]) -> list[str]:
    return sorted({c for t in texts for c in plain(t)} - {" "})


def _learned(rows: pd.DataFrame) -> pd.DataFrame:
    texts = [piece["piece"] for piece in rows["pieces"].iloc[0]]
    letters = _alphabet(texts)
    number = {c: i + 2 for i, c in enumerate(letters)} | {" ": BLANK}
    codes: list[int] = []
    for text in texts:
        codes.extend([number[c] for c in plain(text)] + [-1])
    table = automaton(codes, len(letters) + 2)
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "letters": ["".join(letters)], "length": [len(codes)],
                         "table": [table.tobytes()]})


def fit(labelled: DataFrame, **bounds: int) -> Model:
    """Automata of all languages from ``doc_id, text, lang``; a bounded table for each comes to the driver."""
    rows = sorted(
        sample(labelled, **bounds).groupBy("lang")
        .applyInPandas(_learned, "lang string, letters string, length long, table binary").collect(),
        key=lambda r: r["lang"].encode())
    letters = sorted({c for r in rows for c in r["letters"]})
    symbols = len(letters) + 2
    number = {c: i + 2 for i, c in enumerate(letters)}
    tables, roots, base = [], [], 0
    for row in rows:
        own = np.frombuffer(row["table"], dtype=np.int32).reshape(-1, len(row["letters"]) + 2)
        wide = np.full((len(own), symbols), -1, dtype=np.int32)
        wide[:, [BLANK, OTHER, *[number[c] for c in row["letters"]]]] = own
        tables.append(_closed(wide, base))
        roots.append(base * symbols)
        base += len(own)
    return Model([r["lang"] for r in rows], _codes(number), symbols,
                 np.concatenate(tables).ravel() if rows else np.zeros(0, dtype=np.int32),
                 np.array(roots, dtype=np.int32), np.array([math.log2(r["length"] + 1) for r in rows]))


def _closed(table: np.ndarray, base: int) -> np.ndarray:
    """Total transitions: ``2 * place of the next state + whether a phrase starts``. From a state without
    a transition a phrase starts at the root; a symbol the root does not have is a phrase alone."""
    symbols = table.shape[1]
    begin = np.maximum(table[0], 0)
    missing = table < 0
    missing[0] = True
    target = np.where(missing, begin, table)
    closed = (target + np.int64(base)) * symbols * 2 + missing
    return closed.astype(np.int32 if closed.max() < 1 << 31 else np.int64)


def _codes(number: dict[str, int]) -> np.ndarray:
    """The symbol of every code point: upper-case letters have that of their lower case."""
    codes = np.zeros(POINTS, dtype=np.uint16)
    for point in range(POINTS):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            codes[point] = number.get(low if len(low) == 1 else char, OTHER)
    return codes


# ------------------------------------------------------------------ parsing
def symbols_of(model: Model, text: str) -> np.ndarray:
    """A text as symbols, blanks around it and none twice; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.concatenate([[BLANK], model.codes[points], [BLANK]]).astype(np.uint16)
    if not codes.any():
        return codes[:0]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    return codes[keep]


def phrases(model: Model, lanes: list[np.ndarray]) -> np.ndarray:
    """Phrases of every lane in every language, ``languages x lanes``."""
    order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
    sizes = np.array([len(lanes[i]) for i in order])
    block = np.zeros((sizes[0], len(order)), dtype=np.uint16)
    for column, i in enumerate(order):
        block[:sizes[column], column] = lanes[i]
    count = np.zeros((len(model.langs), len(order)), dtype=np.int32)
    state = np.repeat(model.roots[:, None].astype(np.int64), len(order), axis=1)
    # lanes are sorted by length: those still running are the first ones
    running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for step, active in enumerate(running.tolist()):
        found = model.table[state[:, :active] + block[step, :active]]
        count[:, :active] += found & 1
        state[:, :active] = found >> 1
    out = np.empty_like(count)
    out[:, order] = count
    return out


def _judged(model: Model, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winner and its score, from phrases and characters of every text."""
    bits = counts * model.bits[:, None] / np.maximum(sizes, 1)
    weight = np.exp(-SHARPNESS * (bits - bits.min(axis=0)))
    return bits.argmin(axis=0), (1.0 / weight.sum(axis=0))


def _batches(model: Model, texts: pd.Series) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Lanes of texts and their rows, ``LANES`` at a time."""
    lanes, rows = [], []
    for row, text in enumerate(texts):
        codes = symbols_of(model, text or "")
        for at in range(0, len(codes), LANE):
            lanes.append(codes[at:at + LANE])
            rows.append(row)
            if len(lanes) == LANES:
                yield lanes, rows
                lanes, rows = [], []
    if lanes:
        yield lanes, rows


def identify(model: Model, text: Column) -> Column:
    """``struct<lang, score>``: the language with the fewest normalised phrases."""
    @F.pandas_udf(ANSWER)
    def told(texts: pd.Series) -> pd.DataFrame:
        counts, sizes = np.zeros((len(model.langs), len(texts))), np.zeros(len(texts), dtype=np.int64)
        if model.langs:
            for lanes, rows in _batches(model, texts):
                found = phrases(model, lanes)
                for lang in range(len(model.langs)):
                    counts[lang] += np.bincount(rows, weights=found[lang], minlength=len(texts))
                sizes += np.bincount(rows, weights=[len(x) for x in lanes], minlength=len(texts)).astype(np.int64)
        names, score = np.full(len(texts), NONE, dtype=object), np.zeros(len(texts))
        lettered = np.flatnonzero(sizes)
        if len(lettered):
            best, sure = _judged(model, counts[:, lettered], sizes[lettered])
            names[lettered], score[lettered] = np.array(model.langs, dtype=object)[best], sure
        return pd.DataFrame({"lang": names, "score": score})

    return told(text)
