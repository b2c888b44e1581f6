"""Token ids of many texts at once for a byte-level BPE with word ends.

The ids are those of the ``tokenizers`` library on each whole text. The tokenizer works word by
word (runs of letters, single digits, runs of other marks), so the ids of a text are those of its
words one after the other. Words of a piece of text are told apart by 64-bit hashes, and only
words not met before are encoded: their merges are applied to all of them at a time, as arrays.
Texts with anything beyond plain letters, digits and marks (see ``plain_text``) go through the
library.
"""

from __future__ import annotations

import json

import numpy as np

MOST_KNOWN = 1_000_000      # words kept by a worker before it starts afresh
WIDTHS = (8, 12, 16, 24, 48)  # bytes of words that are merged together; longer ones go to the library
CHUNK = 8192                # words merged at a time
PIECE = 1 << 20             # characters laid end to end

#: The Latin-1 bytes that the array form handles: ASCII but for control characters and apostrophes
#: (contractions), and the letters.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[9, 10, 11, 12, 13, *range(32, 127), *range(192, 256)]] = True
_PLAIN[[39, 215, 247]] = False
_NONE = np.int32(2**31 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE, LETTER, DIGIT, MARK = range(4)
_CLASS = np.full(256, MARK, dtype=np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[97:123] = LETTER
_CLASS[128:] = LETTER


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Pairs:
    """Rank of a pair of neighbouring ids, looked up for whole arrays."""

    SLOTS, DEPTH = 1 << 19, 4

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.keys = np.full((self.SLOTS, self.DEPTH), np.uint64(2**64 - 1), dtype=np.uint64)
        self.ranks = np.full((self.SLOTS, self.DEPTH), _NONE, dtype=np.int32)
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        first = np.searchsorted(slots[order], slots[order], side="left")
        depth = np.arange(len(keys)) - first
        if depth.max(initial=0) >= self.DEPTH:
            raise ValueError("too many merges share a slot")
        self.keys[slots[order], depth] = keys[order]
        self.ranks[slots[order], depth] = order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Negative ids stand for no token and have no rank."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys[:, None], self.ranks[slots], _NONE).min(axis=1)
        return np.where((left < 0) | (right < 0), _NONE, found)


class BulkTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())["model"]
        vocabulary, merges = spec["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        self.pairs = _Pairs(np.array([vocabulary[a] for a, _ in merges]), np.array([vocabulary[b] for _, b in merges]))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int32)
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], dtype=np.int32)
        self.final = np.array([vocabulary[x + spec["end_of_word_suffix"]] for x in letters], dtype=np.int32)
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(5 * PIECE, _BASE, dtype=np.uint64))])
        self.backs = np.concatenate([[np.uint64(1)], np.cumprod(np.full(5 * PIECE, _BACK, dtype=np.uint64))])
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.begin, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.store, self.used = np.zeros(1 << 16, dtype=np.int32), 0

    def _merge(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Applies merges to words given as rows of bytes, of which the first ``size`` count: ids padded with -1."""
        width = words.shape[1]
        ids = np.where(np.arange(width) < size[:, None], self.inner[words], np.int32(-1))
        ids[np.arange(len(words)), size - 1] = self.final[words[np.arange(len(words)), size - 1]]
        done = np.full(ids.shape, -1, dtype=np.int32)
        ranks = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rows, columns = np.arange(len(ids)), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                done[rows[over]] = ids[over]
                rows, ids, ranks, at, best = rows[~over], ids[~over], ranks[~over], at[~over], best[~over]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            ids[here, at] = self.merged[best]
            # the right half goes: everything behind moves up by one
            move = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, move, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(move[:, :-1], width - 2), axis=1)
            ranks[:, -1] = _NONE
            nxt = ids[here, np.minimum(at + 1, width - 1)]
            ranks[here, np.minimum(at, width - 2)] = self.pairs.rank(ids[here, at], np.where(at + 1 < width, nxt, -1))
            before = at > 0
            ranks[here[before], at[before] - 1] = self.pairs.rank(ids[here[before], at[before] - 1], ids[here[before], at[before]])
        return done

    def _learn(self, hashes: np.ndarray, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encodes words that are not known: their hashes, in order, and where they stand."""
        begin, length = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for least, width in zip((0, *WIDTHS), (*WIDTHS, None), strict=True):
            chosen = np.flatnonzero((size > least) & (size <= width if width else True))
            for low in range(0, len(chosen), CHUNK):
                part = chosen[low:low + CHUNK]
                if width is None:
                    rows = [self.model.encode(chars[start[k]:start[k] + size[k]].tobytes().decode(), add_special_tokens=False).ids
                            for k in part]
                    lengths, flat = np.array([len(r) for r in rows]), np.concatenate(rows).astype(np.int32)
                else:
                    spots = np.minimum(start[part][:, None] + np.arange(width), len(chars) - 1)
                    found = self._merge(chars[spots], size[part])
                    real = found >= 0
                    lengths, flat = real.sum(axis=1), found[real]
                while self.used + len(flat) > len(self.store):
                    self.store = np.concatenate([self.store, np.zeros_like(self.store)])
                self.store[self.used:self.used + len(flat)] = flat
                length[part] = lengths
                begin[part] = self.used + np.cumsum(lengths) - lengths
                self.used += len(flat)
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.begin, self.length = np.insert(self.begin, where, begin), np.insert(self.length, where, length)

    def _piece(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.lower().encode() + b" " for t in texts]
        chars = np.frombuffer(b"".join(raw), dtype=np.uint8)
        kind = _CLASS[chars]
        new = (kind != SPACE) & np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)])
        start = np.flatnonzero(new)
        stop = np.flatnonzero((kind[:-1] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[:-1] == DIGIT))) + 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.powers[:len(chars)])])
        hashes = _mixed((sums[stop] - sums[start]) * self.backs[start] + (stop - start).astype(np.uint64))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MOST_KNOWN:
            self.forget()
        at = np.searchsorted(self.known, unique)
        missing = np.ones(len(unique), dtype=bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != unique[inside]
        if missing.any():
            own = first[missing]
            self._learn(unique[missing], chars, start[own], stop[own] - start[own])
            at = np.searchsorted(self.known, unique)
        slots = at[back]
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.arange(total) + np.repeat(self.begin[slots] - (ends - lengths), lengths)]
        # words of a text are those that start before its end
        cuts = np.searchsorted(start, np.cumsum([len(r) for r in raw]))
        marks = np.concatenate([[0], ends])[cuts]
        return np.split(ids.astype("<u4"), marks[:-1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers."""
        out: list = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            if held:
                for place, found in zip(held, self._piece([texts[k] for k in held]), strict=True):
                    out[place] = found

        other = []
        for place, text in enumerate(texts):
            if len(text) > 2 * PIECE or not plain_text(text):
                other.append(place)
                continue
            if size + len(text) > PIECE and held:
                flush()
                held, size = [], 0
            held.append(place)
            size += len(text)
        flush()
        for low in range(0, len(other), 64):
            part = other[low:low + 64]
            coded = self.model.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)
            for place, found in zip(part, coded, strict=True):
                out[place] = np.array(found.ids, dtype="<u4")
        return out


def plain_text(text: str) -> bool:
    """Whether the array form handles a text: plain letters, digits and marks, and no special token in it."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return b"<|" not in raw and bool(_PLAIN[np.frombuffer(raw, dtype=np.uint8)].all())
