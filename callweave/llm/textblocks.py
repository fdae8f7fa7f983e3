"""Vectorised words of Arrow text columns: 64-bit hashes of all words of a batch, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the word rule: blank and the controls 9 to 13.
BLANKS = bytes([32, 9, 10, 11, 12, 13])
SLICE_BYTES = 1 << 20
#: Words whose ids are put together at once.
SLICE_WORDS = 1 << 16
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True


def _byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte; A-Z share those of a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]
    return values


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_VALUES = _byte_values()
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        _powers[:] = []
        for base in (_PRIME, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


class Words:
    """Words of the documents lo..hi of a batch. hashes: one for each word; counts: words of each document; starts: first word of each."""

    def __init__(self, lo: int, hi: int, hashes: np.ndarray, counts: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.lo, self.hi, self.hashes, self.counts, self.data, self.begin, self.end = lo, hi, hashes, counts, data, begin, end
        self.starts = np.concatenate([[0], np.cumsum(counts)])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


#: Calls that drop what other operators keep in a worker between tasks; made before a batch is cut into words, so that a worker holds one operator's memory.
LET_GO: list = []


def word_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Words]:
    """Slices of about most bytes (a longer document is a slice of its own); words are maximal runs without white space, A-Z lower-cased."""
    for drop in LET_GO:
        drop()
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi)
        lo = hi


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo, np.int64), data, none, none)
    full = ~_IS_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:n]
    last = full.copy()
    last[:-1] &= ~full[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _tables(n)
    total = np.cumsum(_VALUES[data] * up[:n])
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    hashes = mixed((total[end] - before) * down[begin])
    counts = np.diff(np.searchsorted(begin, offsets))
    return Words(lo, hi, hashes, counts, data, begin, end)


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words inside a document, its document); a shorter document that has words gives one run of all of them."""
    h = words.hashes
    doc = words.doc_of_word()
    if len(h) >= size:
        run = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            run = run * np.uint64(_PRIME) + h[k : len(h) - size + 1 + k]
        inside = doc[: len(run)] == doc[size - 1 :]
        run, at = mixed(run[inside]), doc[: len(run)][inside]
    else:
        run, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        extra = np.array([_fold(h[words.starts[d] : words.starts[d + 1]]) for d in short], np.uint64)
        run, at = np.concatenate([run, mixed(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        run, at = run[order], at[order]
    return run, at


def _fold(h: np.ndarray) -> int:
    value = len(h)
    for x in h.tolist():
        value = (value * _PRIME + x) & 0xFFFFFFFFFFFFFFFF
    return value


def taken(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of values, each from its begin on, in turn."""
    stop = np.cumsum(size)
    return values[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - size), size)]


def dealt(values: np.ndarray, begin: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of values that codes name, in turn, where each of these begins and the last ends)."""
    stop = np.concatenate([[0], np.cumsum(size[codes])])
    out = np.empty(stop[-1], values.dtype)
    for lo in range(0, len(codes), SLICE_WORDS):
        own = codes[lo : lo + SLICE_WORDS]
        out[stop[lo] : stop[lo + len(own)]] = taken(values, begin[own], size[own])
    return out, stop
