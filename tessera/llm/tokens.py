"""Vectorised word splitting and hashing over Arrow string columns.

A whole Arrow slice is handled as one byte array: words are found by comparing neighbouring bytes,
and each word's 64-bit hash comes from prefix sums of a polynomial over the bytes, so no Python
code runs per word. Both word definitions of this package are bytewise on UTF-8: every byte of a
non-ASCII character is 0x80 or above and belongs to a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Text bytes handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

_all = np.arange(256)
LOWER = np.where((_all >= 65) & (_all <= 90), _all + 32, _all).astype(np.uint8)
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~((_all == 32) | ((_all >= 9) & (_all <= 13)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = ((_all >= 48) & (_all <= 57)) | ((_all >= 97) & (_all <= 122)) | (_all >= 128)

_powers: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), U64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _constants(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


class Words:
    """The words of ``rows`` texts: bytes, start and end of each, and the range of each text."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        self.rows = len(column)
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, width)[column.offset : column.offset + self.rows + 1].astype(np.int64) if self.rows else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
        self.offs = offs - offs[0]
        self.data = LOWER[raw]
        inside = table[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        if len(raw):
            edges = self.offs[:-1]
            before[edges[edges < len(raw)]] = False
            edges = self.offs[1:]
            after[edges[edges > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offs)

    def hashes(self) -> np.ndarray:
        power, inverse = power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (runs may cross texts; callers cut)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.full(n, U64(size * 0xA24BAED4963EE407 % (1 << 64)))
    for j, c in enumerate(_constants(size)):
        total += words[j : j + n] * c
    return mix(total)


def sequence_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each word sequence, from the hashes of all words and where each sequence begins and ends."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.r_[U64(0), np.cumsum(mix(hashes + place.astype(U64) * U64(0x9E3779B97F4A7C15)), dtype=U64)]
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64)).view(np.int64)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which its worker, kept for later tasks, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    if len(_powers[0]) > SLICE_BYTES + 1:
        _powers[:] = [np.empty(0, U64), np.empty(0, U64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each piece holds at most SLICE_BYTES of text, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(column: pa.Array, size: int, table: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """Distinct hashes of the ``size``-word shingles of each text, sorted.

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    found = Words(column, table)
    hashed = found.hashes()
    runs = window_hashes(hashed, size)
    out = []
    bounds = found.bounds.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(window_hashes(hashed[a:b], b - a))
        else:
            out.append(np.empty(0, U64))
    return out
