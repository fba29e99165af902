"""Vectorised text primitives over Arrow string buffers.

A *word* is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased
text: the regular expression ``[0-9A-Za-z_\\u0080-\\U0010ffff]+``. Word hashes are 64-bit and depend on the word's
bytes alone, so they agree between batches, tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[0-9A-Za-z_\u0080-\U0010ffff]+"

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    _IS_WORD[_c] = True

_CLASS = _IS_WORD.astype(np.uint8)
_MARKS = _CLASS.copy()
for _c in range(33, 127):
    if not _IS_WORD[_c]:
        _MARKS[_c] = 2

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _geometric(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        _powers, _inverses = _geometric(_BASE, size), _geometric(_INVERSE, size)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def window_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash for each of the len(symbols)-k+1 windows of k 64-bit symbols."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a column of texts: start and end bytes in ``data``, 64-bit hashes, and per row its range of words.

    With marks, runs of ASCII punctuation are words too.
    """

    __slots__ = ("data", "starts", "ends", "hashes", "first", "rows")

    def __init__(self, column: pa.Array, hashes: bool = True, lower: bool = True, marks: bool = False):
        if lower:
            column = pc.utf8_lower(column)
        self.data, offsets = buffers(column)
        self.rows = len(offsets) - 1
        n = len(self.data)
        kind = np.zeros(n + 2, np.uint8)
        kind[1:-1] = (_MARKS if marks else _CLASS)[self.data]
        own = kind[1:-1]
        is_start, is_end = (own > 0) & (own != kind[:-2]), (own > 0) & (own != kind[2:])
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        is_start[cuts] = own[cuts] > 0
        is_end[cuts - 1] = own[cuts - 1] > 0
        self.starts, self.ends = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if hashes:
            up, down = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        else:
            self.hashes = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def hash_word(word: str) -> int:
    """The hash that Words gives to this word."""
    return int(Words(pa.array([word])).hashes[0])


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text; a longer text is a slice of its own."""
    column = batch.column(text)
    if not len(column):
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    yield batch.slice(begin)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i]+lengths[i]-1, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
