"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are the names of level 0. On each level runs of one name are named by name and count, so that
neighbours differ; deterministic coin tossing turns the names into labels below 6 that still differ from their left
neighbours; phrases begin at local maxima of the labels and at local minima that aren't next to a maximum; a phrase's
name on the next level is a hash of the names in it. Where a phrase begins depends only on some names around it, so equal
substrings get the same phrases but for a bounded number at each end, wherever in a document they stand.

Defined results. Null and empty texts have fingerprint 0, level 0 and no signatures. Equal texts have equal results,
repeated rows and null doc_ids stay as they are, an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm.shared import returning, texts
from tramline.llm.textnum import buffers, lists, mix, pieces, powers

#: The level whose names are the signatures: a phrase there has about 60 bytes.
LEVEL = 4


def toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6; names are 64-bit and differ from their left neighbours within a row, rows begin at first."""
    label, bits = names, 64
    one = np.uint64(1)
    while True:
        differing = np.empty_like(label)
        np.bitwise_xor(label[1:], label[:-1], out=differing[1:])
        differing[first] = one
        low = np.bitwise_count((differing & (~differing + one)) - one).astype(np.uint64)
        label = (low << one) | ((label >> low) & one)
        if bits <= 3:
            return label.astype(np.uint8)
        bits = (2 * bits - 1).bit_length()


def begins(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each place."""
    n = len(label)
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    step = np.sign(label[1:].astype(np.int8) - label[:-1].astype(np.int8))
    left[1:], right[:-1] = step, -step
    left[first] = 0
    right[np.append(first[1:], n) - 1] = 0
    top = (left > 0) & (right > 0)
    bottom = (left < 0) & (right < 0)
    near = np.zeros(n, bool)
    near[1:] |= top[:-1]
    near[:-1] |= top[1:]
    out = top | (bottom & ~near)
    out[first] = True
    return out


def _grouped(names: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of the names from each start up to the next."""
    up, down = powers(len(names) + 1)
    total = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names) * up[: len(names)], out=total[1:])
    return mix((total[np.append(start[1:], len(names))] - total[start]) * down[start])


def level_up(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and row starts of the next level; each row has a name at least."""
    change = np.empty(len(names), bool)
    change[1:] = names[1:] != names[:-1]
    change[first] = True
    runs = np.flatnonzero(change)
    count = np.diff(np.append(runs, len(names))).astype(np.uint64)
    names = np.where(count > 1, mix(names[runs] ^ mix(count)), names[runs])
    first = np.searchsorted(runs, first)
    # A run's name can't equal its neighbour's but by a collision of hashes; toss() then sees no differing bit and gives 128.
    start = np.flatnonzero(begins(toss(names, first), first))
    return _grouped(names, start), np.searchsorted(start, first)


def parse(column: pa.Array, level: int = LEVEL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row the root name and its level; flat signatures and their offsets."""
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    root, height, count = np.zeros(rows, np.uint64), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    row = np.flatnonzero(np.diff(offsets) > 0)
    kept = np.zeros(0, np.uint64)
    names, first, k = data.astype(np.uint64) + np.uint64(1), offsets[:-1][row], 0
    while len(row):
        names, first = level_up(names, first)
        k += 1
        size = np.diff(np.append(first, len(names)))
        if k == level:
            kept, count[row] = names, size
        done = size == 1
        if k >= level and done.any():
            root[row[done]], height[row[done]] = names[first[done]], k
            names = names[np.repeat(~done, size)]
            row, size = row[~done], size[~done]
            first = np.cumsum(size) - size
    return root.view(np.int64), height, kept.view(np.int64), np.concatenate([[0], np.cumsum(count)])


def fingerprints(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """(doc_id, fingerprint, levels, signatures): the root's name, its level, and the names of the given level in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most=2 << 20):
                root, height, flat, first = parse(part.column("text"), level)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(root), pa.array(height), lists(flat, first, pa.int64())], ["doc_id", "fingerprint", "levels", "signatures"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, fingerprint long, levels int, signatures array<long>")
