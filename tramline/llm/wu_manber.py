"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the 13-word windows of each test item (a shorter item is one pattern as a whole). Blocks of two
words index a table of shifts; many lanes of a batch jump through their stretch of the text by those shifts, so most
positions are never looked at. Where the shift is 0, the hash of the window's last block selects a bucket of
patterns, the hash of its first block thins them, and the words' bytes are compared directly.

Defined results. Null and empty texts, and items of fewer than LEAST words, match nothing. Rows without doc_id are
searched and reported with a null id; items without item_id are left out. Repeated document rows are reported
once each in n_windows: rows of one doc_id add up. Windows don't cross documents; long texts are searched whole. Empty tables give
empty results. contaminated() doesn't read other columns, whatever their names; uncontaminated() passes them through. Case and
punctuation between words don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import returning, rewritten, texts
from tramline.llm.textnum import Words, mix, pieces, spread, window_hashes

NGRAM, LEAST = 13, 5
#: Most bytes of test items in one set of tables; more items are searched in several passes.
PASS_BYTES = 8 << 20
#: Most places that are looked up in the buckets at once.
_AT_ONCE = 1 << 16
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Patterns:
    """Shift table, suffix buckets and words of the windows of some test items, all of them in arrays.

    Equal windows are one pattern. Its words are those of source from source.starts[at] on, its items are
    item[first[p]:first[p + 1]]. About nine bytes of tables and temporary arrays go on each byte of items.
    """

    def __init__(self, items: list[tuple[int, str]], ngram: int = NGRAM, least: int = LEAST):
        self.source = words = Words(pa.array([t for _, t in items], pa.large_string()))
        self.n = 0
        count = words.counts
        row = np.flatnonzero(count >= least)
        if not len(row):
            return
        size = np.minimum(ngram, count[row])
        windows = count[row] - size + 1
        at, size, item = spread(words.first[row], windows), np.repeat(size, windows).astype(np.uint16), np.repeat(row, windows)
        # Windows with one hash have one size and one text; what is found is compared with the text of the first of them.
        name = np.empty(len(at), np.uint64)
        for k in np.unique(size).tolist():
            own = size == k
            name[own] = mix(window_hashes(words.hashes, k)[at[own]] ^ mix(np.array([k], np.uint64)))
        order = np.argsort(name, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        owner = np.cumsum(new) - 1
        pairs = np.unique((owner << 32) | item[order])
        ids = np.array([i for i, _ in items], np.int64)
        self.item, self.n = ids[pairs & 0xFFFFFFFF], int(owner[-1]) + 1
        self.first = np.searchsorted(pairs >> 32, np.arange(self.n + 1))
        del pairs, owner, name, item
        self.at, self.sizes = at[order[new]], size[order[new]]
        del at, size, order
        self.m = int(self.sizes.min())
        self.block = min(2, self.m)
        places = self.m - self.block + 1
        self.bits = min(24, max(12, math.ceil(math.log2(self.n * places * 8))))
        self.shift = np.full(1 << self.bits, places, np.uint8 if self.m < 256 else np.uint32)
        for j in range(places):
            # From the front on, so that the block nearest to the window's end, which has the least shift, is written last.
            self.shift[self.slot(self.keys(words.hashes, self.at + j))] = places - 1 - j
        suffix = self.keys(words.hashes, self.at + places - 1)
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.suffix = suffix[self.order]

    def keys(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the blocks of words that begin at these places."""
        return mix(hashes[at] * _C1 + hashes[at + 1] * _C2) if self.block == 2 else mix(hashes[at] * _C1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: Words, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word position, pattern) of all occurrences, and nothing else."""
        none = np.zeros(0, np.int64)
        h, n = words.hashes, len(words.hashes)
        if not self.n or n < self.m:
            return none, none, none
        edge = np.linspace(self.m - 1, n, min(lanes, n - self.m + 1) + 1).astype(np.int64)
        at, stop, hits = edge[:-1].copy(), edge[1:].copy(), []
        back = self.block - 1
        while len(at):
            step = self.shift[self.slot(self.keys(h, at - back))].astype(np.int64)
            zero = step == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(step, 1)
            alive = at < stop
            if not alive.all():
                at, stop = at[alive], stop[alive]
        if not hits:
            return none, none, none
        last = np.sort(np.concatenate(hits))
        out = []
        for own in np.array_split(last, -(-len(last) // _AT_ONCE)):
            key = self.keys(h, own - back)
            low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
            pattern = self.order[spread(low, high - low)]
            begin = np.repeat(own, high - low) - self.m + 1
            fits = begin + self.sizes[pattern] <= n
            begin, pattern = begin[fits], pattern[fits]
            same = self.keys(h, begin) == self.keys(self.source.hashes, self.at[pattern])
            begin, pattern = begin[same], pattern[same]
            row = np.searchsorted(words.first, begin, "right") - 1
            inside = begin + self.sizes[pattern] <= words.first[row + 1]
            begin, pattern, row = begin[inside], pattern[inside], row[inside]
            sure = self.equal(words, begin, pattern)
            out.append((row[sure], begin[sure], pattern[sure]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def equal(self, words: Words, begin: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Whether the words from begin on have the bytes of the pattern's words."""
        size, mine = self.sizes[pattern].astype(np.int64), self.source
        left, right = spread(begin, size), spread(self.at[pattern], size)
        long = words.ends[left] - words.starts[left]
        same = long == mine.ends[right] - mine.starts[right]
        owner = np.repeat(np.arange(len(begin)), size)
        sure = np.bincount(owner[~same], minlength=len(begin)) == 0
        keep = sure[owner]
        left, right, long, owner = left[keep], right[keep], long[keep], owner[keep]
        differ = words.data[spread(words.starts[left], long)] != mine.data[spread(mine.starts[right], long)]
        return sure & (np.bincount(np.repeat(owner, long)[differ], minlength=len(begin)) == 0)


def _passes(docs: DataFrame, benchmark: DataFrame, ngram: int, least: int) -> Iterator[Broadcast]:
    """The patterns of all test items, as many sets as it takes to keep each below PASS_BYTES.

    The test items go to all tasks. They are a fixed evaluation set; their size is measured, and beyond PASS_BYTES
    they are searched in several passes with a part of them each.
    """
    tests = texts(benchmark, key="item_id").where("item_id is not null")
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(total / PASS_BYTES))
    for k in range(passes):
        share = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else tests
        yield docs.sparkSession.sparkContext.broadcast(Patterns([(r.item_id, r.text) for r in share.toLocalIterator()], ngram, least))


def contaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_windows): in how many places a document has a window of the test item."""
    source = texts(docs)
    out = None
    for sent in _passes(docs, benchmark, ngram, least):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns = sent.value
            for batch in batches:
                for part in pieces(batch):
                    words = Words(part.column("text"))
                    row, begin, pattern = patterns.search(words)
                    many = np.diff(patterns.first)[pattern] if patterns.n else pattern
                    if not len(many):
                        continue
                    # A place of an item counts once, whatever patterns of it begin there.
                    item = patterns.item[spread(patterns.first[pattern], many)]
                    place = np.unique(np.stack([np.repeat(row, many), item, np.repeat(begin, many)]), axis=1)[:2]
                    (row, item), n_windows = np.unique(place, axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(n_windows.astype(np.int64))], ["doc_id", "item_id", "n_windows"])

        found = source.mapInArrow(returning(run), "doc_id long, item_id long, n_windows long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, without a window of any test item."""
    at = docs.columns.index("text")
    for sent in _passes(docs, benchmark, ngram, least):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, f"c{at}"):
                    row, _, _ = sent.value.search(Words(part.column(at)))
                    keep = np.ones(part.num_rows, bool)
                    keep[row] = False
                    yield part.filter(pa.array(keep))

        docs = rewritten(docs, run)
    return docs


def sql(ngram: int = NGRAM, least: int = LEAST) -> str:
    """DuckDB SQL with the rows of contaminated() over documents and benchmark."""
    split = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_\x{80}-\x{10ffff}]+')"
    return f"""
        WITH items AS (SELECT item_id, {split} AS w FROM benchmark WHERE item_id IS NOT NULL),
        sized AS (SELECT item_id, w, least({ngram}, len(w)) AS n FROM items WHERE len(w) >= {least}),
        patterns AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
        texts AS (SELECT doc_id, {split} AS w FROM documents),
        grams AS (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM texts, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n))
        SELECT doc_id, item_id, count(*)::BIGINT AS n_windows FROM grams JOIN patterns USING (n, gram) GROUP BY ALL"""
