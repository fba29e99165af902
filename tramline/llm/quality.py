"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Words and runs of punctuation, and pairs of neighbours, are hashed to a table of weights; a pair of one word twice is one
feature whatever the word. A text's features count once each, and its score is their sparse dot product with the weights.
There are two sets of weights, for quality and for toxic text, learnt from the table of labels.

The training rows are a bounded sample of the labelled documents: the SAMPLE least by a hash of doc_id. Scoring covers
all documents and whole texts.

Defined results. Null and empty texts have only the intercept. Rows without doc_id are scored. Labels that are null are
left out; of repeated labels of a doc_id the lower quality and the higher toxic count. Without any label both scores are
0.5 and everything is kept. Repeated rows get equal scores. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import returning, texts
from tramline.llm.textnum import Words, lists, mix, pieces

BITS, SAMPLE, EPOCHS = 18, 4000, 4
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.6, 0.5
_C = np.uint64(0x9E3779B97F4A7C15)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature indexes of the rows, distinct within a row, and the n+1 offsets of the rows in them."""
    words = Words(column, marks=True)
    h = words.hashes
    shift = np.uint64(64 - bits)
    row = words.row_of
    pair = mix(h[:-1] * _C + h[1:])
    pair[h[:-1] == h[1:]] = _C
    within = row[1:] == row[:-1]
    flat = np.concatenate([h >> shift, pair[within] >> shift]).astype(np.int64)
    key = (np.concatenate([row, row[1:][within]]) << bits) | flat
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(key >> bits, np.arange(words.rows + 1))


def train(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, weight: float = 1.0) -> np.ndarray:
    """Weights, the intercept last, after so many passes of per-coordinate updates over the rows in their order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            i = np.append(x, size - 1)
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (weight if y else 1.0)
            after = ni + g * g
            z[i] = zi + g - (np.sqrt(after) - root) / ALPHA * w
            n[i] = after
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights for quality and for toxic."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("doc_id is not null and q is not null and t is not null")
    marked = marked.groupBy("doc_id").agg(F.min("q").alias("q"), F.max("t").alias("t")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                flat, first = features(part.column("text"), bits)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("q"), part.column("t"), lists(flat, first, pa.int32())], ["doc_id", "q", "t", "x"])

    chosen = texts(docs).join(F.broadcast(marked), "doc_id").mapInArrow(run, "doc_id long, q int, t int, x array<int>")
    table = chosen.toArrow().sort_by("doc_id")
    zero = np.zeros((1 << bits) + 1, np.float32)
    if not table.num_rows:
        return zero, zero
    order = np.random.Generator(np.random.PCG64(3)).permutation(table.num_rows)
    x = [r.values.to_numpy() for r in table.column("x").combine_chunks()]
    x = [x[i] for i in order]
    q, t = (np.asarray(table.column(c))[order] for c in ("q", "t"))
    return train(x, q, bits), train(x, t, bits, weight=2.0)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """(doc_id, quality, toxic, keep): two probabilities, and whether quality is at least and toxic below a half.

    The weights that are broadcast have a fixed size, and the labels that are broadcast to choose the training rows
    are sample rows at most.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                flat, first = features(part.column("text"), bits)
                scores = []
                for w in sent.value:
                    total = np.concatenate([[0.0], np.cumsum(w[flat].astype(np.float64))])
                    scores.append(1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + w[-1], -35, 35))))
                keep = (scores[0] >= 0.5) & (scores[1] < 0.5) if any(w.any() for w in sent.value) else np.ones(len(first) - 1, bool)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores[0]), pa.array(scores[1]), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    return texts(docs).mapInArrow(returning(run), "doc_id long, quality double, toxic double, keep boolean")
