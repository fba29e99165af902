"""MinHash near-duplicate search: universal-hash minima, banding, signature verification, connected components.

Every document is a query: all that share a band are candidates, however many there are. A band's bucket first
verifies all its members against its least one; members that fail are then verified against every other member,
so what is linked is exactly what all pairs of the bucket would link, without pairing up large groups of copies. Members whose distances to
the least one differ by more than copies can are no pair (the triangle inequality), so strangers aren't compared with close copies of it.

Defined results. Texts without a word are never linked. Texts of fewer words than a shingle count as one shingle. Long texts are
read whole, in batches of their own. Rows without doc_id are left out. Repeated rows of one doc_id are one document. Ties don't arise:
the least doc_id of a group stays. An empty table gives an empty result. near_duplicates() doesn't read other columns, whatever their
names; kept() passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tramline.llm.shared import discard, plain, returning, store, texts
from tramline.llm.textnum import Words, mix, pieces, spread, window_hashes

PERMUTATIONS, BANDS, SHINGLE, THRESHOLD = 192, 48, 3, 0.45
_random = np.random.Generator(np.random.PCG64(7))
_A = _random.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, 1024, dtype=np.uint64)


def minima(words: Words, permutations: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and for each of them so many 16-bit signatures of its minima."""
    rows = np.flatnonzero(words.counts > 0)
    counts = words.counts[rows]
    lengths = np.maximum(counts - shingle + 1, 1)
    long = counts >= shingle
    starts = np.cumsum(lengths) - lengths
    hashes = np.zeros(int(lengths.sum()), np.uint64)
    whole = window_hashes(words.hashes, shingle)
    hashes[spread(starts[long], lengths[long])] = whole[spread(words.first[rows[long]], lengths[long])]
    for n in range(1, shingle):
        few = counts == n
        if few.any():
            hashes[starts[few]] = window_hashes(words.hashes, n)[words.first[rows[few]]]
    x = hashes >> np.uint64(32)
    value, out = np.empty_like(x), np.empty((len(rows), permutations), np.uint16)
    for p in range(permutations):
        np.multiply(x, _A[p], out=value)
        np.add(value, _B[p], out=value)
        out[:, p] = mix(np.minimum.reduceat(value, starts)) if len(rows) else 0
    return rows, out


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2, sig): sig has 16 bits for each minimum; k1 and k2 are 128 bits of hash of sig."""
    weights = _A[:permutations].copy(), _B[:permutations] | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, most=1 << 20):
                rows, sig = minima(Words(part.column("text")), permutations, shingle)
                if not len(rows):
                    continue
                wide = sig.astype(np.uint64) + np.uint64(1)
                k1, k2 = (mix(mix(wide * w).sum(axis=1, dtype=np.uint64)).view(np.int64) for w in weights)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * permutations), len(rows), [None, pa.py_buffer(np.ascontiguousarray(sig))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), pa.array(k1), pa.array(k2), packed.cast(pa.binary())], ["doc_id", "k1", "k2", "sig"])

    return texts(docs).where("doc_id is not null").mapInArrow(returning(run), "doc_id long, k1 long, k2 long, sig binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame, permutations: int, threshold: float) -> DataFrame:
    """pairs (a, b) with apart, the number of places in which the signatures differ, and ok: whether they agree in at least that share."""
    most = permutations - int(np.ceil(threshold * permutations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, permutations) for c in ("sa", "sb"))
            apart = (x != y).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart.astype(np.int32)), pa.array(apart <= most)], ["a", "b", "apart", "ok"])

    left, right = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, apart int, ok boolean")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label) of all nodes of edges (a, b); label is the least node that is connected. discard() it when it is read.

    Alternating large-star and small-star. Each round is written to the shared folder, so no lineage grows; the
    minima are partial aggregates and a join, so a node with many neighbours doesn't meet in one task.
    """
    current = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = store(small, "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(current)
        current = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    out = current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out._tramline_path = current._tramline_path
    return out


def near_duplicates(docs: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of) for each document that isn't the least of its group; duplicate_of is the least one.

    Documents are linked if they share a band and their estimated resemblance is at least threshold.
    """
    rows = permutations // bands
    sigs = store(signatures(docs, permutations, shingle), "signatures")
    reps = store(sigs.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")), "reps")
    cut = [F.xxhash64(F.lit(i), F.expr(f"substring(sig, {2 * rows * i + 1}, {2 * rows})")) for i in range(bands)]
    members = reps.select("doc_id", F.explode(F.array(*cut)).alias("bucket"))
    least = members.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("bucket", "leader")
    members = store(members.join(least, "bucket").distinct(), "members")
    pairs = members.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = store(_agreeing(pairs, reps, permutations, threshold), "verified")
    # The number of places in which signatures differ is a metric: of two documents that are d and e apart from the leader, |d - e| or more
    # places differ. So only members whose distances are near enough are compared; they meet by cells of half that width.
    most = permutations - int(np.ceil(threshold * permutations))
    wide = max(1, most // 2)
    placed = members.join(first.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), "apart", "ok"), ["leader", "doc_id"])
    near = F.sequence(F.floor((F.col("apart") - most) / wide), F.floor((F.col("apart") + most) / wide))
    failed = placed.where("not ok").select("bucket", "doc_id", "apart", F.explode(near).alias("cell"))
    other = placed.select("bucket", F.col("doc_id").alias("other"), F.col("apart").alias("also"), F.floor(F.col("apart") / wide).alias("cell"))
    met = failed.join(other, ["bucket", "cell"]).where(f"doc_id <> other and abs(apart - also) <= {most}")
    rest = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    second = _agreeing(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), reps, permutations, threshold)
    labels = components(first.where("ok").select("a", "b").unionByName(second.where("ok").select("a", "b")))
    to_rep = sigs.select("doc_id", "k1", "k2").join(reps.select("k1", "k2", F.col("doc_id").alias("rep")), ["k1", "k2"]).select("doc_id", "rep")
    found = to_rep.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("duplicate_of"))
    out = store(found.groupBy("doc_id").agg(F.min("duplicate_of").alias("duplicate_of")).where("doc_id <> duplicate_of"), "duplicates")
    for table in (sigs, reps, members, first, labels):
        discard(table)
    return out


def kept(docs: DataFrame, permutations: int = PERMUTATIONS, bands: int = BANDS, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that stay: one of each group, the one of least doc_id.

    Of several rows of one doc_id the least by text and all other columns that can be ordered stays. Rows without doc_id
    all stay.
    """
    gone = near_duplicates(docs, permutations, bands, shingle, threshold).select("doc_id")
    # Columns go by place, so that none of docs clashes with those made here.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, own = F.col(at["doc_id"]), plain(docs)
    kept = own.where(key.isNotNull()).join(gone, key.cast("long") == gone["doc_id"], "left_anti")
    least = [F.col(at[c]) for c in ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))] if _orderable(docs.schema[docs.columns.index(c)].dataType)]
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*least))).where("nth = 1").drop("nth")
    return one.unionByName(own.where(key.isNull())).toDF(*docs.columns)


def _orderable(kind: DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()
