"""Token counts in delta-maintained rollups.

A Rollup is a folder of batches. A batch holds signed additive totals (documents, tokens, characters) by source, language
and tokenizer version: inserts count +1, deletes -1, and a revision is a delete of the old counts and an insert of the
new ones. The totals are the sum of the committed batches. A batch is written to a folder of its own and
becomes valid by one rename, so a batch that is sent again, or of which an attempt was lost, counts once. compact()
merges committed batches into one, which lists their identifiers; readers see the batches or their merger, never both.

Counting is by byte-pair encoding of whole texts. The source and language of a delta are what its row has.

Defined results. A null text counts no tokens but is a document; null source or language is a group of its own. Rows
without doc_id count too, and each repeated row is a document. Deltas with null op or counts are left out. Groups whose
three totals are all zero are dropped. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.shared import discard, folder, returning, store
from tramline.llm.textnum import pieces

RANKS, VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEYS = ("source", "lang", "version")
SUMS = ("n_docs", "n_tokens", "n_chars")
_SCHEMA = ", ".join([f"{k} string" for k in KEYS] + [f"{s} long" for s in SUMS])
_encodings: dict[str, object] = {}


def encoding(ranks: str):
    """The encoding of a rank file, once a process."""
    if ranks not in _encodings:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks] = tiktoken.Encoding("tramline", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encodings[ranks]


def counted(docs: DataFrame, ranks: str = RANKS, version: str = VERSION) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, n_chars) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(ranks)
        for batch in batches:
            for part in pieces(batch):
                text = [t or "" for t in part.column("text").to_pylist()]
                tokens = np.array([len(own.encode_ordinary(t)) for t in text], np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(text), pa.string()), pa.array(tokens), pa.array([len(t) for t in text], pa.int64())], ["doc_id", "source", "lang", "version", "n_tokens", "n_chars"])

    column = lambda c, kind: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(column("doc_id", "long"), column("source", "string"), column("lang", "string"), column("text", "string")).mapInArrow(returning(run), "doc_id long, source string, lang string, version string, n_tokens long, n_chars long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_chars")).alias("n_chars"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """The totals in a folder that all executors and later sessions reach."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{folder(spark)}/rollup-{uuid.uuid4().hex}").rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("batches"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("batches")))

    def _index(self) -> tuple[list[str], set[str]]:
        """Valid folders, and the identifiers of all committed batches."""
        names = self._names()
        covers = {n: self._read_covered(n) for n in names if n.startswith("merged-")}
        batches = {n.removeprefix("batch-") for n in names if n.startswith("batch-")} | {b for own in covers.values() for b in own["batches"]}
        superseded = {x for own in covers.values() for x in own["folders"]}
        return [n for n in names if n not in superseded], batches

    def _read_covered(self, name: str) -> dict[str, list[str]]:
        return json.loads(self.spark.read.text(f"{self.path}/batches/{name}/covered").first()[0])

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add the signed deltas (KEYS and SUMS) as this batch; False where it is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch):
            raise ValueError(f"batch identifier {batch!r}")
        if batch in self._index()[1]:
            return False
        whole = deltas.where(" and ".join(f"{s} is not null" for s in SUMS)).groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS))
        attempt = f"attempt-{uuid.uuid4().hex}"
        whole.write.parquet(f"{self.path}/{attempt}/data")
        target, nested = self._at(f"batches/batch-{batch}"), self._at(f"batches/batch-{batch}/{attempt}")
        done = not self._fs.exists(target) and self._fs.rename(self._at(attempt), target)
        # Where another attempt came first meanwhile, a rename fails or moves this one into that one's folder.
        for lost in (nested, self._at(attempt)):
            if self._fs.exists(lost):
                self._fs.delete(lost, True)
                done = False
        return bool(done)

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens, n_chars) over all committed batches."""
        valid = self._index()[0]
        read = self.spark.read.schema(_SCHEMA)
        rows = read.parquet(*[f"{self.path}/batches/{n}/data" for n in valid]) if valid else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS)).where(" or ".join(f"{s} <> 0" for s in SUMS))

    def compact(self) -> None:
        """Merge the valid batches into one folder. One compaction may run at a time; commits may go on."""
        valid, _ = self._index()
        if len(valid) < 2:
            return
        batches = sorted({n.removeprefix("batch-") for n in valid if n.startswith("batch-")} | {b for n in valid if n.startswith("merged-") for b in self._read_covered(n)["batches"]})
        attempt = f"attempt-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/batches/{n}/data" for n in valid])
        rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS)).write.parquet(f"{self.path}/{attempt}/data")
        self.spark.createDataFrame([(json.dumps({"batches": batches, "folders": valid}),)], "value string").coalesce(1).write.text(f"{self.path}/{attempt}/covered")
        self._fs.rename(self._at(attempt), self._at(f"batches/merged-{uuid.uuid4().hex}"))
        for n in valid:
            self._fs.delete(self._at(f"batches/{n}"), True)


def rolled(docs: DataFrame, path: str | None = None, batch: str = "documents", ranks: str = RANKS, version: str = VERSION) -> DataFrame:
    """Totals after batches over all of docs, each sent again as after a lost acknowledgement: it counts once.

    The first half of each text comes in, is revised to the whole text, and all rows are deleted and inserted again;
    the batches of the first half are merged before the others come.
    """
    rollup = Rollup(docs.sparkSession, path)
    half = F.expr("substring(cast(`text` as string), 1, length(cast(`text` as string)) div 2)")
    before, now = store(counted(docs.withColumn("text", half), ranks, version), "counts"), store(counted(docs, ranks, version), "counts")
    first = [(batch, inserts(before)), (f"{batch}.revised", revisions(before, now))]
    for name, deltas in [*first, *first]:
        rollup.commit(name, deltas)
    rollup.compact()
    second = [(f"{batch}.deleted", deletes(now)), (f"{batch}.restored", inserts(now))]
    for name, deltas in [*first, *second, *second]:
        rollup.commit(name, deltas)
    discard(before)
    discard(now)
    return rollup.totals()
