"""Tables written to the folder that all executors share, to cut lineage without losing fault tolerance."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset (tests), a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. The schema is kept, so an empty table stays readable."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of store() that no later plan reads."""
    path = getattr(df, "_tramline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of rows that go to a Python worker at once, where the session doesn't say otherwise. Batches are held on both sides, JVM and
#: Python, by each task, and the operators cut them to a megabyte or a few anyway; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def texts(df: DataFrame, *more: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key as a long and the text (null as empty), whatever other columns df has."""
    _small_batches(df.sparkSession)
    return df.select(column(key).cast("long").alias(key), F.coalesce(column(text).cast("string"), F.lit("")).alias(text), *more)


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place, so that no name clashes with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def rewritten(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df's columns by their names and types after run, which sees and gives columns named by place as in plain()."""
    _small_batches(df.sparkSession)
    schema = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(df.schema.fields)])
    return plain(df).mapInArrow(returning(run), schema).toDF(*df.columns)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which lives on for later stages, gives its free memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            return  # not glibc

    return wrapped
