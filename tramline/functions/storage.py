"""Tables in the folder that all executors share (spark.checkpoint.dir), to cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: later plans read it, and a lost executor costs no more than a read."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame, key: str, part: int = 4 << 20) -> DataFrame:
    """df in partitions by key of about so many bytes of the files that it reads, if that makes more than spark.sql.shuffle.partitions: a task that
    sorts its partition then takes no more memory where the table is larger."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = -(-size // part)
    return df.repartition(wanted, key) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def file_system(spark: SparkSession, path: str):
    """The path and its file system, whether that is local or remote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(path: str) -> bool:
    """Whether a file or folder is there. A file system that can't be reached is an error."""
    target, fs = file_system(SparkSession.active(), path)
    return bool(fs.exists(target))


def folders_in(spark: SparkSession, path: str) -> list[str]:
    target, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())


def files_below(path: str) -> list[str]:
    """All files of a folder and those in it; none where there is no such folder."""
    target, fs = file_system(SparkSession.active(), path)
    out, found = [], fs.listFiles(target, True) if fs.exists(target) else None
    while found is not None and found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def sorted_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in ranges of its keys, sorted in each: readers of one key touch one file, and files are in the order of the keys."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
