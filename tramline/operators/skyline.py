"""Pareto sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def journeys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows (keys, dep, arr, transfers) that none of their keys dominates: later or equal departure, earlier or equal arrival,
    no more transfers, and better in one. Equal rows count once.

    For each number of transfers the rows are swept from the latest departure on, once for each bound on transfers that
    occurs below; these are few, so the work is linear but for the sort.
    """
    own = rows.select(*keys, "dep", "arr", "transfers").distinct()
    levels = own.select(*keys, F.col("transfers").alias("level")).distinct()
    seen = own.join(levels, keys).where("transfers <= level")
    w = Window.partitionBy(*keys, "level").orderBy(F.desc("dep"), "arr", "transfers").rowsBetween(Window.unboundedPreceding, -1)
    swept = seen.withColumn("best", F.min("arr").over(w)).where("transfers = level and (best is null or arr < best)")
    return swept.select(*keys, "dep", "arr", "transfers")


def improving(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Rows whose value is below all of a smaller order within their keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__best", F.min(value).over(w)).where(f"__best is null or {value} < __best").drop("__best")
