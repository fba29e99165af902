"""Windows over the stops of a trip: all share one shuffle on the trip and one sort by stop_seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE, _AFTER = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)


def _along(key: str, order: str = "stop_seq"):
    return Window.partitionBy(key).orderBy(order)


def interpolated(stops: DataFrame, key: str = "trip_id") -> DataFrame:
    """Missing arr and dep of (key, stop_seq, arr, dep) filled linearly by stop index, rounded half away from zero.

    Trips whose first departure or last arrival is missing are left out.
    """
    w = _along(key)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(c).alias("t")))
    own = stops.withColumn("__i", (F.row_number().over(w) - 1).cast("long")).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    # Before an arrival lies the previous stop's departure, else its arrival; behind it its own departure, else the next stop's.
    prior = F.last(F.coalesce(known("dep"), known("arr")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(F.coalesce(known("arr"), known("dep")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    own = own.withColumn("__p", prior).withColumn("__l", later)

    def between(low: Column, high: Column) -> Column:
        share = F.when(high["i"] > low["i"], (F.col("__i") - low["i"]) / (high["i"] - low["i"])).otherwise(0.0)
        return low["t"] + F.round((high["t"] - low["t"]) * share).cast("long")

    arr = F.coalesce("arr", between(F.col("__p"), F.coalesce(known("dep"), F.col("__l"))))
    dep = F.coalesce("dep", between(F.coalesce(known("arr"), F.col("__p")), F.col("__l")))
    edges = F.max(F.when((F.col("__i") == 0) & F.col("dep").isNull() | (F.col("__i") == F.col("__n") - 1) & F.col("arr").isNull(), 1).otherwise(0)).over(Window.partitionBy(key))
    first, last = F.col("__i") == 0, F.col("__i") == F.col("__n") - 1
    own = own.withColumn("__bad", edges).withColumn("arr2", F.when(first, F.coalesce("arr", "dep")).otherwise(arr)).withColumn("dep2", F.when(last, F.coalesce("dep", "arr")).otherwise(dep))
    return own.where("__bad = 0").drop("__i", "__n", "__p", "__l", "__bad", "arr", "dep").withColumnsRenamed({"arr2": "arr", "dep2": "dep"})


def resequenced(stops: DataFrame, key: str = "trip_id") -> DataFrame:
    """stop_seq renumbered from 0 without gaps."""
    return stops.withColumn("stop_seq", (F.row_number().over(_along(key)) - 1).cast("long"))


def monotone_forward(stops: DataFrame, column: str, key: str = "trip_id") -> DataFrame:
    """No value below one before it."""
    return stops.withColumn(column, F.max(column).over(_along(key).rowsBetween(*_BEFORE)))


def monotone_backward(stops: DataFrame, column: str, key: str = "trip_id") -> DataFrame:
    """No value above one behind it."""
    return stops.withColumn(column, F.min(column).over(_along(key).rowsBetween(*_AFTER)))


def propagated(stops: DataFrame, key: str = "trip_id", delay: str = "delay") -> DataFrame:
    """The last known delay carried forward; 0 before the first one."""
    return stops.withColumn(delay, F.coalesce(F.last(delay, ignorenulls=True).over(_along(key).rowsBetween(*_BEFORE)), F.lit(0).cast("long")))


def sections(stops: DataFrame, key: str = "trip_id") -> DataFrame:
    """Pairs of consecutive stops: (key, stop_seq, from_id, to_id, dep, arr) with arr at the second one."""
    w = _along(key)
    return stops.select(key, "stop_seq", F.col("location_id").alias("from_id"), F.lead("location_id").over(w).alias("to_id"), "dep", F.lead("arr").over(w).alias("arr")).where("to_id is not null")


def ranges(rows: DataFrame, partition: list[str], order: list[str], same: str) -> DataFrame:
    """Numbers the maximal runs of rows that are equal in column same: adds run, from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)), 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(*_BEFORE))).drop("__new")


def windowed(legs: DataFrame, partition: str, order: str, columns: list[str], n: int) -> DataFrame:
    """Each n consecutive rows as one: columns c_0 .. c_(n-1)."""
    w = Window.partitionBy(partition).orderBy(order)
    cells = [F.lead(c, k).over(w).alias(f"{c}_{k}") for k in range(n) for c in columns]
    whole = F.count(F.lit(1)).over(w.rowsBetween(0, n - 1)).alias("__n")
    return legs.select(partition, order, whole, *cells).where(F.col("__n") == n).drop("__n")


def numbering(rows: DataFrame, seq: str = "gtfs_seq") -> DataFrame:
    """(trip_id, kind, numbers): how the sequence numbers of a trip are kept: none where they count from 0, their first where they count in ones
    or tens from 1 or 10 on, else all of them."""
    w = Window.partitionBy("trip_id").orderBy(seq)
    own = rows.select("trip_id", F.col(seq).cast("long").alias("s"), (F.row_number().over(w) - 1).alias("i"))
    fits = lambda first, step: F.bool_and(F.col("s") == first + step * F.col("i"))
    kind = F.when(fits(0, 1), "zero").when(fits(1, 1), "one").when(fits(10, 10), "ten").otherwise("exact")
    out = own.groupBy("trip_id").agg(kind.alias("kind"), F.array_sort(F.collect_list("s")).alias("all"))
    empty = F.array().cast("array<bigint>")
    return out.select("trip_id", "kind", F.when(F.col("kind") == "zero", empty).when(F.col("kind") == "exact", F.col("all")).otherwise(F.slice("all", 1, 1)).alias("numbers"))
