"""Service calendars as (service, day) rows instead of bit sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def expand(calendar: DataFrame, first: str, last: str, feed_end: Column | None = None) -> DataFrame:
    """(service_id, day) for calendar (service_id, monday .. sunday, start_date, end_date), both ends inclusive, within [first, last].

    A service that ends on the feed's last day goes on until last, if feed_end is given.
    """
    end = F.col("end_date") if feed_end is None else F.when(F.col("end_date") == feed_end, F.to_date(F.lit(last))).otherwise(F.col("end_date"))
    low, high = F.greatest(F.col("start_date"), F.to_date(F.lit(first))), F.least(end, F.to_date(F.lit(last)))
    runs = F.element_at(F.array(*(F.col(d).cast("int") for d in WEEKDAYS)), F.weekday("day") + 1) == 1
    return calendar.where(low <= high).withColumn("day", F.explode(F.sequence(low, high))).where(runs).select("service_id", "day")


def with_exceptions(base: DataFrame, exceptions: DataFrame) -> DataFrame:
    """base (service_id, day) with exceptions (service_id, day, exception_type, position): 1 adds, all else removes; the last of a day counts."""
    last = exceptions.groupBy("service_id", "day").agg(F.max_by("exception_type", "position").alias("exception_type"))
    marked = base.select("service_id", "day", F.lit(1).alias("on"), F.lit(0).alias("by")).unionByName(last.select("service_id", "day", (F.col("exception_type") == 1).cast("int").alias("on"), F.lit(1).alias("by")))
    return marked.groupBy("service_id", "day").agg(F.max_by("on", "by").alias("on")).where("on = 1").drop("on")


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Day sets of equal columns: how is and, andnot or or."""
    if how == "or":
        return a.unionByName(b).distinct()
    return a.distinct().join(b, a.columns, {"and": "left_semi", "andnot": "left_anti"}[how])


def combined(a: DataFrame, b: DataFrame, hows: Sequence[str]) -> DataFrame:
    """Several of combine() of (trip_id, day) at once, by how. A trip's days are one row of two arrays that are combined in it: one shuffle, of a row a trip."""
    both = a.select("trip_id", F.col("day").alias("__a"), F.lit(None).cast(a.schema["day"].dataType).alias("__b")).unionByName(b.select("trip_id", F.lit(None).cast(a.schema["day"].dataType).alias("__a"), F.col("day").alias("__b")))
    days = both.groupBy("trip_id").agg(F.collect_set("__a").alias("__a"), F.collect_set("__b").alias("__b"))
    ways = {"and": F.array_intersect("__a", "__b"), "andnot": F.array_except("__a", "__b"), "or": F.array_union("__a", "__b")}
    each = F.explode(F.array(*(F.struct(F.lit(how).alias("how"), ways[how].alias("days")) for how in hows))).alias("x")
    return days.select("trip_id", each).select("x.how", "trip_id", F.explode("x.days").alias("day"))


def shifted(days: DataFrame, by: Column) -> DataFrame:
    return days.withColumn("day", F.col("day") + by)


def frequencies(trips: DataFrame) -> DataFrame:
    """Each trip's departures: rows (.., start, end, headway) in minutes become (.., iteration, offset); end is exclusive."""
    n = F.floor((F.col("end") - F.col("start")) / F.greatest(F.col("headway"), F.lit(1)))
    return trips.where(n > 0).withColumn("iteration", F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))).withColumn("offset", F.col("start") + F.col("iteration") * F.greatest(F.col("headway"), F.lit(1)))


def route_days(stop_events: DataFrame, service_days: DataFrame) -> DataFrame:
    """(route_id, day): days on which any of a route's trips is under way, its service day shifted by 0 .. the days it lasts."""
    longest = stop_events.groupBy("trip_id", "route_id").agg(F.floor(F.max("arr") / 1440).cast("int").alias("more"))
    return service_days.join(longest, "trip_id").withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("more")))).select("route_id", (F.col("day") + F.col("shift")).alias("day")).distinct()


def to_utc(stop_events: DataFrame, service_days: DataFrame, first_day: str, tz: str) -> DataFrame:
    """Adds utc_arr and utc_dep, minutes since first_day in UTC: the zone's offset at noon of the service day holds for the whole trip.

    The days' offsets are worked out once a day, not once an event.
    """
    from tramline.functions.times import noon_offset

    days = service_days.select("day").distinct().withColumn("offset", noon_offset(F.date_add(F.to_date(F.lit(first_day)), F.col("day").cast("int")), F.lit(tz)))
    at = service_days.join(days, "day").withColumn("base", F.col("day") * 1440 - F.col("offset"))
    return stop_events.join(at.select("trip_id", "day", "base"), "trip_id").withColumn("utc_arr", F.col("base") + F.col("arr")).withColumn("utc_dep", F.col("base") + F.col("dep")).drop("base")


