"""One object for a timetable: tables, hooks, search, updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import calendar, journeys, realtime
from tramline.sources import bundle, folders


class Timetable:
    """Tables by name; stop_events have absolute minutes, see tramline.operators.journeys."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str, hooks: dict[str, Callable[[DataFrame], DataFrame]] | None = None, **options) -> Timetable:
        """From a feed of a known format. A hook maps a table to itself: it may change columns and drop rows."""
        return cls(folders.load(spark, path, hooks, **options))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Timetable:
        return cls(bundle.read(spark, path))

    def save(self, path: str) -> None:
        bundle.write(self.tables, path)

    def counts(self) -> dict[str, int]:
        return {n: t.count() for n, t in self.tables.items()}

    def stations(self, name: str) -> DataFrame:
        return self.tables["stops"].where(F.col("stop_name").contains(name))

    def is_active(self, trip_id: str, day: str) -> bool:
        trips = self.tables["trips"].where(F.col("trip_id") == trip_id)
        return not trips.join(self.tables["service_days"].where(F.col("day") == F.lit(day).cast("date")), "service_id").isEmpty()

    def on_days(self, first: str, last: str, tz: str = "UTC") -> DataFrame:
        """Stop events of all trips that run in [first, last], minutes since first in UTC, trips named by day, and by their departure where they
        have frequencies. The offset is that at noon."""
        from tramline.functions.times import noon_offset

        days = self.tables["service_days"].where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        base = F.datediff("day", F.lit(first).cast("date")) * 1440 - noon_offset(F.col("day"), F.lit(tz))
        runs = self.tables["trips"].select("trip_id", "service_id", "clasz", "route_id", *(c for c in ("bikes", "cars") if c in self.tables["trips"].columns)).join(days, "service_id").withColumn("base", base)
        rows = self.tables["stop_times"].join(runs, "trip_id").withColumns({"shift": F.lit(0).cast("long"), "nth": F.lit(None).cast("string")})
        if "frequencies" in self.tables:
            # A trip with frequencies runs at these times alone, not at those of its stop times.
            first = self.tables["stop_times"].groupBy("trip_id").agg(F.min_by("dep", "stop_seq").alias("leaves"))
            often = calendar.frequencies(self.tables["frequencies"]).join(first, "trip_id").select("trip_id", (F.col("offset") - F.col("leaves")).cast("long").alias("shift"), F.col("offset").cast("string").alias("nth"))
            once = rows.join(often.select("trip_id").distinct(), "trip_id", "left_anti")
            rows = once.unionByName(rows.drop("shift", "nth").join(often, "trip_id").select(*once.columns))
        base = F.col("base") + F.col("shift")
        extra = [c for c in ("in_wheelchair", "out_wheelchair", "bikes", "cars") if c in rows.columns]
        return rows.select(F.concat_ws("@", "trip_id", F.col("day").cast("string"), "nth").alias("trip_id"), "route_id", "clasz", F.col("stop_id").alias("location_id"), "stop_seq", (base + F.col("arr")).alias("arr"), (base + F.col("dep")).alias("dep"), "in_allowed", "out_allowed", *extra)

    def search(self, stop_events: DataFrame, **options) -> journeys.Search:
        stops = self.tables["stops"].select(F.col("stop_id").alias("location_id"), "transfer_min")
        return journeys.Search(stop_events, stops, self.tables["footpaths"].select("from_id", "to_id", "minutes"), **options)

    def updated(self, stop_events: DataFrame, updates: DataFrame) -> DataFrame:
        return realtime.applied(stop_events, realtime.overlay(stop_events, updates))
