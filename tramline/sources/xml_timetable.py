"""XML timetables (NeTEx family): one scan for each kind of element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.classes import of_route_type, route_type_of_mode

_REF = "struct<_ref:string>"
_TEXT = "string"


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of that tag in all files of the folder, .xml and .xml.gz; namespaces are left out."""
    return spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").load(path)


def stop_places(spark: SparkSession, path: str) -> DataFrame:
    """(stop_id, parent_id, name, lat, lng) of places and their quays."""
    point = "struct<Location:struct<Longitude:double,Latitude:double>>"
    own = _rows(spark, path, "StopPlace", f"_id string, Name {_TEXT}, Centroid {point}, quays struct<Quay:array<struct<_id:string,Name:string,PublicCode:string,Centroid:{point}>>>")
    place = own.select(F.col("_id").alias("stop_id"), F.lit(None).cast("string").alias("parent_id"), F.col("Name").alias("name"), F.col("Centroid.Location.Latitude").alias("lat"), F.col("Centroid.Location.Longitude").alias("lng"))
    quay = own.select(F.col("_id").alias("parent_id"), F.col("Name").alias("n"), F.col("Centroid").alias("c"), F.explode("quays.Quay").alias("q"))
    return place.unionByName(quay.select(F.col("q._id").alias("stop_id"), "parent_id", F.coalesce("q.Name", "n").alias("name"), F.coalesce("q.Centroid.Location.Latitude", "c.Location.Latitude").alias("lat"), F.coalesce("q.Centroid.Location.Longitude", "c.Location.Longitude").alias("lng")))


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, stop_id): a quay goes before its place."""
    own = _rows(spark, path, "PassengerStopAssignment", f"ScheduledStopPointRef {_REF}, StopPlaceRef {_REF}, QuayRef {_REF}")
    return own.select(F.col("ScheduledStopPointRef._ref").alias("point_id"), F.coalesce("QuayRef._ref", "StopPlaceRef._ref").alias("stop_id")).where("point_id is not null and stop_id is not null")


def operators(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "Operator", "_id string, Name string, ShortName string").select(F.col("_id").alias("operator_id"), F.coalesce("Name", "ShortName").alias("name"))


def routes(spark: SparkSession, path: str) -> DataFrame:
    sub = "struct<" + ",".join(f"{m}:string" for m in ("RailSubmode", "BusSubmode", "TramSubmode", "MetroSubmode", "WaterSubmode")) + ">"
    own = _rows(spark, path, "Line", f"_id string, Name string, ShortName string, PublicCode string, TransportMode string, TransportSubmode {sub}, OperatorRef {_REF}, AuthorityRef {_REF}").where("_id is not null")
    fine = F.coalesce(*(F.col(f"TransportSubmode.{m}") for m in ("RailSubmode", "BusSubmode", "TramSubmode", "MetroSubmode", "WaterSubmode")))
    kind = route_type_of_mode(F.col("TransportMode"), fine)
    return own.select(F.col("_id").alias("route_id"), F.coalesce("PublicCode", "ShortName", "Name").alias("name"), F.coalesce("OperatorRef._ref", "AuthorityRef._ref").alias("operator_id"), kind.alias("route_type"), of_route_type(kind).alias("clasz"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern_id, position, point_in_pattern, point_id, line_id)."""
    own = _rows(spark, path, "ServiceJourneyPattern", f"_id string, RouteView struct<LineRef:{_REF}>, pointsInSequence struct<StopPointInJourneyPattern:array<struct<_id:string,_order:int,ScheduledStopPointRef:{_REF},ForBoarding:boolean,ForAlighting:boolean>>>")
    p = own.select(F.col("_id").alias("pattern_id"), F.col("RouteView.LineRef._ref").alias("line_id"), F.posexplode("pointsInSequence.StopPointInJourneyPattern").alias("i", "p"))
    return p.select("pattern_id", "line_id", F.coalesce("p._order", F.col("i") + 1).alias("position"), F.col("p._id").alias("point_in_pattern"), F.col("p.ScheduledStopPointRef._ref").alias("point_id"), F.coalesce("p.ForBoarding", F.lit(True)).alias("in_allowed"), F.coalesce("p.ForAlighting", F.lit(True)).alias("out_allowed"))


def valid_days(spark: SparkSession, path: str) -> DataFrame:
    """(day_type_id, day): bits of the operating periods that day types are assigned to, else explicit days."""
    periods = _rows(spark, path, "UicOperatingPeriod", "_id string, FromDate string, ToDate string, ValidDayBits string").where("ValidDayBits is not null")
    bits = periods.select(F.col("_id").alias("period_id"), F.to_date(F.substring("FromDate", 1, 10)).alias("first"), F.posexplode(F.filter(F.split("ValidDayBits", ""), lambda c: c != "")).alias("i", "bit")).where("bit = '1'").select("period_id", F.date_add("first", F.col("i")).alias("day"))
    link = _rows(spark, path, "DayTypeAssignment", f"OperatingPeriodRef {_REF}, UicOperatingPeriodRef {_REF}, DayTypeRef {_REF}, Date string").select(F.coalesce("OperatingPeriodRef._ref", "UicOperatingPeriodRef._ref").alias("period_id"), F.col("DayTypeRef._ref").alias("day_type_id"), F.to_date(F.substring("Date", 1, 10)).alias("day"))
    return link.drop("day").join(bits, "period_id").select("day_type_id", "day").unionByName(link.where("day is not null").select("day_type_id", "day")).distinct()


_JOURNEY = (
    f"_id string, TransportMode string, DepartureTime string, LineRef {_REF}, OperatorRef {_REF}, ServiceJourneyPatternRef {_REF}, JourneyPatternRef {_REF}, dayTypes struct<DayTypeRef:array<{_REF}>>, "
    f"passingTimes struct<TimetabledPassingTime:array<struct<StopPointInJourneyPatternRef:{_REF},ArrivalTime:string,ArrivalDayOffset:int,DepartureTime:string,DepartureDayOffset:int>>>, "
    f"calls struct<Call:array<struct<_order:int,ScheduledStopPointRef:{_REF},Arrival:struct<Time:string,DayOffset:int,ForAlighting:boolean>,Departure:struct<Time:string,DayOffset:int,ForBoarding:boolean>>>>"
)


def _minutes(time: str, offset: str):
    return (F.substring(time, 1, 2).cast("long") * 60 + F.substring(time, 4, 2).cast("long") + F.coalesce(F.col(offset), F.lit(0)) * 1440)


def journeys(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trips (trip_id, route_id, operator_id, day_type_id) and stop events (trip_id, stop_seq, stop_id, arr, dep, in_allowed, out_allowed) in local minutes, from calls
    in the journey or from passing times over its pattern."""
    own = _rows(spark, path, "ServiceJourney", _JOURNEY).where("_id is not null")
    pattern, assigned = patterns(spark, path), assignments(spark, path)
    call = own.select(F.col("_id").alias("trip_id"), F.posexplode("calls.Call").alias("i", "c")).select("trip_id", F.coalesce("c._order", F.col("i") + 1).alias("position"), F.col("c.ScheduledStopPointRef._ref").alias("point_id"), _minutes("c.Arrival.Time", "c.Arrival.DayOffset").alias("arr"), _minutes("c.Departure.Time", "c.Departure.DayOffset").alias("dep"), F.coalesce("c.Departure.ForBoarding", F.lit(True)).alias("in_allowed"), F.coalesce("c.Arrival.ForAlighting", F.lit(True)).alias("out_allowed"))
    passed = own.select(F.col("_id").alias("trip_id"), F.coalesce("ServiceJourneyPatternRef._ref", "JourneyPatternRef._ref").alias("pattern_id"), F.posexplode("passingTimes.TimetabledPassingTime").alias("i", "p")).select("trip_id", "pattern_id", F.col("p.StopPointInJourneyPatternRef._ref").alias("point_in_pattern"), _minutes("p.ArrivalTime", "p.ArrivalDayOffset").alias("arr"), _minutes("p.DepartureTime", "p.DepartureDayOffset").alias("dep"))
    passed = passed.join(pattern.drop("line_id"), ["pattern_id", "point_in_pattern"]).select(*call.columns)
    from pyspark.sql import Window

    events = call.unionByName(passed).join(assigned, "point_id", "left").select("trip_id", (F.row_number().over(Window.partitionBy("trip_id").orderBy("position")) - 1).cast("long").alias("stop_seq"), F.coalesce("stop_id", "point_id").alias("stop_id"), F.coalesce("arr", "dep").alias("arr"), F.coalesce("dep", "arr").alias("dep"), "in_allowed", "out_allowed")
    lines = pattern.select("pattern_id", "line_id").distinct()
    trips = own.select(F.col("_id").alias("trip_id"), F.col("LineRef._ref").alias("route_id"), F.col("OperatorRef._ref").alias("operator_id"), F.coalesce("ServiceJourneyPatternRef._ref", "JourneyPatternRef._ref").alias("pattern_id"), F.explode_outer("dayTypes.DayTypeRef._ref").alias("day_type_id"))
    return trips.join(lines, "pattern_id", "left").select("trip_id", F.coalesce("route_id", "line_id").alias("route_id"), "operator_id", "day_type_id"), events


def meetings(spark: SparkSession, path: str) -> DataFrame:
    """(from_trip, to_trip) of interchanges at which one stays seated."""
    own = _rows(spark, path, "ServiceJourneyInterchange", f"StaySeated boolean, FromJourneyRef {_REF}, ToJourneyRef {_REF}")
    return own.where("StaySeated").select(F.col("FromJourneyRef._ref").alias("from_trip"), F.col("ToJourneyRef._ref").alias("to_trip"))


def to_utc(events: DataFrame, days: DataFrame, tz: str) -> DataFrame:
    """(trip_id, day, stop_seq, utc_arr, utc_dep): here each event has the zone's offset at its own time, not that of noon."""
    rows = events.join(days, "trip_id")
    at = lambda c: F.to_utc_timestamp(F.timestamp_micros((F.unix_date("day") * 1440 + F.col(c)) * 60_000_000), tz)
    return rows.select("trip_id", "day", "stop_seq", at("arr").alias("utc_arr"), at("dep").alias("utc_dep"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    trips, events = journeys(spark, path)
    return {"stops": stop_places(spark, path), "operators": operators(spark, path), "routes": routes(spark, path), "day_types": valid_days(spark, path), "trips": trips, "stop_events": events, "seated": meetings(spark, path)}
