"""Schedule feeds of CSV files. All cells are read as text by name, then cast; a missing file is an empty table."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.storage import exists
from tramline.functions import classes, colors, times

#: Columns of each file; those that a feed lacks are null.
FILES: dict[str, str] = {
    "agency": "agency_id agency_name agency_url agency_timezone agency_fare_url ticketing_deep_link_id",
    "stops": "stop_id stop_name location_type stop_timezone parent_station platform_code stop_code stop_desc stop_lat stop_lon wheelchair_boarding",
    "transfers": "from_stop_id to_stop_id transfer_type min_transfer_time from_trip_id to_trip_id",
    "stop_group_elements": "stop_group_id stop_id",
    "routes": "route_id agency_id route_short_name route_long_name route_url route_desc route_type route_color route_text_color network_id ticketing_deep_link_id",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "feed_info": "feed_end_date feed_lang default_lang",
    "trips": "route_id service_id trip_id trip_headsign trip_short_name direction_id block_id shape_id bikes_allowed cars_allowed wheelchair_accessible pickup_type trip_route_type ticketing_trip_id ticketing_type",
    "frequencies": "trip_id start_time end_time headway_secs exact_times",
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence stop_headsign pickup_type drop_off_type shape_dist_traveled location_group_id location_id start_pickup_drop_off_window end_pickup_drop_off_window pickup_booking_rule_id drop_off_booking_rule_id ticketing_type",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence shape_dist_traveled",
    "translations": "table_name field_name language translation record_id record_sub_id field_value",
    "location_groups": "location_group_id location_group_name",
    "location_group_stops": "location_group_id stop_id",
    "booking_rules": "booking_rule_id booking_type prior_notice_duration_min prior_notice_duration_max prior_notice_last_day prior_notice_last_time prior_notice_start_day prior_notice_start_time prior_notice_service_id message pickup_message drop_off_message phone_number info_url booking_url",
    "fare_media": "fare_media_id fare_media_name fare_media_type",
    "rider_categories": "rider_category_id rider_category_name is_default_fare_category eligibility_url",
    "fare_products": "fare_product_id fare_product_name fare_media_id amount currency rider_category_id",
    "areas": "area_id area_name",
    "area_set_elements": "area_set_id area_id",
    "networks": "network_id network_name",
    "route_networks": "network_id route_id",
    "timeframes": "timeframe_group_id start_time end_time service_id",
    "fare_leg_rules": "leg_group_id network_id from_area_id to_area_id from_timeframe_group_id to_timeframe_group_id fare_product_id rule_priority contains_area_set_id contains_exactly_area_set_id",
    "stop_areas": "area_id stop_id",
    "fare_leg_join_rules": "from_network_id to_network_id from_stop_id to_stop_id",
    "fare_transfer_rules": "from_leg_group_id to_leg_group_id transfer_count duration_limit duration_limit_type fare_transfer_type fare_product_id",
    "ticketing_identifiers": "ticketing_stop_id stop_id agency_id",
    "ticketing_deep_links": "ticketing_deep_link_id web_url android_intent_uri ios_universal_link_url",
}


def applicable(path: str) -> bool:
    """Whether the files that every feed must have are there."""
    there = lambda n: exists(f"{path}/{n}.txt")
    return all(map(there, ("agency", "stops", "routes", "trips", "stop_times"))) and (there("calendar") or there("calendar_dates"))


def raw(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A file's known columns as trimmed text, blank as null, and position in the file (file order for 'the last one counts')."""
    columns = FILES[name].split()
    file = f"{path}/{name}.txt"
    if not exists(file):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", position long")
    own = spark.read.option("header", True).option("multiLine", False).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(str(file))
    found = {c.strip().lstrip("﻿").strip('"'): c for c in own.columns}
    cell = lambda c: F.when(F.trim(F.col(f"`{found[c]}`")) != "", F.trim(F.col(f"`{found[c]}`"))) if c in found else F.lit(None).cast("string")
    return own.select(*(cell(c).alias(c) for c in columns), F.monotonically_increasing_id().alias("position"))


def _int(c: str, default: int | None = None) -> Column:
    value = F.col(c).try_cast("int") if hasattr(Column, "try_cast") else F.expr(f"try_cast({c} as int)")
    return value if default is None else F.coalesce(value, F.lit(default))


def agencies(spark: SparkSession, path: str, default_tz: str = "UTC") -> DataFrame:
    own = raw(spark, path, "agency")
    return own.select(F.coalesce("agency_id", F.lit("")).alias("agency_id"), "agency_name", "agency_url", F.coalesce("agency_timezone", F.lit(default_tz)).alias("timezone"), "ticketing_deep_link_id", "position")


def stops(spark: SparkSession, path: str) -> DataFrame:
    """Entrances and nodes are dropped; coordinates are kept within the globe; unknown accessibility counts as accessible."""
    own = raw(spark, path, "stops").where(~_int("location_type", 0).isin(2, 3))
    bound = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))))
    return own.select("stop_id", "stop_name", "parent_station", "platform_code", "stop_code", "stop_desc", "stop_timezone", bound("stop_lat", 90.0).alias("lat"), bound("stop_lon", 180.0).alias("lng"), (_int("wheelchair_boarding", 0) != 2).alias("wheelchair"), F.lit(2).cast("long").alias("transfer_min"))


def transfers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transfer times (stop_id, minutes), footpaths (from_id, to_id, minutes) and seated links (from_trip, to_trip)."""
    own = raw(spark, path, "transfers").withColumn("type", _int("transfer_type", 0)).withColumn("minutes", F.floor(_int("min_transfer_time", 0) / 60)).where("type <> 3")
    seated = own.where("type = 4 and from_trip_id is not null and to_trip_id is not null").select(F.col("from_trip_id").alias("from_trip"), F.col("to_trip_id").alias("to_trip")).distinct()
    walks = own.where("type <> 4 and from_stop_id is not null and to_stop_id is not null")
    same = walks.where("from_stop_id = to_stop_id").groupBy(F.col("from_stop_id").alias("stop_id")).agg(F.min("minutes").alias("minutes"))
    other = walks.where("from_stop_id <> to_stop_id").groupBy(F.col("from_stop_id").alias("from_id"), F.col("to_stop_id").alias("to_id")).agg(F.min_by("minutes", "position").alias("minutes"))
    return same, other, seated


def routes(spark: SparkSession, path: str) -> DataFrame:
    own = raw(spark, path, "routes").withColumn("route_type", _int("route_type", -1))
    color, text = colors.corrected(colors.to_color(F.coalesce("route_color", F.lit(""))), colors.to_color(F.coalesce("route_text_color", F.lit(""))))
    return own.select("route_id", F.coalesce("agency_id", F.lit("")).alias("agency_id"), F.coalesce("route_short_name", "route_long_name").alias("name"), "route_type", classes.of_route_type(F.col("route_type")).alias("clasz"), color.alias("color"), text.alias("text_color"), "network_id", "ticketing_deep_link_id")


def service_days(spark: SparkSession, path: str, first: str, last: str, extend: bool = False) -> DataFrame:
    """(service_id, day) from the calendar and its exceptions; with extend, services that end with the feed go on."""
    from tramline.operators import calendar as ops

    own = raw(spark, path, "calendar")
    days = own.select("service_id", *(_int(d, 0).alias(d) for d in ops.WEEKDAYS), times.parse_date(F.col("start_date")).alias("start_date"), times.parse_date(F.col("end_date")).alias("end_date"))
    feed_end = None
    if extend:
        row = raw(spark, path, "feed_info").select(times.parse_date(F.col("feed_end_date")).alias("d")).first()
        feed_end = F.lit(row["d"]) if row and row["d"] else None
    exceptions = raw(spark, path, "calendar_dates").select("service_id", times.parse_date(F.col("date")).alias("day"), _int("exception_type", 2).alias("exception_type"), "position").where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return ops.with_exceptions(ops.expand(days, first, last, feed_end), exceptions)


def feed_info(spark: SparkSession, path: str) -> DataFrame:
    own = raw(spark, path, "feed_info")
    return own.select(times.parse_date(F.col("feed_end_date")).alias("feed_end"), F.coalesce(F.when(F.col("default_lang").isNotNull(), F.col("default_lang")), "feed_lang", F.lit("en")).alias("language"))


def trips(spark: SparkSession, path: str, known_routes: DataFrame, days: DataFrame) -> DataFrame:
    """Trips of known routes and services; a trip's own route type goes before the route's."""
    own = raw(spark, path, "trips").join(known_routes.select("route_id", "clasz", "agency_id"), "route_id").join(days.select("service_id").distinct(), "service_id", "left_semi")
    clasz = F.when(_int("trip_route_type").isNotNull(), classes.of_route_type(_int("trip_route_type"))).otherwise(F.col("clasz"))
    rail = clasz.isin(classes.REGIONAL, classes.SUBURBAN, classes.SUBWAY)
    bikes = F.when(_int("bikes_allowed") == 1, True).when(_int("bikes_allowed") == 2, False).otherwise(rail)
    return own.select("trip_id", "route_id", "service_id", "agency_id", clasz.alias("clasz"), F.coalesce("trip_headsign", F.lit("")).alias("headsign"), "trip_short_name", "block_id", "shape_id", _int("direction_id", 0).alias("direction_id"), bikes.alias("bikes"), (_int("cars_allowed", 0) == 1).alias("cars"), (_int("wheelchair_accessible", 0) != 2).alias("wheelchair"), "ticketing_trip_id")


def rejected_trips(spark: SparkSession, path: str, kept: DataFrame) -> DataFrame:
    return raw(spark, path, "trips").join(kept.select("trip_id"), "trip_id", "left_anti").select("trip_id", "route_id", "service_id")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(trip_id, start, end, headway) in minutes; headways are rounded and a minute at least."""
    own = raw(spark, path, "frequencies")
    return own.select("trip_id", times.hhmm_to_min(F.col("start_time")).alias("start"), times.hhmm_to_min(F.col("end_time")).alias("end"), F.greatest(F.round(_int("headway_secs", 60) / 60).cast("int"), F.lit(1)).alias("headway")).where("start is not null and end is not null")


def stop_times(spark: SparkSession, path: str, known_trips: DataFrame, known_stops: DataFrame) -> DataFrame:
    """Calls of known trips at stops, location groups or areas, in order of stop_sequence, with missing times filled in."""
    from tramline.operators.stop_times import interpolated

    own = raw(spark, path, "stop_times").join(known_trips.select("trip_id", F.col("wheelchair").alias("__w")), "trip_id").join(known_stops.select("stop_id", F.col("wheelchair").alias("__s")), "stop_id", "left")
    own = own.where("__s is not null or location_group_id is not null or location_id is not null")
    seq = (F.row_number().over(Window.partitionBy("trip_id").orderBy(_int("stop_sequence", 0), "position")) - 1).cast("long")
    into, out = _int("pickup_type", 0) != 1, _int("drop_off_type", 0) != 1
    rows = own.select("trip_id", "stop_id", "location_group_id", F.col("location_id").alias("area_id"), seq.alias("stop_seq"), _int("stop_sequence", 0).alias("gtfs_seq"), times.hhmm_to_min(F.col("arrival_time")).cast("long").alias("arr"), times.hhmm_to_min(F.col("departure_time")).cast("long").alias("dep"), into.alias("in_allowed"), out.alias("out_allowed"), (into & F.coalesce("__s", F.lit(True)) & F.col("__w")).alias("in_wheelchair"), (out & F.coalesce("__s", F.lit(True)) & F.col("__w")).alias("out_wheelchair"), "stop_headsign", F.expr("try_cast(shape_dist_traveled as double)").alias("travelled"), times.hhmm_to_min(F.col("start_pickup_drop_off_window")).alias("window_begin"), times.hhmm_to_min(F.col("end_pickup_drop_off_window")).alias("window_end"), "pickup_booking_rule_id", "drop_off_booking_rule_id")
    fixed = interpolated(rows.where("window_begin is null"))
    return fixed.unionByName(rows.where("window_begin is not null"))


def shapes(spark: SparkSession, path: str) -> DataFrame:
    own = raw(spark, path, "shapes")
    return own.select("shape_id", _int("shape_pt_sequence", 0).alias("sequence"), F.expr("try_cast(shape_pt_lat as double)").alias("lat"), F.expr("try_cast(shape_pt_lon as double)").alias("lng"), F.expr("try_cast(shape_dist_traveled as double)").alias("travelled"))


def translated(names: DataFrame, translations: DataFrame, table: str, field: str, key: str, value: str, language: str) -> DataFrame:
    """names with the texts (language, text) of value, the default first: by record, else by the field's value."""
    own = translations.where((F.col("table_name") == table) & (F.col("field_name") == field))
    by_key = own.where("record_id is not null").groupBy(F.col("record_id").alias(key)).agg(F.collect_list(F.struct("language", F.col("translation").alias("text"))).alias("__a"))
    by_value = own.where("record_id is null and field_value is not null").groupBy(F.col("field_value").alias(value)).agg(F.collect_list(F.struct("language", F.col("translation").alias("text"))).alias("__b"))
    first = F.array(F.struct(F.lit(language).alias("language"), F.col(value).alias("text")))
    return names.join(by_key, key, "left").join(by_value, value, "left").withColumn("texts", F.concat(first, F.coalesce("__a", "__b", F.expr("cast(array() as array<struct<language:string,text:string>>)")))).drop("__a", "__b")


def areas(spark: SparkSession, path: str) -> DataFrame:
    """(area_id, name, ring, holes) of the polygons in locations.geojson."""
    file = f"{path}/locations.geojson"
    if not exists(file):
        return spark.createDataFrame([], "area_id string, name string, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    schema = "features array<struct<id:string,properties:struct<stop_name:string,stop_desc:string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    own = spark.read.schema(schema).option("multiLine", True).json(str(file)).select(F.explode("features").alias("f")).where("f.geometry.type = 'Polygon'")
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return own.select(F.col("f.id").alias("area_id"), F.col("f.properties.stop_name").alias("name"), rings[0].alias("ring"), F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"))


def deep_links(spark: SparkSession, path: str, known_routes: DataFrame, known_agencies: DataFrame) -> DataFrame:
    """(route_id, web_url): a route's ticket link, else its agency's."""
    own = known_routes.join(known_agencies.select("agency_id", F.col("ticketing_deep_link_id").alias("__a")), "agency_id", "left").withColumn("ticketing_deep_link_id", F.coalesce("ticketing_deep_link_id", "__a"))
    return own.join(raw(spark, path, "ticketing_deep_links").drop("position"), "ticketing_deep_link_id").select("route_id", "web_url", "android_intent_uri", "ios_universal_link_url")


def read(spark: SparkSession, path: str, first: str = "2024-01-01", last: str = "2024-12-31", default_tz: str = "UTC", extend: bool = False) -> dict[str, DataFrame]:
    """All tables of a feed, with the days of its services in [first, last]. A folder without the files of a feed is an error."""
    if not applicable(path):
        raise FileNotFoundError(f"no feed in {path}")
    own_stops, own_routes, days = stops(spark, path), routes(spark, path), service_days(spark, path, first, last, extend)
    own_trips, own_agencies = trips(spark, path, own_routes, days), agencies(spark, path, default_tz)
    same, walks, seated = transfers(spark, path)
    own_stops = own_stops.join(same.withColumnRenamed("minutes", "__m"), "stop_id", "left").withColumn("transfer_min", F.coalesce("__m", "transfer_min")).drop("__m")
    tables = {"agencies": own_agencies, "stops": own_stops, "routes": own_routes, "service_days": days, "trips": own_trips, "stop_times": stop_times(spark, path, own_trips, own_stops), "footpaths": walks, "seated": seated, "frequencies": frequencies(spark, path), "shapes": shapes(spark, path), "areas": areas(spark, path), "deep_links": deep_links(spark, path, own_routes, own_agencies), "feed_info": feed_info(spark, path)}
    plain = ("translations", "stop_group_elements", "location_groups", "location_group_stops", "booking_rules", "fare_media", "rider_categories", "fare_products", "areas", "area_set_elements", "networks", "route_networks", "timeframes", "fare_leg_rules", "stop_areas", "fare_leg_join_rules", "fare_transfer_rules", "ticketing_identifiers")
    return tables | {("fare_areas" if n == "areas" else n): raw(spark, path, n) for n in plain}


def assistance(spark: SparkSession, file: str) -> DataFrame:
    """(name, lat, lng, day, begin, end) of opening hours such as 'Mo-Fr 08:00-18:00; Sa 09:00-12:00'; day 0 is Monday. Names of days may be ranges or lists."""
    own = spark.read.option("header", True).csv(file).select("name", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.explode(F.split("time", r"\s*;\s*")).alias("rule"))
    names = F.array(*map(F.lit, ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")))
    part = own.select("*", F.regexp_extract("rule", r"^\s*((?:[A-Z][a-z][-, ]*)*)", 1).alias("days"), F.regexp_extract("rule", r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})", 1).alias("b"), F.regexp_extract("rule", r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})", 2).alias("e")).where("b <> ''")
    each = part.select("*", F.explode(F.split(F.when(F.trim("days") == "", "Mo-Su").otherwise(F.trim("days")), r"\s*,\s*")).alias("span"))
    at = lambda i: F.array_position(names, F.substring(F.trim("span"), i, 2)) - 1
    low, high = at(1).cast("int"), F.when(F.contains("span", F.lit("-")), at(4)).otherwise(at(1)).cast("int")
    length = F.pmod(high - low, F.lit(7))
    return each.select("name", "lat", "lng", F.explode(F.transform(F.sequence(F.lit(0), length), lambda i: F.pmod(low + i, F.lit(7)))).alias("day"), times.hhmm_to_min(F.col("b")).alias("begin"), times.hhmm_to_min(F.col("e")).alias("end"))
