"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import classes, colors, geo, times
from tramline.plans.derived import Derived
from tramline.plans.registry import query


@query("", """t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat(p_partkey % 30, ':', lpad((p_partkey % 60)::VARCHAR, 2, '0')) WHEN 2 THEN concat(lpad((p_partkey % 30)::VARCHAR, 2, '0'), ':', lpad((p_partkey % 60)::VARCHAR, 2, '0'), ':59') WHEN 3 THEN 'x:10' ELSE concat(' ', 24 + p_partkey % 5, ':00:00 ') END AS s FROM part)
    SELECT p_partkey, CASE WHEN regexp_full_match(trim(s), '[0-9]{1,3}:[0-9]{1,2}(:[0-9]{1,2})?') THEN (split_part(trim(s), ':', 1)::INTEGER * 60 + split_part(trim(s), ':', 2)::INTEGER) END AS minutes FROM t""")
def hhmm_parse(d: Derived) -> DataFrame:
    k = F.col("p_partkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat((k % 30).cast("string"), F.lit(":"), two(k % 60))).when(k % 5 == 2, F.concat(two(k % 30), F.lit(":"), two(k % 60), F.lit(":59"))).when(k % 5 == 3, "x:10").otherwise(F.concat(F.lit(" "), (24 + k % 5).cast("string"), F.lit(":00:00 ")))
    return d.table("part").select("p_partkey", times.hhmm_to_min(s).alias("minutes"))


@query("", """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN DATE '2024-05-01' ELSE DATE '2024-05-01' - (o_orderkey % 90)::INTEGER END, '%Y-%m-%d') AS day FROM orders""")
def parse_dates(d: Derived) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 2, "TODAY").otherwise(F.concat(F.lit("-"), (k % 90).cast("string")))
    return d.table("orders").select("o_orderkey", times.parse_date(text, F.lit("2024-05-01").cast("date")).cast("string").alias("day"))


@query("", """p AS (SELECT p_partkey, p_partkey * 7 % 1440 AS a, p_partkey * 13 % 1440 AS b FROM part)
    SELECT p_partkey, CASE WHEN abs(a - b) > 720 THEN 1440 - abs(a - b) ELSE abs(a - b) END AS minutes, (CASE WHEN abs(a - b) <= 720 THEN 0 WHEN a < b THEN -1 ELSE 1 END)::INTEGER AS shift FROM p""")
def cyclic_minute_distance(d: Derived) -> DataFrame:
    minutes, shift = times.mam_distance(F.col("p_partkey") * 7 % 1440, F.col("p_partkey") * 13 % 1440)
    return d.table("part").select("p_partkey", minutes.alias("minutes"), shift.alias("shift"))


@query("stop_times", "SELECT trip_id, stop_seq, floor((dep - 700) / 1440)::BIGINT AS day, (dep - 700 - floor((dep - 700) / 1440) * 1440)::BIGINT AS mam FROM stop_times")
def day_and_minute(d: Derived) -> DataFrame:
    day, mam = times.split_minutes(F.col("dep") - 700)
    return d.stop_times.select("trip_id", "stop_seq", day.alias("day"), mam.alias("mam"))


@query("service_days", "SELECT trip_id, string_agg(day::VARCHAR, ', ' ORDER BY day) AS days FROM (SELECT DISTINCT trip_id, day FROM service_days) GROUP BY trip_id")
def day_list(d: Derived) -> DataFrame:
    return d.service_days.groupBy("trip_id").agg(F.collect_list("day").alias("days")).select("trip_id", times.day_list(F.col("days")).alias("days"))


@query("", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'de ' || p_name WHEN p_partkey % 3 = 0 THEN 'fr ' || p_name ELSE p_name END AS name FROM part")
def translation_fallback(d: Derived) -> DataFrame:
    """German, else French, else the default; every second part has German and every third French."""
    one = lambda lang, when: F.when(when, F.struct(F.lit(lang).alias("language"), F.concat(F.lit(lang + " "), "p_name").alias("text")))
    texts = F.array_compact(F.array(F.struct(F.lit("en").alias("language"), F.col("p_name").alias("text")), one("fr", F.col("p_partkey") % 3 == 0), one("de", F.col("p_partkey") % 2 == 0)))
    return d.table("part").select("p_partkey", texts.alias("texts")).select("p_partkey", classes.translated(F.col("texts"), ["de", "fr"]).alias("name"))


@query("", f"SELECT p_partkey, ({classes.route_type_sql('(p_partkey * 17 % 1800)')})::INTEGER AS clasz FROM part")
def route_type_class(d: Derived) -> DataFrame:
    return d.table("part").select("p_partkey", classes.of_route_type(F.col("p_partkey") * 17 % 1800).alias("clasz"))


_NAMES = ("ICE 5", "IC", "NJ", "re 7", "S1", "U", "Str", "Bus", "??", "FUN")


@query("", "SELECT p_partkey, ([1, 2, 4, 5, 7, 8, 9, 10, 15, 13][(p_partkey % 10 + 1)::INTEGER])::INTEGER AS clasz FROM part")
def category_class(d: Derived) -> DataFrame:
    return d.table("part").select("p_partkey", classes.of_category(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int"))).alias("clasz"))


@query("", "SELECT p_partkey, ([100, 101, 102, 900, 700, 1700][(p_partkey % 6 + 1)::INTEGER])::INTEGER AS route_type FROM part")
def mode_route_type(d: Derived) -> DataFrame:
    pairs = (("rail", None), ("rail", "highSpeedRail"), ("rail", "intercityRail"), ("tram", "x"), ("bus", None), ("submarine", None))
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]).cast("string") for p in pairs)), at)
    return d.table("part").select("p_partkey", classes.route_type_of_mode(pick(0), pick(1)).alias("route_type"))


@query("", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE printf('%06X', p_partkey * 7919 % 16777216) END AS text FROM part")
def color_round_trip(d: Derived) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "zz").otherwise(F.lpad(F.hex(k * 7919 % 16777216), 6, "0"))
    return d.table("part").select("p_partkey", colors.to_text(colors.to_color(text)).alias("text"))


@query("locations", "SELECT location_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(48.05 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.05)) * pow(sin(radians(8.05 - lng) / 2), 2)))), 2) AS metres FROM locations")
def distance_to_point(d: Derived) -> DataFrame:
    return d.locations.select("location_id", F.round(geo.haversine_m(F.col("lat"), F.col("lng"), F.lit(48.05), F.lit(8.05)), 2).alias("metres"))


@query("stop_times", "SELECT trip_id, stop_seq, (dep - CASE WHEN dep >= 600 AND dep < 900 THEN 120 ELSE 60 END)::BIGINT AS utc FROM stop_times")
def season_time(d: Derived) -> DataFrame:
    """A zone that is an hour further from minute 600 to 900."""
    offset = times.season_offset(F.col("dep"), F.lit(60), F.lit(600), F.lit(900), F.lit(120))
    return d.stop_times.select("trip_id", "stop_seq", (F.col("dep") - offset).alias("utc"))


@query("locations", "SELECT '{\"features\":[{\"id\":' || location_id || ',\"lat\":' || printf('%.4f', lat) || '}]}' AS json, location_id FROM locations")
def geojson_writer(d: Derived) -> DataFrame:
    return d.locations.select(F.to_json(F.struct(F.array(F.struct(F.col("location_id").alias("id"), F.round("lat", 4).cast("decimal(10,4)").alias("lat"))).alias("features"))).alias("json"), "location_id")
