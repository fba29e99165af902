"""Queries of the load-time transforms: calendars, stop times, routes, footpaths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import colors
from tramline.operators import calendar, footpaths, graph, routes, stop_times
from tramline.plans.derived import FIRST_DAY, Derived
from tramline.plans.registry import query

_CALENDAR = "calendar AS (SELECT DISTINCT day_mask AS service_id, DATE '2024-01-01' + (day_mask % 5)::INTEGER AS start_date, DATE '2024-02-15' - (day_mask % 3)::INTEGER AS end_date FROM trips)"
_BASE = _CALENDAR + """, base AS (SELECT service_id, unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM calendar),
    running AS (SELECT service_id, day FROM base WHERE ((service_id >> (isodow(day) - 1)::INTEGER) & 1) = 1 AND day <= DATE '2024-01-31')"""


def _calendar(d: Derived) -> DataFrame:
    services = d.trips.select(F.col("day_mask").alias("service_id")).distinct()
    days = [F.shiftright("service_id", i).bitwiseAND(1).alias(n) for i, n in enumerate(calendar.WEEKDAYS)]
    start, end = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("service_id") % 5).cast("int")), F.date_sub(F.lit("2024-02-15").cast("date"), (F.col("service_id") % 3).cast("int"))
    return services.select("service_id", *days, start.alias("start_date"), end.alias("end_date"))


@query("trips", _BASE + " SELECT service_id, strftime(day, '%Y-%m-%d') AS day FROM running")
def calendar_expand(d: Derived) -> DataFrame:
    return calendar.expand(_calendar(d), FIRST_DAY, "2024-01-31").select("service_id", F.col("day").cast("string").alias("day"))


@query("trips", _BASE + """, exceptions AS (SELECT 1 + event_id % 127 AS service_id, ts::DATE AS day, arg_max(event_type = 'purchase', event_id) AS adds FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2)
    SELECT service_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT service_id, day FROM running WHERE (service_id, day) NOT IN (SELECT service_id, day FROM exceptions WHERE NOT adds)
        UNION SELECT service_id, day FROM exceptions WHERE adds)""")
def calendar_exceptions(d: Derived) -> DataFrame:
    own = d.table("events").where("event_type in ('purchase', 'error')").select((1 + F.col("event_id") % 127).alias("service_id"), F.to_date("ts").alias("day"), F.when(F.col("event_type") == "purchase", 1).otherwise(2).alias("exception_type"), F.col("event_id").alias("position"))
    return calendar.with_exceptions(calendar.expand(_calendar(d), FIRST_DAY, "2024-01-31"), own).select("service_id", F.col("day").cast("string").alias("day"))


@query("stop_times", """gaps AS (SELECT trip_id, stop_seq, count(*) OVER (PARTITION BY trip_id) AS n, CASE WHEN stop_seq % 3 <> 0 AND stop_seq <> max(stop_seq) OVER (PARTITION BY trip_id) THEN NULL ELSE arr END AS a,
        CASE WHEN stop_seq % 3 <> 0 AND stop_seq <> max(stop_seq) OVER (PARTITION BY trip_id) THEN NULL ELSE dep END AS d FROM stop_times),
    known AS (SELECT *, CASE WHEN d IS NOT NULL THEN stop_seq END AS k FROM gaps),
    sides AS (SELECT *, last_value(k IGNORE NULLS) OVER w1 AS i0, last_value(d IGNORE NULLS) OVER w1 AS t0, first_value(k IGNORE NULLS) OVER w2 AS i1, first_value(a IGNORE NULLS) OVER w2 AS t1 FROM known
        WINDOW w1 AS (PARTITION BY trip_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY trip_id ORDER BY stop_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT trip_id, stop_seq, coalesce(a, t0 + round((t1 - t0) * ((stop_seq - i0) / (i1 - i0))))::BIGINT AS arr, coalesce(d, t0 + round((t1 - t0) * ((stop_seq - i0) / (i1 - i0))))::BIGINT AS dep FROM sides""")
def interpolate_stop_times(d: Derived) -> DataFrame:
    from pyspark.sql import Window

    gap = (F.col("stop_seq") % 3 != 0) & (F.col("stop_seq") != F.max("stop_seq").over(Window.partitionBy("trip_id")))
    own = d.stop_times.withColumn("gap", gap).select("trip_id", "stop_seq", F.when(~F.col("gap"), F.col("arr")).alias("arr"), F.when(~F.col("gap"), F.col("dep")).alias("dep"))
    return stop_times.interpolated(own).select("trip_id", "stop_seq", "arr", "dep")


@query("stop_times", "SELECT trip_id, location_id, row_number() OVER (PARTITION BY trip_id ORDER BY stop_seq) - 1 AS stop_seq FROM (SELECT trip_id, location_id, stop_seq * 10 + trip_id % 7 AS stop_seq FROM stop_times)")
def resequence_stops(d: Derived) -> DataFrame:
    return stop_times.resequenced(d.stop_times.withColumn("stop_seq", F.col("stop_seq") * 10 + F.col("trip_id") % 7)).select("trip_id", "location_id", "stop_seq")


@query("trips", """f AS (SELECT trip_id, (trip_id * 37) % 1200 AS s, 60 + trip_id % 120 AS long, 10 + trip_id % 20 AS headway FROM trips)
    SELECT trip_id, i::BIGINT AS iteration, s + i * headway AS departure FROM (SELECT *, unnest(range(0, long // headway)) AS i FROM f)""")
def frequency_expand(d: Derived) -> DataFrame:
    start = (F.col("trip_id") * 37) % 1200
    own = d.trips.select("trip_id", start.alias("start"), (start + 60 + F.col("trip_id") % 120).alias("end"), (10 + F.col("trip_id") % 20).alias("headway"))
    return calendar.frequencies(own).select("trip_id", F.col("iteration").cast("long").alias("iteration"), F.col("offset").alias("departure"))


@query("events_on service_days", """SELECT s.trip_id, day::BIGINT AS day, stop_seq, (day * 1440 - CASE WHEN day >= 6 THEN 120 ELSE 60 END + arr)::BIGINT AS utc_arr, (day * 1440 - CASE WHEN day >= 6 THEN 120 ELSE 60 END + dep)::BIGINT AS utc_dep
    FROM events_on s JOIN service_days USING (trip_id)""")
def local_to_utc(d: Derived) -> DataFrame:
    """The calendar begins on 2024-03-25, six days before the clocks change."""
    return calendar.to_utc(d.events_on, d.service_days, "2024-03-25", "Europe/Berlin").select("trip_id", "day", "stop_seq", "utc_arr", "utc_dep")


@query("events_on", """k AS (SELECT trip_id, clasz, string_agg(concat(location_id, ':', in_allowed::INT, ':', out_allowed::INT), ',' ORDER BY stop_seq) AS s FROM events_on GROUP BY trip_id, clasz)
    SELECT trip_id, min(trip_id) OVER (PARTITION BY clasz, s) AS route FROM k""")
def route_grouping(d: Derived) -> DataFrame:
    from pyspark.sql import Window

    return routes.grouped(d.events_on).select("trip_id", F.min("trip_id").over(Window.partitionBy("route_key")).alias("route"))


@query()
def fifo_split(d: Derived) -> DataFrame:
    """Trips of one route number and number of stops count as one key, so that there is something to split."""
    own = d.events_on
    keys = own.groupBy("trip_id", "route_id").agg(F.count("*").alias("n")).select("trip_id", F.concat_ws("/", "route_id", "n").alias("route_key"))
    return routes.without_overtaking(own, keys)


@query("events_on service_days", """l AS (SELECT trip_id, route_id, max(arr) // 1440 AS more FROM events_on GROUP BY ALL)
    SELECT DISTINCT route_id, (day + unnest(range(0, more + 1)))::BIGINT AS day FROM l JOIN service_days USING (trip_id)""")
def route_active_days(d: Derived) -> DataFrame:
    return calendar.route_days(d.events_on, d.service_days)


@query("footpaths", """o AS (SELECT * FROM footpaths WHERE from_id < to_id OR from_id % 3 = 0)
    SELECT from_id, to_id, minutes FROM o UNION ALL SELECT to_id, from_id, minutes FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.from_id = a.to_id AND b.to_id = a.from_id)""")
def symmetric_footpaths(d: Derived) -> DataFrame:
    return footpaths.symmetric(d.footpaths.where("from_id < to_id or from_id % 3 = 0"))


_FAR = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query("locations", f"""p AS (SELECT a.location_id AS from_id, b.location_id AS to_id, a.transfer_min AS ta, b.transfer_min AS tb, {_FAR} AS m FROM locations a JOIN locations b ON a.src <> b.src)
    SELECT from_id, to_id, greatest(ta, tb, round(m / 90.0)::BIGINT) AS minutes, m < 500 AS equivalent FROM p WHERE m <= 1500""")
def nearby_links(d: Derived) -> DataFrame:
    return footpaths.linked(d.locations, 1500.0, 500.0)


@query("locations", f"""p AS (SELECT a.location_id AS from_id, b.location_id AS to_id, {_FAR} AS m FROM locations a JOIN locations b ON a.location_id <> b.location_id
        AND (a.name = b.name OR coalesce(a.parent_id, a.location_id) = coalesce(b.parent_id, b.location_id)))
    SELECT from_id, to_id, greatest(2, round(m / 90.0)::BIGINT) AS minutes FROM p WHERE m <= 5000""")
def same_place_footpaths(d: Derived) -> DataFrame:
    return footpaths.same_place(d.locations, 5000.0)


@query("locations", """t AS (SELECT location_id, parent_id, transfer_min FROM locations WHERE location_id % 2 = 1 AND parent_id IS NOT NULL)
    SELECT location_id AS from_id, parent_id AS to_id, transfer_min AS minutes FROM t UNION ALL SELECT parent_id, location_id, transfer_min FROM t
    UNION ALL SELECT a.location_id, b.location_id, a.transfer_min FROM t a JOIN t b ON a.parent_id = b.parent_id AND a.location_id <> b.location_id""")
def child_footpaths(d: Derived) -> DataFrame:
    return footpaths.to_children(d.locations.withColumn("generated", F.col("location_id") % 2 == 1))


_GRAPH = "g AS (SELECT from_id, to_id FROM footpaths WHERE NOT (abs(from_id - to_id) = 1 AND least(from_id, to_id) % 35 = 34))"


@query("footpaths", "RECURSIVE " + _GRAPH + """, r AS (SELECT from_id AS a, to_id AS b FROM g UNION SELECT r.a, g.to_id FROM r JOIN g ON r.b = g.from_id)
    SELECT a AS location_id, least(a, min(b)) AS component FROM r GROUP BY a""")
def footpath_components(d: Derived) -> DataFrame:
    return footpaths.groups(d.footpaths.where("not (abs(from_id - to_id) = 1 and least(from_id, to_id) % 35 = 34)"))


@query("footpaths locations", """RECURSIVE b AS (SELECT from_id, to_id, minutes FROM footpaths UNION SELECT to_id, from_id, minutes FROM footpaths),
    p AS (SELECT from_id, to_id, minutes FROM b WHERE minutes <= 12 UNION SELECT p.from_id, b.to_id, p.minutes + b.minutes FROM p JOIN b ON p.to_id = b.from_id WHERE p.minutes + b.minutes <= 12 AND p.from_id <> b.to_id)
    SELECT p.from_id, p.to_id, greatest(min(p.minutes), any_value(x.transfer_min), any_value(y.transfer_min)) AS minutes FROM p JOIN locations x ON x.location_id = p.from_id JOIN locations y ON y.location_id = p.to_id GROUP BY 1, 2""")
def footpath_closure(d: Derived) -> DataFrame:
    return footpaths.closed(d.footpaths, d.locations, 12)


@query("locations", """e AS (SELECT location_id // 50 AS group_id, location_id FROM locations)
    SELECT group_id, location_id FROM e UNION SELECT group_id, l.location_id FROM e JOIN locations l ON l.parent_id = e.location_id""")
def stop_group_members(d: Derived) -> DataFrame:
    own = d.locations.select(F.floor(F.col("location_id") / 50).alias("group_id"), "location_id")
    return footpaths.expand_groups(own, d.locations)


_EDGES = """ride AS (SELECT location_id AS f, lead(location_id) OVER w AS t, lead(arr) OVER w - dep AS m FROM events_on WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq)),
    e AS (SELECT f, t, m FROM ride WHERE t IS NOT NULL UNION ALL SELECT from_id, to_id, minutes FROM footpaths),
    lb AS (SELECT coalesce(a.parent_id, a.location_id) AS from_id, coalesce(b.parent_id, b.location_id) AS to_id, min(m)::BIGINT AS minutes FROM e JOIN locations a ON a.location_id = f JOIN locations b ON b.location_id = t GROUP BY 1, 2)"""


@query("events_on footpaths locations", _EDGES + " SELECT * FROM lb WHERE from_id <> to_id")
def lb_edges(d: Derived) -> DataFrame:
    return routes.lower_bound_edges(d.events_on, d.footpaths, routes.roots(d.locations))


@query("events_on footpaths locations", "RECURSIVE " + _EDGES + """, p AS (SELECT 0::BIGINT AS node, 0::BIGINT AS minutes UNION SELECT to_id, p.minutes + lb.minutes FROM p JOIN lb ON from_id = node AND from_id <> to_id WHERE p.minutes + lb.minutes <= 10)
    SELECT node, min(minutes) AS minutes FROM p GROUP BY node""")
def lower_bounds(d: Derived) -> DataFrame:
    edges = routes.lower_bound_edges(d.events_on, d.footpaths, routes.roots(d.locations))
    return graph.distances(edges, d.spark.createDataFrame([(0, 0)], "node long, minutes long"), limit=10)


@query("events_on service_days locations", """n AS (SELECT trip_id, count(*) AS n FROM service_days GROUP BY 1), c AS (SELECT DISTINCT trip_id, location_id, clasz FROM events_on)
    SELECT coalesce(parent_id, location_id) AS location_id, sum(n * CASE clasz WHEN 1 THEN 20 WHEN 5 THEN 16 WHEN 6 THEN 15 WHEN 9 THEN 3 ELSE 2 END)::BIGINT AS importance FROM c JOIN n USING (trip_id) JOIN locations USING (location_id) GROUP BY 1""")
def station_importance(d: Derived) -> DataFrame:
    return routes.importance(d.events_on, d.service_days, d.locations)


def _luminance_sql(c: str) -> str:
    part = lambda s: f"CASE WHEN (({c} >> {s}) & 255) / 255.0::DOUBLE <= 0.03928 THEN (({c} >> {s}) & 255) / 255.0::DOUBLE / 12.92 ELSE pow(((({c} >> {s}) & 255) / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
    return f"(0.2126 * {part(16)} + 0.7152 * {part(8)} + 0.0722 * {part(0)})"


@query("", f"""c AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 4278190080 + p_partkey * 7919 % 16777216 END AS a, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 4278190080 + p_partkey * 104729 % 16777216 END AS b FROM part),
    l AS (SELECT *, {_luminance_sql('a')} AS la, {_luminance_sql('b')} AS lb FROM c),
    x AS (SELECT *, (greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) AS r, CASE WHEN (la + 0.05) / 0.05 > 1.05 / (la + 0.05) THEN 4278190080 ELSE 4294967295 END AS for_a, CASE WHEN (lb + 0.05) / 0.05 > 1.05 / (lb + 0.05) THEN 4278190080 ELSE 4294967295 END AS for_b FROM l)
    SELECT p_partkey, CASE WHEN a = 0 AND b <> 0 THEN for_b ELSE a END::BIGINT AS color, CASE WHEN a <> 0 AND b = 0 THEN for_a WHEN a <> 0 AND b <> 0 AND r < 2 THEN for_a ELSE b END::BIGINT AS text_color FROM x""")
def color_contrast(d: Derived) -> DataFrame:
    k = F.col("p_partkey")
    own = d.table("part").select(k, F.when(k % 7 == 0, "").otherwise(F.lpad(F.hex(k * 7919 % 16777216), 6, "0")).alias("a"), F.when(k % 5 == 0, "").otherwise(F.lpad(F.hex(k * 104729 % 16777216), 6, "0")).alias("b"))
    color, text = colors.corrected(colors.to_color(F.col("a")), colors.to_color(F.col("b")))
    return own.select("p_partkey", color.alias("color"), text.alias("text_color"))


@query("events_on active service_days", """e AS (SELECT trip_id, arg_min(location_id, stop_seq) AS f, arg_max(location_id, stop_seq) AS t, arg_min(dep, stop_seq) AS d, arg_max(arr, stop_seq) AS a FROM events_on GROUP BY 1),
    r AS (SELECT block_id, day, trip_id AS first_trip, t, a, lead(trip_id) OVER w AS next_trip, lead(f) OVER w AS nf, lead(d) OVER w AS nd FROM e JOIN active USING (trip_id) JOIN service_days USING (trip_id) WINDOW w AS (PARTITION BY block_id, day ORDER BY d, trip_id))
    SELECT block_id, first_trip, next_trip, day::BIGINT AS day FROM r WHERE t = nf AND nd >= a""")
def block_chains(d: Derived) -> DataFrame:
    return routes.chained(d.events_on, d.active, d.service_days)


@query()
def seated_paths(d: Derived) -> DataFrame:
    """Links lead from a trip to those with twice its number, and one more, within blocks of 64."""
    at = F.col("trip_id") % 64
    low = F.when((at >= 1) & (at < 32), at * 2 + F.floor(F.col("trip_id") / 64) * 64)
    links = d.trips.select(F.col("trip_id").alias("from_trip"), low.alias("a")).where("a is not null").select("from_trip", F.explode(F.array("a", F.col("a") + 1)).alias("to_trip"))
    return routes.seated_paths(links, d.trips)


@query("events_on active service_days", """e AS (SELECT trip_id, string_agg(location_id // 5, ',' ORDER BY stop_seq) AS path, list(arr ORDER BY stop_seq) AS a, list(dep ORDER BY stop_seq) AS d FROM events_on GROUP BY trip_id),
    p AS (SELECT x.trip_id AS kept, y.trip_id AS dropped FROM e x JOIN e y ON x.path = y.path AND x.d[1] = y.d[1] AND x.trip_id < y.trip_id
        WHERE list_sum(list_transform(range(1, len(x.a) + 1), lambda i: abs(x.a[i] - y.a[i]) + abs(x.d[i] - y.d[i]))) < len(x.a))
    SELECT kept, dropped, s.day::BIGINT AS day FROM p JOIN service_days s ON s.trip_id = kept JOIN service_days t ON t.trip_id = dropped AND s.day = t.day""")
def duplicate_trips(d: Derived) -> DataFrame:
    equal = d.locations.select("location_id", F.floor(F.col("location_id") / 5).alias("group_id"))
    return routes.duplicates(d.events_on, d.service_days, equal).select("kept", "dropped", "day")


@query("events_on", """p AS (SELECT a.trip_id AS first_trip, b.trip_id AS next_trip FROM (SELECT trip_id, arg_max(location_id, stop_seq) AS t, max(arr) AS a FROM events_on GROUP BY 1) a
        JOIN (SELECT trip_id, arg_min(location_id, stop_seq) AS f, min(dep) AS d FROM events_on GROUP BY 1) b ON t = f AND d BETWEEN a AND a + 2 AND a.trip_id <> b.trip_id),
    u AS (SELECT first_trip, next_trip, 0 AS part, s.* FROM p JOIN events_on s ON s.trip_id = first_trip UNION ALL SELECT first_trip, next_trip, 1, s.* FROM p JOIN events_on s ON s.trip_id = next_trip),
    l AS (SELECT *, lead(part) OVER w > part AS met, lead(dep) OVER w AS nd, lead(in_allowed) OVER w AS ni FROM u WINDOW w AS (PARTITION BY first_trip, next_trip ORDER BY part, stop_seq))
    SELECT first_trip, next_trip, location_id, arr, CASE WHEN met THEN nd ELSE dep END AS dep, CASE WHEN met THEN ni ELSE in_allowed END AS in_allowed, out_allowed,
        row_number() OVER (PARTITION BY first_trip, next_trip ORDER BY part, stop_seq) - 1 AS position FROM l WHERE NOT (part = 1 AND stop_seq = 0)""")
def seated_seam(d: Derived) -> DataFrame:
    own = d.events_on
    ends = own.groupBy("trip_id").agg(F.max_by("location_id", "stop_seq").alias("at_id"), F.max("arr").alias("a")).withColumnRenamed("trip_id", "first_trip")
    begins = own.groupBy("trip_id").agg(F.min_by("location_id", "stop_seq").alias("at_id"), F.min("dep").alias("d")).withColumnRenamed("trip_id", "next_trip")
    pairs = ends.join(begins, "at_id").where("d between a and a + 2 and first_trip <> next_trip").select("first_trip", "next_trip")
    return routes.seam(own, pairs).withColumn("position", F.col("position").cast("long"))


