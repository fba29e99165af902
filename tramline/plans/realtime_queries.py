"""Queries of updates in real time, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.storage import written
from tramline.operators import realtime
from tramline.plans.derived import Derived
from tramline.plans.registry import query

_LATEST = "m AS (SELECT trip_id, stop_seq, arg_max(delay, (ts, event_id)) AS delay, arg_max(kind, (ts, event_id)) AS kind, max(ts) AS ts FROM updates GROUP BY 1, 2)"


def _latest(d: Derived) -> DataFrame:
    return realtime.latest(d.updates, ["trip_id", "stop_seq"])


@query("updates", _LATEST + " SELECT trip_id, stop_seq, delay, kind FROM m")
def event_feed_latest(d: Derived) -> DataFrame:
    """The last message of a stop counts, in whatever order they come."""
    return _latest(d).select("trip_id", "stop_seq", "delay", "kind")


_OVERLAY = _LATEST + """, gone AS (SELECT trip_id, bool_or(kind = 'purchase') AS gone FROM m GROUP BY 1),
    r AS (SELECT s.trip_id, s.stop_seq, s.location_id, s.arr, s.dep, s.in_allowed, s.out_allowed, gone, coalesce(kind = 'error', false) AS skipped,
        coalesce(last_value(CASE WHEN kind <> 'error' THEN delay END IGNORE NULLS) OVER (PARTITION BY s.trip_id ORDER BY s.stop_seq), 0) AS lag_ FROM events_on s JOIN gone USING (trip_id) LEFT JOIN m USING (trip_id, stop_seq)),
    t AS (SELECT *, arr + lag_ AS a, greatest(dep + lag_, arr + lag_) AS d, count(*) FILTER (NOT skipped) OVER (PARTITION BY trip_id) AS n FROM r),
    u AS (SELECT *, greatest(a, coalesce(max(d) OVER (PARTITION BY trip_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS a2 FROM t),
    o AS (SELECT trip_id, stop_seq, a2::BIGINT AS arr, max(greatest(d, a2)) OVER (PARTITION BY trip_id ORDER BY stop_seq)::BIGINT AS dep, gone OR n <= 1 AS cancelled, skipped, in_allowed, out_allowed FROM u)"""


def _overlay(d: Derived) -> DataFrame:
    own = _latest(d).select("trip_id", "stop_seq", "delay", (F.col("kind") == "error").alias("skipped"), (F.col("kind") == "purchase").alias("cancelled"))
    return realtime.overlay(d.events_on, own)


@query("events_on updates", _OVERLAY + " SELECT trip_id, stop_seq, arr, dep, in_allowed AND NOT skipped AND NOT cancelled AS in_allowed, cancelled FROM o")
def rt_overlay_events(d: Derived) -> DataFrame:
    return _overlay(d).select("trip_id", "stop_seq", "arr", "dep", "in_allowed", "cancelled")


@query("events_on updates", _OVERLAY + " SELECT trip_id, bool_or(cancelled) AS cancelled, count(*) AS stops FROM o GROUP BY trip_id")
def rt_cancel_rule(d: Derived) -> DataFrame:
    return _overlay(d).groupBy("trip_id").agg(F.bool_or("cancelled").alias("cancelled"), F.count("*").alias("stops"))


@query("events_on updates", _OVERLAY + " SELECT trip_id, stop_seq, dep FROM events_on ANTI JOIN o USING (trip_id) UNION ALL SELECT trip_id, stop_seq, dep FROM o WHERE NOT cancelled")
def rt_timetable(d: Derived) -> DataFrame:
    return realtime.applied(d.events_on, _overlay(d)).select("trip_id", "stop_seq", "dep")


@query("events_on updates", _OVERLAY + ", b AS (SELECT trip_id, stop_seq, o.arr - e.arr AS x, o.dep - e.dep AS y FROM o JOIN events_on e USING (trip_id, stop_seq)) SELECT trip_id, stop_seq, 'arr' AS event, x::BIGINT AS delay FROM b WHERE x <> 0 UNION ALL SELECT trip_id, stop_seq, 'dep', y FROM b WHERE y <> 0")
def rt_change_feed(d: Derived) -> DataFrame:
    return realtime.changes(d.events_on, _overlay(d))


@query("updates", "SELECT kind, count(*) AS messages, count(DISTINCT trip_id) AS trips, sum(CASE WHEN delay > 0 THEN 1 ELSE 0 END)::BIGINT AS late FROM updates GROUP BY kind")
def rt_statistics(d: Derived) -> DataFrame:
    return realtime.statistics(d.updates)


@query("stop_times locations", """x AS (SELECT trip_id, lat, lng, greatest((dep - lag(dep) OVER w) * 60, 60) AS sec, lag(lat) OVER w AS la, lag(lng) OVER w AS lo FROM stop_times JOIN locations USING (location_id) WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq)),
    v AS (SELECT trip_id, count(*) AS stops, max(CASE WHEN la IS NOT NULL THEN 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - lo) / 2), 2)))) / sec END) AS top FROM x GROUP BY 1)
    SELECT trip_id, stops FROM v WHERE stops >= 2 AND coalesce(top, 0) <= 20""")
def rt_added_speed_check(d: Derived) -> DataFrame:
    own = d.stop_times.select("trip_id", "stop_seq", "location_id", "arr", "dep")
    return realtime.plausible(own, d.locations, 20.0)


@query("updates stop_times locations", """p AS (SELECT event_id, trip_id, 48 + event_id % 97 / 1000.0::DOUBLE AS y, 8 + event_id % 89 / 1000.0::DOUBLE AS x, 400 + event_id % 600 AS minute FROM updates),
    n AS (SELECT event_id, trip_id, minute, min({'far': round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lng - x) / 2), 2)))), 3), 'stop_seq': stop_seq, 'arr': arr}) AS m
        FROM p JOIN stop_times USING (trip_id) JOIN locations USING (location_id) GROUP BY 1, 2, 3) SELECT event_id, trip_id, m.stop_seq AS stop_seq, (minute - m.arr)::BIGINT AS delay FROM n""")
def vehicle_positions(d: Derived) -> DataFrame:
    k = F.col("event_id")
    own = d.updates.select(k, "trip_id", (48 + k % 97 / F.lit(1000.0)).alias("lat"), (8 + k % 89 / F.lit(1000.0)).alias("lng"), (400 + k % 600).alias("minute"))
    return realtime.vehicle_delays(own, d.stop_times, d.locations)


@query("updates trips service_days", """u AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN trip_id END AS trip_id, trip_id % 50 AS route_id, (trip_id * 37) % 1200 + 1440 AS start_time, event_id % 14 AS day FROM updates), t AS (SELECT trip_id, route_id, (trip_id * 37) % 1200 AS s FROM trips),
    r AS (SELECT event_id, t.trip_id, u.day FROM u JOIN t USING (trip_id) UNION ALL SELECT event_id, t.trip_id, u.day FROM u JOIN t ON u.trip_id IS NULL AND t.route_id = u.route_id AND t.s % 1440 = u.start_time % 1440)
    SELECT event_id, trip_id, day FROM r SEMI JOIN service_days USING (trip_id, day)""")
def resolve_runs(d: Derived) -> DataFrame:
    k = F.col("event_id")
    own = d.updates.select("event_id", F.when(k % 3 != 0, F.col("trip_id")).alias("trip_id"), (F.col("trip_id") % 50).alias("route_id"), ((F.col("trip_id") * 37) % 1200 + 1440).alias("start_time"), (k % 14).alias("day"))
    trips = d.trips.select("trip_id", "route_id", ((F.col("trip_id") * 37) % 1200).alias("start_time"))
    return realtime.resolved(own, trips, d.service_days).select("event_id", "trip_id", "day")


#: Messages of a trip in order of their numbers; each names a stop by its number, or by its place, or both.
_MESSAGES = """n AS (SELECT count(*) AS stops FROM supplier),
    msg AS (SELECT event_id, trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY event_id) AS position, CASE WHEN event_id % 3 = 0 THEN stop_seq END AS seq, CASE WHEN event_id % 3 <> 0 THEN coalesce((SELECT location_id FROM stop_times s WHERE s.trip_id = u.trip_id AND s.stop_seq = u.stop_seq), event_id % (SELECT stops FROM n)) END AS loc,
        CASE WHEN event_id % 5 < 2 THEN delay - 5 END AS arr_delay, CASE WHEN event_id % 5 IN (1, 2) THEN delay END AS dep_delay, event_id % 5 = 3 AS timed, kind, delay FROM updates u),
    line AS (SELECT trip_id, stop_seq, location_id, arr::BIGINT AS arr, dep::BIGINT AS dep, in_allowed, out_allowed FROM stop_times),
    cell AS (SELECT DISTINCT trip_id, stop_seq AS cur FROM line UNION SELECT trip_id, max(stop_seq) + 1 FROM line GROUP BY 1),
    nm AS (SELECT m.trip_id, m.position, c.cur, min(s.stop_seq) AS hit FROM msg m JOIN cell c USING (trip_id) LEFT JOIN line s ON s.trip_id = m.trip_id AND s.stop_seq >= c.cur AND (s.stop_seq = m.seq OR s.location_id = m.loc) GROUP BY 1, 2, 3),
    walk AS (SELECT trip_id, 0::BIGINT AS position, 0::BIGINT AS cur, NULL::BIGINT AS hit FROM (SELECT DISTINCT trip_id FROM msg) UNION ALL SELECT w.trip_id, nm.position, coalesce(nm.hit + 1, w.cur), nm.hit FROM walk w JOIN nm ON nm.trip_id = w.trip_id AND nm.position = w.position + 1 AND nm.cur = w.cur),
    met AS (SELECT msg.*, hit AS stop_seq, l.arr + delay AS due FROM walk JOIN msg USING (trip_id, position) JOIN line l ON l.trip_id = walk.trip_id AND l.stop_seq = hit)"""


def _messages(d: Derived, stop_times: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("event_id")
    count = d.table("supplier").agg(F.count("*").alias("n"))
    named = stop_times.select("trip_id", "stop_seq", "location_id")
    own = d.updates.join(named, ["trip_id", "stop_seq"], "left").crossJoin(F.broadcast(count)).withColumn("position", F.row_number().over(Window.partitionBy("trip_id").orderBy("event_id")).cast("long"))
    return own.select(k, "trip_id", "position", F.when(k % 3 == 0, F.col("stop_seq")).alias("stop_seq"), F.when(k % 3 != 0, F.coalesce("location_id", k % F.col("n"))).alias("location_id"), F.when(k % 5 < 2, F.col("delay") - 5).alias("arr_delay"), F.when((k % 5).isin(1, 2), F.col("delay")).alias("dep_delay"), (k % 5 == 3).alias("timed"), "kind", "delay")


def _planned(d: Derived) -> DataFrame:
    """The stop times, which are read several times, sorted once."""
    return written(d.stop_times.drop("bike_section"), "stop_times")


@query("updates stop_times", "RECURSIVE " + _MESSAGES + " SELECT event_id, trip_id, stop_seq FROM met")
def rt_cursor(d: Derived) -> DataFrame:
    """Messages and the stops that they mean; what fits no stop behind the one before is dropped."""
    stops = _planned(d)
    return realtime.matched_stops(_messages(d, stops).select("event_id", "trip_id", "position", "stop_seq", "location_id"), stops).select("event_id", "trip_id", "stop_seq")


_RETIMED = _MESSAGES + """, per AS (SELECT trip_id, stop_seq, max(arr_delay) AS arr_delay, max(dep_delay) AS dep_delay, max(CASE WHEN timed THEN due END) AS arr_time FROM met GROUP BY 1, 2),
    base AS (SELECT l.*, max(l.stop_seq) OVER (PARTITION BY l.trip_id) AS last, lag(l.dep) OVER (PARTITION BY l.trip_id ORDER BY l.stop_seq) AS left_, arr_delay, dep_delay, arr_time FROM line l SEMI JOIN per p0 ON p0.trip_id = l.trip_id LEFT JOIN per p ON p.trip_id = l.trip_id AND p.stop_seq = l.stop_seq),
    ev AS (SELECT trip_id, 2 * stop_seq AS e, dep AS planned, CASE WHEN stop_seq = 0 AND dep_delay IS NULL THEN arr_delay ELSE dep_delay END AS late, CASE WHEN stop_seq = 0 AND dep_delay IS NULL THEN arr_time END AS time, CASE WHEN stop_seq > 0 THEN arr END AS before FROM base WHERE stop_seq < last OR last = 0
        UNION ALL SELECT trip_id, 2 * stop_seq - 1, arr, arr_delay, arr_time, left_ FROM base WHERE stop_seq > 0),
    go AS (SELECT trip_id, -1::BIGINT AS e, NULL::BIGINT AS att, NULL::BIGINT AS carried, NULL::BIGINT AS shown FROM (SELECT DISTINCT trip_id FROM ev)
        UNION ALL SELECT trip_id, e, coalesce(new, att), CASE WHEN late IS NOT NULL THEN late WHEN time IS NOT NULL THEN new - planned ELSE carried END, greatest(coalesce(new, planned), shown) FROM (
            SELECT g.trip_id, x.e, g.att, g.carried, g.shown, x.planned, x.late, x.time, CASE WHEN x.late IS NOT NULL THEN greatest(coalesce(g.att, x.before, -100000), x.planned + x.late) WHEN x.time IS NOT NULL THEN greatest(coalesce(g.att, x.before, -100000), x.time) WHEN g.att IS NOT NULL THEN greatest(g.att, x.planned + g.carried) END AS new
            FROM go g JOIN ev x ON x.trip_id = g.trip_id AND x.e = g.e + 1))"""


@query("updates stop_times", "RECURSIVE " + _RETIMED + " SELECT trip_id, e AS event, shown AS time FROM go WHERE e >= 0")
def rt_absolute(d: Derived) -> DataFrame:
    """Delays and absolute times of messages carried along their trips; event 2i is the departure of stop i, 2i - 1 its arrival."""
    stops = _planned(d)
    own = written(_messages(d, stops), "messages")
    found = realtime.matched_stops(own.select("event_id", "trip_id", "position", "stop_seq", "location_id"), stops)
    met = written(found.join(own.drop("stop_seq", "location_id", "position"), ["event_id", "trip_id"]).join(stops.select("trip_id", "stop_seq", "arr"), ["trip_id", "stop_seq"]), "matched")
    new = realtime.retimed(stops, met.select("trip_id", "stop_seq", "arr_delay", "dep_delay", F.when(F.col("timed"), F.col("arr") + F.col("delay")).alias("arr_time"), F.lit(None).cast("long").alias("dep_time")))
    last = stops.groupBy("trip_id").agg(F.max("stop_seq").alias("last"))
    rows = new.join(last, "trip_id").select("trip_id", "last", "stop_seq", F.explode(F.array(F.struct((2 * F.col("stop_seq")).alias("event"), F.col("dep").alias("time")), F.struct((2 * F.col("stop_seq") - 1).alias("event"), F.col("arr").alias("time")))).alias("x"))
    return rows.where("x.event >= 0 and (x.event < 2 * last or last = 0)").select("trip_id", "x.event", "x.time")


@query("updates stop_times locations", "RECURSIVE " + _RETIMED + """, pl AS (SELECT location_id, coalesce(parent_id, location_id) AS root FROM locations),
    marks AS (SELECT trip_id, stop_seq, bool_or(kind = 'error') AS skipped FROM met GROUP BY 1, 2), off AS (SELECT trip_id, bool_or(kind = 'purchase' AND delay > 17) AS gone FROM msg GROUP BY 1),
    rest AS (SELECT l.trip_id, l.stop_seq, l.location_id, coalesce(skipped, false) AS skipped, gone, l.in_allowed, count(*) FILTER (NOT coalesce(skipped, false) AND (l.in_allowed OR l.out_allowed)) OVER (PARTITION BY l.trip_id) AS n FROM line l JOIN off USING (trip_id) LEFT JOIN marks USING (trip_id, stop_seq))
    SELECT trip_id, stop_seq, CASE WHEN NOT skipped AND location_id % 5 = 1 AND EXISTS (SELECT 1 FROM met WHERE met.trip_id = rest.trip_id AND met.stop_seq = rest.stop_seq) AND location_id + 1 IN (SELECT location_id FROM pl) THEN location_id + 1 ELSE location_id END AS location_id, gone OR n <= 1 AS cancelled, in_allowed AND NOT skipped AND NOT (gone OR n <= 1) AS in_allowed FROM rest""")
def rt_skip_track_cancel(d: Derived) -> DataFrame:
    """What messages do to stops: skipped ones, tracks that change to the next stop of the station, and trips that are cancelled."""
    stops = _planned(d)
    own = written(_messages(d, stops), "messages")
    found = realtime.matched_stops(own.select("event_id", "trip_id", "position", "stop_seq", "location_id"), stops).select("event_id", "trip_id", F.col("at_id"))
    own = own.join(found, ["event_id", "trip_id"], "left")
    no = F.lit(None).cast("long")
    asked = own.select("event_id", "trip_id", "position", "stop_seq", "location_id", "arr_delay", "dep_delay", no.alias("arr_time"), no.alias("dep_time"), (F.col("kind") == "error").alias("skipped"), ((F.col("kind") == "purchase") & (F.col("delay") > 17)).alias("cancelled"), F.when(F.col("at_id") % 5 == 1, F.col("at_id") + 1).alias("assigned_id"))
    tree = d.locations.select("location_id", F.coalesce("parent_id", "location_id").alias("root"))
    same = tree.join(tree.withColumnRenamed("location_id", "other_id"), "root").where("location_id <> other_id").select("location_id", "other_id")
    return realtime.run_updates(stops, written(asked, "asked"), same).select("trip_id", "stop_seq", "location_id", "cancelled", "in_allowed")


_NEW = "x AS (SELECT trip_id, stop_seq, location_id + CASE WHEN trip_id % 11 = 0 AND stop_seq = 1 THEN 1000000 ELSE 0 END AS location_id, CASE WHEN stop_seq % 2 = 0 THEN arr::BIGINT END AS a, CASE WHEN trip_id % 13 <> 0 OR stop_seq > 0 THEN dep::BIGINT - trip_id % 3 END AS d FROM stop_times)"


@query("stop_times locations", _NEW + """, y AS (SELECT x.*, lat, lng, coalesce(d, a) AS t FROM x LEFT JOIN locations USING (location_id)),
    z AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS la, lag(lng) OVER w AS lo, max(greatest(a, d)) OVER (PARTITION BY trip_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM y WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq)),
    ok AS (SELECT trip_id FROM z GROUP BY 1 HAVING count(*) >= 2 AND count(lat) = count(*) AND count(t) = count(*)
        AND coalesce(max(CASE WHEN la IS NOT NULL THEN 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lng - lo) / 2), 2)))) / greatest((t - pt) * 60, 60) END), 0) <= 20)
    SELECT trip_id, stop_seq, coalesce(greatest(a, before), d) AS arr, greatest(d, coalesce(greatest(a, before), d)) AS dep FROM z SEMI JOIN ok USING (trip_id)""")
def rt_added(d: Derived) -> DataFrame:
    """All trips as added ones: some with a stop that no one knows, some times missing, some too fast."""
    t, s = F.col("trip_id"), F.col("stop_seq")
    own = d.stop_times.select("trip_id", F.col("stop_seq").alias("position"), (F.col("location_id") + F.when((t % 11 == 0) & (s == 1), 1_000_000).otherwise(0)).alias("location_id"), F.when(s % 2 == 0, F.col("arr")).alias("arr_time"), F.when((t % 13 != 0) | (s > 0), F.col("dep") - t % 3).alias("dep_time"), "in_allowed", "out_allowed")
    return realtime.added(own, d.locations, 20.0).select("trip_id", "stop_seq", "arr", "dep")


@query("stop_times updates", """b AS (SELECT trip_id, stop_seq, e AS event, (location_id % 12)::VARCHAR AS track FROM stop_times, (SELECT unnest(['arr', 'dep']) AS e)), o AS (SELECT trip_id, stop_seq, 'dep' AS event, max((delay)::VARCHAR || 'a') AS changed FROM updates WHERE kind = 'view' GROUP BY 1, 2)
    SELECT trip_id, stop_seq, event, coalesce(changed, track) AS track FROM b LEFT JOIN o USING (trip_id, stop_seq, event)""")
def rt_tracks(d: Derived) -> DataFrame:
    planned = d.stop_times.select("trip_id", "stop_seq", F.explode(F.array(F.lit("arr"), F.lit("dep"))).alias("event"), (F.col("location_id") % 12).cast("string").alias("track"))
    changed = d.updates.where("kind = 'view'").groupBy("trip_id", "stop_seq").agg(F.max(F.concat(F.col("delay").cast("string"), F.lit("a"))).alias("track")).withColumn("event", F.lit("dep"))
    return realtime.tracks(planned, changed)


@query("events_on updates footpaths locations", _OVERLAY + """, w AS (SELECT trip_id, stop_seq, location_id, arr, dep FROM events_on UNION ALL SELECT trip_id + 100000000, stop_seq, e.location_id, o.arr, o.dep FROM o JOIN events_on e USING (trip_id, stop_seq) WHERE NOT cancelled),
    ride AS (SELECT location_id AS f, lead(location_id) OVER x AS t, lead(arr) OVER x - dep AS m FROM w WINDOW x AS (PARTITION BY trip_id ORDER BY stop_seq)), k AS (SELECT f, t, m FROM ride WHERE t IS NOT NULL UNION ALL SELECT from_id, to_id, minutes FROM footpaths)
    SELECT coalesce(a.parent_id, a.location_id) AS from_id, coalesce(b.parent_id, b.location_id) AS to_id, min(m)::BIGINT AS minutes FROM k JOIN locations a ON a.location_id = f JOIN locations b ON b.location_id = t WHERE coalesce(a.parent_id, a.location_id) <> coalesce(b.parent_id, b.location_id) GROUP BY 1, 2""")
def rt_lower_bounds(d: Derived) -> DataFrame:
    from tramline.operators import routes

    return realtime.lower_bounds(d.events_on, _overlay(d), d.footpaths, routes.roots(d.locations))


@query("events_on updates locations", _OVERLAY + """ SELECT e.trip_id, e.stop_seq, name, coalesce(parent_id, location_id) AS station_id, last_value(name) OVER (PARTITION BY e.trip_id ORDER BY e.stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS direction, coalesce(o.arr, e.arr) AS arr, (coalesce(o.dep, e.dep) - e.dep)::BIGINT AS dep_delay, coalesce(cancelled, false) AS cancelled,
    CASE WHEN o.trip_id IS NULL THEN e.in_allowed ELSE o.in_allowed AND NOT skipped AND NOT cancelled END AS in_allowed, e.stop_seq = 0 AS is_first, e.stop_seq = max(e.stop_seq) OVER (PARTITION BY e.trip_id) AS is_last
    FROM events_on e LEFT JOIN o ON o.trip_id = e.trip_id AND o.stop_seq = e.stop_seq JOIN locations USING (location_id)""")
def run_stops(d: Derived) -> DataFrame:
    return realtime.run_stops(d.events_on, _overlay(d), d.locations).select("trip_id", "stop_seq", "name", "station_id", "direction", "arr", "dep_delay", "cancelled", "in_allowed", "is_first", "is_last")
