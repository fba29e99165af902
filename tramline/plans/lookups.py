"""Queries of filters, lookups and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.times import adjusted_transfer
from tramline.operators import areas, calendar, footpaths, matching, measures, rides, routes, skyline, stop_times
from tramline.plans.derived import Derived
from tramline.plans.registry import query


@query("trips", "SELECT trip_id, clasz::INTEGER AS clasz FROM trips WHERE ((1 << clasz::INTEGER) & 1058) <> 0")
def class_filter(d: Derived) -> DataFrame:
    return routes.in_class_mask(d.trips.select("trip_id", "clasz"), (1 << 1) | (1 << 5) | (1 << 10))


@query("events_on", "SELECT route_id, bool_and(bike_section) AS every, bool_or(bike_section) AS some FROM events_on GROUP BY route_id")
def route_flags(d: Derived) -> DataFrame:
    return routes.flags(d.events_on, "bike_section")


_ALIGHT = "a.trip_id = b.trip_id AND a.stop_seq < b.stop_seq AND a.in_allowed AND b.out_allowed AND a.location_id <> b.location_id"
_SUMMARY = "a.location_id AS from_id, b.location_id AS to_id, count(*) AS rides, min(b.arr - a.dep) AS shortest"


def _summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("from_id", "to_id").agg(F.count("*").alias("rides"), F.min(F.col("arr") - F.col("dep")).alias("shortest"))


@query("events_on", f"""c AS (SELECT *, coalesce(sum(CASE WHEN bike_section THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM events_on)
    SELECT {_SUMMARY} FROM c a JOIN c b ON {_ALIGHT} AND a.bad = b.bad GROUP BY 1, 2""")
def section_flag_rides(d: Derived) -> DataFrame:
    return _summary(rides.all_rides(d.events_on, "bike_section"))


@query("events_on", f"SELECT {_SUMMARY} FROM events_on a JOIN events_on b ON {_ALIGHT} GROUP BY 1, 2")
def ride_pairs(d: Derived) -> DataFrame:
    return _summary(rides.all_rides(d.events_on))


@query("stop_times service_days", "SELECT trip_id, location_id, dep::BIGINT AS dep FROM stop_times SEMI JOIN (SELECT trip_id FROM service_days WHERE day = 3) USING (trip_id)")
def active_transports(d: Derived) -> DataFrame:
    return d.stop_times.join(d.service_days.where("day = 3").select("trip_id"), "trip_id", "left_semi").select("trip_id", "location_id", "dep")


@query("events_on", "SELECT route_id, count(DISTINCT trip_id) AS trips, sum(CASE WHEN in_allowed AND out_allowed THEN 1 ELSE 0 END)::BIGINT AS both_ways, sum(CASE WHEN NOT in_allowed AND NOT out_allowed THEN 1 ELSE 0 END)::BIGINT AS neither FROM events_on GROUP BY 1")
def boarding_rules(d: Derived) -> DataFrame:
    """Stops where one may board and alight, and those that count as cancelled."""
    both, none = F.col("in_allowed") & F.col("out_allowed"), ~F.col("in_allowed") & ~F.col("out_allowed")
    return d.events_on.groupBy("route_id").agg(F.countDistinct("trip_id").alias("trips"), F.sum(both.cast("long")).alias("both_ways"), F.sum(none.cast("long")).alias("neither"))


@query("events_on", "SELECT trip_id, min(dep) AS begin, max(arr) AS until, greatest(min(dep), 600) AS clamped_begin, least(max(arr), 720) AS clamped_until FROM events_on GROUP BY trip_id HAVING min(dep) < 720 AND max(arr) > 600")
def interval_overlap(d: Derived) -> DataFrame:
    """Trips under way in [600, 720), and the part in it."""
    own = d.events_on.groupBy("trip_id").agg(F.min("dep").alias("begin"), F.max("arr").alias("until")).where("begin < 720 and until > 600")
    return own.select("trip_id", "begin", "until", F.greatest("begin", F.lit(600)).alias("clamped_begin"), F.least("until", F.lit(720)).alias("clamped_until"))


@query("locations", "SELECT location_id, (2 + greatest(4, trunc(transfer_min * 1.5)::INTEGER))::INTEGER AS minutes FROM locations")
def transfer_time(d: Derived) -> DataFrame:
    return d.locations.select("location_id", adjusted_transfer(F.col("transfer_min"), 4, 2, 1.5).alias("minutes"))


@query("locations", "SELECT location_id, coalesce(parent_id, location_id) AS root_id FROM locations")
def station_root(d: Derived) -> DataFrame:
    return routes.roots(d.locations)


@query("locations", "SELECT event_id, location_id, name, lat FROM events JOIN locations ON location_id = user_id AND src = user_id % 3")
def id_lookup(d: Derived) -> DataFrame:
    """By source and identifier."""
    own = d.table("events").select("event_id", F.col("user_id").alias("location_id"), (F.col("user_id") % 3).alias("src"))
    return own.join(d.locations, ["location_id", "src"]).select("event_id", "location_id", "name", "lat")


@query("events_on", "SELECT route_id, arg_max(trip_id, (n, -trip_id)) AS transport_id, max(n) AS stops FROM (SELECT route_id, trip_id, count(*) AS n FROM events_on GROUP BY 1, 2) GROUP BY 1")
def trip_reference(d: Derived) -> DataFrame:
    """The longest transport of each route, the first of equals."""
    parts = d.events_on.groupBy("route_id", "trip_id").agg(F.count("*").alias("last")).select(F.col("route_id").alias("trip_id"), F.col("trip_id").alias("transport_id"), F.lit(0).cast("long").alias("first"), "last")
    one = parts.groupBy("trip_id").agg(F.max_by(F.struct("transport_id", "last"), F.struct("last", -F.col("transport_id"))).alias("x"))
    return one.select(F.col("trip_id").alias("route_id"), "x.transport_id", F.col("x.last").alias("stops"))


_EQUAL = "eq AS (SELECT a.location_id AS f, b.location_id AS t FROM locations a JOIN locations b ON a.name = b.name AND a.location_id <> b.location_id), tree AS (SELECT location_id, coalesce(parent_id, location_id) AS root FROM locations)"
_FAMILY = _EQUAL + """, w AS (SELECT location_id AS asked FROM locations), fam AS (SELECT asked, b.location_id FROM w JOIN tree a ON a.location_id = asked JOIN tree b USING (root)),
    more AS (SELECT DISTINCT asked, c.location_id FROM fam JOIN eq ON f = fam.location_id JOIN tree b ON b.location_id = t JOIN tree c USING (root)), family AS (SELECT * FROM fam UNION SELECT * FROM more)"""


def _family(d: Derived) -> DataFrame:
    return matching.expand_classes(d.locations, d.locations, d.locations.select("location_id", F.col("name").alias("class")))


@query("locations", _FAMILY + " SELECT asked, location_id FROM family")
def match_equivalent(d: Derived) -> DataFrame:
    return _family(d)


@query("locations", "SELECT location_id AS asked, location_id FROM locations UNION SELECT p.location_id, c.location_id FROM locations c JOIN locations p ON c.parent_id = p.location_id")
def match_children(d: Derived) -> DataFrame:
    return matching.expand_locations(d.locations, d.locations, "children")


@query("events_on locations", _FAMILY + " SELECT trip_id, stop_seq, location_id FROM events_on WHERE location_id IN (SELECT location_id FROM family WHERE asked = 1)")
def match_semi(d: Derived) -> DataFrame:
    return d.events_on.join(_family(d).where("asked = 1").select("location_id"), "location_id", "left_semi").select("trip_id", "stop_seq", "location_id")


_ASKED = "asked AS (SELECT location_id AS query_id, location_id, 300 + location_id * 7 % 900 AS time FROM locations)"


def _asked(d: Derived) -> DataFrame:
    return d.locations.select(F.col("location_id").alias("query_id"), "location_id", (300 + F.col("location_id") * 7 % 900).alias("time"))


@query("events_on locations", _ASKED + """ SELECT query_id, route_id, x.dep AS dep, x.trip_id AS trip_id FROM (SELECT query_id, route_id, min({'dep': dep, 'trip_id': trip_id, 'stop_seq': stop_seq}) AS x FROM asked JOIN events_on USING (location_id) WHERE in_allowed AND dep >= time GROUP BY 1, 2)""")
def earliest_departure_asof(d: Derived) -> DataFrame:
    return matching.next_departures(_asked(d), d.events_on).select("query_id", "route_id", "dep", "trip_id")


@query("events_on locations", _ASKED + """ SELECT query_id, route_id, x.arr AS arr, x.trip_id AS trip_id FROM (SELECT query_id, route_id, max({'arr': arr, 'trip_id': trip_id, 'stop_seq': stop_seq}) AS x FROM asked JOIN events_on USING (location_id) WHERE out_allowed AND arr <= time GROUP BY 1, 2)""")
def latest_arrival_asof(d: Derived) -> DataFrame:
    return matching.last_arrivals(_asked(d), d.events_on).select("query_id", "route_id", "arr", "trip_id")


@query("events_on updates", """u AS (SELECT trip_id, ts // 60000000 % 1440 AS dep, max(delay) AS delay FROM updates GROUP BY 1, 2), o AS (SELECT DISTINCT trip_id, stop_seq, dep FROM events_on)
    SELECT o.trip_id, o.stop_seq, u.delay FROM o ASOF LEFT JOIN u ON o.trip_id = u.trip_id AND o.dep >= u.dep""")
def delay_as_of(d: Derived) -> DataFrame:
    """The last message of the trip by the time of day at which it calls."""
    known = d.updates.select("trip_id", (F.floor(F.col("ts") / 60000000) % 1440).alias("dep"), "delay")
    return matching.as_of(d.events_on.select("trip_id", "stop_seq", "dep"), known, ["trip_id"], "dep", ["delay"]).select("trip_id", "stop_seq", "delay")


@query("events_on footpaths", "SELECT to_id AS location_id, min(arr + minutes)::BIGINT AS time FROM events_on JOIN footpaths ON from_id = location_id WHERE out_allowed AND arr >= 480 GROUP BY 1")
def footpath_join(d: Derived) -> DataFrame:
    own = d.events_on.where("out_allowed and arr >= 480").join(d.footpaths, F.col("location_id") == F.col("from_id"))
    return own.groupBy(F.col("to_id").alias("location_id")).agg(F.min(F.col("arr") + F.col("minutes")).alias("time"))


_TD = "s AS (SELECT *, lead(valid_from) OVER (PARTITION BY from_id, to_id ORDER BY valid_from) AS until FROM steps), a AS (SELECT location_id AS k, 28401120 + location_id * 997 % 43200 AS time FROM locations), "
#: Of users who share an edge the last message of a minute counts.
_STEPS = "steps AS (SELECT from_id, to_id, valid_from, arg_max(duration, duration) AS duration, bool_and(blocked) AS blocked FROM td_edges GROUP BY 1, 2, 3), "


def _steps(d: Derived) -> DataFrame:
    return d.td_edges.groupBy("from_id", "to_id", "valid_from").agg(F.max("duration").alias("duration"), F.bool_and("blocked").alias("blocked"))


def _td_asked(d: Derived, at: str) -> DataFrame:
    return d.locations.select(F.col("location_id").alias("query_id"), F.col("location_id").alias(at), (28401120 + F.col("location_id") * 997 % 43200).alias("time"))


@query("td_edges locations", _STEPS + _TD + """r AS (SELECT k, to_id, time, arg_min(duration, valid_from) AS duration, min(valid_from) AS valid_from FROM a JOIN s ON s.from_id = k WHERE NOT blocked AND (until IS NULL OR until > time) AND valid_from - time <= 1440 GROUP BY 1, 2, 3)
    SELECT k AS from_id, to_id, greatest(valid_from, time) + duration - time AS minutes FROM r""")
def td_edge_fwd(d: Derived) -> DataFrame:
    return matching.td_forward(_td_asked(d, "from_id"), _steps(d)).select("from_id", "to_id", "minutes")


@query("td_edges locations", _STEPS + _TD + """r AS (SELECT k, from_id, time, valid_from, duration, CASE WHEN until IS NULL THEN time ELSE least(time, until - 1 + duration) END AS by_ FROM a JOIN s ON s.to_id = k WHERE NOT blocked AND valid_from + duration <= time)
    SELECT from_id, k AS to_id, arg_max(time - (by_ - duration), valid_from) AS minutes FROM r WHERE time - by_ <= 1440 GROUP BY from_id, k""")
def td_edge_bwd(d: Derived) -> DataFrame:
    return matching.td_backward(_td_asked(d, "to_id"), _steps(d)).select("from_id", "to_id", "minutes")


#: Stops of the start and of the destination of direct connections: two stations with their children.
_BOARD, _OFF = "location_id IN (1, 2, 3, 4, 5, 6, 7)", "location_id IN (11, 12, 13, 14, 15, 16, 17)"


@query("events_on", f"SELECT a.trip_id, a.location_id AS from_id, b.location_id AS to_id, a.dep, b.arr FROM events_on a JOIN events_on b ON {_ALIGHT}")
def direct_connections(d: Derived) -> DataFrame:
    own = d.events_on
    board = own.where("in_allowed").select("trip_id", F.col("stop_seq").alias("board_seq"))
    return rides.rides(own, board).select("trip_id", "from_id", "to_id", "dep", "arr")


@query("events_on", f"""m AS (SELECT *, {_BOARD} AND in_allowed AS b, {_OFF} AND out_allowed AS a FROM events_on), g AS (SELECT *, sum(a::INT) OVER (PARTITION BY trip_id ORDER BY stop_seq) AS done FROM m WHERE a OR b),
    x AS (SELECT trip_id, done, min(stop_seq) AS board_seq FROM g WHERE b GROUP BY 1, 2)
    SELECT g.trip_id, x.board_seq, g.stop_seq AS alight_seq FROM g JOIN x ON x.trip_id = g.trip_id AND x.done = g.done - 1 WHERE a""")
def direct_pairing(d: Derived) -> DataFrame:
    return rides.paired(d.events_on, d.locations.where(_BOARD), d.locations.where(_OFF)).select("trip_id", "board_seq", "alight_seq")


@query("events_on", f"SELECT a.trip_id, a.dep, b.arr, a.stop_seq AS board_seq, b.stop_seq AS alight_seq FROM events_on a JOIN events_on b ON {_ALIGHT} WHERE a.{_BOARD} AND b.{_OFF} AND a.dep >= 480 ORDER BY b.arr, a.dep DESC, a.trip_id, a.stop_seq, b.stop_seq LIMIT 20")
def first_arrivals(d: Derived) -> DataFrame:
    """The direct generators of all routes merged by arrival, the first 20."""
    own = d.events_on
    pairs = rides.rides(own, own.where(_BOARD).where("in_allowed and dep >= 480").select("trip_id", F.col("stop_seq").alias("board_seq"))).where(_OFF.replace("location_id", "to_id"))
    return rides.top(pairs, 20, [F.col("arr"), F.desc("dep"), "trip_id", "board_seq", "alight_seq"]).select("trip_id", "dep", "arr", "board_seq", "alight_seq")


@query("footpaths locations", """o AS (SELECT location_id, 1 + location_id % 9 AS m FROM locations WHERE location_id % 7 = 3), t AS (SELECT location_id, 2 AS m FROM locations WHERE location_id % 21 = 3),
    w AS (SELECT to_id AS location_id, min(m + minutes) AS m FROM o JOIN footpaths ON from_id = location_id GROUP BY 1)
    SELECT l.location_id, coalesce(t.m, o.m, w.m)::BIGINT AS minutes FROM locations l LEFT JOIN o USING (location_id) LEFT JOIN w USING (location_id) LEFT JOIN t USING (location_id) WHERE coalesce(t.m, o.m, w.m) IS NOT NULL""")
def access_egress(d: Derived) -> DataFrame:
    offsets = d.locations.where("location_id % 7 = 3").select("location_id", (1 + F.col("location_id") % 9).alias("minutes"))
    td = d.locations.where("location_id % 21 = 3").select("location_id", F.lit(2).cast("long").alias("minutes"))
    return matching.access(d.locations, offsets, d.footpaths, td)


_FAR = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query("locations", f"SELECT a.location_id AS a, b.location_id AS b, round({_FAR}, 3) AS metres FROM locations a, locations b WHERE a.location_id < b.location_id AND {_FAR} <= 2000")
def radius_join(d: Derived) -> DataFrame:
    own = d.locations.select("location_id", "lat", "lng")
    pairs = footpaths.within(own, own, 2000.0, values={"metres": F.round("metres", 3)}).where("a_location_id < b_location_id")
    return pairs.select(F.col("a_location_id").alias("a"), F.col("b_location_id").alias("b"), "metres")


@query("events_on", """m AS (SELECT trip_id AS message_id, location_id, dep + trip_id % 7 AS time FROM events_on),
    p AS (SELECT message_id, m.location_id, time, e.trip_id, max(230 - pow(abs(e.dep - time), 2)) AS points FROM m JOIN events_on e ON e.location_id = m.location_id AND abs(e.dep - time) <= 15 GROUP BY 1, 2, 3, 4),
    s AS (SELECT message_id, trip_id, sum(points) / (230.0 * any_value(n)) AS score FROM p JOIN (SELECT message_id, count(*) AS n FROM m GROUP BY 1) USING (message_id) GROUP BY 1, 2)
    SELECT message_id, trip_id, round(score, 6) AS score FROM s WHERE score >= 0.5 QUALIFY score >= max(score) OVER (PARTITION BY message_id) * 0.975""")
def fuzzy_run_match(d: Derived) -> DataFrame:
    own = d.events_on
    messages = own.select(F.col("trip_id").alias("message_id"), "location_id", (F.col("dep") + F.col("trip_id") % 7).alias("time"))
    return matching.likely_runs(messages, own).select("message_id", "trip_id", F.round("score", 6).alias("score"))


_CHANGES = """own AS (SELECT *, lag(location_id) OVER w AS before, lead(location_id) OVER w AS after FROM events_on WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq)),
    walk AS (SELECT location_id AS f, location_id AS t, transfer_min AS m FROM locations UNION ALL SELECT from_id, to_id, minutes FROM footpaths),
    c AS (SELECT a.trip_id AS from_trip, a.stop_seq AS from_seq, t, b.route_id, b.dep, b.trip_id, b.stop_seq, a.arr + m AS ready FROM own a JOIN walk ON f = a.location_id JOIN own b ON b.location_id = t AND b.dep >= a.arr + m AND b.dep - a.arr - m < 15
        WHERE a.out_allowed AND a.stop_seq > 0 AND b.in_allowed AND b.after IS NOT NULL AND a.trip_id <> b.trip_id {keep}),
    x AS (SELECT from_trip, from_seq, min({{'dep': dep, 'trip': trip_id, 'seq': stop_seq, 'ready': ready}}) AS x FROM c GROUP BY from_trip, from_seq, t, route_id)
    SELECT from_trip, from_seq, x.trip AS to_trip, x.seq AS to_seq, min(x.dep - x.ready)::BIGINT AS wait FROM x GROUP BY ALL"""


@query("events_on footpaths locations", _CHANGES.format(keep="AND a.before IS DISTINCT FROM b.after"))
def uturn_filter(d: Derived) -> DataFrame:
    return rides.transfers(d.events_on, d.locations, d.footpaths, 15)


@query("events_on footpaths locations", _CHANGES.format(keep=""))
def transfer_pairs(d: Derived) -> DataFrame:
    return rides.transfers(d.events_on, d.locations, d.footpaths, 15, uturns=True)


@query("events_on", """r AS (SELECT a.trip_id % 20 AS k, a.dep, b.arr, (a.trip_id % 4)::INTEGER AS transfers FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND a.stop_seq = 0 AND b.stop_seq > 0)
    SELECT DISTINCT k, dep, arr, transfers FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.k = a.k AND b.dep >= a.dep AND b.arr <= a.arr AND b.transfers <= a.transfers AND (b.dep > a.dep OR b.arr < a.arr OR b.transfers < a.transfers))""")
def pareto_skyline(d: Derived) -> DataFrame:
    own = d.events_on
    first = own.where("stop_seq = 0").select("trip_id", "dep")
    rows = own.where("stop_seq > 0").select("trip_id", "arr").join(first, "trip_id").select((F.col("trip_id") % 20).alias("k"), "dep", "arr", (F.col("trip_id") % 4).cast("int").alias("transfers"))
    return skyline.journeys(rows, ["k"])


@query("locations events_on service_days", """f AS (SELECT trip_id, arg_min(location_id, stop_seq) AS location_id FROM events_on GROUP BY 1), t AS (SELECT trip_id, src FROM f JOIN locations USING (location_id)),
    d AS (SELECT src, count(DISTINCT trip_id) AS trips, min(day)::BIGINT AS first_day, max(day)::BIGINT AS last_day, count(*) AS trip_days FROM t JOIN service_days USING (trip_id) GROUP BY 1)
    SELECT src, count(*) AS locations, coalesce(any_value(trips), 0) AS trips, any_value(first_day) AS first_day, any_value(last_day) AS last_day, coalesce(any_value(trip_days), 0) AS trip_days FROM locations LEFT JOIN d USING (src) GROUP BY src""")
def feed_metrics(d: Derived) -> DataFrame:
    return measures.feeds(d.locations, d.events_on, d.service_days)


@query("", "SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.99) AS q99 FROM events GROUP BY event_type")
def latency_quantiles(d: Derived) -> DataFrame:
    return measures.quantiles(d.table("events"), ["event_type"], "value")


@query("stop_times", """m AS (SELECT *, CASE WHEN bike_section IS NOT DISTINCT FROM lag(bike_section) OVER w THEN 0 ELSE 1 END AS new FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY trip_id ORDER BY stop_seq) AS run FROM m) SELECT trip_id, run::BIGINT AS run, min(stop_seq) AS first, max(stop_seq) AS last, any_value(bike_section) AS bike_section FROM g GROUP BY trip_id, run""")
def trip_sections(d: Derived) -> DataFrame:
    own = stop_times.ranges(d.stop_times, ["trip_id"], ["stop_seq"], "bike_section")
    return own.groupBy("trip_id", "run", "bike_section").agg(F.min("stop_seq").alias("first"), F.max("stop_seq").alias("last"))


@query("stop_times", "SELECT trip_id, stop_seq, location_id AS from_id, lead(location_id) OVER w AS to_id, dep::BIGINT AS dep, lead(arr::BIGINT) OVER w AS arr FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq) QUALIFY lead(location_id) OVER w IS NOT NULL")
def consecutive_stops(d: Derived) -> DataFrame:
    return stop_times.sections(d.stop_times)


@query("stop_times", "SELECT trip_id, stop_seq, location_id AS location_id_0, lead(location_id, 1) OVER w AS location_id_1, lead(location_id, 2) OVER w AS location_id_2, lead(location_id, 3) OVER w AS location_id_3, lead(location_id, 4) OVER w AS location_id_4 FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_seq) QUALIFY lead(stop_seq, 4) OVER w IS NOT NULL")
def five_legs(d: Derived) -> DataFrame:
    return stop_times.windowed(d.stop_times, "trip_id", "stop_seq", ["location_id"], 5)


_NOISY = "n AS (SELECT trip_id, stop_seq, (dep + (stop_seq * 7919 + trip_id) % 40 - 20)::BIGINT AS t FROM stop_times)"


def _noisy(d: Derived) -> DataFrame:
    return d.stop_times.select("trip_id", "stop_seq", (F.col("dep") + (F.col("stop_seq") * 7919 + F.col("trip_id")) % 40 - 20).alias("t"))


@query("stop_times", _NOISY + " SELECT trip_id, stop_seq, max(t) OVER (PARTITION BY trip_id ORDER BY stop_seq) AS t FROM n")
def monotone_forward(d: Derived) -> DataFrame:
    return stop_times.monotone_forward(_noisy(d), "t")


@query("stop_times", _NOISY + " SELECT trip_id, stop_seq, min(t) OVER (PARTITION BY trip_id ORDER BY stop_seq DESC) AS t FROM n")
def monotone_backward(d: Derived) -> DataFrame:
    return stop_times.monotone_backward(_noisy(d), "t")


@query("stop_times", "SELECT trip_id, stop_seq, coalesce(last_value(CASE WHEN (stop_seq + trip_id) % 3 = 0 THEN stop_seq + trip_id % 10 END IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY stop_seq), 0) AS delay FROM stop_times")
def delay_propagation(d: Derived) -> DataFrame:
    own = d.stop_times.select("trip_id", "stop_seq", F.when((F.col("stop_seq") + F.col("trip_id")) % 3 == 0, F.col("stop_seq") + F.col("trip_id") % 10).alias("delay"))
    return stop_times.propagated(own)


@query("events_on", """c AS (SELECT a.trip_id, a.stop_seq AS board_seq, b.stop_seq AS alight_seq, a.location_id AS from_id, b.location_id AS to_id, a.dep, b.arr FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND a.stop_seq < b.stop_seq AND a.in_allowed AND b.out_allowed AND a.location_id <> b.location_id),
    l AS (SELECT trip_id AS leg_id, trip_id, from_id, to_id, dep - 5 AS ready FROM c WHERE board_seq = 0 AND alight_seq = 1)
    SELECT leg_id, row_number() OVER (PARTITION BY leg_id ORDER BY c.arr, c.dep DESC, c.trip_id, board_seq, alight_seq) AS nth, c.trip_id, c.dep, c.arr FROM l JOIN c USING (from_id, to_id) WHERE c.dep >= ready AND c.trip_id <> l.trip_id
    QUALIFY row_number() OVER (PARTITION BY leg_id ORDER BY c.arr, c.dep DESC, c.trip_id, board_seq, alight_seq) <= 3""")
def top_alternatives(d: Derived) -> DataFrame:
    pairs = rides.all_rides(d.events_on)
    legs = pairs.where("board_seq = 0 and alight_seq = 1").select(F.col("trip_id").alias("leg_id"), "trip_id", "from_id", "to_id", (F.col("dep") - 5).alias("ready"))
    return rides.alternatives(legs, pairs, 3).select("leg_id", F.col("nth").cast("long").alias("nth"), "trip_id", "dep", "arr")


@query("events_on", """c AS (SELECT a.trip_id, a.location_id AS from_id, b.location_id AS to_id, a.dep, b.arr FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND b.stop_seq = a.stop_seq + 1 AND a.location_id <> b.location_id)
    SELECT trip_id, from_id, to_id, dep, arr FROM c QUALIFY arr - dep <= 1.5 * min(arr - dep) OVER (PARTITION BY from_id, to_id)""")
def slow_direct(d: Derived) -> DataFrame:
    own = stop_times.sections(d.events_on).where("from_id <> to_id").select("trip_id", "from_id", "to_id", "dep", "arr")
    return rides.slow(own, 1.5)


@query("locations footpaths", _EQUAL + ", w AS (SELECT location_id FROM locations WHERE location_id IN (2, 11)), m AS (SELECT b.location_id FROM w JOIN tree a USING (location_id) JOIN tree b USING (root)) SELECT location_id FROM m UNION SELECT to_id FROM m JOIN footpaths ON from_id = location_id")
def candidate_union(d: Derived) -> DataFrame:
    """Where one may begin who wants to start at two stops: their stations and what is on foot from there."""
    own = matching.expand_locations(d.locations.where("location_id in (2, 11)"), d.locations, "equivalent").select("location_id")
    return own.unionByName(own.join(d.footpaths, F.col("location_id") == F.col("from_id")).select(F.col("to_id").alias("location_id"))).distinct()


@query("events_on", f"SELECT route_id FROM events_on WHERE {_BOARD} AND in_allowed INTERSECT SELECT route_id FROM events_on WHERE {_OFF} AND out_allowed")
def route_intersection(d: Derived) -> DataFrame:
    own = d.events_on
    return own.where(_BOARD).where("in_allowed").select("route_id").intersect(own.where(_OFF).where("out_allowed").select("route_id"))


@query("service_days", """a AS (SELECT trip_id, day FROM service_days WHERE day < 9), b AS (SELECT trip_id, day FROM service_days WHERE (trip_id + day) % 2 = 0 AND day > 3)
    SELECT 'and' AS how, trip_id, day::BIGINT AS day FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'andnot', trip_id, day FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'or', trip_id, day FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def day_set_algebra(d: Derived) -> DataFrame:
    a, b = d.service_days.where("day < 9"), d.service_days.where("(trip_id + day) % 2 = 0 and day > 3")
    return calendar.combined(a, b, ("and", "andnot", "or")).select("how", "trip_id", "day")


@query("locations stop_times", "SELECT trip_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng FROM stop_times JOIN locations USING (location_id) GROUP BY 1")
def bounding_boxes(d: Derived) -> DataFrame:
    return areas.boxes(d.stop_times.join(d.locations, "location_id"), ["trip_id"])


@query("locations stop_times", "p AS (SELECT trip_id, list({'lat': lat, 'lng': lng} ORDER BY stop_seq) AS p FROM stop_times JOIN locations USING (location_id) GROUP BY 1) SELECT trip_id, len(p[2:4]) AS n, p[2].lat AS first_lat, p[least(4, len(p))].lng AS last_lng FROM p WHERE len(p) >= 2")
def shape_slice(d: Derived) -> DataFrame:
    """A trip's line is that of its stops; from its second to its fourth point."""
    shapes = areas.lines(d.stop_times.join(d.locations, "location_id").select(F.col("trip_id").alias("shape_id"), F.col("stop_seq").alias("sequence"), "lat", "lng"))
    ranges = shapes.where(F.size("points") >= 2).select("shape_id", F.lit(1).alias("first"), F.lit(3).alias("last"))
    return areas.sliced(shapes, ranges).select(F.col("shape_id").alias("trip_id"), F.size("points").cast("long").alias("n"), F.element_at("points", 1)["lat"].alias("first_lat"), F.element_at("points", -1)["lng"].alias("last_lng"))


@query("stop_times", """p AS (SELECT trip_id, stop_seq * 2 + i AS sequence, dep + i * 2 AS travelled FROM stop_times, (SELECT unnest([0, 1]) AS i)), n AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY sequence) - 1 AS o FROM p)
    SELECT s.trip_id, s.stop_seq, coalesce(min(o) FILTER (travelled >= arr), max(o)) AS "offset" FROM stop_times s JOIN n USING (trip_id) GROUP BY 1, 2""")
def shape_offsets(d: Derived) -> DataFrame:
    own = d.stop_times
    points = own.select(F.col("trip_id").alias("shape_id"), "dep", "stop_seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("shape_id", (F.col("stop_seq") * 2 + F.col("i")).alias("sequence"), (F.col("dep") + F.col("i") * 2).alias("travelled"))
    return areas.offsets_by_distance(own.select("trip_id", "stop_seq", F.col("trip_id").alias("shape_id"), F.col("arr").alias("travelled")), points)


@query()
def nearest_shape_points(d: Derived) -> DataFrame:
    """The line of a trip's stops with a point between each two; stops lie on it."""
    own = d.events_on.join(d.locations.select("location_id", "lat", "lng"), "location_id")
    points = own.select(F.col("trip_id").alias("shape_id"), "stop_seq", "lat", "lng", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select("shape_id", (F.col("stop_seq") * 2 + F.col("i")).alias("sequence"), (F.col("lat") + F.col("i") * 0.001).alias("lat"), "lng")
    return areas.nearest_offsets(own.select("trip_id", "stop_seq", F.col("trip_id").alias("shape_id"), "lat", "lng"), points)


@query("locations", """a AS (SELECT unnest(range(0, 12)) AS area_id), r AS (SELECT area_id, 8.00005 + area_id / 120.0 AS x0, 48.00005 + area_id % 5 / 50.0 AS y0 FROM a)
    SELECT area_id::BIGINT AS area_id, location_id FROM r JOIN locations ON lng > x0 AND lng < x0 + 0.04 AND lat > y0 AND lat < y0 + 0.03 AND NOT (lng > x0 + 0.01 AND lng < x0 + 0.02 AND lat > y0 + 0.01 AND lat < y0 + 0.02)""")
def point_in_polygon(d: Derived) -> DataFrame:
    """Twelve rectangles with a hole each; the ray test doesn't know that they are rectangles."""
    a = d.spark.range(12).select(F.col("id").alias("area_id"), (8.00005 + F.col("id") / 120.0).alias("x"), (48.00005 + F.col("id") % 5 / 50.0).alias("y"))

    def box(dx: float, dy: float, w: float, h: float):
        corner = lambda i, j: F.struct((F.col("x") + (dx + i * w)).alias("x"), (F.col("y") + (dy + j * h)).alias("y"))
        return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))

    return areas.inside(d.locations, a.select("area_id", box(0, 0, 0.04, 0.03).alias("ring"), F.array(box(0.01, 0.01, 0.01, 0.01)).alias("holes")))
