"""Queries of profiles, of what is done around a search, of the trip-based search, and of orders in which tables are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.storage import sorted_index, written
from tramline.operators import assistance, footpaths, journeys, matching, requests, rides, routes, stop_times, trip_based
from tramline.plans.derived import Derived
from tramline.plans.journey_queries import _TABLES, BEGIN, START, _rounds_sql, _search, _start
from tramline.plans.lookups import _CHANGES
from tramline.plans.registry import query


@query("locations", "SELECT location_id, location_id - location_id % 6 AS root_id FROM locations")
def station_root_chain(d: Derived) -> DataFrame:
    """Chains of six: each stop's parent is the one before it."""
    k = F.col("location_id")
    return routes.roots(d.locations.select(k, F.when(k % 6 != 0, k - 1).alias("parent_id")))


_BIKES = "own AS (SELECT e.*, coalesce(sum(CASE WHEN bike_section THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM events_on e JOIN (SELECT trip_id FROM trips WHERE bikes) USING (trip_id)), "


@query(_TABLES + " trips", _BIKES + _rounds_sql(2, events="own", part="bad") + " SELECT l AS location_id, t AS arr FROM arr_2")
def bike_rounds(d: Derived) -> DataFrame:
    """Only trips that take bikes, and on them only sections that do."""
    events = d.events_on.join(d.trips.select("trip_id", "bikes"), "trip_id")
    search = journeys.Search(events, d.locations, d.footpaths, require=("bikes",), section_flag="bike_section")
    return journeys.one_to_all(journeys.rounds(search, _start(d), 2)).select("location_id", "arr")


_CHAIRS = "own AS (SELECT e.* REPLACE (in_allowed AND wheelchair AND location_id % 7 <> 3 AS in_allowed, out_allowed AND wheelchair AND location_id % 7 <> 5 AS out_allowed) FROM events_on e JOIN (SELECT trip_id, wheelchair FROM trips) USING (trip_id)), "


@query(_TABLES + " trips", _CHAIRS + _rounds_sql(2, events="own") + " SELECT l AS location_id, t AS arr FROM arr_2")
def wheelchair_rounds(d: Derived) -> DataFrame:
    events = d.events_on.join(d.trips.select("trip_id", "wheelchair"), "trip_id").withColumns({"in_wheelchair": F.col("wheelchair") & (F.col("location_id") % 7 != 3), "out_wheelchair": F.col("wheelchair") & (F.col("location_id") % 7 != 5)})
    search = journeys.Search(events, d.locations, d.footpaths, wheelchair=True)
    return journeys.one_to_all(journeys.rounds(search, _start(d), 2)).select("location_id", "arr")


def _counted(k: int) -> str:
    return f"SELECT {k} AS round, count(CASE WHEN ft IS NULL OR rt <= ft THEN 1 END) AS by_ride, count(CASE WHEN rt IS NULL OR ft < rt THEN 1 END) AS by_walk FROM (SELECT coalesce(o.l, f.l) AS l, o.t AS rt, f.t AS ft FROM off_{k} o FULL JOIN foot_{k} f ON o.l = f.l) x LEFT JOIN best_{k - 1} b ON b.l = x.l WHERE b.t IS NULL OR least(coalesce(rt, 999999), coalesce(ft, 999999)) < b.t"


@query(_TABLES, _rounds_sql(3) + " " + " UNION ALL ".join(_counted(k) for k in (1, 2, 3)))
def search_counters(d: Derived) -> DataFrame:
    return requests.counters(journeys.rounds(_search(d), _start(d), 3)).select("round", "by_ride", "by_walk")


_HEAD, _TAIL = _CHANGES.format(keep="").rsplit("\n    SELECT", 1)


@query("events_on footpaths locations", f"""{_HEAD}, ch AS (SELECT{_TAIL}), s0 AS (SELECT trip_id, min(stop_seq) AS s FROM events_on WHERE location_id = {START} AND dep >= {BEGIN} AND dep - {BEGIN} <= 1440 AND in_allowed GROUP BY 1),
    s1 AS (SELECT to_trip AS trip_id, min(to_seq) AS s FROM s0 JOIN ch ON from_trip = trip_id AND from_seq > s GROUP BY 1), s2 AS (SELECT to_trip AS trip_id, min(to_seq) AS s FROM s1 JOIN ch ON from_trip = trip_id AND from_seq > s GROUP BY 1),
    u AS (SELECT k AS transfers, location_id, min(arr)::BIGINT AS arr FROM (SELECT 0 AS k, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2) JOIN events_on USING (trip_id) WHERE stop_seq > s AND out_allowed GROUP BY 1, 2)
    SELECT * FROM u QUALIFY arr < coalesce(min(arr) OVER (PARTITION BY location_id ORDER BY transfers ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999999)""")
def trip_based_rounds(d: Derived) -> DataFrame:
    """Over the table of transfer_pairs: changes to the next departure of each route within a quarter of an hour."""
    changes = written(rides.transfers(d.events_on, d.locations, d.footpaths, 15, uturns=True), "changes")
    return trip_based.search(d.events_on, changes, _start(d), most=3).select("transfers", "location_id", "arr")


@query("events_on", """r AS (SELECT a.route_id AS k, a.dep, b.arr, (a.trip_id % 4)::INTEGER AS transfers FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND a.stop_seq = 0 AND b.stop_seq = 1)
    SELECT DISTINCT k, dep, arr, transfers, dense_rank() OVER (PARTITION BY k ORDER BY dep, transfers, arr) AS nth FROM r""")
def result_order(d: Derived) -> DataFrame:
    """Journeys of each query by departure and transfers."""
    own = d.events_on
    first = own.where("stop_seq = 0").select("trip_id", F.col("route_id").alias("k"), "dep")
    rows = first.join(own.where("stop_seq = 1").select("trip_id", "arr"), "trip_id").select("k", "dep", "arr", (F.col("trip_id") % 4).cast("int").alias("transfers")).distinct()
    return requests.ordered(rows, ["k"])


@query("footpaths", "SELECT from_id, to_id, minutes, row_number() OVER (PARTITION BY from_id ORDER BY minutes, to_id) AS nth FROM footpaths")
def footpaths_by_duration(d: Derived) -> DataFrame:
    return footpaths.by_duration(d.footpaths)


_SEQ = "CASE WHEN trip_id % 4 = 0 THEN stop_seq WHEN trip_id % 4 = 1 THEN stop_seq + 1 WHEN trip_id % 4 = 2 THEN 10 * stop_seq + 10 ELSE stop_seq * stop_seq + 5 END"


@query("stop_times", f"""n AS (SELECT trip_id, list(({_SEQ})::BIGINT ORDER BY stop_seq) AS l FROM stop_times GROUP BY 1), k AS (SELECT *, CASE WHEN l = range(0, len(l)) THEN 'zero' WHEN l = range(1, len(l) + 1) THEN 'one' WHEN l = range(10, 10 * len(l) + 1, 10) THEN 'ten' ELSE 'exact' END AS kind FROM n)
    SELECT trip_id, kind, array_to_string(CASE kind WHEN 'zero' THEN [] WHEN 'exact' THEN l ELSE l[1:1] END, ',') AS numbers FROM k""")
def stop_numbering(d: Derived) -> DataFrame:
    own = d.stop_times.select("trip_id", F.expr(_SEQ).alias("gtfs_seq"))
    return stop_times.numbering(own).select("trip_id", "kind", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


@query("trips", "SELECT trip_id % 3 AS src, trip_id, route_id FROM trips")
def trip_index(d: Derived) -> DataFrame:
    """Trips in ranges of source and identifier, sorted in each."""
    return sorted_index(d.trips.select((F.col("trip_id") % 3).alias("src"), "trip_id", "route_id"), ["src", "trip_id"])


@query("events_on service_days", """e AS (SELECT trip_id, string_agg(location_id // 20, ',' ORDER BY stop_seq) AS path, list(arr ORDER BY stop_seq) AS a, list(dep ORDER BY stop_seq) AS d FROM events_on GROUP BY trip_id),
    p AS (SELECT x.trip_id AS kept, y.trip_id AS dropped FROM e x JOIN e y ON x.path = y.path AND x.d[1] = y.d[1] AND x.trip_id < y.trip_id WHERE list_sum(list_transform(range(1, len(x.a) + 1), lambda i: abs(x.a[i] - y.a[i]) + abs(x.d[i] - y.d[i]))) < len(x.a)),
    common AS (SELECT DISTINCT dropped AS trip_id, s.day FROM p JOIN service_days s ON s.trip_id = kept JOIN service_days t ON t.trip_id = dropped AND s.day = t.day), own AS (SELECT trip_id, day FROM service_days SEMI JOIN common USING (trip_id)),
    rest AS (SELECT * FROM own ANTI JOIN common USING (trip_id, day))
    SELECT t.trip_id, day::BIGINT AS day, day IS NULL AS disabled FROM (SELECT DISTINCT trip_id FROM own) t LEFT JOIN rest USING (trip_id)""")
def merged_service_days(d: Derived) -> DataFrame:
    """What duplicate trips have left when the days that they share with the trip that is kept are taken away."""
    equal = d.locations.select("location_id", F.floor(F.col("location_id") / 20).alias("group_id"))
    return routes.merged_days(d.service_days, routes.duplicates(d.events_on, d.service_days, equal))


@query("events_on footpaths", """q AS (SELECT a.trip_id AS k, a.location_id AS f, b.location_id AS t, a.arr AS ready, b.dep AS latest FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND a.stop_seq = 1 AND b.stop_seq = 2),
    wa AS (SELECT k, f AS here, ready, latest FROM q UNION ALL SELECT k, to_id, ready + minutes, latest FROM q JOIN footpaths ON from_id = f), wb AS (SELECT k, t AS there, 0 AS more, latest FROM q UNION ALL SELECT k, from_id, minutes, latest FROM q JOIN footpaths ON to_id = t),
    b AS (SELECT k, trip_id, min(stop_seq) AS first FROM wa JOIN events_on ON location_id = here AND dep >= ready AND dep <= latest WHERE in_allowed GROUP BY 1, 2),
    o AS (SELECT k, min({'arr': arr + more, 'trip': trip_id, 'b': first, 'a': stop_seq}) AS x FROM wb JOIN events_on ON location_id = there JOIN b USING (k, trip_id) WHERE out_allowed AND stop_seq > first AND arr + more <= latest GROUP BY 1)
    SELECT k AS query_id, x.trip AS trip_id, x.b AS board_seq, x.a AS alight_seq, x.arr::BIGINT AS arr FROM o""")
def middle_leg_alternative(d: Derived) -> DataFrame:
    """For the third stop of each trip, the ride that is there earliest from the second stop on."""
    own = d.events_on
    a = own.where("stop_seq = 1").select(F.col("trip_id").alias("query_id"), F.col("location_id").alias("from_id"), F.col("arr").alias("ready"))
    b = own.where("stop_seq = 2").select(F.col("trip_id").alias("query_id"), F.col("location_id").alias("to_id"), F.col("dep").alias("latest"))
    return rides.earliest_between(a.join(b, "query_id"), own, d.footpaths).select("query_id", "trip_id", "board_seq", "alight_seq", "arr")


@query("events_on td_edges", """s AS (SELECT from_id AS location_id, valid_from, max(duration) AS duration FROM td_edges GROUP BY 1, 2), l AS (SELECT trip_id AS leg_id, location_id, 28401120 + dep * 30 AS time, 7 AS minutes FROM events_on WHERE stop_seq = 0)
    SELECT leg_id, l.location_id, coalesce(duration, minutes)::BIGINT AS minutes FROM l ASOF LEFT JOIN s ON l.location_id = s.location_id AND l.time >= s.valid_from""")
def timed_leg_offsets(d: Derived) -> DataFrame:
    steps = d.td_edges.groupBy(F.col("from_id").alias("location_id"), "valid_from").agg(F.max("duration").alias("duration"))
    legs = d.events_on.where("stop_seq = 0").select(F.col("trip_id").alias("leg_id"), "location_id", (28401120 + F.col("dep") * 30).alias("time"), F.lit(7).cast("long").alias("minutes"))
    return matching.timed_offsets(legs, steps).select("leg_id", "location_id", "minutes")


_METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query("events_on service_days locations", f"""served AS (SELECT a.location_id, min({{'m': round({_METRES}, 3), 'o': b.location_id}}).o AS offer FROM locations a JOIN locations b ON b.location_id % 3 = 0 AND {_METRES} <= 800 GROUP BY 1),
    hours AS (SELECT location_id AS offer, wd AS weekday, 300 + location_id % 5 * 60 AS b, 1300 - location_id % 4 * 60 AS e FROM locations, (SELECT unnest(range(0, 7)) AS wd) WHERE location_id % 3 = 0 AND wd <> location_id % 7),
    calls AS (SELECT e.trip_id, stop_seq, arr, dep, location_id % 7 <> 3 AS may_in, location_id % 7 <> 5 AS may_out, offer, stop_seq = max(stop_seq) OVER (PARTITION BY e.trip_id) AS last FROM events_on e LEFT JOIN served USING (location_id)),
    days AS (SELECT c.*, day FROM calls c JOIN service_days USING (trip_id)),
    f AS (SELECT trip_id, day, stop_seq, may_in AND (last OR EXISTS (SELECT 1 FROM hours h WHERE h.offer = days.offer AND h.weekday = (day + dep // 1440) % 7 AND dep % 1440 >= b AND dep % 1440 < e)) AS i,
        may_out AND (stop_seq = 0 OR EXISTS (SELECT 1 FROM hours h WHERE h.offer = days.offer AND h.weekday = (day + arr // 1440) % 7 AND arr % 1440 >= b AND arr % 1440 < e)) AS o FROM days),
    g AS (SELECT trip_id, day, string_agg(i::INT::VARCHAR, '' ORDER BY stop_seq) AS boarding, string_agg(o::INT::VARCHAR, '' ORDER BY stop_seq) AS alighting FROM f GROUP BY 1, 2)
    SELECT trip_id, boarding, alighting, string_agg(day::VARCHAR, ',' ORDER BY day) AS days FROM g GROUP BY 1, 2, 3""")
def assistance_split(d: Derived) -> DataFrame:
    """Trips by the days on which assistance is open where they call."""
    k = F.col("location_id")
    offers = d.locations.where("location_id % 3 = 0")
    hours = offers.select(k.alias("offer_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"), (300 + k % 5 * 60).alias("begin"), (1300 - k % 4 * 60).alias("end")).where("weekday <> offer_id % 7")
    served = assistance.nearest(d.locations, offers.select(k.alias("offer_id"), "lat", "lng"))
    events = d.events_on.withColumns({"in_wheelchair": k % 7 != 3, "out_wheelchair": k % 7 != 5})
    return assistance.split(events, d.service_days, served, hours).select("trip_id", "boarding", "alighting", F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days"))


@query()
def random_queries(d: Derived) -> DataFrame:
    """A hundred pairs of stops further apart than ten minutes on foot."""
    return requests.random_queries(d.locations, 100, seed=1, least_walk=10)
