"""Queries of the journey search, from one stop on the derived Wednesday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.storage import written
from tramline.operators import all_stops, journeys, measures, routes
from tramline.plans.derived import Derived
from tramline.plans.registry import query

START, BEGIN, TARGET = 1, 480, 7


def _rounds_sql(most: int, starts: str = f"SELECT 0::BIGINT AS q, {START}::BIGINT AS l, {BEGIN}::BIGINT AS t", events: str = "events_on", where: str = "true", part: str = "") -> str:
    """Common tables arr_1 .. arr_most (q, l, t): the best arrival with at most so many rides. No label of an earlier round is left out, as none makes a minimum worse."""
    parts = [f"ev AS MATERIALIZED (SELECT trip_id, stop_seq, location_id, arr, dep, in_allowed, out_allowed{part and f', {part}'} FROM {events} WHERE {where})", f"go_0 AS ({starts})", "best_0 AS (SELECT q, l, min(t) AS t FROM go_0 GROUP BY 1, 2)"]
    for k in range(1, most + 1):
        parts += [
            f"in_{k} AS (SELECT q, trip_id, {part or 0} AS part, min(stop_seq) AS s FROM go_{k - 1} JOIN ev ON location_id = l AND dep >= t AND dep - t <= 1440 WHERE in_allowed GROUP BY 1, 2, 3)",
            f"off_{k} AS MATERIALIZED (SELECT e.q, e.l, e.t FROM (SELECT q, location_id AS l, min(arr) AS t FROM in_{k} JOIN ev USING (trip_id) WHERE stop_seq > s AND out_allowed AND part = {part or 0} GROUP BY 1, 2) e LEFT JOIN best_{k - 1} z ON z.q = e.q AND z.l = e.l WHERE z.t IS NULL OR e.t < z.t)",
            f"foot_{k} AS (SELECT e.q, e.l, e.t FROM (SELECT q, to_id AS l, min(t + minutes) AS t FROM off_{k} JOIN footpaths ON from_id = l GROUP BY 1, 2) e LEFT JOIN best_0 z ON z.q = e.q AND z.l = e.l WHERE z.t IS NULL OR e.t < z.t)",
            f"go_{k} AS MATERIALIZED (SELECT q, l, min(t)::BIGINT AS t FROM (SELECT q, l, t + transfer_min AS t FROM off_{k} JOIN locations ON location_id = l UNION ALL SELECT * FROM foot_{k} UNION ALL SELECT * FROM go_{k - 1}) GROUP BY 1, 2)",
            f"arr_{k} AS MATERIALIZED (SELECT q, l, min(t)::BIGINT AS t FROM (SELECT * FROM off_{k} UNION ALL SELECT * FROM foot_{k}{f' UNION ALL SELECT * FROM arr_{k - 1}' if k > 1 else ''}) GROUP BY 1, 2)",
            f"best_{k} AS MATERIALIZED (SELECT q, l, min(t)::BIGINT AS t FROM (SELECT * FROM arr_{k} UNION ALL SELECT * FROM go_0) GROUP BY 1, 2)",
        ]
    return ", ".join(parts)


def _search(d: Derived, **options) -> journeys.Search:
    return journeys.Search(d.events_on, d.locations, d.footpaths, **options)


def _start(d: Derived) -> DataFrame:
    return d.spark.createDataFrame([(0, START, BEGIN)], "query_id long, location_id long, time long")


_TABLES = "events_on locations footpaths"


@query(_TABLES, _rounds_sql(3) + " SELECT l AS location_id, t AS arr FROM arr_3")
def earliest_arrival_rounds(d: Derived) -> DataFrame:
    return journeys.one_to_all(journeys.rounds(_search(d), _start(d), 3)).select("location_id", "arr")


@query(_TABLES, _rounds_sql(3) + ", u AS (SELECT 1 AS k, * FROM arr_1 UNION ALL SELECT 2, * FROM arr_2 UNION ALL SELECT 3, * FROM arr_3) SELECT l AS location_id, min(t) AS arr, arg_min(k, t * 10 + k)::INTEGER AS round FROM u GROUP BY l")
def one_to_all_fastest(d: Derived) -> DataFrame:
    return journeys.one_to_all(journeys.rounds(_search(d), _start(d), 3)).select("location_id", "arr", "round")


@query(_TABLES, _rounds_sql(3) + ", u AS (SELECT 1 AS k, * FROM arr_1 UNION ALL SELECT 2, * FROM arr_2 UNION ALL SELECT 3, * FROM arr_3) SELECT l AS location_id, k::INTEGER AS round, t AS arr FROM u QUALIFY t < coalesce(min(t) OVER (PARTITION BY l ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999999)")
def improving_rounds(d: Derived) -> DataFrame:
    labels = journeys.rounds(_search(d), _start(d), 3).where("kind = 'arrive'")
    return labels.select("location_id", "round", "arr")


_MIRROR = "mirror AS (SELECT trip_id, -stop_seq AS stop_seq, location_id, -dep AS arr, -arr AS dep, out_allowed AS in_allowed, in_allowed AS out_allowed FROM events_on), "


@query(_TABLES, _MIRROR + _rounds_sql(2, f"SELECT 0::BIGINT AS q, {TARGET}::BIGINT AS l, -1000::BIGINT AS t", "mirror") + " SELECT l AS location_id, -t AS dep FROM arr_2")
def latest_departure_rounds(d: Derived) -> DataFrame:
    """Backwards: the latest departure from each stop that still reaches one stop by a time. The derived footpaths are symmetric."""
    search = journeys.Search(journeys.mirrored(d.events_on), d.locations, d.footpaths)
    starts = d.spark.createDataFrame([(0, TARGET, -1000)], "query_id long, location_id long, time long")
    return journeys.one_to_all(journeys.rounds(search, starts, 2)).select("location_id", (-F.col("arr")).alias("dep"))


@query(_TABLES, _rounds_sql(2, where="((1 << clasz::INTEGER) & 1058) <> 0") + " SELECT l AS location_id, t AS arr FROM arr_2")
def class_limited_rounds(d: Derived) -> DataFrame:
    return journeys.one_to_all(journeys.rounds(_search(d, class_mask=1058), _start(d), 2)).select("location_id", "arr")


@query(_TABLES, _rounds_sql(2, "SELECT location_id AS q, location_id AS l, 300 + location_id % 20 * 30 AS t FROM locations") + " SELECT q AS query_id, l AS location_id, t AS arr FROM arr_2")
def many_to_all(d: Derived) -> DataFrame:
    """All stops as queries of one run."""
    starts = d.locations.select(F.col("location_id").alias("query_id"), "location_id", (300 + F.col("location_id") % 20 * 30).alias("time"))
    return all_stops.fastest(_search(d), starts, 2).select("query_id", "location_id", "arr")


_OFFSETS = f"o AS (SELECT location_id, location_id % 3 AS minutes FROM locations WHERE location_id BETWEEN {START} AND {START + 2})"
_STARTS = _OFFSETS + ", s AS (SELECT DISTINCT dep - minutes AS start_time, location_id, dep AS time FROM events_on JOIN o USING (location_id) WHERE in_allowed AND dep - minutes >= 480 AND dep - minutes < 540 UNION ALL SELECT 540, location_id, 540 + minutes FROM o)"


def _offsets(d: Derived) -> DataFrame:
    return d.locations.where(f"location_id between {START} and {START + 2}").select("location_id", (F.col("location_id") % 3).alias("minutes"))


@query(_TABLES, _STARTS + " SELECT start_time::BIGINT AS start_time, location_id, time::BIGINT AS time FROM s")
def start_events(d: Derived) -> DataFrame:
    return journeys.start_events(d.events_on, _offsets(d), 480, 540)


@query(_TABLES, _STARTS + ", " + _rounds_sql(2, "SELECT start_time AS q, location_id AS l, min(time) AS t FROM s GROUP BY 1, 2") + f""", j AS (SELECT q AS dep, t AS arr, 0 AS transfers FROM arr_1 WHERE l = {TARGET} UNION ALL SELECT q, t, 1 FROM arr_2 WHERE l = {TARGET})
    SELECT DISTINCT dep::BIGINT AS dep, arr, transfers::INTEGER AS transfers FROM j a WHERE dep < 540 AND NOT EXISTS (SELECT 1 FROM j b WHERE b.dep >= a.dep AND b.arr <= a.arr AND b.transfers <= a.transfers AND (b.dep > a.dep OR b.arr < a.arr OR b.transfers < a.transfers))""")
def profile_search_2rounds(d: Derived) -> DataFrame:
    targets = d.locations.where(f"location_id = {TARGET}").select("location_id", F.lit(0).cast("long").alias("minutes"))
    return journeys.profile(_search(d), _offsets(d), targets, 480, 540, 2)


@query(_TABLES, _rounds_sql(2) + ", a AS (SELECT 1 AS k, t FROM arr_1 WHERE l = 7 UNION ALL SELECT 2, t FROM arr_2 WHERE l = 7), f AS (SELECT k, t FROM a QUALIFY t < coalesce(min(t) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999999)), " + _MIRROR.rstrip(", ")
    + ", " + _rounds_sql(2, "SELECT k::BIGINT AS q, 7::BIGINT AS l, -t AS t FROM f", "mirror").replace("ev AS", "ew AS").replace("JOIN ev", "JOIN ew").replace("go_", "bo_").replace("best_", "bbest_").replace("in_1", "bin_1").replace("in_2", "bin_2").replace("off_", "boff_").replace("foot_", "bfoot_").replace("arr_1", "barr_1").replace("arr_2", "barr_2")
    + ", b AS (SELECT q, t FROM barr_1 WHERE l = 1 UNION ALL SELECT q, t FROM barr_2 WHERE l = 1 AND q >= 2) SELECT (k - 1)::INTEGER AS transfers, max(-b.t)::BIGINT AS dep, f.t AS arr FROM f JOIN b ON q = k GROUP BY k, f.t")
def ping_pong(d: Derived) -> DataFrame:
    return journeys.ping_pong(_search(d), START, TARGET, BEGIN, 2)


@query(_TABLES, f"""ride AS (SELECT a.trip_id, a.location_id AS f, b.location_id AS t, a.dep, b.arr, a.stop_seq AS i, b.stop_seq AS j FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND a.stop_seq < b.stop_seq AND a.in_allowed AND b.out_allowed AND a.location_id <> b.location_id),
    one AS (SELECT r.*, v.stop_seq AS k FROM ride r JOIN events_on v ON v.trip_id = r.trip_id AND v.location_id = 3 AND v.stop_seq > r.i AND v.stop_seq <= r.j WHERE f = {START} AND r.dep >= {BEGIN})
    SELECT t AS location_id, min(arr)::BIGINT AS arr FROM (SELECT t, arr FROM one UNION ALL SELECT to_id, arr + minutes FROM one JOIN footpaths ON from_id = t) GROUP BY 1""")
def via_rounds(d: Derived) -> DataFrame:
    """One ride that passes a stop on the way, without stay."""
    labels = journeys.rounds(_search(d, vias=[(3, 0)]), _start(d), 1)
    return journeys.one_to_all(labels, vias=1).select("location_id", "arr")


@query()
def journey_legs(d: Derived) -> DataFrame:
    labels = journeys.rounds(_search(d), _start(d), 3)
    return journeys.reconstruct(labels, d.locations.where(f"location_id = {TARGET}"), 3)


@query("stop_times active locations", "one AS (SELECT min(trip_id) AS t FROM active WHERE trip_id > 100) SELECT location_id, min(arr + transfer_min)::BIGINT AS time FROM stop_times JOIN one ON trip_id = t JOIN locations USING (location_id) WHERE stop_seq >= 1 AND out_allowed GROUP BY 1")
def ontrip_offsets(d: Derived) -> DataFrame:
    trip = d.active.where("trip_id > 100").agg(F.min("trip_id")).first()[0]
    return journeys.on_trip_offsets(d.stop_times, d.locations, trip, 1)


@query("locations footpaths", """s AS (SELECT location_id, location_id % 4 AS m FROM locations WHERE location_id % 10 = 2), t AS (SELECT location_id, location_id % 6 AS m FROM locations WHERE location_id % 10 = 4)
    SELECT min(s.m + ceil(minutes * 1.5) + t.m)::BIGINT AS minutes FROM s JOIN footpaths ON from_id = s.location_id JOIN t ON t.location_id = to_id""")
def fastest_walk(d: Derived) -> DataFrame:
    pick = lambda k, m: d.locations.where(f"location_id % 10 = {k}").select("location_id", (F.col("location_id") % m).alias("minutes"))
    return journeys.fastest_walk(pick(2, 4), pick(4, 6), d.footpaths, 1.5)


@query("events_on", "r AS (SELECT a.trip_id, a.dep, b.arr FROM events_on a JOIN events_on b ON a.trip_id = b.trip_id AND a.stop_seq = 0 AND b.stop_seq = 2) SELECT * FROM r WHERE arr - dep < 40 AND dep >= 480 AND dep < 600")
def travel_time_filter(d: Derived) -> DataFrame:
    own = d.events_on
    pairs = own.where("stop_seq = 0").select("trip_id", "dep").join(own.where("stop_seq = 2").select("trip_id", "arr"), "trip_id")
    return journeys.within_limits(pairs, 40, 480, 600)


@query("events_on footpaths service_days locations", """n AS (SELECT trip_id, count(*) AS n FROM service_days GROUP BY 1), c AS (SELECT DISTINCT trip_id, location_id, clasz FROM events_on),
    i AS (SELECT coalesce(parent_id, location_id) AS location_id, sum(n * CASE clasz WHEN 1 THEN 20 WHEN 5 THEN 16 WHEN 6 THEN 15 WHEN 9 THEN 3 ELSE 2 END) AS importance FROM c JOIN n USING (trip_id) JOIN locations USING (location_id) GROUP BY 1),
    x AS (SELECT a.trip_id AS from_trip, b.trip_id AS to_trip, a.location_id AS alight_id, b.location_id AS board_id, a.arr, b.dep, CASE WHEN a.location_id = b.location_id THEN 0 ELSE minutes END AS m
        FROM events_on a JOIN events_on b ON b.trip_id = a.trip_id + 3 LEFT JOIN footpaths ON from_id = a.location_id AND to_id = b.location_id WHERE a.out_allowed AND b.in_allowed),
    p AS (SELECT from_trip, to_trip, alight_id, board_id, arr, m - 3 * coalesce(importance / (SELECT max(importance) FROM i), 0.0) - 0.2::DOUBLE * least(dep - arr - m, 15) AS penalty FROM x LEFT JOIN i ON i.location_id = alight_id WHERE m IS NOT NULL AND arr + m <= dep)
    SELECT from_trip, to_trip, alight_id, board_id, round(penalty, 6)::DOUBLE AS penalty FROM p QUALIFY row_number() OVER (PARTITION BY from_trip, to_trip ORDER BY penalty, arr, alight_id, board_id) = 1""")
def footpath_optimised(d: Derived) -> DataFrame:
    own = d.events_on
    a = own.where("out_allowed").select(F.col("trip_id").alias("from_trip"), (F.col("trip_id") + 3).alias("to_trip"), F.col("location_id").alias("alight_id"), "arr")
    b = own.where("in_allowed").select(F.col("trip_id").alias("to_trip"), F.col("location_id").alias("board_id"), "dep")
    none = d.spark.createDataFrame([], "from_trip long, to_trip long, latest long")
    best = journeys.best_changes(a.join(b, "to_trip"), d.footpaths, routes.importance(own, d.service_days, d.locations), none)
    return best.withColumn("penalty", F.round("penalty", 6))


@query()
def qa_rating(d: Derived) -> DataFrame:
    """Connections of two rounds against those of one, for each stop that is reached."""
    labels = written(journeys.rounds(_search(d), _start(d), 2).where("kind = 'arrive'"), "rated")
    rows = labels.select(F.col("location_id").alias("query_id"), F.lit(BEGIN).alias("dep"), "arr", (F.col("round") - 1).alias("transfers"))
    return measures.ratings(rows, rows.where("transfers = 0"))


@query(_TABLES, _rounds_sql(1, "SELECT 10 * a AS q, a::BIGINT AS l, 480::BIGINT AS t FROM (SELECT unnest([1, 2, 3]) AS a)") + """, ask AS (SELECT 10 * a AS q, a, b FROM (SELECT unnest([1, 2, 3]) AS a, unnest([4, 2, 7]) AS b)), tree AS (SELECT location_id, coalesce(parent_id, location_id) AS root FROM locations)
    SELECT ask.q::BIGINT AS query_id, t AS arr FROM ask JOIN arr_1 ON arr_1.q = ask.q AND l = b JOIN tree x ON x.location_id = a JOIN tree y ON y.location_id = b WHERE x.root <> y.root""")
def start_is_destination(d: Derived) -> DataFrame:
    """Queries from one stop to another: those whose stops belong to one station have no result."""
    from tramline.operators.requests import overlapping

    one = lambda at: d.spark.createDataFrame([(at,)], "location_id long")
    asked = [(10 * a, a, b) for a, b in ((1, 4), (2, 2), (3, 7)) if not overlapping(one(a), one(b), d.locations)]
    starts = d.spark.createDataFrame([(q, a, BEGIN) for q, a, _ in asked], "query_id long, location_id long, time long")
    ends = d.spark.createDataFrame([(q, b) for q, _, b in asked], "query_id long, location_id long")
    return journeys.one_to_all(journeys.rounds(_search(d), starts, 1)).join(ends, ["query_id", "location_id"]).select("query_id", "arr")
