"""Updates over the timetable: each is one row (trip_id, stop_seq, ..) and the overlay is worked out by windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import haversine_m
from tramline.operators.stop_times import monotone_forward, propagated

MOST_SPEED_M_S, MATCH_WINDOW = 100.0, 15


def latest(updates: DataFrame, keys: list[str], time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last message of each key."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("x")).select(*keys, "x.*")


def resolved(updates: DataFrame, trips: DataFrame, service_days: DataFrame) -> DataFrame:
    """Updates (trip_id or route_id + start_time, day) with the trip they mean, if it runs on that day.

    trips are (trip_id, route_id, start_time); a time matches modulo a day.
    """
    by_id = updates.where("trip_id is not null").join(trips.select("trip_id"), "trip_id", "left_semi").join(service_days, ["trip_id", "day"], "left_semi")
    # The trips of a route, time and day are one array, so what a message without a trip means isn't moved again.
    minute = F.pmod("start_time", F.lit(1440)).alias("__m")
    days = service_days.groupBy("trip_id").agg(F.collect_set("day").alias("__days"))
    runs = trips.select("trip_id", "route_id", minute).join(days, "trip_id").select("trip_id", "route_id", "__m", F.explode("__days").alias("day")).groupBy("route_id", "__m", "day").agg(F.collect_list("trip_id").alias("__trips"))
    by_route = updates.where("trip_id is null").drop("trip_id").select("*", minute).join(runs, ["route_id", "__m", "day"]).withColumn("trip_id", F.explode("__trips"))
    return by_id.unionByName(by_route.select(*by_id.columns))


def overlay(stop_events: DataFrame, updates: DataFrame) -> DataFrame:
    """(trip_id, stop_seq, location_id, arr, dep, in_allowed, out_allowed, cancelled): the updated trips with delays carried forward, times
    that never run backwards, and skipped stops.

    updates are (trip_id, stop_seq, delay, skipped, cancelled), one row a stop. A trip of which fewer than two stops are left is cancelled.
    """
    per_stop = updates.groupBy("trip_id", "stop_seq").agg(F.max(F.when(~F.col("skipped"), F.col("delay"))).alias("delay"), F.bool_or("skipped").alias("skipped"))
    gone = updates.groupBy("trip_id").agg(F.bool_or("cancelled").alias("gone"))
    rows = stop_events.join(gone, "trip_id").join(per_stop, ["trip_id", "stop_seq"], "left")
    rows = propagated(rows).withColumn("arr", F.col("arr") + F.col("delay")).withColumn("dep", F.greatest(F.col("dep") + F.col("delay"), F.col("arr")))
    rows = rows.withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    # Both times share one running maximum: a departure holds up the next arrival.
    w = Window.partitionBy("trip_id").orderBy("stop_seq")
    before = F.max("dep").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("arr", F.greatest("arr", before))
    rows = monotone_forward(rows.withColumn("dep", F.greatest("dep", "arr")), "dep")
    left = F.sum((~F.col("skipped")).cast("int")).over(Window.partitionBy("trip_id"))
    rows = rows.withColumn("cancelled", F.col("gone") | (left <= 1))
    usable = ~(F.col("skipped") | F.col("cancelled"))
    return rows.select("trip_id", "stop_seq", "location_id", "arr", "dep", (F.col("in_allowed") & usable).alias("in_allowed"), (F.col("out_allowed") & usable).alias("out_allowed"), "cancelled")


def applied(stop_events: DataFrame, changed: DataFrame) -> DataFrame:
    """The timetable with the overlay's trips in place of their own; cancelled ones are gone."""
    columns = ["trip_id", "stop_seq", "location_id", "arr", "dep", "in_allowed", "out_allowed"]
    return stop_events.join(changed.select("trip_id").distinct(), "trip_id", "left_anti").select(*columns).unionByName(changed.where("not cancelled").select(*columns))


def matched_stops(updates: DataFrame, stop_events: DataFrame) -> DataFrame:
    """Updates (event_id, trip_id, position, stop_seq, location_id) with the stop that they mean: (.., stop_seq, at_id).

    A cursor moves forward along the trip: each update, in order of position, takes the first stop at or behind the cursor that has its
    sequence number or is its stop, and the cursor goes behind it. An update that fits none is dropped. A trip's stops and updates are
    folded JVM-side; both are bounded by the length of a trip.
    """
    stops = stop_events.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_seq", "location_id"))).alias("stops"))
    u = F.struct("position", "event_id", F.col("stop_seq").cast("long").alias("seq"), F.col("location_id").alias("at"))
    asked = updates.groupBy("trip_id").agg(F.array_sort(F.collect_list(u)).alias("asked"))
    rows = asked.join(stops, "trip_id")

    def step(acc, x):
        fits = F.transform(F.col("stops"), lambda s, i: F.when((i >= acc["cursor"]) & (F.coalesce(s["stop_seq"] == x["seq"], F.lit(False)) | F.coalesce(s["location_id"] == x["at"], F.lit(False))), i))
        at = F.array_min(fits)
        return F.struct(F.coalesce(at + 1, acc["cursor"]).alias("cursor"), F.concat(acc["found"], F.array(at)).alias("found"))

    empty = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("found"))
    # The fold is a column of its own: what is exploded is evaluated again in the filters that Spark puts before it, as is what must not be null.
    met = rows.select("trip_id", "stops", "asked", F.aggregate("asked", empty, step)["found"].alias("found")).select("trip_id", "stops", "found", F.posexplode("asked").alias("i", "x"))
    met = met.withColumn("at", F.expr("coalesce(found[i], -1)")).where("at >= 0").withColumn("s", F.expr("stops[at]"))
    return met.select("x.event_id", "trip_id", "x.position", "s.stop_seq", F.col("s.location_id").alias("at_id"))


def retimed(stop_events: DataFrame, updates: DataFrame) -> DataFrame:
    """(trip_id, stop_seq, arr, dep): times of the trips that have updates (trip_id, stop_seq, arr_delay, dep_delay, arr_time, dep_time).

    The events of a trip are gone through in order. One with a delay of its own gets it, else one with an absolute time that time, else it
    has the last delay; nothing comes before the event before it. Before the first update times stay as planned. A first
    departure without an update takes that of its arrival. Delays are minutes, as absolute times are.
    """
    per_stop = updates.groupBy("trip_id", "stop_seq").agg(*(F.max(c).alias(c) for c in ("arr_delay", "dep_delay", "arr_time", "dep_time")))
    known = stop_events.join(updates.select("trip_id").distinct(), "trip_id", "left_semi").join(per_stop, ["trip_id", "stop_seq"], "left")
    stop = F.struct("stop_seq", "arr", "dep", "arr_delay", "dep_delay", "arr_time", "dep_time")
    trips = known.groupBy("trip_id").agg(F.array_sort(F.collect_list(stop)).alias("stops"))

    def event(planned, delay, time, before):
        return F.struct(planned.alias("planned"), delay.cast("long").alias("delay"), time.cast("long").alias("time"), before.cast("long").alias("before"))

    def events(s, i):
        previous = F.expr("stops")[F.greatest(i - 1, F.lit(0))]["dep"]
        arr = event(s["arr"], s["arr_delay"], s["arr_time"], previous)
        own = s["dep_delay"].isNotNull() | s["dep_time"].isNotNull()
        first = (i == 0) & ~own
        dep = event(s["dep"], F.when(first, s["arr_delay"]).otherwise(s["dep_delay"]), F.when(first, s["arr_time"]).otherwise(s["dep_time"]), F.when(i == 0, F.lit(None)).otherwise(s["arr"]))
        return F.when(i == 0, F.array(dep)).when(i == F.size("stops") - 1, F.array(arr)).otherwise(F.array(arr, dep))

    def step(acc, e):
        floor = F.coalesce(acc["at"], e["before"], e["planned"] - 100_000)
        new = F.when(e["delay"].isNotNull(), F.greatest(floor, e["planned"] + e["delay"])).when(e["time"].isNotNull(), F.greatest(floor, e["time"])).when(acc["at"].isNotNull(), F.greatest(acc["at"], e["planned"] + acc["late"]))
        late = F.when(e["delay"].isNotNull(), e["delay"]).when(e["time"].isNotNull(), new - e["planned"]).otherwise(acc["late"])
        out = F.greatest(F.coalesce(new, e["planned"]), F.coalesce(F.try_element_at(acc["out"], F.lit(-1)), F.coalesce(new, e["planned"])))
        return F.struct(F.coalesce(new, acc["at"]).alias("at"), late.alias("late"), F.concat(acc["out"], F.array(out)).alias("out"))

    none = F.lit(None).cast("long")
    start = F.struct(none.alias("at"), none.alias("late"), F.array().cast("array<bigint>").alias("out"))
    times = trips.withColumn("events", F.flatten(F.transform("stops", events))).withColumn("out", F.aggregate("events", start, step)["out"])
    # Event 0 is the first departure; the arrival of stop i is event 2i - 1, its departure event 2i.
    rows = times.select("trip_id", "out", F.size("stops").alias("n"), F.posexplode("stops").alias("i", "s"))
    arr, dep = F.expr("get(out, 2 * i - 1)"), F.expr("get(out, 2 * i)")
    return rows.select("trip_id", "s.stop_seq", F.coalesce(arr, F.col("s.arr") + dep - F.col("s.dep")).alias("arr"), F.coalesce(dep, F.col("s.dep") + arr - F.col("s.arr")).alias("dep"))


def run_updates(stop_events: DataFrame, updates: DataFrame, same_place: DataFrame | None = None) -> DataFrame:
    """The overlay (see applied()) of messages: (trip_id, stop_seq, location_id, arr, dep, in_allowed, out_allowed, cancelled).

    updates are (event_id, trip_id, position, stop_seq, location_id, arr_delay, dep_delay, arr_time, dep_time, skipped, cancelled, assigned_id), a
    row a stop, position null in a message without stops. They are matched by a cursor, retimed, and skipped or moved to the assigned stop, if
    that is one of same_place (location_id, other_id) to the planned one. A trip of which one stop or none is left is cancelled.
    """
    stops = updates.where("position is not null")
    found = matched_stops(stops.select("event_id", "trip_id", "position", "stop_seq", "location_id"), stop_events).select("event_id", "trip_id", "position", "stop_seq")
    rest = ["arr_delay", "dep_delay", "arr_time", "dep_time", "skipped", "assigned_id", F.col("location_id").alias("named_id")]
    met = found.join(stops.select("event_id", "trip_id", "position", *rest), ["event_id", "trip_id", "position"])
    shown = met.where("not skipped")
    # A trip without a stop that matches has its planned times, though it may be cancelled.
    times = retimed(stop_events, shown.select("trip_id", "stop_seq", "arr_delay", "dep_delay", "arr_time", "dep_time"))
    per_stop = met.groupBy("trip_id", "stop_seq").agg(F.bool_or("skipped").alias("skipped"), F.max(F.coalesce("assigned_id", "named_id")).alias("wanted"))
    gone = updates.groupBy("trip_id").agg(F.bool_or("cancelled").alias("gone"))
    own = stop_events.join(gone, "trip_id").join(per_stop, ["trip_id", "stop_seq"], "left").join(times.select("trip_id", "stop_seq", F.col("arr").alias("new_arr"), F.col("dep").alias("new_dep")), ["trip_id", "stop_seq"], "left")
    if same_place is not None:
        own = own.join(same_place.select("location_id", F.col("other_id").alias("wanted"), F.col("other_id").alias("moved")).distinct(), ["location_id", "wanted"], "left")
    else:
        own = own.withColumn("moved", F.lit(None).cast(stop_events.schema["location_id"].dataType))
    skipped = F.coalesce("skipped", F.lit(False))
    left = F.sum((~skipped & (F.col("in_allowed") | F.col("out_allowed"))).cast("int")).over(Window.partitionBy("trip_id"))
    own = own.withColumn("cancelled", F.col("gone") | (left <= 1)).withColumn("usable", ~(skipped | F.col("cancelled")))
    return own.select("trip_id", "stop_seq", F.when(skipped, F.col("location_id")).otherwise(F.coalesce("moved", "location_id")).alias("location_id"), F.coalesce("new_arr", "arr").alias("arr"), F.coalesce("new_dep", "dep").alias("dep"), (F.col("in_allowed") & F.col("usable")).alias("in_allowed"), (F.col("out_allowed") & F.col("usable")).alias("out_allowed"), "cancelled")


def added(updates: DataFrame, locations: DataFrame, limit: float = MOST_SPEED_M_S) -> DataFrame:
    """Stop events of trips that no timetable has: updates (trip_id, position, location_id, arr_time, dep_time, in_allowed, out_allowed), a row a stop.

    All stops must be known and have an absolute time, and no section may be too fast, else the whole trip is left out. A missing time is
    that of the event before it, and none comes before the one before.
    """
    own = updates.select("trip_id", F.col("position").cast("long").alias("stop_seq"), "location_id", F.col("arr_time").alias("arr"), F.col("dep_time").alias("dep"), "in_allowed", "out_allowed")
    own = own.join(plausible(own, locations, limit).select("trip_id"), "trip_id", "left_semi")
    w = Window.partitionBy("trip_id").orderBy("stop_seq")
    before = F.max(F.greatest("arr", "dep")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    arr = F.coalesce(F.greatest("arr", before), "dep")
    return own.withColumn("new", arr).select("trip_id", "stop_seq", "location_id", F.col("new").alias("arr"), F.greatest("dep", "new").alias("dep"), "in_allowed", "out_allowed")


def tracks(stops: DataFrame, overrides: DataFrame) -> DataFrame:
    """stops (trip_id, stop_seq, event, track) with the track of overrides (trip_id, stop_seq, event, track), where there is one."""
    own = overrides.select("trip_id", "stop_seq", "event", F.col("track").alias("changed"))
    return stops.join(own, ["trip_id", "stop_seq", "event"], "left").select("trip_id", "stop_seq", "event", F.coalesce("changed", "track").alias("track"))


def lower_bounds(planned: DataFrame, changed: DataFrame, footpaths: DataFrame, roots: DataFrame) -> DataFrame:
    """(from_id, to_id, minutes): the edges of routes.lower_bound_edges() with what the overlay's trips make shorter or add."""
    from tramline.operators.routes import lower_bound_edges

    both = lower_bound_edges(planned, footpaths, roots).unionByName(lower_bound_edges(changed.where("not cancelled"), footpaths.limit(0), roots))
    return both.groupBy("from_id", "to_id").agg(F.min("minutes").alias("minutes"))


def run_stops(stop_events: DataFrame, changed: DataFrame, locations: DataFrame) -> DataFrame:
    """One row a stop of each run: its name and station, planned and expected times, delays, whether it is the first or last, and what is allowed."""
    own = stop_events.join(changed.select("trip_id", "stop_seq", F.col("location_id").alias("now_id"), F.col("arr").alias("rt_arr"), F.col("dep").alias("rt_dep"), F.col("in_allowed").alias("rt_in"), F.col("out_allowed").alias("rt_out"), "cancelled"), ["trip_id", "stop_seq"], "left")
    own = own.withColumn("location_id", F.coalesce("now_id", "location_id")).join(locations.select("location_id", "name", F.coalesce("parent_id", "location_id").alias("station_id")), "location_id")
    w = Window.partitionBy("trip_id")
    names = F.last("name").over(w.orderBy("stop_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.select("trip_id", "stop_seq", "location_id", "name", "station_id", names.alias("direction"), F.col("arr").alias("planned_arr"), F.col("dep").alias("planned_dep"), F.coalesce("rt_arr", "arr").alias("arr"), F.coalesce("rt_dep", "dep").alias("dep"), (F.coalesce("rt_arr", "arr") - F.col("arr")).alias("arr_delay"), (F.coalesce("rt_dep", "dep") - F.col("dep")).alias("dep_delay"), F.coalesce("rt_in", "in_allowed").alias("in_allowed"), F.coalesce("rt_out", "out_allowed").alias("out_allowed"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"), (F.col("stop_seq") == F.min("stop_seq").over(w)).alias("is_first"), (F.col("stop_seq") == F.max("stop_seq").over(w)).alias("is_last"))


def plausible(stops: DataFrame, locations: DataFrame, limit: float = MOST_SPEED_M_S) -> DataFrame:
    """(trip_id, stops): added trips (trip_id, stop_seq, location_id, arr, dep) of two stops at least, all of them known and with a time, none of
    whose sections is faster than the limit. A stop's time is its departure, else its arrival; a section counts as a minute at least."""
    own = stops.join(locations.select("location_id", "lat", "lng"), "location_id", "left")
    w = Window.partitionBy("trip_id").orderBy("stop_seq")
    at = F.coalesce("dep", "arr")
    seconds = F.greatest((at - F.lag(at).over(w)) * 60, F.lit(60))
    speed = haversine_m(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")) / seconds
    return own.withColumn("speed", speed).groupBy("trip_id").agg(F.count("*").alias("stops"), F.count("lat").alias("known"), F.count(at).alias("timed"), F.max("speed").alias("top")).where(f"stops >= 2 and known = stops and timed = stops and coalesce(top, 0) <= {limit}").select("trip_id", "stops")


def vehicle_delays(positions: DataFrame, stop_events: DataFrame, locations: DataFrame) -> DataFrame:
    """(event_id, trip_id, stop_seq, delay): positions (event_id, trip_id, lat, lng, minute) at the nearest stop of their run."""
    at = positions.join(stop_events.select("trip_id", "stop_seq", "location_id", "arr"), "trip_id").join(locations.select("location_id", F.col("lat").alias("y"), F.col("lng").alias("x")), "location_id")
    far = haversine_m(F.col("lat"), F.col("lng"), F.col("y"), F.col("x"))
    near = at.groupBy("event_id", "trip_id", "minute").agg(F.min(F.struct(F.round(far, 3).alias("far"), "stop_seq", "arr")).alias("x"))
    return near.select("event_id", "trip_id", "x.stop_seq", (F.col("minute") - F.col("x.arr")).alias("delay"))


def statistics(updates: DataFrame) -> DataFrame:
    """Counts by kind."""
    return updates.groupBy("kind").agg(F.count("*").alias("messages"), F.countDistinct("trip_id").alias("trips"), F.sum(F.when(F.col("delay") > 0, 1).otherwise(0)).alias("late"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(trip_id, stop_seq, event, delay): what an overlay changed against the timetable, for those who listen."""
    both = before.select("trip_id", "stop_seq", F.col("arr").alias("a0"), F.col("dep").alias("d0")).join(after.select("trip_id", "stop_seq", "arr", "dep"), ["trip_id", "stop_seq"])
    rows = both.select("trip_id", "stop_seq", F.explode(F.array(F.struct(F.lit("arr").alias("event"), (F.col("arr") - F.col("a0")).alias("delay")), F.struct(F.lit("dep").alias("event"), (F.col("dep") - F.col("d0")).alias("delay")))).alias("x"))
    return rows.select("trip_id", "stop_seq", "x.event", "x.delay").where("delay <> 0")
