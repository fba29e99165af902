"""Rides without a change: pairs of stops of one trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A minute before all departures.
_LONG_AGO = -(1 << 62)


def rides(stop_events: DataFrame, boards: DataFrame, section_flag: str | None = None) -> DataFrame:
    """(.., trip_id, board_seq, from_id, dep, alight_seq, to_id, arr) from each of boards (.., trip_id, board_seq) to all later stops.

    With a flag, all sections between must have it: the count of sections without it is equal at both ends.
    """
    own = stop_events
    if section_flag:
        w = Window.partitionBy("trip_id").orderBy("stop_seq").rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("__bad", F.coalesce(F.sum(F.when(F.col(section_flag), 0).otherwise(1)).over(w), F.lit(0)))
    extra = ["__bad"] if section_flag else []
    board = own.where("in_allowed").select("trip_id", F.col("stop_seq").alias("board_seq"), F.col("location_id").alias("from_id"), "dep", *(F.col(c).alias("__b") for c in extra))
    alight = own.where("out_allowed").select("trip_id", F.col("stop_seq").alias("alight_seq"), F.col("location_id").alias("to_id"), "arr", *extra)
    pairs = boards.join(board, ["trip_id", "board_seq"]).join(alight, "trip_id").where("alight_seq > board_seq and from_id <> to_id")
    return pairs.where("__bad = __b").drop("__bad", "__b") if section_flag else pairs


def all_rides(stop_events: DataFrame, section_flag: str | None = None) -> DataFrame:
    return rides(stop_events, stop_events.where("in_allowed").select("trip_id", F.col("stop_seq").alias("board_seq")), section_flag)


def paired(stop_events: DataFrame, board_at: DataFrame, alight_at: DataFrame) -> DataFrame:
    """(trip_id, board_seq, alight_seq, from_id, to_id, dep, arr): along each trip the first stop of board_at with the first later one of
    alight_at, then the same again from there on. Both are (location_id)."""
    on = stop_events.join(board_at.select("location_id", F.lit(True).alias("__b")).distinct(), "location_id", "left").join(alight_at.select("location_id", F.lit(True).alias("__a")).distinct(), "location_id", "left")
    on = on.where("(__b and in_allowed) or (__a and out_allowed)").select("trip_id", "stop_seq", "location_id", "arr", "dep", F.coalesce(F.col("__b") & F.col("in_allowed"), F.lit(False)).alias("b"), F.coalesce(F.col("__a") & F.col("out_allowed"), F.lit(False)).alias("a"))
    done = F.sum(F.col("a").cast("int")).over(Window.partitionBy("trip_id").orderBy("stop_seq").rowsBetween(Window.unboundedPreceding, 0))
    # What is boarded after n alighting stops is left at the next one.
    cells = on.withColumn("done", done).withColumn("part", F.explode(F.array(F.when(F.col("b"), F.col("done")), F.when(F.col("a"), F.col("done") - 1)))).where("part is not null")
    board, alight = F.when((F.col("part") == F.col("done")) & F.col("b"), F.struct("stop_seq", "location_id", "dep")), F.when((F.col("part") == F.col("done") - 1) & F.col("a"), F.struct("stop_seq", "location_id", "arr"))
    met = cells.groupBy("trip_id", "part").agg(F.min(board).alias("x"), F.max(alight).alias("y")).where("x is not null and y is not null")
    return met.select("trip_id", F.col("x.stop_seq").alias("board_seq"), F.col("y.stop_seq").alias("alight_seq"), F.col("x.location_id").alias("from_id"), F.col("y.location_id").alias("to_id"), "x.dep", "y.arr")


def top(connections: DataFrame, n: int, order: list[str], where: str | None = None) -> DataFrame:
    """The first n connections by the order that meet a condition."""
    return (connections.where(where) if where else connections).orderBy(*order).limit(n)


def alternatives(legs: DataFrame, connections: DataFrame, n: int) -> DataFrame:
    """For each leg (leg_id, from_id, to_id, ready, trip_id) the n earliest other connections that leave when one is ready."""
    fits = legs.withColumnRenamed("trip_id", "own").join(connections, ["from_id", "to_id"]).where("dep >= ready and trip_id <> own")
    w = Window.partitionBy("leg_id").orderBy("arr", F.desc("dep"), "trip_id", "board_seq", "alight_seq")
    return fits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("leg_id", "nth", "trip_id", "board_seq", "alight_seq", "dep", "arr")


def slow(connections: DataFrame, factor: float) -> DataFrame:
    """Connections that take at most factor times the shortest of their two stops."""
    took = F.col("arr") - F.col("dep")
    return connections.withColumn("best", F.min(took).over(Window.partitionBy("from_id", "to_id"))).where(took <= F.col("best") * factor).drop("best")


def transfers(stop_events: DataFrame, locations: DataFrame, footpaths: DataFrame, most: int = 60, uturns: bool = False) -> DataFrame:
    """(from_trip, from_seq, to_trip, to_seq, wait): from each arrival, over the stop's transfer time or a footpath, the first departure
    of each route within so many minutes. A change that only goes back where the trip came from is left out.

    Departures are cut into cells of that many minutes, so the range join is an equi-join on (location, cell). They lie in their cell and the one
    before, so an arrival, which lies in one, sees all that it may take there and its first departures are picked before anything is moved on.
    """
    w = Window.partitionBy("trip_id").orderBy("stop_seq")
    own = stop_events.withColumn("before", F.lag("location_id").over(w)).withColumn("after", F.lead("location_id").over(w))
    arrivals = own.where("out_allowed and stop_seq > 0").select(F.col("trip_id").alias("from_trip"), F.col("stop_seq").alias("from_seq"), "location_id", "arr", "before")
    stay = locations.select("location_id", F.col("location_id").alias("to_id"), F.col("transfer_min").alias("minutes"))
    walk = footpaths.select(F.col("from_id").alias("location_id"), "to_id", "minutes")
    at = F.floor((F.col("arr") + F.col("minutes")) / most)
    ready = arrivals.join(stay.unionByName(walk), "location_id").select("to_id", at.alias("cell"), "from_trip", "from_seq", (F.col("arr") + F.col("minutes")).alias("ready"), "before")
    on = F.floor(F.col("dep") / most)
    leaving = own.where("in_allowed and after is not null").select(F.col("trip_id").alias("to_trip"), F.col("stop_seq").alias("to_seq"), F.col("location_id").alias("to_id"), "dep", "after", F.col("route_id").alias("to_route"), F.explode(F.array(on, on - 1)).alias("cell"))
    fits = f"dep >= ready and dep - ready < {most} and from_trip <> to_trip"
    if uturns:
        # A departure is the first of its route where the one before it has left when one is ready, or is of the trip that one comes with and the one before that trip has
        # left: known from the departures alone, so that pairs needn't be sorted to find it.
        at_stop = Window.partitionBy("to_id", "cell", "to_route").orderBy("dep", "to_trip", "to_seq")
        leaving = leaving.where("to_trip is not null").repartition("to_id", "cell").withColumns({"__dep": F.lag("dep").over(at_stop), "__trip": F.lag("to_trip").over(at_stop)})
        other = F.when(F.col("__trip").isNull() | (F.col("__trip") != F.col("to_trip")), F.coalesce(F.col("__dep"), F.lit(_LONG_AGO)))
        leaving = leaving.withColumn("__other", F.last(other, ignorenulls=True).over(at_stop.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__other", F.lag("__other").over(at_stop))
        near = ready.join(leaving, ["to_id", "cell"]).where(f"{fits} and (__dep is null or __dep < ready or (__trip = from_trip and __other < ready))")
        if stay.unionByName(walk).groupBy("location_id", "to_id").count().where("count > 1").isEmpty():
            return near.groupBy("from_trip", "from_seq", "to_trip", "to_seq").agg(F.min(F.col("dep") - F.col("ready")).alias("wait"))
        near = near.select("to_id", "from_trip", "from_seq", "to_route", F.struct("dep", "to_trip", "to_seq", "ready").alias("x"))
    else:
        pairs = ready.join(leaving, ["to_id", "cell"]).where(f"{fits} and not (before <=> after)")
        # The keys of the join lead, so it is grouped where it lies; a change over several walks to one stop is then met in the trips' rows.
        near = pairs.groupBy("to_id", "cell", "from_trip", "from_seq", "to_route").agg(F.min(F.struct("dep", "to_trip", "to_seq", "ready")).alias("x"))
    first = near.repartition("from_trip", "from_seq").groupBy("from_trip", "from_seq", "to_id", "to_route").agg(F.min("x").alias("x"))
    return first.groupBy("from_trip", "from_seq", "x.to_trip", "x.to_seq").agg(F.min(F.col("x.dep") - F.col("x.ready")).alias("wait"))


def earliest_between(asked: DataFrame, stop_events: DataFrame, footpaths: DataFrame, cell: int = 60) -> DataFrame:
    """(query_id, trip_id, board_seq, alight_seq, dep, arr): for each of asked (query_id, from_id, to_id, ready, latest) the ride that is at to_id
    earliest, and by latest: over a footpath or none at each end. Such a ride may take the place of the middle leg of three.

    Rides no longer than the longest time that any query has are set against queries by stop and cell of so many minutes. A query carries the stops from which one walks
    to its end, so that a ride to elsewhere is dropped at once.
    """
    walk = footpaths.select("from_id", "to_id", "minutes")
    back = walk.groupBy("to_id").agg(F.collect_list(F.struct(F.col("from_id").alias("id"), F.col("minutes").cast("long").alias("more"))).alias("__back"))
    own = asked.where("ready <= latest").join(back, "to_id", "left")
    ends = F.concat(F.array(F.struct(F.col("to_id").alias("id"), F.lit(0).cast("long").alias("more"))), F.coalesce("__back", F.array().cast(back.schema["__back"].dataType)))
    own = own.select("query_id", "from_id", F.col("ready").cast("long").alias("ready"), "latest", ends.alias("ends"))
    ahead = own.withColumnRenamed("from_id", "board_id").unionByName(own.join(walk.withColumnRenamed("to_id", "board_id"), "from_id").select("query_id", "board_id", (F.col("ready") + F.col("minutes")).alias("ready"), "latest", "ends"))
    ahead = ahead.where("ready <= latest").withColumn("cell", F.explode(F.sequence(F.floor(F.col("ready") / cell), F.floor(F.col("latest") / cell))))
    longest = asked.agg(F.max(F.col("latest") - F.col("ready")).alias("__longest"))
    on = stop_events.where("in_allowed").select("trip_id", F.col("stop_seq").alias("board_seq"), F.col("location_id").alias("board_id"), "dep")
    off = stop_events.where("out_allowed").select("trip_id", F.col("stop_seq").alias("alight_seq"), F.col("location_id").alias("alight_id"), "arr")
    rode = on.crossJoin(F.broadcast(longest)).join(off, "trip_id").where("alight_seq > board_seq and arr - dep <= __longest").drop("__longest").withColumn("cell", F.floor(F.col("dep") / cell))
    met = ahead.join(rode, ["board_id", "cell"]).where("dep >= ready and arr <= latest")
    met = met.withColumn("e", F.explode(F.filter("ends", lambda e: (e["id"] == F.col("alight_id")) & (F.col("arr") + e["more"] <= F.col("latest")))))
    one = met.groupBy("query_id").agg(F.min(F.struct((F.col("arr") + F.col("e.more")).alias("arr"), "trip_id", "board_seq", "alight_seq", "dep")).alias("x"))
    return one.select("query_id", "x.trip_id", "x.board_seq", "x.alight_seq", "x.dep", "x.arr")
