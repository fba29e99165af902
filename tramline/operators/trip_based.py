"""Search over the table of changes between trips: only segments of trips are queued, no stop is looked up in between.

A segment is a trip from one of its stops on. Each round rides all segments, and the changes that leave from their stops give the next
ones. A trip is queued again only from an earlier stop than before. Filters, vias and updates are for journeys.rounds().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tramline.functions.storage import written


def all_changes(stop_events: DataFrame, locations: DataFrame, footpaths: DataFrame, longest: int = 24 * 60) -> DataFrame:
    """(from_trip, from_seq, to_trip, to_seq): each change that one can make within so many minutes, of a trip the first stop at each place.

    A change to a trip is left out where an earlier or equal stop of it can be reached from a later stop of the first trip.
    """
    from pyspark.sql import Window

    stay = locations.select("location_id", F.col("location_id").alias("to_id"), F.col("transfer_min").alias("minutes"))
    walk = stay.unionByName(footpaths.select(F.col("from_id").alias("location_id"), "to_id", "minutes"))
    off = stop_events.where("out_allowed").select(F.col("trip_id").alias("from_trip"), F.col("stop_seq").alias("from_seq"), "location_id", "arr").join(walk, "location_id").select("from_trip", "from_seq", "to_id", (F.col("arr") + F.col("minutes")).alias("ready"))
    off = off.withColumn("cell", F.explode(F.array(F.floor(F.col("ready") / longest), F.floor(F.col("ready") / longest) + 1)))
    on = stop_events.where("in_allowed").select(F.col("trip_id").alias("to_trip"), F.col("stop_seq").alias("to_seq"), F.col("location_id").alias("to_id"), "dep", F.floor(F.col("dep") / longest).alias("cell"))
    pairs = off.join(on, ["to_id", "cell"]).where(f"dep >= ready and dep - ready <= {longest} and from_trip <> to_trip")
    first = pairs.groupBy("from_trip", "from_seq", "to_trip").agg(F.min("to_seq").alias("to_seq"))
    w = Window.partitionBy("from_trip", "to_trip").orderBy(F.desc("from_seq")).rowsBetween(Window.unboundedPreceding, -1)
    # What leaves later and boards as early or earlier reaches all that this one does, from every segment that has this one.
    return first.withColumn("later", F.min("to_seq").over(w)).where("later is null or to_seq < later").drop("later")


def search(stop_events: DataFrame, changes: DataFrame, starts: DataFrame, footpaths: DataFrame | None = None, most: int = 3, max_travel: int = 24 * 60) -> DataFrame:
    """(query_id, transfers, location_id, arr): for each number of transfers the earliest arrival at each stop, if earlier than with fewer.

    starts are (query_id, location_id, time), changes (from_trip, from_seq, to_trip, to_seq). Footpaths lead on from the last stop.
    """
    events = written(stop_events.select("trip_id", "stop_seq", "location_id", "arr", "dep", "in_allowed", "out_allowed"), "events")
    on = events.where("in_allowed").select("trip_id", "stop_seq", "location_id", "dep")
    first = starts.join(on, "location_id").where(f"dep >= time and dep - time <= {max_travel}").groupBy("query_id", "trip_id").agg(F.min("stop_seq").alias("s"))
    state = written(first.select("query_id", "trip_id", F.col("s").alias("best"), F.lit(True).alias("fresh"), F.lit(0).alias("k")), "segments")
    found = []
    for k in range(most):
        fresh = state.where("fresh").select("query_id", "trip_id", F.col("best").alias("s"))
        found.append(fresh.withColumn("transfers", F.lit(k)))
        if k == most - 1:
            break
        after = fresh.join(changes.select(F.col("from_trip").alias("trip_id"), "from_seq", "to_trip", "to_seq"), "trip_id").where("from_seq > s").groupBy("query_id", F.col("to_trip").alias("trip_id")).agg(F.min("to_seq").alias("new"))
        both = state.select("query_id", "trip_id", "best", F.lit(None).cast("long").alias("new")).unionByName(after.select("query_id", "trip_id", F.lit(None).cast("long").alias("best"), F.col("new").cast("long")))
        both = both.groupBy("query_id", "trip_id").agg(F.min("best").alias("old"), F.min("new").alias("new"))
        seen = Observation()
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        state = written(both.select("query_id", "trip_id", F.least("old", "new").alias("best"), better.alias("fresh"), F.lit(k + 1).alias("k")).observe(seen, F.count(F.when(F.col("fresh"), 1)).alias("n")), "segments")
        if not seen.get["n"]:
            break
    segments = found[0]
    for f in found[1:]:
        segments = segments.unionByName(f)
    off = events.where("out_allowed").select("trip_id", "stop_seq", "location_id", "arr")
    arrived = segments.join(off, "trip_id").where("stop_seq > s").select("query_id", "transfers", "location_id", "arr")
    if footpaths is not None:
        # Nobody walks on from where the journey began: one was there before.
        arrived = arrived.groupBy("query_id", "transfers", "location_id").agg(F.min("arr").alias("arr")).join(starts.select("query_id", "location_id"), ["query_id", "location_id"], "left_anti").select("query_id", "transfers", "location_id", "arr")
        arrived = arrived.unionByName(arrived.join(footpaths, F.col("location_id") == F.col("from_id")).select("query_id", "transfers", F.col("to_id").alias("location_id"), (F.col("arr") + F.col("minutes")).alias("arr")))
    best = arrived.groupBy("query_id", "transfers", "location_id").agg(F.min("arr").alias("arr"))
    from tramline.operators.skyline import improving

    return improving(best, ["query_id", "location_id"], "arr", "transfers")
