"""Routes: groups of trips with one stop sequence, their filters and what is derived from them."""

from __future__ import annotations

from bisect import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.sorted_groups import by_group

#: Weights by position; further classes weigh nothing.
CLASS_WEIGHT = (20, 20, 20, 20, 20, 16, 15, 10, 10, 3, 2, 10, 1)


def grouped(stop_events: DataFrame) -> DataFrame:
    """(trip_id, route_key): trips of equal class, stops and boarding flags have an equal key."""
    stop = F.struct("stop_seq", "location_id", "in_allowed", "out_allowed")
    whole = stop_events.groupBy("trip_id", "clasz").agg(F.array_sort(F.collect_list(stop)).alias("stops"))
    text = F.array_join(F.transform("stops", lambda s: F.concat_ws(":", s["location_id"], s["in_allowed"].cast("int"), s["out_allowed"].cast("int"))), ",")
    return whole.select("trip_id", F.concat_ws("|", F.col("clasz").cast("string"), text).alias("route_key"))


def without_overtaking(stop_events: DataFrame, keys: DataFrame) -> DataFrame:
    """(trip_id, route_key, sub_route): within a key, trips go to the first sub-route in which they overtake no other trip.

    Greedy in the order of first departure and trip; the trips of one key meet in one task, as their order decides.
    """
    times = stop_events.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_seq", "arr", "dep"))).alias("e")).select("trip_id", F.expr("transform(e, x -> x.arr)").alias("arr"), F.expr("transform(e, x -> x.dep)").alias("dep"))

    def split(rows: list[dict]) -> list[tuple]:
        # The trips of a sub-route are a chain, each behind the one before at all stops: one that is behind the last is behind all.
        chains: list[list[tuple[int, ...]]] = []
        lasts = None
        out = []
        for row in rows:
            # Compared modulo a day, by the first departure; times behind it keep their distance.
            shift = row["dep"][0] // 1440 * 1440
            own = tuple(t - shift for pair in zip(row["arr"], row["dep"], strict=True) for t in pair)
            if lasts is None:
                lasts = np.empty((16, len(own)), dtype=np.int64)
            elif lasts.shape[1] != len(own):
                raise ValueError("trips of one key have different numbers of stops")
            used = lasts[: len(chains)]
            behind = (used <= own).all(axis=1)
            for k in map(int, np.flatnonzero(behind | (used >= own).all(axis=1))):
                chain = chains[k]
                if behind[k]:
                    chain.append(own)
                    lasts[k] = own
                    break
                at = bisect(chain, own)
                if (at == 0 or all(x <= y for x, y in zip(chain[at - 1], own, strict=True))) and all(x >= y for x, y in zip(chain[at], own, strict=True)):
                    chain.insert(at, own)
                    break
            else:
                k = len(chains)
                if k == len(lasts):
                    lasts = np.concatenate([lasts, np.empty_like(lasts)])
                chains.append([own])
                lasts[k] = own
            out.append((row["trip_id"], row["route_key"], k))
        return out

    rows = keys.join(times, "trip_id").withColumn("first", F.col("dep")[0])
    return by_group(rows, ["route_key"], ["first", "trip_id"], split, "trip_id long, route_key string, sub_route long")


def flags(stop_events: DataFrame, flag: str, route: str = "route_id") -> DataFrame:
    """(route, every, some): whether all and whether any sections of a route have the flag."""
    return stop_events.groupBy(route).agg(F.bool_and(flag).alias("every"), F.bool_or(flag).alias("some"))


def in_class_mask(rows: DataFrame, mask: int, clasz: str = "clasz") -> DataFrame:
    return rows.where(F.expr(f"(shiftleft(1, cast({clasz} as int)) & {mask}) <> 0"))


def lower_bound_edges(stop_events: DataFrame, footpaths: DataFrame, roots: DataFrame) -> DataFrame:
    """(from_id, to_id, minutes): the least time between neighbours by ride or on foot, between roots; roots is (location_id, root_id)."""
    from tramline.operators.stop_times import sections

    rides = sections(stop_events).select("from_id", "to_id", (F.col("arr") - F.col("dep")).alias("minutes")).groupBy("from_id", "to_id").agg(F.min("minutes").alias("minutes"))
    both = rides.unionByName(footpaths.select("from_id", "to_id", "minutes"))
    a, b = roots.select(F.col("location_id").alias("from_id"), F.col("root_id").alias("a")), roots.select(F.col("location_id").alias("to_id"), F.col("root_id").alias("b"))
    return both.join(a, "from_id").join(b, "to_id").where("a <> b").groupBy(F.col("a").alias("from_id"), F.col("b").alias("to_id")).agg(F.min("minutes").alias("minutes"))


def importance(stop_events: DataFrame, service_days: DataFrame, locations: DataFrame) -> DataFrame:
    """(location_id, importance): active days of the trips that call, times the weight of their class, at the parent."""
    days = service_days.groupBy("trip_id").agg(F.count("*").alias("n"))
    weight = F.coalesce(F.try_element_at(F.array(*map(F.lit, CLASS_WEIGHT)), F.col("clasz") + 1), F.lit(0))
    calls = stop_events.select("trip_id", "location_id", "clasz").distinct().join(days, "trip_id").groupBy("location_id").agg(F.sum(F.col("n") * weight).alias("x"))
    return calls.join(locations.select("location_id", F.coalesce("parent_id", "location_id").alias("root")), "location_id").groupBy(F.col("root").alias("location_id")).agg(F.sum("x").cast("long").alias("importance"))


def roots(locations: DataFrame, hops: int = 21) -> DataFrame:
    """(location_id, root_id): the top of the parents' chain. On a cycle, or where the top is more than hops steps up, the parent itself.

    Each round doubles the steps that are taken, so 21 steps are five joins.
    """
    parent = locations.where("parent_id is not null").select("location_id", "parent_id")
    up = parent.select("location_id", F.col("parent_id").alias("root_id"), F.lit(1).alias("steps"))
    taken = 1
    while taken <= hops:
        above = up.select(F.col("location_id").alias("root_id"), F.col("root_id").alias("above"), F.col("steps").alias("more"))
        up = up.join(above, "root_id", "left").select("location_id", F.coalesce("above", "root_id").alias("root_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        taken *= 2
    done = up.join(parent.select(F.col("location_id").alias("root_id"), F.lit(True).alias("on")), "root_id", "left")
    top = done.select("location_id", F.when(F.col("on").isNull() & (F.col("steps") <= hops), F.col("root_id")).alias("root_id"))
    return locations.select("location_id", "parent_id").join(top, "location_id", "left").select("location_id", F.coalesce("root_id", "parent_id", "location_id").alias("root_id"))


def merged_days(service_days: DataFrame, pairs: DataFrame) -> DataFrame:
    """(trip_id, day, disabled) for the dropped trips of duplicates(): the days that are left to them, and whether none is; a trip
    without any has one row with day null."""
    days = service_days.join(pairs.select(F.col("dropped").alias("trip_id")).distinct(), "trip_id", "left_semi").select("trip_id", "day")
    left = days.join(pairs.select(F.col("dropped").alias("trip_id"), "day").distinct(), ["trip_id", "day"], "left_anti")
    trips = days.select("trip_id").distinct()
    return trips.join(left, "trip_id", "left").select("trip_id", "day", F.col("day").isNull().alias("disabled"))


def duplicates(stop_events: DataFrame, service_days: DataFrame, equivalent: DataFrame) -> DataFrame:
    """(kept, dropped, day): pairs of trips over equivalent stops with one first departure, whose times differ by less than
    a minute a stop in all, on their common days. equivalent is (location_id, group_id)."""
    named = stop_events.join(equivalent, "location_id")
    whole = named.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_seq", "group_id", "arr", "dep"))).alias("e")).select("trip_id", F.expr("transform(e, x -> x.group_id)").alias("path"), F.expr("transform(e, x -> x.arr)").alias("arr"), F.expr("transform(e, x -> x.dep)").alias("dep"))
    whole = whole.withColumn("first", F.col("dep")[0]).withColumn("path_key", F.sha2(F.array_join(F.transform("path", lambda x: x.cast("string")), ","), 256))
    a, b = whole.select("path_key", "first", *(F.col(c).alias(f"a_{c}") for c in ("trip_id", "arr", "dep"))), whole.select("path_key", "first", *(F.col(c).alias(f"b_{c}") for c in ("trip_id", "arr", "dep")))
    gap = lambda c: F.aggregate(F.zip_with(f"a_{c}", f"b_{c}", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, d: s + d)
    pairs = a.join(b, ["path_key", "first"]).where("a_trip_id < b_trip_id").where(gap("arr") + gap("dep") < F.size("a_arr"))
    pairs = pairs.select(F.col("a_trip_id").alias("kept"), F.col("b_trip_id").alias("dropped"))
    days = service_days.select("trip_id", "day")
    return pairs.join(days.withColumnRenamed("trip_id", "kept"), "kept").join(days.withColumnRenamed("trip_id", "dropped"), ["dropped", "day"]).select("kept", "dropped", "day")


def chained(stop_events: DataFrame, trips: DataFrame, service_days: DataFrame) -> DataFrame:
    """(block_id, first_trip, next_trip, day): trips of a block that a vehicle runs one after the other on a day: the next
    one by first departure that doesn't leave before the arrival, at the stop where the other one ends."""
    ends = stop_events.groupBy("trip_id").agg(F.min_by("location_id", "stop_seq").alias("from_id"), F.max_by("location_id", "stop_seq").alias("to_id"), F.min_by("dep", "stop_seq").alias("dep"), F.max_by("arr", "stop_seq").alias("arr"))
    runs = ends.join(trips.select("trip_id", "block_id"), "trip_id").join(service_days, "trip_id")
    w = Window.partitionBy("block_id", "day").orderBy("dep", "trip_id")
    after = runs.select("block_id", "day", F.col("trip_id").alias("first_trip"), "to_id", "arr", F.lead("trip_id").over(w).alias("next_trip"), F.lead("from_id").over(w).alias("next_from"), F.lead("dep").over(w).alias("next_dep"))
    return after.where("to_id = next_from and next_dep >= arr").select("block_id", "first_trip", "next_trip", "day")


def seated_paths(links: DataFrame, trips: DataFrame) -> DataFrame:
    """(path, trips): all paths from trips without a predecessor to trips without a successor over links (from_trip, to_trip).

    Links form small components; each is walked in one task after its label is known. A cycle has no such path and gives none.
    """
    from tramline.operators.graph import components

    labels = components(links.select(F.col("from_trip").alias("a"), F.col("to_trip").alias("b")))

    def walk(rows: list[dict]) -> list[tuple]:
        after: dict[int, list[int]] = {}
        for row in rows:
            after.setdefault(row["from_trip"], []).append(row["to_trip"])
        starts = sorted(set(after) - {row["to_trip"] for row in rows})
        found, stack = [], [[s] for s in reversed(starts)]
        while stack:
            path = stack.pop()
            if path[-1] not in after:
                found.append((path[0], path[-1], ",".join(map(str, path))))
            stack += [[*path, n] for n in sorted(after.get(path[-1], []), reverse=True) if n not in path]
        return found

    known = links.join(labels.select(F.col("node").alias("from_trip"), "label"), "from_trip").join(trips.select(F.col("trip_id").alias("from_trip")), "from_trip", "left_semi")
    return by_group(known.select("label", "from_trip", "to_trip"), ["label"], ["from_trip", "to_trip"], walk, "first_trip long, last_trip long, trips string")


def seam(stop_events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stops of pairs (first_trip, next_trip) as one sequence; the stop where they meet has the first's arrival and alighting, the next's departure and boarding."""
    a = stop_events.join(pairs.select(F.col("first_trip").alias("trip_id"), "next_trip"), "trip_id").withColumnRenamed("trip_id", "first_trip").withColumn("part", F.lit(0))
    b = stop_events.join(pairs.select(F.col("next_trip").alias("trip_id"), "first_trip"), "trip_id").withColumnRenamed("trip_id", "next_trip").withColumn("part", F.lit(1))
    both = a.unionByName(b)
    key = Window.partitionBy("first_trip", "next_trip").orderBy("part", "stop_seq")
    last = F.lead("part").over(key) > F.col("part")
    met = both.select("first_trip", "next_trip", "part", "stop_seq", "location_id", "arr", F.when(last, F.lead("dep").over(key)).otherwise(F.col("dep")).alias("dep"), F.when(last, F.lead("in_allowed").over(key)).otherwise(F.col("in_allowed")).alias("in_allowed"), "out_allowed")
    return met.where("not (part = 1 and stop_seq = 0)").withColumn("position", F.row_number().over(key) - 1).drop("part", "stop_seq")
