"""Round-based journey search over label tables; one run answers many queries at once.

Stop events are (trip_id, stop_seq, location_id, arr, dep, in_allowed, out_allowed) with absolute minutes. In each round,
labels board trips, ride to all later stops, and change there or walk on. A round is one job: what may come next is joined with the
state, which has the best time of each label, by one aggregation, and the new state is written to the folder that all executors
share. Only labels that became better go into the next round, and the loop ends without any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tramline.functions.storage import written
from tramline.functions.times import adjusted_transfer

MAX_TRANSFERS, MAX_TRAVEL = 14, 24 * 60
_LEGS = ["trip_id", "board_seq", "alight_seq", "board_id"]


@dataclass
class Search:
    """What rides and walks a search may use.

    vias are pairs (location_id, stay) in order. td_edges are time-dependent walks as matching.td_forward takes them. require names
    flags of whole trips (bikes, cars), section_flag one of the section that begins at a stop. With wheelchair one boards and alights
    only where in_wheelchair and out_wheelchair allow it too. In a search that is backward, all times are negative, see mirrored().
    """

    stop_events: DataFrame
    locations: DataFrame
    footpaths: DataFrame
    td_edges: DataFrame | None = None
    vias: Sequence[tuple[int | str, int]] = ()
    class_mask: int | None = None
    section_flag: str | None = None
    require: Sequence[str] = ()
    wheelchair: bool = False
    backward: bool = False
    least_transfer: int = 0
    additional_transfer: int = 0
    transfer_factor: float = 1.0
    max_travel: int = MAX_TRAVEL
    _events: DataFrame | None = field(default=None, repr=False)
    _moves: DataFrame | None = field(default=None, repr=False)

    def events(self) -> DataFrame:
        if self._events is None:
            own = self.stop_events
            if self.class_mask is not None:
                own = own.where(F.expr(f"(shiftleft(1, cast(clasz as int)) & {self.class_mask}) <> 0"))
            for trip_flag in self.require:
                own = own.where(F.col(trip_flag))
            if self.wheelchair:
                own = own.withColumns({"in_allowed": F.col("in_allowed") & F.col("in_wheelchair"), "out_allowed": F.col("out_allowed") & F.col("out_wheelchair")})
            columns = ["trip_id", "stop_seq", "location_id", "arr", "dep", "in_allowed", "out_allowed"]
            if self.section_flag:
                w = Window.partitionBy("trip_id").orderBy("stop_seq").rowsBetween(Window.unboundedPreceding, -1)
                own = own.withColumn("bad", F.coalesce(F.sum(F.when(F.col(self.section_flag), 0).otherwise(1)).over(w), F.lit(0)))
                columns.append("bad")
            self._events = written(own.select(*columns), "events")
        return self._events

    def moves(self) -> DataFrame:
        """(location_id, to_id, kind, minutes, walk): what follows an arrival: being there, changing there, and footpaths, after which one
        is there and may board at once. A stop with time-dependent walks has no other ones."""
        if self._moves is None:
            at = F.col("location_id")
            stay = [F.struct(F.lit("arrive").alias("kind"), F.lit(0).cast("long").alias("minutes")), F.struct(F.lit("board").alias("kind"), self._walk(F.col("transfer_min")).cast("long").alias("minutes"))]
            own = self.locations.select(at, at.alias("to_id"), F.explode(F.array(*stay)).alias("x")).select("location_id", "to_id", "x.kind", "x.minutes", F.lit(False).alias("walk"))
            walks = self.footpaths.select(F.col("from_id").alias("location_id"), "to_id", F.explode(F.array(F.lit("arrive"), F.lit("board"))).alias("kind"), self._walk(F.col("minutes")).cast("long").alias("minutes"), F.lit(True).alias("walk"))
            if self.td_edges is not None:
                walks = walks.join(self.td_edges.select(F.col("to_id" if self.backward else "from_id").alias("location_id")).distinct(), "location_id", "left_anti")
            self._moves = written(own.unionByName(walks), "moves")
        return self._moves

    def reversed(self) -> Search:
        """The same search with time running backwards."""
        flags = (self.section_flag,) if self.section_flag else ()
        walks = self.footpaths.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "minutes")
        return replace(self, stop_events=mirrored(self.stop_events, flags), footpaths=walks, vias=tuple(reversed(self.vias)), backward=not self.backward, _events=None, _moves=None)

    def _walk(self, minutes):
        return adjusted_transfer(minutes, self.least_transfer, self.additional_transfer, self.transfer_factor)


def mirrored(stop_events: DataFrame, section_flags: Sequence[str] = ()) -> DataFrame:
    """Time runs backwards: arrivals and departures, boarding and alighting change places. A flag of the section that begins at a stop goes
    to the stop where it ends."""
    own, w = stop_events, Window.partitionBy("trip_id").orderBy("stop_seq")
    for flag in section_flags:
        own = own.withColumn(flag, F.coalesce(F.lag(flag).over(w), F.lit(True)))
    swapped = (("arr", "dep"), ("in_allowed", "out_allowed"), ("in_wheelchair", "out_wheelchair"))
    turned = {a: F.col(b) for pair in swapped for a, b in (pair, pair[::-1])} | {"stop_seq": -F.col("stop_seq"), "arr": -F.col("dep"), "dep": -F.col("arr")}
    return own.select(*(turned[c].alias(c) if c in turned else F.col(c) for c in own.columns))


def rounds(search: Search, starts: DataFrame, most: int = MAX_TRANSFERS + 1, targets: DataFrame | None = None, profile: bool = False) -> DataFrame:
    """(query_id, via, round, kind, location_id, arr, trip_id, board_seq, alight_seq, board_id, walk_from): for each round and stop the
    best arrival (kind arrive) and the best time from which one can board there (kind board), if better than in all rounds before.

    starts are (query_id, location_id, time): labels to board from. trip_id .. board_id tell the ride that leads there,
    walk_from the stop at which it was left, where a footpath follows. The earliest boarding of a trip is the one that is kept.

    With targets (location_id, minutes) no label goes on that can't come earlier there than in the rounds before; a query that starts at a
    target has none. With profile, query_id is the time of setting out, and a label that one who sets out later has as early, with as few
    rides, doesn't go on.
    """
    events, moves = search.events(), search.moves()
    flag = ["bad"] if search.section_flag else []
    key = ["kind", "query_id", "via", "location_id"]
    at_type = events.schema["location_id"].dataType.simpleString()
    fields = ["arr", "walked", "walk_from", *_LEGS]
    types = {"arr": "bigint", "walked": "boolean", "walk_from": at_type, "trip_id": events.schema["trip_id"].dataType.simpleString(), "board_seq": events.schema["stop_seq"].dataType.simpleString(), "alight_seq": events.schema["stop_seq"].dataType.simpleString(), "board_id": at_type}
    label = "struct<" + ",".join(f"{f}:{types[f]}" for f in fields) + ">"
    first = starts.groupBy("query_id", "location_id").agg(F.min("time").cast("long").alias("best")).withColumn("begin", F.min("best").over(Window.partitionBy("query_id")))
    state = first.select(F.explode(F.array(F.lit("arrive"), F.lit("board"))).alias("kind"), "query_id", F.lit(0).alias("via"), "location_id", "begin", "best", (F.col("kind") == "board").alias("fresh"))
    found: list[DataFrame] = []
    vias = None
    if search.vias:
        vias = starts.sparkSession.createDataFrame([(i, at, int(stay)) for i, (at, stay) in enumerate(search.vias)], f"via int, location_id {at_type}, stay int")
    on = events.where("in_allowed").select("trip_id", F.col("stop_seq").alias("board_seq"), "location_id", "dep", *(F.col(c).alias(f"board_{c}") for c in flag))
    off = events.where("out_allowed").select("trip_id", F.col("stop_seq").alias("alight_seq"), "location_id", "arr", *flag)
    for k in range(1, most + 1):
        frontier = state.where("fresh and kind = 'board'").select("query_id", "via", "location_id", "begin", F.col("best").alias("time"))
        boarded = frontier.join(on, "location_id").where(f"dep >= time and dep - time <= {search.max_travel}")
        # Sections that a flag forbids part a trip: each part is boarded by itself.
        part = [F.col(f"board_{c}") for c in flag]
        boarded = boarded.groupBy("query_id", "via", "begin", "trip_id", *part).agg(F.min(F.struct("board_seq", F.col("location_id").alias("board_id"))).alias("x")).select("query_id", "via", "begin", "trip_id", *part, "x.board_seq", "x.board_id", F.col("x.board_seq").alias("from_seq"))
        if vias is not None:
            stops = events.select("trip_id", "stop_seq", "location_id")
            crossed = boarded
            for _ in search.vias:
                hit = crossed.join(F.broadcast(vias.where("stay = 0").select("via", "location_id")), "via").join(stops, ["trip_id", "location_id"]).where("stop_seq > from_seq")
                crossed = hit.groupBy("query_id", "via", "begin", "trip_id", "board_seq", "board_id", *part).agg((F.min("stop_seq") - 1).alias("from_seq")).withColumn("via", F.col("via") + 1)
                boarded = boarded.unionByName(crossed)
        rode = boarded.join(off, "trip_id").where(f"alight_seq > from_seq and location_id <> board_id and arr - begin <= {search.max_travel}")
        if flag:
            rode = rode.where("bad = board_bad")
        arrived = _earliest(rode)
        if vias is not None:
            stay = arrived.join(F.broadcast(vias), ["via", "location_id"]).select("query_id", (F.col("via") + 1).alias("via"), "begin", "location_id", (F.col("arr") + F.col("stay")).alias("arr"), *_LEGS)
            arrived = _earliest(arrived.unionByName(stay.select(*arrived.columns)))
        # A ride counts only where it comes earlier than any label before, the starts among them; else one can't walk on from it either.
        arrived = arrived.join(state.where("kind = 'arrive'").select("query_id", "via", "location_id", "best"), key[1:], "left").where("best is null or arr < best").drop("best")
        if targets is not None:
            there = state.where((F.col("kind") == "arrive") & (F.col("via") == len(search.vias))).join(targets.select("location_id", "minutes"), "location_id")
            limit = there.groupBy("query_id").agg(F.min(F.col("best") + F.col("minutes")).alias("limit"))
            arrived = arrived.join(limit, "query_id", "left").where("limit is null or arr < limit").drop("limit")
        after = arrived.join(moves, "location_id").select("kind", "query_id", "via", F.col("to_id").alias("location_id"), "begin", (F.col("arr") + F.col("minutes")).alias("arr"), F.col("walk").alias("walked"), F.when(F.col("walk"), F.col("location_id")).alias("walk_from"), *_LEGS)
        if search.td_edges is not None:
            after = after.unionByName(_timed_walks(search, arrived).select(*after.columns))
        both = after.select(*key, "begin", F.lit(None).cast("long").alias("old"), F.struct(*(F.col(f).cast(types[f]).alias(f) for f in fields)).alias("x"))
        both = both.unionByName(state.select(*key, "begin", F.col("best").alias("old"), F.lit(None).cast(label).alias("x")))
        state = both.groupBy(*key).agg(F.max("begin").alias("begin"), F.min("old").alias("old"), F.min("x").alias("x"))
        state = state.select(*key, "begin", F.least("old", "x.arr").alias("best"), (F.col("x").isNotNull() & (F.col("old").isNull() | (F.col("x.arr") < F.col("old")))).alias("fresh"), "x", F.lit(k).alias("round"))
        if profile:
            later = F.min("best").over(Window.partitionBy("kind", "via", "location_id").orderBy(F.desc("query_id")).rowsBetween(Window.unboundedPreceding, -1))
            state = state.withColumn("later", later).withColumn("fresh", F.col("fresh") & (F.col("later").isNull() | (F.col("x.arr") < F.col("later")))).drop("later")
        seen = Observation()
        state = written(state.observe(seen, F.count(F.when(F.expr("fresh and kind = 'board'"), 1)).alias("n")), "labels")
        found.append(state.where("fresh").select("query_id", "via", "round", "kind", "location_id", "x.arr", *(f"x.{c}" for c in _LEGS), "x.walk_from"))
        if k == most or not seen.get["n"]:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _earliest(rode: DataFrame) -> DataFrame:
    return rode.groupBy("query_id", "via", "begin", "location_id").agg(F.min(F.struct("arr", *_LEGS)).alias("x")).select("query_id", "via", "begin", "location_id", "x.*")


def _timed_walks(search: Search, arrived: DataFrame) -> DataFrame:
    """What follows arrivals over time-dependent walks, of both kinds."""
    from tramline.operators.matching import td_backward, td_forward

    kinds = F.explode(F.array(F.lit("arrive"), F.lit("board"))).alias("kind")
    here, there = ("to_id", "from_id") if search.backward else ("from_id", "to_id")
    sign = -1 if search.backward else 1
    asked = arrived.select("query_id", F.col("location_id").alias(here), (F.col("arr") * sign).alias("time"), "via", "begin", *_LEGS)
    find = td_backward if search.backward else td_forward
    walks = find(asked.select("query_id", here, "time").distinct(), search.td_edges)
    met = asked.join(walks, ["query_id", here, "time"])
    return met.select(kinds, "query_id", "via", F.col(there).alias("location_id"), "begin", (F.col("time") * sign + F.col("minutes")).alias("arr"), F.lit(True).alias("walked"), F.col(here).alias("walk_from"), *_LEGS)


def one_to_all(labels: DataFrame, most: int | None = None, vias: int = 0) -> DataFrame:
    """(query_id, location_id, arr, round): the earliest arrival, and the fewest rounds for it, of at most so many rounds."""
    own = labels.where((F.col("kind") == "arrive") & (F.col("via") == vias))
    own = own.where(F.col("round") <= most) if most else own
    return own.groupBy("query_id", "location_id").agg(F.min(F.struct("arr", "round")).alias("x")).select("query_id", "location_id", "x.arr", "x.round")


def start_events(stop_events: DataFrame, offsets: DataFrame, begin: int, end: int, on_trip: bool = True) -> DataFrame:
    """(start_time, location_id, time): each departure that one reaches by setting out in [begin, end) over offsets (location_id, minutes),
    and one start at the end, which only serves to dominate."""
    leave = stop_events.where("in_allowed").join(offsets, "location_id").select((F.col("dep") - F.col("minutes")).alias("start_time"), "location_id", F.col("dep").alias("time")).where(f"start_time >= {begin} and start_time < {end}").distinct()
    if not on_trip:
        return leave
    return leave.unionByName(offsets.select(F.lit(end).cast("long").alias("start_time"), "location_id", (F.lit(end).cast("long") + F.col("minutes")).alias("time")))


def profile(search: Search, offsets: DataFrame, targets: DataFrame, begin: int, end: int, most: int = 3, extend: int = 0, least: int = 0, earlier: int = 0) -> DataFrame:
    """Pareto set (dep, arr, transfers) of all journeys that set out in [begin, end). All start times are queries of one run; labels that a
    later start dominates don't go on.

    With least, the interval grows by extend minutes at its end and by earlier ones at its begin until so many connections are found or the
    travel limit is reached.
    """
    from tramline.operators.skyline import journeys

    while True:
        starts = written(start_events(search.events(), offsets, begin, end).select(F.col("start_time").alias("query_id"), "location_id", "time"), "starts")
        ends = targets.select("location_id", "minutes")
        labels = rounds(search, starts, most, ends, profile=True).where((F.col("kind") == "arrive") & (F.col("via") == len(search.vias)))
        reached = labels.join(ends.withColumnRenamed("minutes", "egress"), "location_id").groupBy("query_id", "round").agg(F.min(F.col("arr") + F.col("egress")).alias("arr"))
        found = journeys(reached.select(F.lit(0).alias("k"), F.col("query_id").alias("dep"), "arr", (F.col("round") - 1).alias("transfers")), ["k"]).where(f"dep < {end}").select("dep", "arr", "transfers")
        if not least or extend + earlier <= 0:
            return found
        found = written(found, "journeys")
        if end - begin >= search.max_travel or found.count() >= least:
            return found
        begin, end = begin - earlier, end + extend


def ping_pong(search: Search, start: int | str, target: int | str, begin: int, most: int = 3) -> DataFrame:
    """(transfers, dep, arr): for each number of transfers the earliest arrival from begin on, and the latest departure for it."""
    spark = search.stop_events.sparkSession
    at_type = search.stop_events.schema["location_id"].dataType.simpleString()
    schema = f"query_id long, location_id {at_type}, time long"
    one = lambda at: spark.createDataFrame([(at, 0)], f"location_id {at_type}, minutes long")
    ahead = rounds(search, spark.createDataFrame([(0, start, begin)], schema), most, one(target))
    best = ahead.where((F.col("kind") == "arrive") & (F.col("location_id") == target) & (F.col("via") == len(search.vias))).select("round", "arr").collect()  # a row a round at most
    if not best:
        return spark.createDataFrame([], "transfers int, dep long, arr long")
    starts = spark.createDataFrame([(r["round"], target, -r["arr"]) for r in best], schema)
    reached = rounds(search.reversed(), starts, most, one(start)).where((F.col("kind") == "arrive") & (F.col("location_id") == start) & (F.col("via") == len(search.vias)) & F.expr("round <= query_id"))
    latest = reached.groupBy("query_id").agg((-F.min("arr")).alias("dep"))
    arrivals = spark.createDataFrame([(r["round"], r["arr"]) for r in best], "query_id long, arr long")
    return latest.join(arrivals, "query_id").select((F.col("query_id") - 1).cast("int").alias("transfers"), "dep", "arr")


def reconstruct(labels: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(query_id, target, transfers, leg, from_id, to_id, trip_id, board_seq, alight_seq, arr, walk_from): the legs that lead to targets (location_id), the
    last one first, by going back from round to round over the stop at which each ride was boarded."""
    columns = ["round", "arr", "trip_id", "board_seq", "alight_seq", "board_id", "walk_from"]
    own = labels.where("via = 0")
    board = own.where("kind = 'board'").select("query_id", F.col("location_id"), *columns)
    current = own.where("kind = 'arrive'").join(targets.select("location_id"), "location_id", "left_semi").select("query_id", F.col("location_id").alias("target"), (F.col("round") - 1).alias("transfers"), "location_id", *columns)
    out = None
    for leg in range(most):
        rows = current.select("query_id", "target", "transfers", F.lit(leg).alias("leg"), F.col("board_id").alias("from_id"), F.col("location_id").alias("to_id"), "trip_id", "board_seq", "alight_seq", "arr", "walk_from")
        out = rows if out is None else out.unionByName(rows)
        # A trip is boarded from a label of the round before, as only those go on.
        asked = current.where("round > 1").select("query_id", "target", "transfers", F.col("board_id").alias("location_id"), (F.col("round") - 1).alias("round"))
        current = written(asked.join(board, ["query_id", "location_id", "round"]), "legs")
        if leg + 1 < most and current.isEmpty():
            break
    return out


def on_trip_offsets(stop_events: DataFrame, locations: DataFrame, trip_id: int, stop_seq: int) -> DataFrame:
    """(location_id, time): when one who sits in a trip can change at each of its later stops."""
    return stop_events.where(f"trip_id = {trip_id} and stop_seq >= {stop_seq} and out_allowed").join(locations.select("location_id", "transfer_min"), "location_id").groupBy("location_id").agg(F.min(F.col("arr") + F.col("transfer_min")).alias("time"))


def fastest_walk(starts: DataFrame, targets: DataFrame, footpaths: DataFrame, factor: float = 1.0) -> DataFrame:
    """(minutes): the shortest walk from starts to targets, both (location_id, minutes), over one footpath or none."""
    a, b = starts.select("location_id", F.col("minutes").alias("m1")), targets.select(F.col("location_id").alias("to_id"), F.col("minutes").alias("m2"))
    stay = a.select("location_id", F.col("location_id").alias("to_id"), "m1", F.lit(0).cast("long").alias("walk"))
    walk = a.join(footpaths.select(F.col("from_id").alias("location_id"), "to_id", F.ceil(F.col("minutes") * F.lit(factor)).cast("long").alias("walk")), "location_id")
    return stay.unionByName(walk.select("location_id", "to_id", "m1", "walk")).join(b, "to_id").agg(F.min(F.col("m1") + F.col("walk") + F.col("m2")).alias("minutes")).where("minutes is not null")


def within_limits(found: DataFrame, walk_minutes: int | None, begin: int, end: int, max_travel: int = MAX_TRAVEL) -> DataFrame:
    """Journeys (dep, arr) faster than the walk alone, no longer than the limit, that set out in [begin, end)."""
    took = F.col("arr") - F.col("dep")
    own = found.where((took <= max_travel) & (F.col("dep") >= begin) & (F.col("dep") < end))
    return own if walk_minutes is None else own.where(took < walk_minutes)


def best_changes(rides: DataFrame, footpaths: DataFrame, importance: DataFrame, outer: DataFrame) -> DataFrame:
    """(from_trip, to_trip, alight_id, board_id): for pairs of trips the change of least penalty between them.

    rides are possible (from_trip, to_trip, alight_id, arr, board_id, dep); the penalty is the walk, less three times the stop's share of the greatest
    importance, less a fifth of the spare minutes up to 15. outer is unused rows' limit (from_trip, to_trip, latest) of the outer legs.
    """
    top = importance.agg(F.max("importance").alias("top"))
    own = rides.join(footpaths.select(F.col("from_id").alias("alight_id"), F.col("to_id").alias("board_id"), "minutes"), ["alight_id", "board_id"], "left").withColumn("minutes", F.coalesce("minutes", F.when(F.col("alight_id") == F.col("board_id"), 0)))
    own = own.join(outer, ["from_trip", "to_trip"], "left").where("minutes is not null and arr + minutes <= dep and (latest is null or dep <= latest)")
    own = own.join(importance.select(F.col("location_id").alias("alight_id"), "importance"), "alight_id", "left").crossJoin(F.broadcast(top))
    penalty = F.col("minutes") - 3 * F.coalesce(F.col("importance") / F.col("top"), F.lit(0.0)) - 0.2 * F.least(F.col("dep") - F.col("arr") - F.col("minutes"), F.lit(15))
    w = Window.partitionBy("from_trip", "to_trip").orderBy("penalty", "arr", "alight_id", "board_id")
    return own.withColumn("penalty", penalty).withColumn("nth", F.row_number().over(w)).where("nth = 1").select("from_trip", "to_trip", "alight_id", "board_id", "penalty")
