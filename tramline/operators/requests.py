"""What is done to a query before it is searched: limits, vias, the guard of start and destination, and the interval to search."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.journeys import MAX_TRAVEL
from tramline.operators.matching import expand_locations

HOUR, DAY = 60, 24 * 60
#: Longest interval that is searched, in minutes.
MAX_INTERVAL = 28 * DAY


def travel_limit(minutes: int | None) -> int:
    """The asked limit on the travel time, or the greatest one where that is negative, missing or longer."""
    return minutes if minutes is not None and 0 <= minutes <= MAX_TRAVEL else MAX_TRAVEL


def merged_vias(vias: Sequence[tuple[int | str, int]], same_place: Iterable[tuple[int | str, int | str]] = ()) -> list[tuple[int | str, int]]:
    """Neighbouring vias (location_id, stay) at one place count as one that stays as long as both."""
    equal = {frozenset(p) for p in same_place}
    out: list[tuple[int | str, int]] = []
    for at, stay in vias:
        if out and (out[-1][0] == at or frozenset((out[-1][0], at)) in equal):
            out[-1] = (out[-1][0], out[-1][1] + stay)
        else:
            out.append((at, stay))
    return out


def overlapping(starts: DataFrame, targets: DataFrame, locations: DataFrame, start_mode: str = "equivalent", target_mode: str = "equivalent", equivalences: DataFrame | None = None) -> bool:
    """Whether a start and a destination (location_id), each by its mode, mean one place, so that there is nothing to search. Coordinates
    (mode intermodal) never do."""
    if "intermodal" in (start_mode, target_mode):
        return False
    a = expand_locations(starts.select("location_id").distinct(), locations, start_mode, equivalences).select("location_id")
    b = expand_locations(targets.select("location_id").distinct(), locations, target_mode, equivalences).select("location_id")
    return not a.join(b, "location_id", "left_semi").isEmpty()


@dataclass(frozen=True)
class Intervals:
    """Which interval to search first, and by what to extend it while there are too few connections.

    All times are minutes; timetable and at_most are intervals that nothing is searched beyond.
    """

    asked: tuple[int, int]
    timetable: tuple[int, int]
    least: int = 0
    earlier: bool = False
    later: bool = False
    backward: bool = False
    fastest_direct: bool = False
    at_most: tuple[int, int] | None = None

    def initial(self) -> tuple[int, int]:
        """An hour against the direction of the search, and an hour for each connection in it."""
        begin, end = self.asked
        if not self.least or not (self.earlier or self.later):
            return self.asked
        more = HOUR * self.least
        before, after = self._open(self.asked)
        if self.backward:
            if before:
                begin, end = begin - more - (0 if after else HOUR), end + (HOUR if after else 0)
            elif self.later:
                end += HOUR + more
        elif after:
            begin, end = begin - (HOUR if before else 0), end + more + (0 if before else HOUR)
        elif self.earlier:
            begin -= HOUR + more
        return self._clamped(begin, end)

    def extended(self, searched: tuple[int, int], missing: int) -> tuple[int, int]:
        """Longer by its own length for each connection that is missing, on one side or half on each."""
        if not missing or not (self.earlier or self.later):
            return searched
        begin, end = searched
        more = (end - begin) * missing
        if all(self._open(searched)):
            return self._clamped(begin - more // 2, end + more // 2)
        return self._clamped(begin - (more if self.earlier else 0), end + (more if self.later else 0))

    def widest(self) -> tuple[int, int]:
        return self._clamped(-(1 << 40), 1 << 40)

    def _open(self, own: tuple[int, int]) -> tuple[bool, bool]:
        return self.earlier and own[0] != self.timetable[0], self.later and own[1] != self.timetable[1]

    def _clamped(self, begin: int, end: int) -> tuple[int, int]:
        a, b = self.asked
        span = DAY if self.fastest_direct else 2 * DAY
        near = lambda t: (t + DAY // 2) // DAY * DAY
        reach = max(near(a - span), near(a + (b - a - MAX_INTERVAL) // 2)), min(near(b + span), near(a + (b - a + MAX_INTERVAL) // 2))
        for low, high in (self.timetable, reach, *([self.at_most] if self.at_most else [])):
            begin, end = min(max(begin, low), high), min(max(end, low), high)
        return begin, end


def ordered(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Journeys with nth, their place by departure and transfers (of equals, by arrival) among those of one query."""
    from pyspark.sql import Window

    return found.withColumn("nth", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("dep", "transfers", "arr")).cast("long"))


def counters(labels: DataFrame) -> DataFrame:
    """(query_id, round, by_ride, by_walk): how many labels of arrival each round of a search made better."""
    return labels.where("kind = 'arrive'").groupBy("query_id", "round").agg(F.count(F.when(F.col("walk_from").isNull(), 1)).alias("by_ride"), F.count("walk_from").alias("by_walk"))


def random_queries(locations: DataFrame, n: int, seed: int = 0, least_walk: int = 45, metres_a_minute: float = 90.0, attempts: int = 8, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(query_id, from_id, to_id): n random pairs of locations (location_id, lat, lng) in a box (low and high lat, low and high lng), equal for equal
    seeds. Of each query's attempts the first counts that is no walk of least_walk minutes; a query without any has no row.

    Each location is hashed with each attempt's number, and the least hash is drawn, without numbering the locations. The least hashes are plain
    numbers, which are aggregated in place; only who has them is then looked at as a whole.
    """
    from tramline.functions.geo import haversine_m

    own = locations.select("location_id", "lat", "lng")
    if box:
        own = own.where(F.col("lat").between(box[0], box[1]) & F.col("lng").between(box[2], box[3]))
    draws = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * attempts - 1))).alias("draw"))
    hashed = lambda salt: F.xxhash64("location_id", "draw", F.lit(2 * seed + salt))
    least = draws.groupBy("draw").agg(F.min(hashed(0)).alias("__a"), F.min(hashed(1)).alias("__b"))
    drawn = draws.join(F.broadcast(least), "draw").where((hashed(0) == F.col("__a")) | (hashed(1) == F.col("__b")))
    pick = lambda salt: F.min(F.struct(hashed(salt).alias("h"), "location_id", "lat", "lng"))
    pairs = drawn.groupBy("draw").agg(pick(0).alias("a"), pick(1).alias("b"))
    far = haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) > least_walk * metres_a_minute
    query = F.floor(F.col("draw") / attempts)
    good = pairs.where(far & (F.col("a.location_id") != F.col("b.location_id"))).groupBy(query.alias("query_id")).agg(F.min(F.struct("draw", F.col("a.location_id").alias("from_id"), F.col("b.location_id").alias("to_id"))).alias("x"))
    return good.select("query_id", "x.from_id", "x.to_id")
