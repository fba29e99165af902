"""Measures of feeds, searches and result sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.sorted_groups import by_group

WEIGHTS = (1.0, 1.0, 30.0)
WORST, BEST = 2.2250738585072014e-308, 1.7976931348623157e308


def feeds(locations: DataFrame, stop_events: DataFrame, service_days: DataFrame) -> DataFrame:
    """Per source of the first stop: stops, trips, first and last day, and days times trips."""
    first = stop_events.groupBy("trip_id").agg(F.min_by("location_id", "stop_seq").alias("location_id"))
    trips = first.join(locations.select("location_id", "src"), "location_id").select("trip_id", "src")
    days = service_days.join(trips, "trip_id").groupBy("src").agg(F.countDistinct("trip_id").alias("trips"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("trip_days"))
    return locations.groupBy("src").agg(F.count("*").alias("locations")).join(days, "src", "left").select("src", "locations", F.coalesce("trips", F.lit(0).cast("long")).alias("trips"), "first_day", "last_day", F.coalesce("trip_days", F.lit(0).cast("long")).alias("trip_days"))


def quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, and exact quantiles."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.5, 0.9, 0.99)))


def improvement(a: tuple[float, ...], b: tuple[float, ...], weights: tuple[float, ...] = WEIGHTS) -> float:
    gaps = [(x - y) * w for x, y, w in zip(a, b, weights, strict=True)]
    gain = math.sqrt(sum(g * g for g in gaps if g < 0))
    if gain == 0:
        return 0.0
    far = math.sqrt(sum(g * g for g in gaps))
    return math.log2(gain * gain / far) * (math.atan(30.0 * (far - 0.1)) + math.pi / 2)


def _gained(a: list[tuple[float, ...]], b: list[tuple[float, ...]]) -> float:
    left, have, total = list(a), list(b), 0.0
    while left:
        scored = [min([BEST, *(improvement(x, y) for y in have)]) for x in left]
        best, at = WORST, 0
        for i, s in enumerate(scored):
            if s > best:
                best, at = s, i
        total += best
        have.append(left.pop(at))
    return total


def rating(a: list[tuple[float, ...]], b: list[tuple[float, ...]]) -> float:
    """How much better set a is than b; both hold (-departure, arrival, transfers)."""
    if not a or not b:
        return 0.0 if not a and not b else (BEST if a else WORST)
    return _gained(a, b) - _gained(b, a)


def ratings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, rating) for result sets (query_id, dep, arr, transfers); each query's two sets meet in one task."""
    both = a.select("query_id", "dep", "arr", "transfers", F.lit(0).alias("side")).unionByName(b.select("query_id", "dep", "arr", "transfers", F.lit(1).alias("side")))

    def rate(rows: list[dict]) -> list[tuple]:
        sides = [sorted((-float(r["dep"]), float(r["arr"]), float(r["transfers"])) for r in rows if r["side"] == s) for s in (0, 1)]
        return [(rows[0]["query_id"], rating(*sides))]

    return by_group(both, ["query_id"], ["side"], rate, "query_id long, rating double")
