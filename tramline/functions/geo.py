"""Distances and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M, WALK_M_S = 6371000.0, 111320.0, 1.5


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    # Not least(): that skips nulls, and an unknown place would lie half around the world.
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def walk_minutes(metres: Column) -> Column:
    return F.round(metres / (60 * WALK_M_S)).cast("long")


def cell(lat: Column, lng: Column, metres: float, max_lat: float = 80.0) -> tuple[Column, Column]:
    """A grid whose cells are at least so many metres wide up to max_lat; neighbours within that distance are in adjacent cells."""
    import math

    return F.floor(lat * DEGREE_M / metres).cast("long"), F.floor(lng * DEGREE_M * math.cos(math.radians(max_lat)) / metres).cast("long")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of structs (x, y), by the parity of edges that a ray to the right crosses."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1
