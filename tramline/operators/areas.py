"""Flexible service areas, shapes and their boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.geo import in_ring


def boxed(areas: DataFrame) -> DataFrame:
    """Adds the box of each area (area_id, ring, holes): ring is an array of structs (x, y), holes an array of rings."""
    low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
    return areas.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")})


def inside(locations: DataFrame, areas: DataFrame, size: float = 0.01, cells: int = 100_000) -> DataFrame:
    """(area_id, location_id): points in areas but not in their holes. Points and boxes meet in grid cells of that many degrees, an
    equi-join; areas that span more than so many cells are compared with all points."""
    own = boxed(areas)
    across = lambda a, b: F.floor(F.col(b) / size) - F.floor(F.col(a) / size) + 1
    own = own.withColumn("__n", across("x0", "x1") * across("y0", "y1"))
    points = locations.select("location_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    gx, gy = F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)), F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))
    fine = own.where(F.col("__n") <= cells).withColumn("cx", F.explode(gx)).withColumn("cy", F.explode(gy))
    hit = points.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size)).join(fine, ["cx", "cy"]).drop("cx", "cy")
    wide = points.crossJoin(own.where(F.col("__n") > cells))
    both = hit.unionByName(wide).where("x between x0 and x1 and y between y0 and y1")
    ok = in_ring(F.col("x"), F.col("y"), F.col("ring")) & ~F.coalesce(F.exists("holes", lambda h: in_ring(F.col("x"), F.col("y"), h)), F.lit(False))
    return both.where(ok).select("area_id", "location_id").distinct()


def lines(points: DataFrame) -> DataFrame:
    """(shape_id, points): the points of shapes (shape_id, sequence, lat, lng), in any order, by sequence."""
    return points.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "lat", "lng"))).alias("points"))


def sliced(shapes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(shape_id, first, last, points): the points from offset first to last, both of them included."""
    return shapes.join(ranges, "shape_id").select("shape_id", "first", "last", F.slice("points", F.col("first") + 1, F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))).alias("points"))


def offsets_by_distance(stops: DataFrame, points: DataFrame) -> DataFrame:
    """(trip_id, stop_seq, offset): the first point (shape_id, sequence, travelled) that lies as far as the stop (trip_id, stop_seq, shape_id,
    travelled) or farther; the last point if none does. One merge of both in the order of distance."""
    numbered = points.withColumn("offset", F.row_number().over(Window.partitionBy("shape_id").orderBy("sequence")) - 1)
    both = stops.select("shape_id", "travelled", "trip_id", "stop_seq", F.lit(None).cast("int").alias("offset"), F.lit(0).alias("__p")).unionByName(numbered.select("shape_id", "travelled", F.lit(None).cast("long").alias("trip_id"), F.lit(None).cast("long").alias("stop_seq"), F.col("offset"), F.lit(1).alias("__p")))
    w = Window.partitionBy("shape_id")
    ahead = F.min("offset").over(w.orderBy("travelled", "__p").rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("o", F.coalesce(ahead, F.max("offset").over(w))).where("__p = 0").select("trip_id", "stop_seq", F.col("o").cast("long").alias("offset"))


def nearest_offsets(stops: DataFrame, points: DataFrame) -> DataFrame:
    """(trip_id, stop_seq, offset): the nearest point of the shape at or behind the one of the stop before; stops are (trip_id, stop_seq, shape_id, lat, lng).

    The stops of a trip depend on each other, so a trip's are folded in order, JVM-side, over its shape's points.
    """
    rows = stops.groupBy("trip_id", "shape_id").agg(F.array_sort(F.collect_list(F.struct("stop_seq", "lat", "lng"))).alias("stops")).join(lines(points), "shape_id")

    def far(s, p):
        return F.pow(s["lat"] - p["lat"], 2) + F.pow((s["lng"] - p["lng"]) * F.cos(F.radians(s["lat"])), 2)

    def step(acc, s):
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["offset"], F.lit(0))
        ranked = F.transform(F.col("points"), lambda p, i: F.when(i >= last, F.struct(far(s, p).alias("d"), i.alias("i"))))
        return F.concat(acc, F.array(F.struct(s["stop_seq"].alias("stop_seq"), F.array_min(ranked)["i"].alias("offset"))))

    empty = F.expr("cast(array() as array<struct<stop_seq:bigint,offset:int>>)")
    folded = rows.select("trip_id", F.explode(F.aggregate("stops", empty, step)).alias("x"))
    return folded.select("trip_id", "x.stop_seq", F.col("x.offset").cast("long").alias("offset"))


def boxes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The box of the points (lat, lng) of each key."""
    return rows.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"))


def windows_to_utc(areas: DataFrame, service_days: DataFrame, first_day: str, tz: str) -> DataFrame:
    """Flexible trips (trip_id, stop_seq, begin, end) in local minutes as windows in UTC minutes since first_day, on each service day."""
    from tramline.functions.times import noon_offset

    base = F.col("day") * 1440 - noon_offset(F.date_add(F.to_date(F.lit(first_day)), F.col("day").cast("int")), F.lit(tz))
    return areas.join(service_days, "trip_id").select("trip_id", "stop_seq", "day", (base + F.col("begin")).alias("begin"), (base + F.col("end")).alias("end"))
