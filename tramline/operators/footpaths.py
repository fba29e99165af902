"""Walks between stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.geo import cell, haversine_m, walk_minutes
from tramline.functions.storage import small
from tramline.operators.graph import closure, components

#: A table of stops of at most so many rows is sent to all tasks.
SENT = 500_000


def symmetric(footpaths: DataFrame) -> DataFrame:
    """Adds the reverse of each footpath (from_id, to_id, minutes) that has none."""
    back = footpaths.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "minutes")
    both = footpaths.select("from_id", "to_id", "minutes", F.lit(0).alias("made")).unionByName(back.select("*", F.lit(1).alias("made")))
    return both.groupBy("from_id", "to_id").agg(F.min(F.struct("made", "minutes"))["minutes"].alias("minutes"))


def within(a: DataFrame, b: DataFrame, metres: float, equal: Sequence[str] = (), where: str | Column | None = None, values: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of a (location_id, lat, lng, ..) and b within that distance: columns a_*, b_* and metres.

    An equi-join on grid cells of that size, b in its own cell and the eight around it; only then the distance is worked out. In the columns
    of equal both are the same; where is a further condition, values are further columns, of a_* and b_* without the identifiers.
    Stops that differ in location_id only are one row until the pairs are made, so all of this is done once for them. Without location_id no
    identifiers are made.
    """
    y, x = cell(F.col("a_lat"), F.col("a_lng"), metres)
    left = _alike(a, "a").select("*", *(F.col(f"a_{c}").alias(f"__{c}") for c in equal), y.alias("__y"), x.alias("__x"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    y, x = cell(F.col("b_lat"), F.col("b_lng"), metres)
    right = _alike(b, "b").withColumn("__d", F.explode(around)).select("*", *(F.col(f"b_{c}").alias(f"__{c}") for c in equal), (y + F.col("__d.i")).alias("__y"), (x + F.col("__d.j")).alias("__x")).drop("__d")
    if small(a, SENT):
        # Few rows can give many pairs: they are made where b's rows lie, and these are spread.
        left, right = F.broadcast(left), right.repartition(4 * a.sparkSession.sparkContext.defaultParallelism)
    keys = [*(f"__{c}" for c in equal), "__y", "__x"]
    pairs = right.join(left, keys).drop(*keys).withColumn("metres", haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))).where(F.col("metres") <= metres)
    pairs = pairs.where(where) if where is not None else pairs
    pairs = pairs.withColumns(values) if values else pairs
    for side in ("a", "b"):
        if f"__{side}_ids" in pairs.columns:
            pairs = pairs.withColumn(f"{side}_location_id", F.explode(f"__{side}_ids")).drop(f"__{side}_ids")
    return pairs


def _alike(stops: DataFrame, side: str) -> DataFrame:
    own = stops.select(*(F.col(c).alias(f"{side}_{c}") for c in stops.columns))
    if "location_id" not in stops.columns:
        return own.distinct()
    return own.groupBy(*(c for c in own.columns if c != f"{side}_location_id")).agg(F.collect_list(f"{side}_location_id").alias(f"__{side}_ids"))


def linked(locations: DataFrame, metres: float = 300.0, equal_metres: float = 100.0) -> DataFrame:
    """(from_id, to_id, minutes, equivalent) between feeds: the longest of both transfer times and the walk."""
    own = locations.select("location_id", "lat", "lng", "transfer_min", "src").where("src is not null and not (abs(lat) < 2 and abs(lng) < 2)")
    values = {"minutes": F.greatest("a_transfer_min", "b_transfer_min", walk_minutes(F.col("metres"))), "equivalent": F.col("metres") < equal_metres}
    pairs = within(own, own, metres, where="a_src <> b_src", values=values)
    return pairs.select(F.col("a_location_id").alias("from_id"), F.col("b_location_id").alias("to_id"), "minutes", "equivalent")


def same_place(locations: DataFrame, metres: float = 200.0) -> DataFrame:
    """(from_id, to_id, minutes): stops of equal name or parent within the distance, two minutes at least.

    Pairs of one name are found by name, those of one parent that differ in their names by parent."""
    own = locations.select("location_id", "lat", "lng", "name", F.coalesce("parent_id", "location_id").alias("root"))
    values = {"minutes": F.greatest(F.lit(2).cast("long"), walk_minutes(F.col("metres")))}
    columns = [F.col("a_location_id").alias("from_id"), F.col("b_location_id").alias("to_id"), "minutes"]
    named = within(own.drop("root"), own.drop("root"), metres, ["name"], values=values).select(*columns)
    family = within(own, own, metres, ["root"], where="not coalesce(a_name = b_name, false)", values=values).select(*columns)
    return named.unionByName(family).where("from_id <> to_id")


def closed(footpaths: DataFrame, locations: DataFrame, longest: int = 15) -> DataFrame:
    """All walks of at most longest minutes over footpaths in either direction, none shorter than both stops' transfer times."""
    both = footpaths.select("from_id", "to_id", "minutes").unionByName(footpaths.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "minutes"))
    a, b = locations.select(F.col("location_id").alias("from_id"), F.col("transfer_min").alias("ta")), locations.select(F.col("location_id").alias("to_id"), F.col("transfer_min").alias("tb"))
    return closure(both, longest).join(a, "from_id").join(b, "to_id").select("from_id", "to_id", F.greatest("minutes", "ta", "tb").alias("minutes"))


def to_children(locations: DataFrame) -> DataFrame:
    """(from_id, to_id, minutes): parent and generated tracks, and the tracks of one parent among themselves; generated is a boolean column."""
    tracks = locations.where("generated and parent_id is not null").select("location_id", "parent_id", "transfer_min")
    up = tracks.select(F.col("location_id").alias("from_id"), F.col("parent_id").alias("to_id"), F.col("transfer_min").alias("minutes"))
    down = up.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "minutes")
    other = tracks.select(F.col("location_id").alias("to_id"), "parent_id")
    among = tracks.join(other, "parent_id").where("location_id <> to_id").select(F.col("location_id").alias("from_id"), "to_id", F.col("transfer_min").alias("minutes"))
    return up.unionByName(down).unionByName(among)


def groups(footpaths: DataFrame) -> DataFrame:
    """(location_id, component) of the footpath graph."""
    return components(footpaths.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).select(F.col("node").alias("location_id"), F.col("label").alias("component"))


def expand_groups(elements: DataFrame, locations: DataFrame) -> DataFrame:
    """(group_id, location_id): the elements of stop groups with their children and grandchildren."""
    child = locations.where("parent_id is not null").select(F.col("parent_id").alias("location_id"), F.col("location_id").alias("child"))
    own = elements.select("group_id", "location_id")
    one = own.join(child, "location_id").select("group_id", F.col("child").alias("location_id"))
    two = one.join(child, "location_id").select("group_id", F.col("child").alias("location_id"))
    return own.unionByName(one).unionByName(two).distinct()


def by_duration(footpaths: DataFrame) -> DataFrame:
    """footpaths with nth: the place of each among those from its stop, the shortest first."""
    from pyspark.sql import Window

    return footpaths.withColumn("nth", F.row_number().over(Window.partitionBy("from_id").orderBy("minutes", "to_id")).cast("long"))


def persisted(footpaths: DataFrame, path: str) -> None:
    """Written by stop and sorted by duration, so that a stop's walks lie together in the order in which they are tried."""
    footpaths.repartition("from_id").sortWithinPartitions("from_id", "minutes", "to_id").write.mode("overwrite").parquet(path)
