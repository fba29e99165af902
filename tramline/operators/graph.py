"""Fixpoints over edge tables. Each round is a join and a minimum; what a round leaves is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.storage import written


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, label) for undirected edges (a, b); label is the least node of the component.

    Labels spread along edges, and each round also jumps to the label's own label, so that long chains take few rounds.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        state = written(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        labels = state.select("node", "label")
        if state.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components not stable after {most} rounds")


def closure(edges: DataFrame, longest: int, most: int = 60) -> DataFrame:
    """(from_id, to_id, minutes): shortest paths of at most longest minutes between all pairs that edges connect, doubling each round."""
    best = written(edges.where(F.col("minutes") <= longest).groupBy("from_id", "to_id").agg(F.min("minutes").alias("minutes")), "paths")
    for _ in range(most):
        a, b = best.select("from_id", F.col("to_id").alias("via"), F.col("minutes").alias("m1")), best.select(F.col("from_id").alias("via"), "to_id", F.col("minutes").alias("m2"))
        longer = a.join(b, "via").where(f"from_id <> to_id and m1 + m2 <= {longest}").select("from_id", "to_id", (F.col("m1") + F.col("m2")).alias("minutes"))
        marked = best.select("*", F.lit(1).alias("old")).unionByName(longer.select("*", F.lit(0).alias("old")))
        state = written(marked.groupBy("from_id", "to_id").agg(F.min("minutes").alias("minutes"), F.min(F.when(F.col("old") == 1, F.col("minutes"))).alias("before")), "paths")
        best = state.select("from_id", "to_id", "minutes")
        if state.where("before is null or minutes < before").isEmpty():
            return best
    raise RuntimeError(f"closure not stable after {most} rounds")


def distances(edges: DataFrame, sources: DataFrame, most: int = 100, limit: int = 5 * 1440) -> DataFrame:
    """(node, minutes): the least cost from any of sources (node, minutes) along edges (from_id, to_id, minutes), up to limit.

    Only nodes that became nearer send on in a round.
    """
    best = written(sources.groupBy("node").agg(F.min("minutes").cast("long").alias("minutes")), "distances")
    frontier = best
    for _ in range(most):
        sent = frontier.withColumnRenamed("minutes", "m").join(edges, F.col("node") == F.col("from_id")).select(F.col("to_id").alias("node"), (F.col("m") + F.col("minutes")).alias("minutes")).where(F.col("minutes") <= limit)
        marked = best.select("*", F.col("minutes").alias("before")).unionByName(sent.select("*", F.lit(None).cast("long").alias("before")))
        state = written(marked.groupBy("node").agg(F.min("minutes").alias("minutes"), F.min("before").alias("before")), "distances")
        best, frontier = state.select("node", "minutes"), state.where("before is null or minutes < before").select("node", "minutes")
        if frontier.isEmpty():
            return best
    raise RuntimeError(f"distances not stable after {most} rounds")
