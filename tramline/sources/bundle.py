"""A timetable on disk: each table as Parquet, events partitioned by service day and sorted by stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.storage import folders_in


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Overwrites the bundle's tables; stop events with a service_day are partitioned by it, so that a query reads its days alone."""
    for name, df in tables.items():
        if "service_day" in df.columns:
            df.repartition("service_day").sortWithinPartitions("location_id", "dep").write.mode("overwrite").partitionBy("service_day").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a bundle, on whatever file system; an error where there is no such folder."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in folders_in(spark, path)}


def clock(minutes: Column) -> Column:
    """HH:MM, with +n for the days after."""
    day = F.floor(minutes / 1440).cast("int")
    return F.concat(F.format_string("%02d:%02d", F.floor(F.pmod(minutes, F.lit(1440)) / 60), F.pmod(minutes, F.lit(60))), F.when(day > 0, F.concat(F.lit("+"), day.cast("string"))).otherwise(""))


def legs_as_text(legs: DataFrame) -> DataFrame:
    """(query_id, target, transfers, text): one line a leg, in the order of travel."""
    line = F.format_string("%d -> %d trip %d arr %s", F.col("from_id"), F.col("to_id"), F.col("trip_id"), clock(F.col("arr")))
    return legs.groupBy("query_id", "target", "transfers").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("leg")).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
