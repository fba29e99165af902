"""A timetable derived from the driver's tables, as DataFrames and as the same definitions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.storage import spread

#: First service day, and how many days the derived calendar covers.
FIRST_DAY, DAYS = "2024-01-01", 14
_ORDER = "l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"

#: name: (what it reads, SQL)
CTES: dict[str, tuple[str, str]] = {
    "locations": ("", """SELECT s_suppkey AS location_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey - s_suppkey % 5 END AS parent_id,
        48 + (s_suppkey * 7919 % 1000) / 10000.0::DOUBLE AS lat, 8 + (s_suppkey * 104729 % 1000) / 10000.0::DOUBLE AS lng, 2 + s_suppkey % 4 AS transfer_min, s_nationkey % 3 AS src,
        'Stop ' || (s_suppkey % 50) AS name FROM supplier"""),
    "trips": ("", """SELECT o_orderkey AS trip_id, o_custkey AS block_id, o_custkey % 50 AS route_id, 1 + o_orderkey % 127 AS day_mask,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 5 WHEN '3' THEN 6 WHEN '4' THEN 9 ELSE 10 END AS clasz,
        o_orderkey % 2 = 0 AS bikes, o_orderkey % 3 = 0 AS cars, o_orderkey % 5 <> 0 AS wheelchair FROM orders"""),
    "stop_times": ("", f"""SELECT trip_id, location_id, stop_seq, arr, dep, in_allowed, out_allowed, bike_section FROM (
        SELECT l_orderkey AS trip_id, l_suppkey AS location_id, rn AS stop_seq,
            (l_orderkey * 37) % 1200 + sum(leg) OVER w + greatest(2 * rn - 1, 0) AS arr, (l_orderkey * 37) % 1200 + sum(leg) OVER w + 2 * rn AS dep,
            l_returnflag <> 'R' AS in_allowed, NOT (l_linestatus = 'F' AND l_discount > 0.08) AS out_allowed, l_tax <= 0.06 AS bike_section
        FROM (SELECT *, CASE WHEN rn = 0 THEN 0 ELSE 3 + floor(l_quantity)::BIGINT % 25 END AS leg FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS rn FROM lineitem))
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY rn))"""),
    "active": ("trips", "SELECT * FROM trips WHERE (day_mask & 4) <> 0"),
    "events_on": ("stop_times active", "SELECT s.* REPLACE (s.arr::BIGINT AS arr, s.dep::BIGINT AS dep), t.route_id, t.clasz FROM stop_times s JOIN active t USING (trip_id)"),
    "footpaths": ("locations", """SELECT from_id, to_id, min(minutes) AS minutes FROM (
        SELECT a.location_id AS from_id, b.location_id AS to_id, 3 AS minutes FROM locations a JOIN locations b
            ON coalesce(a.parent_id, a.location_id) = coalesce(b.parent_id, b.location_id) AND a.location_id <> b.location_id
        UNION ALL SELECT a.location_id, b.location_id, 4 + least(a.location_id, b.location_id) % 6 FROM locations a JOIN locations b ON b.location_id = a.location_id + 1 OR b.location_id = a.location_id - 1)
        GROUP BY from_id, to_id"""),
    "service_days": ("trips", f"""SELECT trip_id, d AS day FROM trips, (SELECT unnest(range({DAYS})) AS d) WHERE ((day_mask >> (d % 7)::INTEGER) & 1) = 1"""),
    "updates": ("", """SELECT event_id, user_id, event_id % (SELECT count(*) FROM orders) AS trip_id, k % 4 AS stop_seq, delay, kind, ts FROM (
        SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, floor(value)::BIGINT % 20 AS delay, event_type AS kind, epoch_us(ts) AS ts FROM events)"""),
    "td_edges": ("", """SELECT user_id % (SELECT count(*) FROM supplier) AS from_id, (user_id + 1) % (SELECT count(*) FROM supplier) AS to_id, valid_from, duration, blocked FROM (
        SELECT user_id, epoch_us(ts) // 60000000 AS valid_from, 2 + floor(value)::BIGINT % 30 AS duration, event_type = 'error' AS blocked, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 60000000 ORDER BY event_id DESC) AS nth FROM events) WHERE nth = 1"""),
}


def sql(names: str, body: str) -> str:
    """DuckDB SQL of body, which is a query or further common tables and a query, over the named tables above."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in found:
            needs, text = CTES[name]
            for n in needs.split():
                add(n)
            found[name] = text

    for n in names.split():
        add(n)
    head = ", ".join(f"{n} AS ({t})" for n, t in found.items())
    recursive = "RECURSIVE " if "RECURSIVE" in body.split("(")[0] else ""
    body = body.strip().removeprefix("RECURSIVE").strip()
    if not head:
        return body if body.upper().startswith("SELECT") else f"WITH {recursive}{body}"
    return f"WITH {recursive}{head} {'' if body.upper().startswith('SELECT') else ','} {body}"


class Derived:
    """The derived tables; each attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One DataFrame for each table, as reading its schema is a job."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @property
    def locations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(k.alias("location_id"), F.when(k % 5 != 0, k - k % 5).alias("parent_id"), (48 + (k * 7919 % 1000) / F.lit(10000.0)).alias("lat"), (8 + (k * 104729 % 1000) / F.lit(10000.0)).alias("lng"), (2 + k % 4).alias("transfer_min"), (F.col("s_nationkey") % 3).alias("src"), F.concat(F.lit("Stop "), (k % 50).cast("string")).alias("name"))

    @property
    def trips(self) -> DataFrame:
        k, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
        clasz = F.when(p == "1", 1).when(p == "2", 5).when(p == "3", 6).when(p == "4", 9).otherwise(10)
        return self.table("orders").select(k.alias("trip_id"), F.col("o_custkey").alias("block_id"), (F.col("o_custkey") % 50).alias("route_id"), (1 + k % 127).alias("day_mask"), clasz.alias("clasz"), (k % 2 == 0).alias("bikes"), (k % 3 == 0).alias("cars"), (k % 5 != 0).alias("wheelchair"))

    @property
    def stop_times(self) -> DataFrame:
        return self._stop_times(self._lines)

    @property
    def _lines(self) -> DataFrame:
        return spread(self.table("lineitem"), "l_orderkey")

    def _stop_times(self, lines: DataFrame) -> DataFrame:
        k = F.col("l_orderkey")
        order = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
        own = lines.withColumn("rn", (F.row_number().over(order) - 1).cast("long"))
        leg = F.when(F.col("rn") == 0, 0).otherwise(3 + F.floor("l_quantity") % 25)
        # Rows before the current one in the same order: one shuffle and one sort serve both windows.
        at = (k * 37) % 1200 + F.sum(leg).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return own.select(k.alias("trip_id"), F.col("l_suppkey").alias("location_id"), F.col("rn").alias("stop_seq"), (at + F.greatest(2 * F.col("rn") - 1, F.lit(0))).alias("arr"), (at + 2 * F.col("rn")).alias("dep"), (F.col("l_returnflag") != "R").alias("in_allowed"), (~((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08))).alias("out_allowed"), (F.col("l_tax") <= 0.06).alias("bike_section"))

    @property
    def active(self) -> DataFrame:
        """Trips of Wednesday."""
        return self.trips.where(F.col("day_mask").bitwiseAND(4) != 0)

    @property
    def events_on(self) -> DataFrame:
        # Whole trips go before their stops are sorted; the stops' order within a trip doesn't change by that.
        active = self.active.select("trip_id", "route_id", "clasz")
        lines = self._lines.join(active.select(F.col("trip_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        return self._stop_times(lines).join(active, "trip_id")

    @property
    def footpaths(self) -> DataFrame:
        own = self.locations.select("location_id", F.coalesce("parent_id", "location_id").alias("root"))
        a, b = own.select(F.col("location_id").alias("from_id"), "root"), own.select(F.col("location_id").alias("to_id"), "root")
        inside = a.join(b, "root").where("from_id <> to_id").select("from_id", "to_id", F.lit(3).cast("long").alias("minutes"))
        step = self.locations.select(F.col("location_id").alias("from_id"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("d")).withColumn("to_id", F.col("from_id") + F.col("d"))
        along = step.join(self.locations.select(F.col("location_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", (4 + F.least("from_id", "to_id") % 6).alias("minutes"))
        return inside.unionByName(along).groupBy("from_id", "to_id").agg(F.min("minutes").alias("minutes"))

    @property
    def service_days(self) -> DataFrame:
        """(trip_id, day): day counts from FIRST_DAY."""
        return self.trips.select("trip_id", "day_mask", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("day")).where("(shiftright(day_mask, cast(day % 7 as int)) & 1) = 1").select("trip_id", F.col("day").cast("long").alias("day"))

    @property
    def updates(self) -> DataFrame:
        count = self.table("orders").agg(F.count("*").alias("n"))
        own = self.table("events").select("event_id", "user_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("stop_seq"), (F.floor("value") % 20).alias("delay"), F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
        return own.crossJoin(F.broadcast(count)).withColumn("trip_id", F.col("event_id") % F.col("n")).drop("n")

    @property
    def td_edges(self) -> DataFrame:
        count = self.table("supplier").agg(F.count("*").alias("n"))
        minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000)
        own = self.table("events").select("event_id", "user_id", minute.alias("valid_from"), (2 + F.floor("value") % 30).alias("duration"), (F.col("event_type") == "error").alias("blocked"))
        last = own.groupBy("user_id", "valid_from").agg(F.max_by(F.struct("duration", "blocked"), "event_id").alias("x"))
        return last.crossJoin(F.broadcast(count)).select((F.col("user_id") % F.col("n")).alias("from_id"), ((F.col("user_id") + 1) % F.col("n")).alias("to_id"), "valid_from", "x.duration", "x.blocked")
