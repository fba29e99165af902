"""Fixed-width timetables (HRD family): master data, service blocks, their expansion.

A line belongs to the block of the last *Z line above it. Lines of a file keep their order by the position in it, as each
file is read whole; files are the unit of distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.storage import exists

#: Folder and names of the master files, of two dialects.
DIALECTS = (
    {"folder": "stamm", "services": "fahrten", "stations": "bahnhof.101", "coordinates": "dbkoord_geo.101", "bitfields": "bitfeld.101", "categories": "zugart_int.101", "providers": "unternehmen_ris.101", "tracks": "gleise.101", "basic": "eckdaten.101", "timezones": "zeitvs.101", "footpaths": "metabhf.101", "attributes": "attributd_int_int.101", "directions": "richtung.101"},
    {"folder": "", "services": "", "stations": "BAHNHOF", "coordinates": "BFKOORD_WGS", "bitfields": "BITFELD", "categories": "ZUGART", "providers": "BETRIEB_DE", "tracks": "GLEIS", "basic": "ECKDATEN", "timezones": "ZEITVS", "footpaths": "METABHF", "attributes": "ATTRIBUT_DE", "directions": "RICHTUNG"},
)


def _in(*parts: str) -> str:
    return "/".join(p for p in parts if p)


def dialect_of(path: str) -> dict[str, str] | None:
    for d in DIALECTS:
        if exists(_in(path, d["folder"], d["stations"])) and exists(_in(path, d["folder"], d["bitfields"])):
            return d
    return None


def applicable(path: str) -> bool:
    return dialect_of(path) is not None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, line) of ISO-8859-1 files, without blank lines."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n")).alias("nth", "line"))
    return own.where("trim(line) <> ''")


def _cut(begin: int, length: int | None = None) -> Column:
    return F.trim(F.substring("line", begin, length if length is not None else 1000))


def stations(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike("^[0-9]{7}")).select(_cut(1, 7).alias("eva"), F.regexp_replace(_cut(13), r"[$<].*$", "").alias("name"))


def coordinates(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike("^[0-9]{7}")).select(_cut(1, 7).alias("eva"), F.regexp_extract("line", r"^\d{7}\s+(-?[\d.]+)\s+(-?[\d.]+)", 1).cast("double").alias("lng"), F.regexp_extract("line", r"^\d{7}\s+(-?[\d.]+)\s+(-?[\d.]+)", 2).cast("double").alias("lat"))


def basic_info(own: DataFrame) -> DataFrame:
    """(first, last): the period, both days included."""
    day = own.where(F.col("line").rlike(r"^\d{2}\.\d{2}\.\d{4}")).select(F.to_date(F.substring("line", 1, 10), "dd.MM.yyyy").alias("day"))
    return day.agg(F.min("day").alias("first"), F.max("day").alias("last"))


def bitfields(own: DataFrame, period: DataFrame) -> DataFrame:
    """(bitfield, day): the period's days are the bits between the first and the last '11' of hexadecimal digits; number 0 is every day."""
    bits = own.where(F.col("line").rlike("^[0-9]{6} +[0-9A-Fa-f]+")).select(F.substring("line", 1, 6).cast("int").alias("bitfield"), F.regexp_extract("line", r"^\d{6} +([0-9A-Fa-f]+)", 1).alias("hex"))
    digits = F.transform(F.filter(F.split("hex", ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    text = bits.select("bitfield", F.array_join(digits, "").alias("bits"))
    text = text.select("bitfield", F.regexp_extract("bits", "^.*?11(.*)11", 1).alias("bits"))
    on = text.select("bitfield", F.posexplode(F.filter(F.split("bits", ""), lambda c: c != "")).alias("i", "b")).where("b = '1'")
    listed = on.crossJoin(F.broadcast(period)).select("bitfield", F.date_add("first", F.col("i")).alias("day")).join(F.broadcast(period), F.lit(True)).where("day <= last").select("bitfield", "day")
    return listed.unionByName(period.select(F.lit(0).alias("bitfield"), F.explode(F.sequence("first", "last")).alias("day")))


def categories(own: DataFrame) -> DataFrame:
    from tramline.functions.classes import of_category

    return own.where(F.col("line").rlike(r"^\S{1,3} +\d")).select(_cut(1, 3).alias("category"), of_category(_cut(1, 3)).alias("clasz"))


def providers(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike(r"^\d{5} K")).select(_cut(1, 5).alias("number"), F.regexp_extract("line", r'L "([^"]*)"', 1).alias("name"))


def attributes(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike(r"^\S{2} ")).select(_cut(1, 2).alias("code"), F.regexp_replace(_cut(13), r"[#$].*$", "").alias("text"))


def directions(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike(r"^\d{7} ")).select(_cut(1, 7).alias("code"), _cut(9).alias("text"))


def tracks(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike(r"^\d{7} \d")).select(_cut(1, 7).alias("eva"), _cut(9, 5).cast("int").alias("train"), _cut(16, 6).alias("owner"), _cut(23, 8).alias("track"))


def footpaths(own: DataFrame) -> DataFrame:
    return own.where(F.col("line").rlike(r"^\d{7} \d{7} \d+")).select(_cut(1, 7).alias("from_id"), _cut(9, 7).alias("to_id"), _cut(17, 3).cast("long").alias("minutes"))


def timezones(own: DataFrame) -> DataFrame:
    """(eva, standard): from which stop number on which offset in minutes holds."""
    part = own.where(F.col("line").rlike(r"^\d{7} [+-]\d{4}"))
    sign = F.when(F.substring("line", 9, 1) == "-", -1).otherwise(1)
    return part.select(_cut(1, 7).alias("eva"), (sign * (F.substring("line", 10, 2).cast("int") * 60 + F.substring("line", 12, 2).cast("int"))).alias("standard"))


def services(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks (service, train, owner, repeats, interval), stops (service, stop_seq, eva, arr, dep, in_allowed, out_allowed) and
    ranges (service, kind, value, from_eva, to_eva): A VE gives traffic days, A others attributes, G category, L line, R direction."""
    w = Window.partitionBy("file").orderBy("nth")
    block = own.withColumn("block", F.sum(F.when(F.substring("line", 1, 2).isin("*Z", "*T"), 1).otherwise(0)).over(w)).withColumn("kept", F.max(F.when(F.substring("line", 1, 2) == "*Z", True)).over(Window.partitionBy("file", "block"))).where("block > 0 and kept").withColumn("service", F.concat_ws("#", F.element_at(F.split("file", "/"), -1), "block"))
    head = block.where("line like '*Z%'").select("service", _cut(4, 5).alias("train"), _cut(10, 6).alias("owner"), F.coalesce(F.expr("try_cast(trim(substring(line, 23, 3)) as int)"), F.lit(0)).alias("repeats"), F.coalesce(F.expr("try_cast(trim(substring(line, 27, 3)) as int)"), F.lit(0)).alias("interval"))
    minutes = lambda at: F.when(F.abs(F.expr(f"try_cast(trim(substring(line, {at}, 6)) as int)")).isNotNull(), (F.floor(F.abs(F.expr(f"try_cast(trim(substring(line, {at}, 6)) as int)")) / 100) * 60 + F.abs(F.expr(f"try_cast(trim(substring(line, {at}, 6)) as int)")) % 100))
    seq = F.row_number().over(Window.partitionBy("service").orderBy("nth")) - 1
    stop = block.where(F.col("line").rlike("^[0-9]{7}")).select("service", seq.cast("long").alias("stop_seq"), _cut(1, 7).alias("eva"), minutes(30).alias("arr"), minutes(37).alias("dep"), (~F.contains(F.substring("line", 37, 6), F.lit("-"))).alias("in_allowed"), (~F.contains(F.substring("line", 30, 6), F.lit("-"))).alias("out_allowed"))
    part = block.where(F.col("line").rlike(r"^\*[AGLR] "))
    value = F.when(F.col("line").rlike(r"^\*A VE"), F.regexp_extract("line", r"^\*A VE \d{7} \d{7} +(\d+)", 1)).otherwise(F.regexp_extract("line", r"^\*[AGLR] +(\S+)", 1))
    kind = F.when(F.col("line").rlike(r"^\*A VE"), "VE").otherwise(F.substring("line", 2, 1))
    ranges = part.select("service", kind.alias("kind"), value.alias("value"), F.regexp_extract("line", r"(\d{7}) (\d{7})", 1).alias("from_eva"), F.regexp_extract("line", r"(\d{7}) (\d{7})", 2).alias("to_eva"))
    return head, stop, ranges


def expand(head: DataFrame, stops: DataFrame, ranges: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stop events (trip_id, service, stop_seq, eva, arr, dep, ..) and service days (trip_id, day).

    A service whose sections run on different days is cut: each day's maximal run of sections is a trip of its own, and
    equal runs of several days are one trip. Repetitions are trips interval minutes apart.
    """
    at = stops.groupBy("service", "eva").agg(F.min("stop_seq").alias("first"), F.max("stop_seq").alias("last"))
    ve = ranges.where("kind = 'VE'").join(at.select("service", F.col("eva").alias("from_eva"), F.col("first").alias("a")), ["service", "from_eva"], "left").join(at.select("service", F.col("eva").alias("to_eva"), F.col("last").alias("z")), ["service", "to_eva"], "left")
    sections = stops.select("service", F.col("stop_seq").alias("s")).join(stops.groupBy("service").agg(F.max("stop_seq").alias("end")), "service").where("s < end")
    on = sections.join(ve, "service").where("s >= coalesce(a, 0) and s < coalesce(z, end)").select("service", "s", F.coalesce(F.expr("try_cast(value as int)"), F.lit(0)).alias("bitfield")).join(days, "bitfield").select("service", "s", "day").distinct()
    w = Window.partitionBy("service", "day").orderBy("s")
    runs = on.withColumn("run", F.col("s") - F.row_number().over(w)).groupBy("service", "day", "run").agg(F.min("s").alias("first"), (F.max("s") + 1).alias("last"))
    parts = runs.groupBy("service", "first", "last").agg(F.collect_set("day").alias("days"))
    trips = parts.join(head, "service").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("repeats")))).withColumn("trip_id", F.concat_ws("/", "service", "first", "last", "k"))
    shift = F.col("k") * F.col("interval")
    events = trips.drop("days").join(stops, "service").where("stop_seq between first and last").select("trip_id", "service", (F.col("stop_seq") - F.col("first")).alias("stop_seq"), "eva", (F.coalesce("arr", "dep") + shift).alias("arr"), (F.coalesce("dep", "arr") + shift).alias("dep"), "in_allowed", "out_allowed")
    return events, trips.select("trip_id", F.explode("days").alias("day"))


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    d = dialect_of(path)
    if d is None:
        raise ValueError(f"no master data known in {path}")
    of = lambda name: lines(spark, _in(path, d["folder"], d[name]))
    there = lambda name: exists(_in(path, d["folder"], d[name]))
    period = basic_info(of("basic"))
    days = bitfields(of("bitfields"), period)
    head, stop, ranges = services(lines(spark, _in(path, d["services"])))
    events, service_days = expand(head, stop, ranges, days)
    readers = {"coordinates": coordinates, "categories": categories, "providers": providers, "attributes": attributes, "directions": directions, "tracks": tracks, "footpaths": footpaths, "timezones": timezones}
    return {"stops": stations(of("stations")), "stop_events": events, "service_days": service_days, "ranges": ranges, "services": head, "period": period} | {n: f(of(n)) for n, f in readers.items() if there(n)}
