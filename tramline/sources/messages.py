"""Messages in real time: binary and JSON trip updates, XML and JSON stop reports, alerts.

All become the update rows that tramline.operators.realtime takes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVENT = "struct<delay:int,time:bigint>"
FEED = (
    "struct<header:struct<timestamp:bigint>,entity:array<struct<id:string,is_deleted:boolean,"
    f"trip_update:struct<trip:struct<trip_id:string,start_date:string,start_time:string,route_id:string,direction_id:int,schedule_relationship:string>,stop_time_update:array<struct<stop_sequence:int,stop_id:string,arrival:{_EVENT},departure:{_EVENT},schedule_relationship:string>>>,"
    "vehicle:struct<trip:struct<trip_id:string,start_date:string>,position:struct<latitude:double,longitude:double>,timestamp:bigint>,"
    "alert:struct<active_period:array<struct<start:bigint,end:bigint>>,informed_entity:array<struct<agency_id:string,route_id:string,route_type:int,trip:struct<trip_id:string>,stop_id:string>>,header_text:struct<translation:array<struct<text:string,language:string>>>>>>>"
)
#: Field numbers of the messages: name, kind (m message, s text, v number, z signed number, e enumeration, f float, b boolean), repeated, of what.
_TRIP = {1: ("trip_id", "s"), 2: ("start_time", "s"), 3: ("start_date", "s"), 4: ("schedule_relationship", ("SCHEDULED", "ADDED", "UNSCHEDULED", "CANCELED", None, "REPLACEMENT", "DUPLICATED", "DELETED", "NEW")), 5: ("route_id", "s"), 6: ("direction_id", "v")}
_TIME = {1: ("delay", "z"), 2: ("time", "z")}
_TEXT = {1: ("translation", [{1: ("text", "s"), 2: ("language", "s")}])}
_FIELDS = {
    1: ("header", {3: ("timestamp", "v")}),
    2: ("entity", [{
        1: ("id", "s"), 2: ("is_deleted", "b"),
        3: ("trip_update", {1: ("trip", _TRIP), 2: ("stop_time_update", [{1: ("stop_sequence", "v"), 2: ("arrival", _TIME), 3: ("departure", _TIME), 4: ("stop_id", "s"), 5: ("schedule_relationship", ("SCHEDULED", "SKIPPED", "NO_DATA", "UNSCHEDULED"))}])}),
        4: ("vehicle", {1: ("trip", _TRIP), 2: ("position", {1: ("latitude", "f"), 2: ("longitude", "f")}), 5: ("timestamp", "v")}),
        5: ("alert", {1: ("active_period", [{1: ("start", "v"), 2: ("end", "v")}]), 5: ("informed_entity", [{1: ("agency_id", "s"), 2: ("route_id", "s"), 3: ("route_type", "z"), 4: ("trip", _TRIP), 5: ("stop_id", "s")}]), 10: ("header_text", _TEXT)}),
    }]),
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("number too long")


def decode(data: bytes, fields: dict = _FIELDS) -> dict:
    """A binary message as nested dictionaries; unknown fields are skipped."""
    out: dict = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire, number = tag & 7, tag >> 3
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("message cut short")
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if number not in fields:
            continue
        name, kind = fields[number]
        if isinstance(kind, list):
            out.setdefault(name, []).append(decode(value, kind[0]))
        elif isinstance(kind, dict):
            out[name] = decode(value, kind)
        elif isinstance(kind, tuple):
            out[name] = kind[value] if value < len(kind) else None
        elif kind == "s":
            out[name] = value.decode("utf-8", "replace")
        elif kind == "f":
            out[name] = struct.unpack("<f" if len(value) == 4 else "<d", value)[0]
        elif kind == "b":
            out[name] = bool(value)
        else:
            out[name] = value - (1 << 64) if kind == "z" and value >= 1 << 63 else value
    return out


def encode(message: dict, fields: dict = _FIELDS) -> bytes:
    """The mirror of decode."""
    out = bytearray()

    def number(value: int) -> bytes:
        value &= (1 << 64) - 1
        part = bytearray()
        while True:
            part.append(value & 0x7F | (0x80 if value > 0x7F else 0))
            value >>= 7
            if not value:
                return bytes(part)

    for n, (name, kind) in sorted(fields.items()):
        if message.get(name) is None:
            continue
        for value in message[name] if isinstance(kind, list) else [message[name]]:
            if isinstance(kind, list | dict) or kind == "s":
                body = value.encode() if kind == "s" else encode(value, kind[0] if isinstance(kind, list) else kind)
                out += number(n << 3 | 2) + number(len(body)) + body
            elif kind == "f":
                out += number(n << 3 | 5) + struct.pack("<f", value)
            else:
                out += number(n << 3) + number(kind.index(value) if isinstance(kind, tuple) else int(value))
    return bytes(out)


def binary_to_json(df: DataFrame, column: str = "content") -> DataFrame:
    """df with json beside its binary messages; null where a message is broken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data in batch.column(column).to_pylist():
                try:
                    texts.append(None if data is None else json.dumps(decode(data)))
                except (ValueError, IndexError, TypeError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "json"])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("json", StringType())]))


def entities(feeds: DataFrame) -> DataFrame:
    """(feed_ts, entity) of feeds (json)."""
    return feeds.select(F.from_json("json", FEED).alias("m")).select(F.col("m.header.timestamp").alias("feed_ts"), F.explode("m.entity").alias("entity"))


def trip_updates(own: DataFrame) -> DataFrame:
    """(feed_ts, entity_id, trip_id, start_date, start_time, route_id, relationship, position, stop_seq, stop_id, arr_delay, dep_delay, arr_time, dep_time, skipped, cancelled, supported)."""
    u = own.where("entity.trip_update is not null").select("feed_ts", F.col("entity.id").alias("entity_id"), F.col("entity.trip_update.trip").alias("t"), F.posexplode_outer("entity.trip_update.stop_time_update").alias("position", "s"))
    kind = F.coalesce("t.schedule_relationship", F.lit("SCHEDULED"))
    return u.select("feed_ts", "entity_id", "t.trip_id", "t.start_date", "t.start_time", "t.route_id", kind.alias("relationship"), "position", F.col("s.stop_sequence").cast("long").alias("stop_seq"), "s.stop_id", F.col("s.arrival.delay").alias("arr_delay"), F.col("s.departure.delay").alias("dep_delay"), F.col("s.arrival.time").alias("arr_time"), F.col("s.departure.time").alias("dep_time"), F.coalesce(F.col("s.schedule_relationship") == "SKIPPED", F.lit(False)).alias("skipped"), (kind == "CANCELED").alias("cancelled"), kind.isin("SCHEDULED", "CANCELED", "ADDED", "NEW").alias("supported"))


def vehicles(own: DataFrame) -> DataFrame:
    v = own.where("entity.vehicle is not null")
    return v.select("feed_ts", F.col("entity.id").alias("event_id"), F.col("entity.vehicle.trip.trip_id").alias("trip_id"), F.col("entity.vehicle.position.latitude").alias("lat"), F.col("entity.vehicle.position.longitude").alias("lng"), F.floor(F.coalesce("entity.vehicle.timestamp", "feed_ts") / 60).alias("minute"))


def alert_selectors(own: DataFrame) -> DataFrame:
    a = own.where("entity.alert is not null").select(F.col("entity.id").alias("alert_id"), F.explode("entity.alert.informed_entity").alias("e"))
    return a.select("alert_id", F.col("e.trip.trip_id").alias("trip_id"), "e.route_id", "e.agency_id", "e.route_type", F.col("e.stop_id").alias("location_id"))


def alert_periods(own: DataFrame) -> DataFrame:
    a = own.where("entity.alert is not null").select(F.col("entity.id").alias("alert_id"), F.explode("entity.alert.active_period").alias("p"))
    return a.select("alert_id", F.floor(F.col("p.start") / 60).alias("begin"), F.floor(F.col("p.end") / 60).alias("end"))


def _pascal(value: object) -> object:
    if isinstance(value, dict):
        return {k[:1].upper() + k[1:]: _pascal(v) for k, v in value.items()}
    return [_pascal(v) for v in value] if isinstance(value, list) else value


def json_to_xml(text: str) -> str:
    """Reports in JSON as XML: names begin with a capital, lists are repeated elements."""
    from xml.sax.saxutils import escape

    def element(name: str, value: object) -> str:
        if isinstance(value, list):
            return "".join(element(name, v) for v in value)
        if isinstance(value, dict):
            return f"<{name}>" + "".join(element(k, v) for k, v in value.items()) + f"</{name}>"
        return f"<{name}/>" if value is None else f"<{name}>{escape(str(value).lower() if isinstance(value, bool) else str(value))}</{name}>"

    return "".join(element(k, v) for k, v in _pascal(json.loads(text)).items())


_CALL = "struct<StopPointRef:string,Order:int,AimedArrivalTime:string,ExpectedArrivalTime:string,AimedDepartureTime:string,ExpectedDepartureTime:string,Cancellation:boolean>"
_JOURNEY = f"LineRef string, DirectionRef string, FramedVehicleJourneyRef struct<DataFrameRef:string,DatedVehicleJourneyRef:string>, Cancellation boolean, IsCompleteStopSequence boolean, RecordedCalls struct<RecordedCall:array<{_CALL}>>, EstimatedCalls struct<EstimatedCall:array<{_CALL}>>"


def _at(text: Column) -> Column:
    return F.floor(F.unix_timestamp(F.to_timestamp(text)) / 60)


def estimated_calls(rows: DataFrame) -> DataFrame:
    """(run_id, complete, cancelled, position, stop_id, arr, dep, new_arr, new_dep, stop_cancelled) of journeys read as XML (schema estimated_schema())."""
    empty = F.expr(f"cast(array() as array<{_CALL}>)")
    calls = F.concat(F.coalesce("RecordedCalls.RecordedCall", empty), F.coalesce("EstimatedCalls.EstimatedCall", empty))
    own = rows.select(F.coalesce("FramedVehicleJourneyRef.DatedVehicleJourneyRef", F.concat_ws("/", "LineRef", "DirectionRef")).alias("run_id"), F.coalesce("IsCompleteStopSequence", F.lit(False)).alias("complete"), F.coalesce("Cancellation", F.lit(False)).alias("cancelled"), F.posexplode_outer(calls).alias("position", "c"))
    return own.select("run_id", "complete", "cancelled", "position", F.col("c.StopPointRef").alias("stop_id"), _at(F.col("c.AimedArrivalTime")).alias("arr"), _at(F.col("c.AimedDepartureTime")).alias("dep"), _at(F.coalesce("c.ExpectedArrivalTime", "c.AimedArrivalTime")).alias("new_arr"), _at(F.coalesce("c.ExpectedDepartureTime", "c.AimedDepartureTime")).alias("new_dep"), F.coalesce("c.Cancellation", F.lit(False)).alias("stop_cancelled"))


def estimated_schema() -> str:
    return _JOURNEY


_HALT = "struct<HaltID:string,Abfahrtszeit:string,Ankunftszeit:string,IstAbfahrtPrognose:string,IstAnkunftPrognose:string,Durchfahrt:boolean>"


def actual_schema() -> str:
    return f"LinienID string, RichtungsID string, FahrtRef struct<FahrtID:struct<FahrtBezeichner:string,Betriebstag:string>>, Komplettfahrt boolean, FaelltAus boolean, IstHalt array<{_HALT}>"


def actual_calls(rows: DataFrame) -> DataFrame:
    """The same columns from the German protocol's IstFahrt elements."""
    own = rows.select(F.concat_ws("#", "FahrtRef.FahrtID.FahrtBezeichner", "FahrtRef.FahrtID.Betriebstag").alias("run_id"), F.coalesce("Komplettfahrt", F.lit(False)).alias("complete"), F.coalesce("FaelltAus", F.lit(False)).alias("cancelled"), F.posexplode_outer("IstHalt").alias("position", "c"))
    return own.select("run_id", "complete", "cancelled", "position", F.col("c.HaltID").alias("stop_id"), _at(F.col("c.Ankunftszeit")).alias("arr"), _at(F.col("c.Abfahrtszeit")).alias("dep"), _at(F.coalesce("c.IstAnkunftPrognose", "c.Ankunftszeit")).alias("new_arr"), _at(F.coalesce("c.IstAbfahrtPrognose", "c.Abfahrtszeit")).alias("new_dep"), F.coalesce("c.Durchfahrt", F.lit(False)).alias("stop_cancelled"))


def situations_schema() -> str:
    return "SituationNumber string, ValidityPeriod struct<StartTime:string,EndTime:string>, PublicationWindow struct<StartTime:string,EndTime:string>, Summary string, Description string, Affects struct<Networks:struct<AffectedNetwork:array<struct<AffectedLine:array<struct<LineRef:string>>>>>,StopPoints:struct<AffectedStopPoint:array<struct<StopPointRef:string>>>>"


def situations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alert selectors and periods (the validity, not the publication window) of PtSituationElement rows."""
    lines = rows.select(F.col("SituationNumber").alias("alert_id"), F.explode(F.flatten("Affects.Networks.AffectedNetwork.AffectedLine")).alias("l")).select("alert_id", F.col("l.LineRef").alias("route_id"), F.lit(None).cast("string").alias("location_id"))
    stops = rows.select(F.col("SituationNumber").alias("alert_id"), F.explode("Affects.StopPoints.AffectedStopPoint").alias("s")).select("alert_id", F.lit(None).cast("string").alias("route_id"), F.col("s.StopPointRef").alias("location_id"))
    none = F.lit(None).cast("string")
    chosen = lines.unionByName(stops).select("alert_id", none.alias("trip_id"), "route_id", none.alias("agency_id"), none.alias("route_type"), "location_id")
    return chosen, rows.select(F.col("SituationNumber").alias("alert_id"), _at(F.col("ValidityPeriod.StartTime")).alias("begin"), _at(F.col("ValidityPeriod.EndTime")).alias("end"))
