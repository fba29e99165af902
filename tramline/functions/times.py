"""Minutes, days and time zones as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_A_DAY = 1440


def hhmm_to_min(c: Column) -> Column:
    """Minutes after midnight of H:MM or H:MM:SS; seconds are ignored, hours may exceed 24; null for blank or malformed text."""
    parts = F.split(F.trim(c), ":")
    return F.when(F.trim(c).rlike(r"^[0-9]{1,3}:[0-9]{1,2}(:[0-9]{1,2})?$"), F.try_element_at(parts, F.lit(1)).cast("int") * 60 + F.try_element_at(parts, F.lit(2)).cast("int"))


def parse_date(c: Column, today: Column | None = None) -> Column:
    """A date from YYYYMMDD, YYYY-MM-DD, TODAY or -n for n days before today."""
    base = F.current_date() if today is None else today
    text = F.trim(c)
    return (
        F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
        .when(F.upper(text) == "TODAY", base)
        .when(text.rlike("^-[0-9]{1,5}$"), F.date_add(base, text.cast("int")))
    )


def mam_distance(a: Column, b: Column) -> tuple[Column, Column]:
    """Shortest distance of two minutes after midnight on the circle, and the day that b's midnight shifts by; a tie doesn't shift."""
    diff = a - b
    over = F.abs(diff) > MINUTES_A_DAY // 2
    return F.when(over, MINUTES_A_DAY - F.abs(diff)).otherwise(F.abs(diff)), F.when(over & (diff < 0), -1).when(over, 1).otherwise(0)


def split_minutes(t: Column) -> tuple[Column, Column]:
    """Day and minute of the day of absolute minutes, also of negative ones."""
    day = F.floor(t / MINUTES_A_DAY)
    return day, t - day * MINUTES_A_DAY


def clamp_minutes(t: Column, low: int = -32767, high: int = 32766) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), t))


def noon_offset(day: Column, tz: Column | str) -> Column:
    """The zone's offset to UTC in minutes at noon of the service day."""
    noon = F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00")))
    return ((F.unix_timestamp(noon) - F.unix_timestamp(F.to_utc_timestamp(noon, tz))) / 60).cast("int")


def season_offset(local: Column, standard: Column, season_from: Column, season_to: Column, season: Column) -> Column:
    """Offset in minutes of a zone that has one season of another offset, by local minutes."""
    return F.when((local >= season_from) & (local < season_to), season).otherwise(standard)


def adjusted_transfer(minutes: Column, least: int = 0, additional: int = 0, factor: float = 1.0) -> Column:
    """additional + max(least, trunc(minutes * factor)); factors below 1 count as 1."""
    return F.lit(additional) + F.greatest(F.lit(least), (minutes.cast("double") * F.lit(max(1.0, factor))).cast("int"))


def day_list(days: Column) -> Column:
    """Distinct days of an array in order, as text."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(days)), lambda d: d.cast("string")), ", ")
