"""Vehicle classes of route types and names, and translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("air", "high_speed", "long_distance", "coach", "night", "regional_fast", "regional", "suburban", "subway", "tram", "bus", "ship", "cable_car", "funicular", "aerial_lift", "other")
AIR, HIGH_SPEED, LONG_DISTANCE, COACH, NIGHT, REGIONAL_FAST, REGIONAL, SUBURBAN, SUBWAY, TRAM, BUS, SHIP, CABLE_CAR, FUNICULAR, AERIAL_LIFT, OTHER = range(16)
#: First and last route type, class; the first range that holds a type counts.
ROUTE_TYPES = (
    (0, 0, TRAM), (1, 1, SUBWAY), (2, 2, REGIONAL), (3, 3, BUS), (4, 4, SHIP), (5, 5, CABLE_CAR), (6, 6, AERIAL_LIFT), (7, 7, FUNICULAR), (11, 11, BUS), (12, 12, SUBURBAN),
    (101, 101, HIGH_SPEED), (102, 102, LONG_DISTANCE), (103, 103, REGIONAL_FAST), (105, 105, NIGHT), (104, 104, LONG_DISTANCE), (106, 106, REGIONAL), (107, 108, LONG_DISTANCE), (109, 109, SUBURBAN), (100, 117, REGIONAL),
    (200, 209, COACH), (300, 309, REGIONAL), (400, 404, SUBWAY), (405, 405, TRAM), (500, 500, SUBWAY), (600, 600, SUBWAY), (700, 716, BUS), (800, 800, BUS), (900, 906, TRAM),
    (1000, 1021, SHIP), (1100, 1114, AIR), (1200, 1200, SHIP), (1300, 1307, AERIAL_LIFT), (1400, 1402, FUNICULAR), (1500, 1507, OTHER), (1700, 1702, OTHER),
)
#: Category texts of timetables that name them.
CATEGORIES = {"AIR": AIR, "ICE": HIGH_SPEED, "THA": HIGH_SPEED, "TGV": HIGH_SPEED, "RJ": HIGH_SPEED, "RJX": HIGH_SPEED, "IC": LONG_DISTANCE, "EC": LONG_DISTANCE, "ICN": LONG_DISTANCE, "EXT": LONG_DISTANCE, "D": LONG_DISTANCE, "FLX": LONG_DISTANCE, "NJ": NIGHT, "EN": NIGHT, "CNL": NIGHT, "NZ": NIGHT, "IR": REGIONAL_FAST, "RE": REGIONAL_FAST, "IRE": REGIONAL_FAST, "REX": REGIONAL_FAST, "X": REGIONAL_FAST, "RB": REGIONAL, "R": REGIONAL, "REG": REGIONAL, "S": SUBURBAN, "SN": SUBURBAN, "U": SUBWAY, "M": SUBWAY, "STR": TRAM, "T": TRAM, "TRAM": TRAM, "BUS": BUS, "B": BUS, "NB": BUS, "SCH": SHIP, "FAE": SHIP, "BAT": SHIP, "SB": CABLE_CAR, "FUN": FUNICULAR, "GB": AERIAL_LIFT, "ZB": FUNICULAR}
#: Transport modes of XML timetables as route types.
MODES = {"air": 1100, "rail": 100, "intercityRail": 102, "highSpeedRail": 101, "regionalRail": 106, "suburbanRailway": 109, "urbanRail": 109, "metro": 401, "tram": 900, "bus": 700, "coach": 200, "water": 1000, "ferry": 1000, "cableway": 1300, "telecabin": 1300, "funicular": 1400, "taxi": 1500, "trolleyBus": 800}


def of_route_type(route_type: Column) -> Column:
    out = F.when(F.lit(False), OTHER)
    for low, high, clasz in ROUTE_TYPES:
        out = out.when((route_type == low) if low == high else route_type.between(low, high), clasz)
    return out.otherwise(OTHER)


def route_type_sql(c: str) -> str:
    cases = " ".join(f"WHEN {c} BETWEEN {low} AND {high} THEN {clasz}" for low, high, clasz in ROUTE_TYPES)
    return f"CASE {cases} ELSE {OTHER} END"


def _named(text: Column, names: dict[str, int], default: int) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.lit(default))


def of_category(text: Column) -> Column:
    return _named(F.upper(F.trim(F.regexp_replace(text, "[0-9 ]+$", ""))), CATEGORIES, OTHER)


def route_type_of_mode(mode: Column, submode: Column | None = None) -> Column:
    """The submode's type if it is known, else the mode's; 1700 for neither."""
    base = _named(mode, MODES, 1700)
    if submode is None:
        return base
    fine = _named(submode, MODES, -1)
    return F.when(fine >= 0, fine).otherwise(base)


def translated(texts: Column, languages: list[str]) -> Column:
    """The text of the first language wanted that texts, an array of structs (language, text) with the default first, have; else the default."""
    def of(language: str) -> Column:
        return F.try_element_at(F.filter(texts, lambda x: x["language"] == language), F.lit(1))["text"]

    ranked = [of(language) for language in languages]
    return F.coalesce(*ranked, F.when(F.size(texts) > 0, texts[0]["text"]))
