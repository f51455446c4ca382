"""Text as columns: conservative names, numbers, node types, station bases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type endings of station names, in the order in which they are tried, and the least that must remain.
STATION_ENDINGS = ("CTS", "MTS", "JCT", "CSS", "SS", "TS", "GS", "DS", "SW")
LEAST_BASE = 5
#: Unit names of generators, voltage classes and plant endings of station names.
GENERATOR = r"^(?:(?:ST|CT|GT|S|C)?G\d+[A-Z]*|G\d+_[A-Z0-9]+)$"
RESPONSE, BATTERY, STORAGE, STORAGE_STATION = "_DRA", "BATT", "STRG", "STRGE"
VOLTAGE, PLANT = "-(LT|115|230|500)$", r"(GS|BESS\d*|STRGE)$"


def number(text: Column) -> Column:
    """Thousands commas go; missing and blank are 0; anything else that is no number fails the query."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(text.isNull() | (bare == ""), F.lit(0.0)).otherwise(bare.cast("double"))


def norm(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def without_parenthesis(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def alphanumeric(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def station_base(station: Column) -> Column:
    """A station's name without its type ending, if enough remains."""
    base = alphanumeric(station)
    fits = [(F.endswith(base, F.lit(e)) & (F.length(base) >= len(e) + LEAST_BASE), F.left(base, F.length(base) - len(e))) for e in STATION_ENDINGS]
    return reduce(lambda case, x: case.when(*x), fits[1:], F.when(*fits[0])).otherwise(base)


def node_base(node: Column) -> Column:
    """The station part of a node's name: all before its first -LT, hyphen or full stop."""
    return alphanumeric(F.regexp_extract(node, r"^(.*?)(?:-LT\b|[-.]|$)", 1))


def node_type(node: Column) -> Column:
    """What a node is, guessed from its name; the first rule that fits decides."""
    name = F.upper(node)
    station, unit = F.substring_index(name, ".", 1), F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)
    return (
        F.when(F.endswith(name, F.lit(":LMP")), "bus")
        .when(~F.contains(name, F.lit(".")), "load")
        .when(F.contains(unit, F.lit(RESPONSE)), "dra")
        .when(F.contains(unit, F.lit(BATTERY)) | F.contains(unit, F.lit(STORAGE)) | F.contains(station, F.lit(STORAGE_STATION)), "battery")
        .when(F.rlike(unit, F.lit(GENERATOR)), "generator")
        .when(F.startswith(unit, F.lit("AG")) | F.startswith(unit, F.lit("APG")), "aggregate")
        .otherwise("load")
    )


def name_stem(node: Column) -> Column:
    """What sibling nodes share: the station without its voltage class and plant or storage ending."""
    station = F.regexp_replace(F.substring_index(F.upper(node), ".", 1), ":LMP$", "")
    return F.regexp_replace(F.regexp_replace(station, VOLTAGE, ""), PLANT, "")


def column_name(label: str) -> str:
    """A label as a column name, for pivots with a fixed list of values."""
    return "_".join(label.lower().replace("-", " ").split())


def file_version(name: Column) -> tuple[Column, Column, Column]:
    """Date digits (8 or 4), is it final (no _vN), and its version number, from a file's name."""
    version = F.regexp_extract(name, r"_v(\d+)", 1)
    return F.nullif(F.regexp_extract(name, r"(\d{8}|\d{4})", 1), F.lit("")), version == "", F.coalesce(F.try_to_number(F.nullif(version, F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
