"""Declared schemas of the input files; readers fail on what doesn't fit."""

from __future__ import annotations

from pyspark.sql import DataFrame

TARIFFS = "effective_from date, effective_to date, plan string, season string, period string, day_type string, start_hour int, end_hour int, commodity_c_per_kwh double, delivery_variable_c_per_kwh double, source_url string"
HOLIDAYS = "date date, name string, note string"
DECISIONS = "licence_no string, utility_name string, decision string, target_licence_no string, reason string, source_url string, decided_by string, status string"
OVERRIDES = "licence_no string, utility_name string, owner_override string, reason string"
NODES = "Longitude double, Latitude double, Location string"
STATIONS = "station_name string, electrical_zone string"
HOURLY_PRICE = "timestamp_utc timestamp, price double"
NODE_DAILY = "node_id string, date date, mean_lmp_minus_ozp double, mean_loss double, mean_congestion double, n_hours int"
QA_LOG = "phase string, dataset string, action string, record_id string, count long, note string"
POINT = "struct<x:double,y:double>"
POLYGONS = f"array<array<array<{POINT}>>>"  # polygons of rings of points; the first ring is the shell


class SchemaError(ValueError):
    """An input that lacks what its schema declares, or is empty where it may not be."""


def require(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")
    return df
