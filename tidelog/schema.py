"""Field roles of an event log, and the canonical columns that every operator reads."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANONICAL = ("geo_location", "country", "city", "usr", "accession", "method", "filename", "ts", "event_id")


@dataclass(frozen=True)
class LogSchema:
    """Which column of a log plays which role; None where it has none."""

    location_field: str = "geo_location"
    country_field: str | None = "country"
    city_field: str | None = "geoip_city_name"
    user_field: str | None = "user"
    project_field: str | None = "accession"
    method_field: str | None = "method"
    filename_field: str | None = "filename"
    timestamp_field: str = "timestamp"
    id_field: str | None = None
    min_location_downloads: int = 1
    min_year: int = 2020
    working_hours_start: int = 9
    working_hours_end: int = 17
    night_hours_start: int = 22
    night_hours_end: int = 6


_schemas: dict[str, LogSchema] = {}


def register_schema(name: str, schema: LogSchema) -> None:
    _schemas[name] = schema


def get_schema(name: str) -> LogSchema:
    if name not in _schemas:
        raise KeyError(f"no schema {name!r}; registered: {sorted(_schemas)}")
    return _schemas[name]


def available_schemas() -> list[str]:
    return sorted(_schemas)


def override(schema: LogSchema, **changes) -> LogSchema:
    """A copy with other values; all further fields stay."""
    return replace(schema, **changes)


register_schema("default", LogSchema())
register_schema(
    "canonical",
    LogSchema(city_field="city", user_field="usr", timestamp_field="ts", id_field="event_id"),
)


def canonical(events: DataFrame, schema: LogSchema) -> DataFrame:
    """The log with canonical names; a role without a column is null.

    The timestamp may be a string. Without an id column, ties in time are
    ordered by a hash of the whole row, so results don't depend on partitions.
    """
    roles = {
        "geo_location": schema.location_field,
        "country": schema.country_field,
        "city": schema.city_field,
        "usr": schema.user_field,
        "accession": schema.project_field,
        "method": schema.method_field,
        "filename": schema.filename_field,
    }
    own = set(events.columns)
    columns = [
        (F.col(f"`{field}`") if field in own else F.lit(None)).cast("string").alias(name) for name, field in roles.items()
    ]
    when = F.col(f"`{schema.timestamp_field}`").cast("timestamp_ntz").alias("ts")
    tie = F.col(f"`{schema.id_field}`") if schema.id_field in own else F.xxhash64(*[F.col(f"`{c}`") for c in events.columns])
    return events.select(*columns, when, tie.cast("long").alias("event_id"))
