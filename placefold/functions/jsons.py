"""JSON text columns: tolerant reads and writes that keep nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX_DDL = "struct<south: double, west: double, north: double, east: double>"
ADDRESS_DDL = (
    "struct<street: string, city: string, state: string, postcode: string, country: string>"
)


def decode(c: Column, ddl: str) -> Column:
    """Parsed JSON, null when the text is not JSON of that shape.

    For an array ``from_json`` does just that. For a struct it answers bad text
    with a struct of nulls; whether the text is an object at all is a scan of
    its outermost keys.
    """
    value = F.from_json(c, ddl)
    return value if ddl.startswith("array") else F.when(F.json_object_keys(c).isNotNull(), value)


def encode(c: Column, default: str) -> Column:
    """JSON text with null fields kept; ``default`` for a null value."""
    return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit(default))


def setting(c: Column, field: str, ddl: str, default) -> Column:
    """One field of a settings text, ``default`` when missing or broken."""
    value = F.from_json(c, f"struct<{field}: {ddl}>").getField(field)
    return F.coalesce(value, F.lit(default).cast(ddl))
