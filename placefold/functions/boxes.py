"""Bounding boxes as struct<south, west, north, east> and great-circle maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_float

# Fixed value: mean earth radius in metres (public geodesy constant).
EARTH_RADIUS_M = 6371008.8

SIDES = ("south", "west", "north", "east")


def make_box(south: Column, west: Column, north: Column, east: Column) -> Column:
    return F.struct(
        south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east")
    )


def _from_list(values: Column, order: tuple[str, ...], strict: bool) -> Column:
    side = {name: parse_float(F.get(values, F.lit(i))) for i, name in enumerate(order)}
    box = make_box(*[side[name] for name in SIDES])
    wrong = F.raise_error(F.lit("a bounding box needs four values")) if strict else F.lit(None)
    return F.when(F.coalesce(F.size(values) == 4, F.lit(False)), box).otherwise(wrong)


def parse_box(values: Column, strict: bool = False) -> Column:
    """Box from text values in the order south, north, west, east.

    A list of another length gives null, or fails the job when ``strict``.
    """
    return _from_list(values, ("south", "north", "west", "east"), strict)


def box_from_list(values: Column, strict: bool = False, numeric: bool = False) -> Column:
    """Box from values in the order west, south, east, north.

    ``numeric`` lists are taken as they are; texts are read tolerantly.
    """
    if numeric:
        side = {name: F.get(values, F.lit(i)) for i, name in enumerate(("west", "south", "east", "north"))}
        box = make_box(*[side[name].cast("double") for name in SIDES])
        wrong = F.raise_error(F.lit("a bounding box needs four values")) if strict else F.lit(None)
        return F.when(F.coalesce(F.size(values) == 4, F.lit(False)), box).otherwise(wrong)
    return _from_list(values.cast("array<string>"), ("west", "south", "east", "north"), strict)


def box_to_list(box: Column) -> Column:
    values = F.array(*[box.getField(side) for side in ("west", "south", "east", "north")])
    return F.when(box.isNotNull(), values)


def center_lat(box: Column) -> Column:
    return (box.getField("south") + box.getField("north")) / F.lit(2.0)


def center_lon(box: Column) -> Column:
    return (box.getField("west") + box.getField("east")) / F.lit(2.0)


def quadrants(box: Column) -> Column:
    """Four child boxes in the order SW, SE, NW, NE."""
    south, west, north, east = (box.getField(side) for side in SIDES)
    lat, lon = center_lat(box), center_lon(box)
    return F.array(
        make_box(south, west, lat, lon),
        make_box(south, lon, lat, east),
        make_box(lat, west, north, lon),
        make_box(lat, lon, north, east),
    )


def can_split(box: Column, min_width: float = 0.05, min_height: float = 0.05) -> Column:
    """Both sides strictly larger than the minimum."""
    return (box.getField("east") - box.getField("west") > F.lit(min_width)) & (
        box.getField("north") - box.getField("south") > F.lit(min_height)
    )


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / F.lit(2.0)
    half_lon = F.radians(lon2 - lon1) / F.lit(2.0)
    a = F.sin(half_lat) * F.sin(half_lat) + F.sin(half_lon) * F.sin(half_lon) * F.cos(
        F.radians(lat1)
    ) * F.cos(F.radians(lat2))
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def radius_m(box: Column, cap: float | None = None) -> Column:
    """Largest centre-to-corner distance in whole metres, at most ``cap``.

    East and west corners lie at the same distance from the centre, so one
    corner per latitude is enough.
    """
    lat, lon = center_lat(box), center_lon(box)
    west = box.getField("west")
    far = F.greatest(
        haversine_m(lat, lon, box.getField("south"), west),
        haversine_m(lat, lon, box.getField("north"), west),
    )
    metres = F.ceil(far).cast("bigint")
    return metres if cap is None else F.least(metres, F.lit(int(cap)).cast("bigint"))


def in_box(lat: Column, lon: Column, box: Column) -> Column:
    """Inclusive on all four sides."""
    return lat.between(box.getField("south"), box.getField("north")) & lon.between(
        box.getField("west"), box.getField("east")
    )


def cell_of(coordinate: Column, per_degree: float) -> Column:
    """Index of the half-open grid cell that holds the coordinate; null if it is none."""
    usable = coordinate.between(-180.0, 180.0)
    return F.when(usable, F.floor(coordinate * F.lit(float(per_degree))).cast("int"))
