"""Boundary files: country name, code, box and GeoJSON geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import parse_box

# The geometry stays text here: the JSON reader keeps a nested object as its
# source text when the field is declared as a string.
BOUNDARY_SCHEMA = (
    "place_id bigint, display_name string, boundingbox array<string>, geojson string, "
    "address struct<country_code: string>"
)

POLYGON = "array<array<array<double>>>"


def read_boundaries(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """One row per boundary record: geom_id, name, code, bbox, geometry text."""
    rows = spark.read.schema(BOUNDARY_SCHEMA).json(path)
    return rows.select(
        F.col("place_id").alias("geom_id"),
        F.col("display_name").alias("country_name"),
        F.coalesce(F.col("address.country_code"), F.lit(country)).alias("country_code"),
        parse_box(F.col("boundingbox")).alias("bbox"),
        F.col("geojson").alias("geometry"),
    )


def polygon_parts(geometry: Column) -> Column:
    """Polygons of a GeoJSON Feature, Polygon or MultiPolygon as an array, null for anything else.

    ``geometry`` is a variant, so that its text is parsed once.
    """
    at = lambda path, kind: F.try_variant_get(geometry, path, kind)
    featured = F.coalesce(at("$.type", "string") == "Feature", F.lit(False))
    kind = F.when(featured, at("$.geometry.type", "string")).otherwise(at("$.type", "string"))
    rings = lambda kind: F.when(featured, at("$.geometry.coordinates", kind)).otherwise(at("$.coordinates", kind))
    return F.when(kind == "Polygon", F.array(rings(POLYGON))).when(kind == "MultiPolygon", rings(f"array<{POLYGON}>"))


def edge_table(boundaries: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Edges of all rings: geom_id, part_id, ring_id, seq and both ends.

    Broken texts, other geometries, nulls and rings of fewer than two points
    give no edges.
    """
    read = boundaries.select("geom_id", F.try_parse_json(F.col(geometry)).alias("_geometry"))
    parts = read.select("geom_id", F.posexplode(polygon_parts(F.col("_geometry"))).alias("part_id", "rings"))
    rings = parts.select("geom_id", "part_id", F.posexplode("rings").alias("ring_id", "ring"))
    n = F.size("ring") - 1
    ends = F.arrays_zip(
        F.slice("ring", F.lit(1), n).alias("a"), F.slice("ring", F.lit(2), n).alias("b")
    )
    edges = rings.where(F.size("ring") > 1).select(
        "geom_id", "part_id", "ring_id", F.posexplode(ends).alias("seq", "edge")
    )
    end = lambda name, i: F.get(F.col(f"edge.{name}"), F.lit(i))
    return edges.select(
        "geom_id",
        "part_id",
        "ring_id",
        "seq",
        end("a", 0).alias("lon1"),
        end("a", 1).alias("lat1"),
        end("b", 0).alias("lon2"),
        end("b", 1).alias("lat2"),
    )
