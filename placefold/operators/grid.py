"""Density-driven split of a box into quadtree cells, without recursion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import make_box, radius_m
from .polygons import points_in_boxes


@dataclass(frozen=True)
class GridRule:
    """Fixed default values of the split rule."""

    max_depth: int = 14
    split_threshold: int = 30
    target_radius_m: int = 25000
    min_width: float = 0.05
    min_height: float = 0.05

    def deepest(self, width: Column, height: Column) -> Column:
        """First depth whose cells are too small to split (or the limit)."""
        least = lambda side, low: F.ceil(F.log2(side / F.lit(low)) + F.lit(1e-9)).cast("int")
        return F.greatest(
            F.lit(0), F.least(F.lit(self.max_depth), least(width, self.min_width), least(height, self.min_height))
        )


ROOT_SIDES = ("_south", "_west", "_north", "_east")


def cell_box(depth: Column, ix: Column, iy: Column) -> Column:
    """Box of a cell of the row's root (columns ``ROOT_SIDES``)."""
    south, west, north, east = (F.col(c) for c in ROOT_SIDES)
    parts = F.pow(F.lit(2.0), depth.cast("double"))
    height, width = (north - south) / parts, (east - west) / parts
    return make_box(south + iy * height, west + ix * width, south + (iy + 1) * height, west + (ix + 1) * width)


def density_cells(
    points: DataFrame,
    root: tuple[float, float, float, float],
    rule: GridRule = GridRule(),
    by: tuple[str, ...] = ("job_id",),
) -> DataFrame:
    """Terminal cells of the split of one ``root`` (south, west, north, east).

    Points outside the root are not counted; ``by`` values without a point
    inside have no cell here (give them as roots to ``seeded_cells``).
    """
    south, west, north, east = (float(v) for v in root)
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    sides = dict(zip(ROOT_SIDES, map(F.lit, (south, west, north, east))))
    return _terminal_cells(points.where(inside).withColumns(sides), None, list(by), rule)


def seeded_cells(
    points: DataFrame, roots: DataFrame, rule: GridRule = GridRule(), keys: tuple[str, ...] = ("job_id", "seed")
) -> DataFrame:
    """Terminal cells of every root of every job in one pass.

    ``roots`` has ``keys`` (the first also in ``points``) and bbox. A root
    without points is one empty cell. Points meet only the roots of their own
    job that cover their part of the map, however many jobs there are.
    """
    sided = roots.select(*keys, *[F.col(f"bbox.{c[1:]}").alias(c[1:]) for c in ROOT_SIDES])
    names = {c[1:]: c for c in ROOT_SIDES}
    rows = points_in_boxes(points.select(keys[0], "lat", "lon"), sided, keys=(keys[0],)).withColumnsRenamed(names)
    return _terminal_cells(rows, sided.withColumnsRenamed(names), list(keys), rule)


def outside_roots(
    points: DataFrame, roots: DataFrame, id_col: str = "point_id", keys: tuple[str, ...] = ("job_id", "seed")
) -> DataFrame:
    """Points that no root of their job holds."""
    sided = roots.select(*keys, *[F.col(f"bbox.{c[1:]}").alias(c[1:]) for c in ROOT_SIDES])
    held = points_in_boxes(points.select(id_col, keys[0], "lat", "lon"), sided, keys=(keys[0],))
    return points.join(held.select(id_col).distinct(), id_col, "left_anti")


def _terminal_cells(points: DataFrame, roots: DataFrame | None, keys: list[str], rule: GridRule) -> DataFrame:
    """Terminal cells of points that carry the sides of their root.

    A cell with points splits when it may (depth, both sides above the minimum)
    and is too wide (radius) or too full (count). Cells are half-open, the last
    row and column closed.

    Points are counted per deepest cell first, so what follows works on
    occupied cells, not on points. Every cell then counts itself into its
    ancestors, a split cell names its four children, and a cell is terminal
    when it was named and does not split.
    """
    keys = [*keys, *ROOT_SIDES]
    south, west, north, east = (F.col(c) for c in ROOT_SIDES)
    depth = rule.deepest(east - west, north - south)

    def index(value: Column, low: Column, high: Column) -> Column:
        side = F.pow(F.lit(2.0), depth.cast("double"))
        return F.least(F.floor((value - low) / (high - low) * side), side - 1).cast("int")

    occupied = points.groupBy(
        *keys, index(F.col("lon"), west, east).alias("ix"), index(F.col("lat"), south, north).alias("iy")
    ).agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.col("_deep"))).alias("depth")
    cells = (
        occupied.withColumn("_deep", depth).select("*", level)
        .withColumns({"ix": F.expr("shiftright(ix, _deep - depth)"), "iy": F.expr("shiftright(iy, _deep - depth)")})
        .groupBy(*keys, "depth", "ix", "iy")
        .agg(F.sum("n").alias("n"))
    )
    box = cell_box(F.col("depth"), F.col("ix"), F.col("iy"))
    parts = F.pow(F.lit(2.0), F.col("depth").cast("double"))
    may_split = (
        (F.col("depth") < rule.max_depth)
        & ((east - west) / parts > F.lit(rule.min_width))
        & ((north - south) / parts > F.lit(rule.min_height))
    )
    splits = may_split & (
        (radius_m(box) > rule.target_radius_m) | (F.col("n") >= rule.split_threshold)
    )
    own = F.struct(
        F.col("depth"), F.col("ix"), F.col("iy"), F.col("n"),
        F.col("splits").alias("splits"), (F.col("depth") == 0).alias("named"),
    )
    children = F.array(
        *[
            F.struct(
                (F.col("depth") + 1).alias("depth"),
                (F.col("ix") * 2 + dx).alias("ix"),
                (F.col("iy") * 2 + dy).alias("iy"),
                F.lit(0).cast("bigint").alias("n"),
                F.lit(False).alias("splits"),
                F.lit(True).alias("named"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )
    named = (
        cells.withColumn("splits", splits)
        .select(
            *keys,
            F.explode(
                F.when(F.col("splits"), F.concat(F.array(own), children)).otherwise(F.array(own))
            ).alias("c"),
        )
        .select(*keys, "c.*")
    )
    if roots is not None:  # each is named, with or without points
        zero = F.lit(0)
        first = [zero.alias("depth"), zero.alias("ix"), zero.alias("iy"), zero.cast("bigint").alias("n")]
        named = named.unionByName(
            roots.select(*keys, *first, F.lit(False).alias("splits"), F.lit(True).alias("named"))
        )
    marked = (
        named.groupBy(*keys, "depth", "ix", "iy")
        .agg(
            F.sum("n").alias("n"),
            F.bool_or("splits").alias("splits"),
            F.bool_or("named").alias("named"),
        )
        .where(F.col("named") & ~F.col("splits"))
    )
    return marked.select(
        *[k for k in keys if k not in ROOT_SIDES],
        "depth",
        "ix",
        "iy",
        box.alias("bbox"),
        "n",
        (F.col("n") >= rule.split_threshold).alias("exhaustive"),
    )
