"""Polygon predicates and measures on edge tables.

An edge table has geom_id, part_id, ring_id (0 outer, others holes), seq and
the edge ends lon1, lat1, lon2, lat2; the edge with the next seq of a ring
starts where this one ends. Shapes across the antimeridian are not handled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import EARTH_RADIUS_M, cell_of, make_box
from ..functions.joins import lookup_join, top_per_key
from .cover import LEVELS, cell_number, cell_size, cells_at, polygon_cover

CELLS_PER_DEGREE = 1

# Boxes over more cells than this go by cells of COARSE_DEGREES instead.
FINE_CELLS = 64
COARSE_DEGREES = 30
_BOX_LEVELS = (2, *LEVELS)


def part_measures(edges: DataFrame) -> DataFrame:
    """Spherical area in square metres and bounding box of each part.

    Chamberlain & Duquette's ring formula, summed edge by edge: each edge adds
    its longitude span times the sines of its two latitudes, so the sum needs
    no neighbouring points and aggregates before the shuffle.
    """
    span = F.radians(F.col("lon2") - F.col("lon1"))
    term = span * (F.sin(F.radians("lat1")) + F.sin(F.radians("lat2")))
    rings = edges.groupBy("geom_id", "part_id", "ring_id").agg(
        (F.abs(F.sum(term)) * F.lit(EARTH_RADIUS_M * EARTH_RADIUS_M / 2.0)).alias("ring_area"),
        F.min("lat1").alias("south"),
        F.min("lon1").alias("west"),
        F.max("lat1").alias("north"),
        F.max("lon1").alias("east"),
    )
    signed = F.when(F.col("ring_id") == 0, F.col("ring_area")).otherwise(-F.col("ring_area"))
    return rings.groupBy("geom_id", "part_id").agg(
        F.sum(signed).alias("area"),
        F.min("south").alias("south"),
        F.min("west").alias("west"),
        F.max("north").alias("north"),
        F.max("east").alias("east"),
    )


def seed_boxes(
    edges: DataFrame,
    countries: DataFrame,
    max_seeds: int = 32,
    cumulative_ratio: float = 0.995,
    min_part_ratio: float = 0.0002,
) -> DataFrame:
    """Boxes of the largest parts that cover most of each country.

    ``countries`` has geom_id and its own ``bbox``, the answer when there is no
    polygon. Parts are taken by area until ``cumulative_ratio`` of the total
    (all parts) is reached or ``max_seeds`` are taken; parts below
    ``min_part_ratio`` are left out, except that the largest always stays.

    The rank cut comes first, so at most ``max_seeds`` parts of a country reach
    the running sum.
    """
    parts = part_measures(edges).where(F.col("area") > 0)
    totals = parts.groupBy("geom_id").agg(F.sum("area").alias("total"))
    largest = Window.partitionBy("geom_id").orderBy(F.col("area").desc(), "part_id")
    top = top_per_key(
        parts,
        "geom_id",
        [F.col("area").desc(), F.col("part_id")],
        max_seeds,
        rank="seed",
        spread_by=F.col("part_id"),
    )
    before = largest.rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        top.join(totals, "geom_id")
        .withColumn("covered", F.coalesce(F.sum("area").over(before), F.lit(0.0)))
        .where(
            (F.col("seed") == 1)
            | (
                (F.col("area") / F.col("total") >= min_part_ratio)
                & (F.col("covered") < F.col("total") * cumulative_ratio)
            )
        )
        .select(
            "geom_id",
            "seed",
            "part_id",
            "area",
            make_box(*[F.col(c) for c in ("south", "west", "north", "east")]).alias("seed_box"),
        )
    )
    return countries.join(chosen, "geom_id", "left").select(
        "geom_id",
        F.coalesce("seed", F.lit(1)).alias("seed"),
        "part_id",
        "area",
        F.coalesce("seed_box", "bbox").alias("bbox"),
    )


def _side(edge: Column, lon: Column, lat: Column) -> Column:
    """Cross product: which side of the edge's line the point is on."""
    return (edge.getField("lon2") - edge.getField("lon1")) * (lat - edge.getField("lat1")) - (
        lon - edge.getField("lon1")
    ) * (edge.getField("lat2") - edge.getField("lat1"))


# Added for an edge the point lies on; larger than any number of edges.
_ON_EDGE = 1 << 40


def _edge_score(edge: Column, lon: Column, lat: Column) -> Column:
    """1 when the edge crosses the eastward ray of the point, else 0.

    Most edges are ruled out by their latitudes alone. No division is needed:
    the point is west of the edge when it is on the proper side of its line.
    """
    lon1, lon2 = edge.getField("lon1"), edge.getField("lon2")
    lat1, lat2 = edge.getField("lat1"), edge.getField("lat2")
    side = _side(edge, lon, lat)
    beside = (lat < F.least(lat1, lat2)) | (lat > F.greatest(lat1, lat2))
    on_edge = (side == F.lit(0.0)) & lon.between(F.least(lon1, lon2), F.greatest(lon1, lon2))
    crosses = ((lat1 > lat) != (lat2 > lat)) & ((side > F.lit(0.0)) == (lat2 > lat1))
    one = lambda n: F.lit(n).cast("bigint")
    return F.when(beside, one(0)).when(on_edge, one(_ON_EDGE)).when(crosses, one(1)).otherwise(one(0))


def holds_point(edges: Column, loose: Column, odd: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test inside a border cell of a cover; a point on an edge is inside.

    ``loose`` has the latitudes in the cell's row where chains of edges east of
    the cell end, ``odd`` the parity of their ends above the row.
    """
    score = F.aggregate(
        edges, F.lit(0).cast("bigint"), lambda total, e: total + _edge_score(e, lon, lat)
    )
    above = F.size(F.filter(loose, lambda end: end > lat))
    return (score >= _ON_EDGE) | ((score + above + odd) % 2 == 1)


def _held(lon: Column, lat: Column) -> Column:
    return F.col("inside") | holds_point(F.col("edges"), F.col("loose"), F.col("odd"), lon, lat)


def points_in_polygons(points: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a point and a polygon part that holds it.

    A point is looked up in the parts' covers at every cell size; cells wholly
    inside answer by themselves. An equi-join on the cell (and on ``keys``, such
    as the point's own country) finds the candidates. The points of a crowded
    cell, also those with the same coordinates, are spread by the adaptive skew
    split.
    """
    located = points.select("*", F.explode(cells_at(F.col("lon"), F.col("lat"))).alias("_cell")).select(
        *points.columns, "_cell.*"
    )
    return (
        located.join(polygon_cover(edges), ["level", "cx", "cy", *keys])
        .where(_held(F.col("lon"), F.col("lat")))
        .drop("level", "cx", "cy", "inside", "edges", "loose", "odd")
    )


def points_inside(
    points: DataFrame,
    edges: DataFrame,
    key: str = "geom_id",
    id_col: str = "point_id",
) -> DataFrame:
    """Every point with ``inside``: whether the geometry it names holds it.

    True where that geometry is not known (or none is named), so that a filter
    by it keeps such points; false without usable coordinates.
    """
    held = (
        points_in_polygons(points.where(F.col(key).isNotNull()), edges, (key,))
        .select(id_col).distinct().withColumn("_held", F.lit(True))
    )
    shaped = edges.select(key).distinct().withColumn("_shaped", F.lit(True))
    known = lookup_join(points, shaped, [key], spread_nulls=F.col(id_col))
    return (
        known.join(held, id_col, "left")
        .withColumn("inside", F.col("_shaped").isNull() | F.col("_held").isNotNull())
        .drop("_shaped", "_held")
    )


def _at_cells(
    points: DataFrame, per_degree: float, index: DataFrame, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Points beside the index rows of their cell."""
    located = points.withColumns(
        {"cx": cell_of(F.col("lon"), per_degree), "cy": cell_of(F.col("lat"), per_degree)}
    )
    return located.join(index, ["cx", "cy", *keys])


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, per_degree: int = CELLS_PER_DEGREE, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs of a point and a box (south, west, north, east) that holds it.

    A box is listed under the cells it covers, a large one under coarse cells,
    so even a box of the whole world is a few rows. Points are looked up at
    both sizes.
    """
    across = cell_of(F.col("east"), per_degree) - cell_of(F.col("west"), per_degree) + 1
    up = cell_of(F.col("north"), per_degree) - cell_of(F.col("south"), per_degree) + 1
    fine = F.coalesce(across.cast("bigint") * up <= FINE_CELLS, F.lit(False))

    def held(some: DataFrame, size: float) -> DataFrame:
        covered = some.select("*", F.explode(_span(F.col("west"), F.col("east"), size)).alias("cx"))
        covered = covered.select("*", F.explode(_span(F.col("south"), F.col("north"), size)).alias("cy"))
        return (
            _at_cells(points, size, covered, keys)
            .where(F.col("lat").between(F.col("south"), F.col("north")))
            .where(F.col("lon").between(F.col("west"), F.col("east")))
            .drop("cx", "cy")
        )

    return held(boxes.where(fine), per_degree).unionByName(held(boxes.where(~fine), 1 / COARSE_DEGREES))


def _span(low: Column, high: Column, per_degree: float) -> Column:
    inside = lambda c: F.greatest(F.least(c, F.lit(180.0)), F.lit(-180.0))
    first, last = cell_of(inside(low), per_degree), cell_of(inside(high), per_degree)
    return F.when(first <= last, F.sequence(first, last))


def _touches(edge: Column) -> Column:
    """The edge and the box of this row share a point.

    Their extents overlap and the four corners are not all strictly on one
    side of the edge's line.
    """
    lon1, lon2 = edge.getField("lon1"), edge.getField("lon2")
    lat1, lat2 = edge.getField("lat1"), edge.getField("lat2")
    overlap = (
        (F.greatest(lon1, lon2) >= F.col("west"))
        & (F.least(lon1, lon2) <= F.col("east"))
        & (F.greatest(lat1, lat2) >= F.col("south"))
        & (F.least(lat1, lat2) <= F.col("north"))
    )
    sides = [
        _side(edge, F.col(lon), F.col(lat)) for lon in ("west", "east") for lat in ("south", "north")
    ]
    return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _ancestors(levels: tuple[int, ...], own: Column, cx: Column, cy: Column, itself: bool) -> Column:
    """A cell's numbers at all coarser ``levels``, and at its own if wanted."""
    each = F.array(
        *(
            F.struct(
                F.lit(n).alias("key_level"), F.call_function("shiftright", cx, own - n).alias("kx"),
                F.call_function("shiftright", cy, own - n).alias("ky"),
            )
            for n in levels
        )
    )
    return F.filter(each, lambda c: (c["key_level"] <= own) if itself else (c["key_level"] < own))


def boxes_meet_polygons(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether each box (box_id, geom_id, sides) meets its own geometry.

    True when an edge touches the box or the box's south-west corner lies in a
    part; true as well for boxes whose geometry is not known. A box goes by few
    cells of its own size, the world by eight. They meet the cells of its
    geometry's cover that are as large or larger in one join and the smaller
    ones in another. A cell wholly inside that overlaps the box says yes, a
    border cell answers for its edges and, if the corner lies in it, for that.
    """
    inside = lambda c: F.greatest(F.least(F.col(c), F.lit(180.0)), F.lit(-180.0))
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.lit(_BOX_LEVELS[0])
    for finer in _BOX_LEVELS[1:]:
        level = F.when(extent <= 4 * 360.0 / (1 << finer), F.lit(finer)).otherwise(level)
    size = cell_size(F.col("own"))
    span = lambda a, b: F.when(
        cell_number(inside(a), size) <= cell_number(inside(b), size),
        F.sequence(cell_number(inside(a), size), cell_number(inside(b), size)),
    )
    box_cells = boxes.select("box_id", "geom_id", "south", "west", "north", "east", level.alias("own"))
    box_cells = box_cells.withColumn("bx", F.explode(span("west", "east"))).withColumn("by", F.explode(span("south", "north")))
    cover = polygon_cover(edges).drop("part_id")

    side = cell_size(F.col("level"))
    cell_west, cell_south = F.col("cx") * side - 180.0, F.col("cy") * side - 180.0
    overlap = (
        (cell_west <= F.col("east")) & (cell_west + side >= F.col("west"))
        & (cell_south <= F.col("north")) & (cell_south + side >= F.col("south"))
    )
    here = (F.col("cx") == cell_number(F.col("west"), side)) & (F.col("cy") == cell_number(F.col("south"), side))
    corner = here & holds_point(F.col("edges"), F.col("loose"), F.col("odd"), F.col("west"), F.col("south"))
    hit = (F.col("inside") & overlap) | (~F.col("inside") & (F.exists("edges", _touches) | corner))

    def met(box_side: DataFrame, cover_side: DataFrame) -> DataFrame:
        keys = ["geom_id", "key_level", "kx", "ky"]
        other = cover_side.select(*[F.col(k).alias(f"_{k}") for k in keys], "level", "cx", "cy", "inside", "edges", "loose", "odd")
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        return box_side.join(other, same & hit, "left_semi").select("box_id")

    up = lambda df, levels, own, cx, cy, itself: df.select(
        "*", F.explode(_ancestors(levels, F.col(own), F.col(cx), F.col(cy), itself)).alias("_k")
    ).select(*df.columns, "_k.*")
    at_box = box_cells.select("*", F.col("own").alias("key_level"), F.col("bx").alias("kx"), F.col("by").alias("ky"))
    at_cover = cover.select("*", F.col("level").alias("key_level"), F.col("cx").alias("kx"), F.col("cy").alias("ky"))
    found = (
        met(up(box_cells, LEVELS, "own", "bx", "by", True), at_cover)
        .unionByName(met(at_box, up(cover, _BOX_LEVELS, "level", "cx", "cy", False)))
        .distinct().withColumn("met", F.lit(True))
    )
    shaped = edges.select("geom_id").distinct().withColumn("has_shape", F.lit(True))
    return (
        boxes.select("box_id", "geom_id")
        .join(found, "box_id", "left")
        .join(shaped, "geom_id", "left")
        .select(
            "box_id",
            "geom_id",
            (F.col("has_shape").isNull() | F.col("met").isNotNull()).alias("intersects"),
        )
    )
