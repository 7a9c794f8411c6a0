"""Covers of polygon parts by quadtree cells of several sizes.

The square of 360 degrees is halved ``level`` times a side; the cells of a
level are numbered from its south-west corner. Cells that an edge reaches are
border cells and stay small; cells wholly inside are merged upwards, 64 to one,
where all 64 of the same square of Morton codes are inside. The cells of a
cover do not overlap and tile the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (5, 8, 11, 14)  # 11.25 to 0.022 degrees
STEP = 3
# A part is cut into so many cells a side at most, or the root of its edges.
LEAST_SIDE = 16
# Clipped edges are widened by this: a cell may list an edge that just misses it.
SLACK = 1e-9

PART = ("geom_id", "part_id")


def cell_size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level.cast("double"))


def cell_number(coordinate: Column, size: Column) -> Column:
    return F.floor((coordinate + F.lit(180.0)) / size).cast("int")


def usable(coordinate: Column) -> Column:
    return coordinate.between(-180.0, 180.0)


def _spread(c: Column) -> Column:
    """The 16 low bits of a number with a gap behind each."""
    x = c.cast("bigint")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def _gathered(c: Column) -> Column:
    x = c.bitwiseAND(F.lit(0x55555555).cast("bigint"))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x.cast("int")


def morton(cx: Column, cy: Column) -> Column:
    """Number of a cell on the Z-shaped curve: the bits of both numbers in turn."""
    return _spread(cx).bitwiseOR(F.shiftleft(_spread(cy), 1))


def unmorton(z: Column) -> tuple[Column, Column]:
    return _gathered(z), _gathered(F.shiftright(z, 1))


def part_levels(edges: DataFrame) -> DataFrame:
    """(geom_id, part_id, level, west): the size of a part's smallest cells, by its extent and its edges."""
    stats = edges.groupBy(*PART).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least("lon1", "lon2")).alias("west"),
        F.greatest(
            F.max(F.greatest("lon1", "lon2")) - F.min(F.least("lon1", "lon2")),
            F.max(F.greatest("lat1", "lat2")) - F.min(F.least("lat1", "lat2")),
        ).alias("extent"),
    )
    side = F.greatest(F.lit(float(LEAST_SIDE)), F.sqrt("n"))
    level = F.lit(LEVELS[0])
    for finer in LEVELS[1:]:
        level = F.when(F.col("extent") <= side * F.lit(360.0 / (1 << finer)), F.lit(finer)).otherwise(level)
    return stats.select(*PART, level.alias("level"), "west")


def _rows(edges: DataFrame) -> DataFrame:
    """Edges by the rows of cells they reach, with their columns in that row."""
    sized = edges.join(part_levels(edges), [*PART]).withColumn("size", cell_size(F.col("level")))
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    size = F.col("size")
    rows = sized.withColumn("cy", F.explode(F.sequence(cell_number(low, size), cell_number(high, size))))
    south = F.col("cy") * size - 180.0
    at = lambda y: F.when(F.col("lat1") == F.col("lat2"), None).otherwise(
        F.col("lon1") + (y - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    )
    xs = [F.coalesce(at(F.greatest(low, south)), F.col("lon1")), F.coalesce(at(F.least(high, south + size)), F.col("lon2"))]
    west = F.greatest(F.least(*xs) - SLACK, F.least("lon1", "lon2"))
    east = F.least(F.greatest(*xs) + SLACK, F.greatest("lon1", "lon2"))
    return rows.select(
        *PART, "level", "cy", "lon1", "lat1", "lon2", "lat2",
        cell_number(west, size).alias("w"), cell_number(east, size).alias("e"),
        cell_number(F.col("west"), size).alias("first"),
        cell_number(F.col("lat1"), size).alias("r1"), cell_number(F.col("lat2"), size).alias("r2"),
    )


def _loose_ends(rows: DataFrame) -> DataFrame:
    """Latitudes by cell of the vertices that have an odd number of their edges east of it.

    An edge wholly east of a cell crosses the eastward ray of a point in the
    cell when exactly one of its ends is above the point. Summed over edges, a
    vertex with both its edges east counts twice and cancels. Where its two
    edges begin at different columns, it counts in the columns between.
    """
    end = lambda k: F.struct(F.col(f"lon{k}").alias("x"), F.col(f"lat{k}").alias("y"), F.col(f"r{k}").alias("r"))
    ends = rows.select(*PART, "level", "cy", "w", "first", F.explode(F.array(end(1), end(2))).alias("v")).where(F.col("v.r") == F.col("cy"))
    met = ends.groupBy(*PART, "level", "cy", "v").agg(
        F.sort_array(F.collect_list("w"), asc=False).alias("ws"), F.min("first").alias("first")
    )
    odd = met.where((F.size("ws") % 2 == 1) | (F.element_at("ws", 1) != F.element_at("ws", -1)))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("ws") - 1, F.lit(2)),
        lambda i: F.struct(F.coalesce(F.get("ws", i + 1), F.col("first")).alias("lo"), (F.get("ws", i) - 1).alias("hi")),
    )
    between = odd.select(*PART, "level", "cy", F.col("v.y").alias("loose"), F.explode(pairs).alias("p")).where("p.lo <= p.hi")
    return between.select(*PART, "level", "cy", F.explode(F.sequence("p.lo", "p.hi")).alias("cx"), "loose")


def _cells(edges: DataFrame) -> DataFrame:
    """Border cells: what reaches into them, and the ends above their row of the edges that begin there."""
    rows = _rows(edges)
    above = (F.col("r1") > F.col("cy")).cast("int") + (F.col("r2") > F.col("cy")).cast("int")
    reached = rows.withColumn("cx", F.explode(F.sequence("w", "e"))).select(
        *PART, "level", "cy", "cx", F.struct("lon1", "lat1", "lon2", "lat2").alias("edge"),
        F.lit(None).cast("double").alias("loose"), F.when(F.col("cx") == F.col("w"), above).otherwise(0).alias("above"),
    )
    ends = _loose_ends(rows).select(
        *PART, "level", "cy", "cx", F.lit(None).cast(reached.schema["edge"].dataType).alias("edge"), "loose", F.lit(0).alias("above")
    )
    return reached.unionByName(ends).groupBy(*PART, "level", "cy", "cx").agg(
        F.collect_list("edge").alias("edges"), F.collect_list("loose").alias("loose"), F.sum("above").alias("above")
    )


def _merged(leaves: DataFrame) -> DataFrame:
    """Full squares of 64 inner cells as one cell of the next larger size, and so on."""
    done, left = [], leaves
    for _ in LEVELS[1:]:
        square = left.groupBy(*PART, "level", F.shiftright("z", 2 * STEP).alias("up")).agg(F.collect_list("z").alias("zs"))
        full = (F.size("zs") == 1 << (2 * STEP)) & (F.col("level") > LEVELS[0])
        done.append(square.where(~full).select(*PART, "level", F.explode("zs").alias("z")))
        left = square.where(full).select(*PART, (F.col("level") - STEP).alias("level"), F.col("up").alias("z"))
    for more in done:
        left = left.unionByName(more)
    return left


def polygon_cover(edges: DataFrame) -> DataFrame:
    """Cells of every part: geom_id, part_id, level, cx, cy, inside, edges, loose, odd.

    Cells with ``inside`` lie wholly in the part. The others have the edges
    that reach into them; ``loose`` and ``odd`` say the rest about edges further
    east: the latitudes where chains of them end in the cell's row, and the
    parity of those that end above it, a running sum over the row from the
    east. Each edge is kept about once per cell it passes; nothing is gathered
    per part or per row, so the work grows with the edges.
    """
    cells = _cells(edges)
    from_east = Window.partitionBy(*PART, "level", "cy").orderBy(F.desc("cx"))
    ahead = F.coalesce(F.sum("above").over(from_east.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = cells.withColumn("ahead", ahead).select(
        *PART, "level", "cx", "cy", F.lit(False).alias("inside"), "edges", "loose", (F.col("ahead") % 2).cast("int").alias("odd")
    )
    gaps = cells.select(*PART, "level", "cy", "cx", (ahead + F.col("above")).alias("upto"), F.lead("cx").over(from_east).alias("west"))
    runs = gaps.where((F.col("upto") % 2 == 1) & (F.col("cx") - F.col("west") > 1))
    leaves = runs.select(*PART, "level", F.explode(F.sequence(F.col("west") + 1, F.col("cx") - 1)).alias("cx"), "cy")
    merged = _merged(leaves.select(*PART, "level", morton(F.col("cx"), F.col("cy")).alias("z")))
    cx, cy = unmorton(F.col("z"))
    empty = lambda name: F.array().cast(border.schema[name].dataType).alias(name)
    inner = merged.select(
        *PART, "level", cx.alias("cx"), cy.alias("cy"), F.lit(True).alias("inside"), empty("edges"), empty("loose"), F.lit(0).alias("odd")
    )
    return border.unionByName(inner)


def cells_at(lon: Column, lat: Column, levels=LEVELS) -> Column:
    """The cells of all sizes that hold a point, none without usable coordinates."""
    each = F.array(
        *(
            F.struct(
                F.lit(n).alias("level"), cell_number(lon, F.lit(360.0 / (1 << n))).alias("cx"),
                cell_number(lat, F.lit(360.0 / (1 << n))).alias("cy"),
            )
            for n in levels
        )
    )
    return F.when(usable(lon) & usable(lat), each)
