"""Place lookup by grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import cell_of, haversine_m
from ..functions.joins import lookup_join
from ..workspace import stored

PER_DEGREE = 10


def cell_places(gazetteer: DataFrame) -> DataFrame:
    """One place per 0.1 degree cell: the lowest place_id.

    The result has at most 3600 x 1800 rows, however large the gazetteer is.
    """
    rest = [c for c in gazetteer.columns if c not in ("cell_x", "cell_y")]
    first = F.min_by(F.struct(*rest), "place_id").alias("place")
    return gazetteer.groupBy("cell_x", "cell_y").agg(first).select("cell_x", "cell_y", "place.*")


def locate_points(points: DataFrame, gazetteer: DataFrame, id_col: str = "point_id") -> DataFrame:
    """Points with the place of their cell, null where no place is known.

    Points without usable coordinates keep their row; ``id_col`` spreads them.
    """
    located = points.withColumns(
        {
            "cell_x": cell_of(F.col("lon"), PER_DEGREE),
            "cell_y": cell_of(F.col("lat"), PER_DEGREE),
        }
    )
    return lookup_join(located, cell_places(gazetteer), ["cell_x", "cell_y"], spread_nulls=F.col(id_col))


# Nearest places. Cells of space: cubes around the unit sphere, each level four times wider.
_LEAST_SIDE = 0.002  # about a tenth of a degree
_LEVELS = 6  # the widest cubes hold the whole sphere
_AXES = ("x", "y", "z")


def _vector(lon: Column, lat: Column) -> list[Column]:
    at, up = F.radians(lon), F.radians(lat)
    return [(F.cos(up) * F.cos(at)).alias("x"), (F.cos(up) * F.sin(at)).alias("y"), F.sin(up).alias("z")]


def _cube(c: Column) -> Column:
    return F.floor((c + 1.0) / F.lit(_LEAST_SIDE)).cast("bigint")


def _cubes(df: DataFrame) -> list[Column]:
    return [_cube(F.col(a)).alias(f"i{a}") for a in _AXES]


def _at(levels: int) -> Column:
    """The cubes of all sizes that hold a row's smallest one."""
    each = [
        F.struct(F.lit(n).alias("level"), *[F.shiftright(F.col(f"i{a}"), 2 * n).alias(f"c{a}") for a in _AXES])
        for n in range(levels)
    ]
    return F.array(*each)


def _around(cube: Column) -> Column:
    """A cube and its neighbours of the same size, 27 in all."""
    steps = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    moved = lambda dx, dy, dz: F.struct(
        cube["level"].alias("level"), (cube["cx"] + dx).alias("cx"), (cube["cy"] + dy).alias("cy"), (cube["cz"] + dz).alias("cz")
    )
    return F.flatten(
        F.transform(steps, lambda dx: F.flatten(F.transform(steps, lambda dy: F.transform(steps, lambda dz: moved(dx, dy, dz)))))
    )


def _gap(level: int, far: bool) -> Column:
    """Least or largest distance between points of a row's smallest cube and of its candidate cube."""
    total = F.lit(0.0)
    wide = float(4**level)
    for a in _AXES:
        low, own = F.col(f"c{a}").cast("double") * wide, F.col(f"i{a}").cast("double")
        if far:
            apart = F.greatest(low + wide - own, own + 1.0 - low)
        else:
            apart = F.greatest(low - own - 1.0, own - low - wide, F.lit(0.0))
        total = total + apart * apart
    return F.sqrt(total) * F.lit(_LEAST_SIDE)


def _candidates(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Places that can be nearest to some point of each smallest cube (ix, iy, iz of ``cells``).

    Rings of cubes grow until one holds a place; four times wider, the same
    ring holds every place that can be nearest. From there on cubes are halved
    twice at a time, and those go that are further off than another one's far
    side. Nothing but cubes is compared, so the work does not grow with the
    points, and each cube keeps few candidates: one row with all of them, ``near``.
    """
    own, cube = ["ix", "iy", "iz"], ["level", "cx", "cy", "cz"]
    held = stored(places.select(*_cubes(places)).distinct().select(F.explode(_at(_LEVELS)).alias("c")).select("c.*").distinct(), "cubes")
    rings = cells.select(*own, F.explode(F.flatten(F.transform(_at(_LEVELS), _around))).alias("c")).select(*own, "c.*")
    # The level to begin at: one wider than the first ring with a place.
    first = rings.join(held, cube, "left_semi").groupBy(*own).agg(F.least(F.min("level") + 1, F.lit(_LEVELS - 1)).alias("first"))
    begin = first.select(*own, F.explode(_around(F.get(_at(_LEVELS), F.col("first")))).alias("c")).select(*own, "c.*")
    begin = stored(begin.join(held, cube, "left_semi"), "rings")
    nearest = Window.partitionBy(*own)
    kept = None
    for level in range(_LEVELS - 1, -1, -1):
        new = begin.where(F.col("level") == level).drop("level")
        if kept is not None:
            inside = held.where(F.col("level") == level).select(*[F.shiftright(f"c{a}", 2).alias(f"p{a}") for a in _AXES], "cx", "cy", "cz")
            old = kept.select(*own, *[F.col(f"c{a}").alias(f"p{a}") for a in _AXES]).join(inside, ["px", "py", "pz"])
            new = old.select(*own, "cx", "cy", "cz").unionByName(new)
        kept = (
            new.withColumn("least", _gap(level, far=False)).withColumn("most", F.min(_gap(level, far=True)).over(nearest))
            .where(F.col("least") <= F.col("most") + 1e-9).drop("least", "most")
        )
    named = places.select("*", *[_cube(F.col(a)).alias(f"c{a}") for a in _AXES])
    met = _undominated(kept.join(named, ["cx", "cy", "cz"]).drop("cx", "cy", "cz"))
    return met.groupBy(*own).agg(F.collect_list(F.struct("place_id", "place_lon", "place_lat")).alias("near"))


def _undominated(met: DataFrame) -> DataFrame:
    """Candidates of each smallest cube, but for those that are further off all over the cube than its middle's nearest.

    Of two places p and q on the sphere, q is the nearer one to x by
    x . (q - p), half the difference of the squared distances. That is linear,
    so its least value over a cube is exact. What is left differs by less than
    a millimetre or is nearest somewhere.
    """
    apart, least = F.lit(0.0), F.lit(0.0)
    for a in _AXES:
        low = F.col(f"i{a}").cast("double") * F.lit(_LEAST_SIDE) - 1.0
        off, gain = F.col(a) - low - F.lit(_LEAST_SIDE / 2), F.col(f"q.{a}") - F.col(a)
        apart = apart + off * off
        least = least + F.least(low * gain, (low + F.lit(_LEAST_SIDE)) * gain)
    middle = F.min(F.struct(apart.alias("d"), *_AXES)).over(Window.partitionBy("ix", "iy", "iz"))
    return met.withColumn("q", middle).where(least <= 1e-9).drop("q")


def nearest_places(points: DataFrame, gazetteer: DataFrame, id_col: str = "point_id") -> DataFrame:
    """The nearest place of each point whose own cell has none: id, place_id, distance_mm.

    A place lies in the middle of its cell. Distances go along great circles, in
    whole millimetres; of equally near places the lowest place_id counts. Space
    is cut by cubes, so poles and the date line are like any other place. Points
    without usable coordinates and all points of an empty gazetteer get no row.
    """
    places = cell_places(gazetteer).select(
        "place_id", ((F.col("cell_x") + 0.5) / PER_DEGREE).alias("place_lon"), ((F.col("cell_y") + 0.5) / PER_DEGREE).alias("place_lat")
    )
    placed = places.select("*", *_vector(F.col("place_lon"), F.col("place_lat")))
    located = points.where(F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-90.0, 90.0)).withColumns(
        {"cell_x": cell_of(F.col("lon"), PER_DEGREE), "cell_y": cell_of(F.col("lat"), PER_DEGREE)}
    )
    alone = located.join(gazetteer.select("cell_x", "cell_y").distinct(), ["cell_x", "cell_y"], "left_anti")
    in_space = alone.select(id_col, "lon", "lat", *_vector(F.col("lon"), F.col("lat")))
    cubed = in_space.select(id_col, "lon", "lat", *_cubes(in_space))
    found = cubed.join(_candidates(cubed.select("ix", "iy", "iz").distinct(), placed), ["ix", "iy", "iz"])
    metres = lambda p: haversine_m(F.col("lat"), F.col("lon"), p["place_lat"], p["place_lon"])
    away = lambda p: F.struct(
        F.floor(metres(p) * 1000 + 0.5).cast("bigint").alias("distance_mm"), p["place_id"].alias("place_id")
    )
    # A point's candidates stay in its row: they are neither sorted nor sent.
    best = found.select(id_col, F.array_min(F.transform("near", away)).alias("best"))
    return best.groupBy(id_col).agg(F.min("best").alias("best")).select(id_col, "best.place_id", "best.distance_mm")
