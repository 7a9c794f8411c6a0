"""Spatial operators against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from placefold.functions import boxes as bx
from placefold.operators import cover, gazetteer, grid, polygons
from placefold.sources import boundaries

R = 6371008.8


def haversine(lat1, lon1, lat2, lon2):
    p = math.radians
    a = math.sin(p(lat2 - lat1) / 2) ** 2 + math.sin(p(lon2 - lon1) / 2) ** 2 * math.cos(p(lat1)) * math.cos(p(lat2))
    return 2 * R * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def radius(box):
    s, w, n, e = box
    lat, lon = (s + n) / 2, (w + e) / 2
    return math.ceil(max(haversine(lat, lon, a, b) for a in (s, n) for b in (w, e)))


# --- density grid ---------------------------------------------------------


def split_recursively(points, root, rule):
    """Cells by splitting box after box; half-open, the root's far sides closed."""
    leaves = {}

    def visit(box, depth, ix, iy, inside):
        s, w, n, e = box
        may = depth < rule.max_depth and e - w > rule.min_width and n - s > rule.min_height
        if inside and may and (radius(box) > rule.target_radius_m or len(inside) >= rule.split_threshold):
            lat, lon = (s + n) / 2, (w + e) / 2
            for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
                child = (lat if dy else s, lon if dx else w, n if dy else lat, e if dx else lon)
                held = [p for p in inside if (p[0] >= lat) == bool(dy) and (p[1] >= lon) == bool(dx)]
                visit(child, depth + 1, ix * 2 + dx, iy * 2 + dy, held)
        else:
            leaves[(depth, ix, iy)] = len(inside)

    visit(root, 0, 0, 0, points)
    return leaves


@pytest.mark.parametrize("rule", [grid.GridRule(), grid.GridRule(max_depth=5, split_threshold=7)])
def test_grid_equals_recursive_split(spark, rule):
    rng = random.Random(4)
    root = (40.0, 0.0, 48.0, 8.0)
    points = [(40 + rng.random() * 8, rng.random() * 8) for _ in range(800)]
    points += [(43 + rng.random() / 20, 5 + rng.random() / 20) for _ in range(900)]  # one crowded spot
    points += [(48.0, 8.0), (40.0, 0.0), (44.0, 4.0)]
    frame = spark.createDataFrame([("j", *p) for p in points], "job_id string, lat double, lon double")
    cells = grid.density_cells(frame, root, rule).collect()
    got = {(r.depth, r.ix, r.iy): r.n for r in cells}
    assert got == split_recursively(points, root, rule)
    assert len(cells) == len(got)
    assert sum(got.values()) == len(points)
    area = sum((r.bbox.north - r.bbox.south) * (r.bbox.east - r.bbox.west) for r in cells)
    assert area == pytest.approx(64.0)


def test_grid_keeps_an_unsplit_root(spark):
    frame = spark.createDataFrame([("j", 0.01, 0.01)], "job_id string, lat double, lon double")
    cells = grid.density_cells(frame, (0.0, 0.0, 0.04, 0.04)).collect()
    assert [(r.depth, r.n, r.exhaustive) for r in cells] == [(0, 1, False)]


# --- boxes ----------------------------------------------------------------


def test_box_helpers(spark):
    row = spark.range(1).select(
        bx.parse_box(F.array(*[F.lit(v) for v in ("1.5", "2", "-3", "4x")])).alias("b"),
        bx.parse_box(F.array(F.lit("1"), F.lit("2"))).alias("short"),
    ).select(
        "b", "short",
        bx.box_to_list(F.col("b")).alias("l"),
        bx.quadrants(F.col("b")).alias("q"),
        bx.radius_m(F.col("b")).alias("r"),
        bx.radius_m(F.col("b"), 1000).alias("capped"),
        bx.in_box(F.lit(1.5), F.lit(4.0), F.col("b")).alias("inside"),
        bx.in_box(F.lit(1.49), F.lit(4.0), F.col("b")).alias("outside"),
        bx.can_split(bx.make_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.05))).alias("thin"),
    ).first()
    assert tuple(row.b) == (1.5, -3.0, 2.0, 4.0) and row.short is None
    assert row.l == [-3.0, 1.5, 4.0, 2.0]
    assert [tuple(q) for q in row.q] == [
        (1.5, -3.0, 1.75, 0.5), (1.5, 0.5, 1.75, 4.0), (1.75, -3.0, 2.0, 0.5), (1.75, 0.5, 2.0, 4.0)]
    assert row.r == radius((1.5, -3.0, 2.0, 4.0)) and row.capped == 1000
    assert row.inside and not row.outside and not row.thin


def test_strict_box_fails(spark):
    with pytest.raises(Exception, match="four values"):
        spark.range(1).select(bx.parse_box(F.array(F.lit("1")), strict=True)).collect()


# --- polygons -------------------------------------------------------------

SQUARE = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
HOLED = [SQUARE[0], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]


def star(rng, cx, cy, r, n):
    ring = []
    for i in range(n):
        angle = 2 * math.pi * i / n
        d = r * rng.uniform(0.4, 1.0)
        ring.append([cx + d * math.cos(angle), cy + d * math.sin(angle)])
    return [*ring, ring[0]]


def shapes(seed=2, n=10):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        cx, cy = rng.uniform(0, 8), rng.uniform(40, 48)
        rings = [star(rng, cx, cy, rng.uniform(0.3, 2.5), 24)]
        if g % 2:
            rings.append(star(rng, cx, cy, 0.12, 7))
        out.append((g, [rings]))
    return out


def frame_of(spark, shaped):
    rows = [
        (g, json.dumps({"type": "MultiPolygon", "coordinates": parts})) for g, parts in shaped
    ]
    return boundaries.edge_table(spark.createDataFrame(rows, "geom_id bigint, geometry string"))


def inside(rings, lon, lat):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            cross = (x2 - x1) * (lat - y1) - (lon - x1) * (y2 - y1)
            if cross == 0 and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
                return True
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def coast(n=1500, seed=3):
    """A large detailed outline with a detailed lake and a far island."""
    rng = random.Random(seed)
    ring = lambda cx, cy, r: [
        [cx + r * rng.uniform(0.7, 1) * math.cos(2 * math.pi * i / n), cy + r * rng.uniform(0.7, 1) * math.sin(2 * math.pi * i / n)]
        for i in range(n)
    ]
    close = lambda points: [*points, points[0]]
    return [[close(ring(4, 44, 4.5)), close(ring(4.3, 44.2, 1.4))], [close(ring(8.2, 48.3, 0.4))]]


def test_points_in_a_detailed_country(spark):
    rng = random.Random(1)
    parts = coast()
    points = [(i, rng.uniform(-1, 9), rng.uniform(39, 49)) for i in range(1200)]
    frame = spark.createDataFrame(points, "point_id bigint, lon double, lat double")
    edges = frame_of(spark, [(1, parts)])
    want = {(p, i) for p, lon, lat in points for i, rings in enumerate(parts) if inside(rings, lon, lat)}
    got = polygons.points_in_polygons(frame, edges).collect()
    assert {(r.point_id, r.part_id) for r in got} == want and len(want) > 200
    assert len(got) == len(want)
    sizes = cover.polygon_cover(edges).select(
        F.sum(F.size("edges")).alias("edges"), F.max(F.size("loose")).alias("loose")).first()
    assert sizes.edges < 6 * edges.count() and sizes.loose < 100


@pytest.mark.parametrize("scale", [1.0, 0.01, 18.0])
def test_points_in_polygons_equal_ray_casting(spark, scale):
    """The same shapes at three sizes, for which covers use different cells."""
    rng = random.Random(9)
    move = lambda x, y: [(x - 4) * scale, (y - 44) * scale]
    shaped = [(g, [[[move(*v) for v in ring] for ring in rings] for rings in parts]) for g, parts in shapes()]
    points = [(i, *move(rng.uniform(-1, 9), rng.uniform(39, 49))) for i in range(1500)]
    points += [(1500 + i, *v) for i, v in enumerate(v for _, parts in shaped for rings in parts for v in rings[0])]
    frame = spark.createDataFrame(points, "point_id bigint, lon double, lat double")
    got = polygons.points_in_polygons(frame, frame_of(spark, shaped))
    want = {(p, g) for p, lon, lat in points for g, parts in shaped if any(inside(r, lon, lat) for r in parts)}
    assert {(r.point_id, r.geom_id) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("scale", [1.0, 12.0])
def test_covers_tile_their_parts(spark, scale):
    """Cells do not overlap; inner cells and clipped border cells add up to the part's area."""
    rng = random.Random(3)
    shaped = [(g, [[[[(x - 4) * scale, (y - 44) * scale] for x, y in ring] for ring in rings] for rings in parts]) for g, parts in shapes(seed=6, n=4)]
    round_one = [[20 + 3.3 * scale * math.cos(math.pi * i / 2500), 20 + 3.3 * scale * math.sin(math.pi * i / 2500)] for i in range(5000)]
    shaped.append((9, [[[*round_one, round_one[0]]]]))
    rows = cover.polygon_cover(frame_of(spark, shaped)).collect()
    for g, parts in shaped:
        own = [r for r in rows if r.geom_id == g]
        assert len({r.level for r in own if not r.inside}) == 1
        leaf = max(r.level for r in own)
        seen = set()
        area = 0.0
        for r in own:
            n = 1 << (leaf - r.level)
            cells = {(r.cx * n + i, r.cy * n + j) for i in range(n) for j in range(n)}
            assert not cells & seen
            seen |= cells
            size = 360 / (1 << r.level)
            if r.inside:
                area += size * size
            else:
                west, south = r.cx * size - 180, r.cy * size - 180
                area += abs(sum(clipped_area(ring, west, south, west + size, south + size) * (1 if k == 0 else -1) for k, ring in enumerate(parts[0])))
        assert area == pytest.approx(sum(ring_area(ring) * (1 if k == 0 else -1) for k, ring in enumerate(parts[0])), rel=1e-9)
    assert any(r.inside and r.level < max(x.level for x in rows if x.geom_id == r.geom_id) for r in rows)


def ring_area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2)


def clipped_area(ring, west, south, east, north):
    """Area of the part of a ring that lies in a box, side by side."""
    points = ring[:-1]
    for axis, bound, keep in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out = []
        for a, b in zip(points, [*points[1:], *points[:1]]):
            da, db = keep * (a[axis] - bound), keep * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da > 0 > db) or (da < 0 < db):
                t = da / (da - db)
                out.append([a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])])
        points = out
    return ring_area([*points, *points[:1]]) if len(points) > 2 else 0.0


def test_very_many_edges_in_one_row(spark):
    """A comb of half a million edges in one row of cells takes time in proportion."""
    import time

    def comb(n):
        x = lambda i: 10.0 * i / n
        up = spark.range(n).select(
            F.lit(1).cast("bigint").alias("geom_id"), F.lit(0).alias("part_id"), F.lit(0).alias("ring_id"), F.col("id").cast("int").alias("seq"),
            (10.0 * F.col("id") / n).alias("lon1"), F.when(F.col("id") % 2 == 0, 0.01).otherwise(0.15).alias("lat1"),
            (10.0 * (F.col("id") + 1) / n).alias("lon2"), F.when(F.col("id") % 2 == 1, 0.01).otherwise(0.15).alias("lat2"),
        )
        back = [(1, 0, 0, n, 10.0, 0.01, 10.0, 0.005), (1, 0, 0, n + 1, 10.0, 0.005, 0.0, 0.005), (1, 0, 0, n + 2, 0.0, 0.005, 0.0, 0.01)]
        return up.unionByName(spark.createDataFrame(back, up.schema)), x

    rng = random.Random(2)
    points = [(i, rng.uniform(-0.5, 10.5), rng.uniform(0, 0.16)) for i in range(200)]
    frame = spark.createDataFrame(points, "point_id bigint, lon double, lat double")
    seconds = []
    for n in (2_000, 100_000, 500_000):
        edges, x = comb(n)
        begin = time.perf_counter()
        got = {r.point_id for r in polygons.points_in_polygons(frame, edges).collect()}
        seconds.append(time.perf_counter() - begin)
        want = set()
        for i, lon, lat in points:
            if 0 <= lon <= 10:
                k = min(int(lon * n / 10), n - 1)
                t = lon * n / 10 - k
                top = 0.01 + 0.14 * (t if k % 2 == 0 else 1 - t)
                if 0.005 <= lat <= top:
                    want.add(i)
        assert got == want
    assert seconds[2] < 8 * seconds[1] + 5


def test_points_on_edges_and_in_holes(spark):
    edges = frame_of(spark, [(1, [HOLED])])
    at = {1: (0.0, 2.0), 2: (2.0, 2.0), 3: (1.0, 2.0), 4: (4.0, 4.0), 5: (0.5, 0.5), 6: (-0.1, 2.0)}
    frame = spark.createDataFrame([(i, *p) for i, p in at.items()], "point_id int, lon double, lat double")
    assert sorted(r.point_id for r in polygons.points_in_polygons(frame, edges).collect()) == [1, 3, 4, 5]


def segment_meets_box(x1, y1, x2, y2, s, w, n, e):
    """Clip the segment against the box side by side."""
    t0, t1 = 0.0, 1.0
    for p, q in ((x1 - x2, x1 - w), (x2 - x1, e - x1), (y1 - y2, y1 - s), (y2 - y1, n - y1)):
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return t0 <= t1


def test_boxes_meet_polygons_equals_clipping(spark):
    rng = random.Random(21)
    shaped = shapes(seed=5)
    by_id = dict(shaped)
    boxes = []
    for i in range(900):
        s, w = rng.uniform(39, 48), rng.uniform(-1, 8)
        boxes.append((i, i % 11, s, w, s + rng.uniform(0.01, 2), w + rng.uniform(0.01, 2)))
    boxes.append((900, 1, 0.0, -90.0, 80.0, 90.0))  # holds the whole geometry
    frame = spark.createDataFrame(boxes, "box_id int, geom_id bigint, south double, west double, north double, east double")
    got = {r.box_id: r.intersects for r in polygons.boxes_meet_polygons(frame, frame_of(spark, shaped)).collect()}
    want = {}
    for i, g, s, w, n, e in boxes:
        parts = by_id.get(g)
        want[i] = parts is None or any(
            inside(rings, w, s)
            or any(segment_meets_box(*a, *b, s, w, n, e) for ring in rings for a, b in zip(ring, ring[1:]))
            for rings in parts
        )
    assert got == want
    assert 50 < sum(want.values()) < 850


def test_box_inside_a_hole_does_not_meet(spark):
    edges = frame_of(spark, [(1, [HOLED])])
    frame = spark.createDataFrame(
        [(1, 1, 1.5, 1.5, 2.5, 2.5), (2, 1, 0.2, 0.2, 0.8, 0.8), (3, 1, 1.5, 1.5, 3.0, 2.0)],
        "box_id int, geom_id bigint, south double, west double, north double, east double")
    got = {r.box_id: r.intersects for r in polygons.boxes_meet_polygons(frame, edges).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_area_of_an_octant_and_a_hole(spark):
    octant = [[[0, 0], [90, 0], [90, 90], [0, 90], [0, 0]]]
    half = [octant[0], [[0, 0], [45, 0], [45, 90], [0, 90], [0, 0]]]
    got = {r.geom_id: r.area for r in polygons.part_measures(frame_of(spark, [(1, [octant]), (2, [half])])).collect()}
    sphere = 4 * math.pi * R * R
    assert got[1] == pytest.approx(sphere / 8)
    assert got[2] == pytest.approx(sphere / 16)


def assert_seeds_hold(areas, seeds, max_seeds=32, ratio=0.995, least=0.0002):
    """What must be true of the seeds of a geometry, whatever way they were found."""
    size = dict(areas)
    total = sum(size.values())
    picked = [size[p] for p in seeds]
    assert len(set(seeds)) == len(seeds) and 1 <= len(seeds) <= max_seeds
    # Largest first, and nothing larger was passed over.
    assert picked == sorted(size.values(), reverse=True)[: len(picked)]
    # Each further seed is worth it and was still needed.
    for k in range(1, len(picked)):
        assert picked[k] / total >= least and sum(picked[:k]) < total * ratio
    # It ends for one of three reasons.
    if len(seeds) < max_seeds and sum(picked) < total * ratio:
        assert all(a / total < least for p, a in areas if p not in seeds)


def test_seed_boxes_hold_their_rule(spark):
    rng = random.Random(8)
    shaped = []
    for g in range(12):
        sizes = [10 ** rng.uniform(-3, 0.6) for _ in range(rng.choice([1, 3, 20, 60]))]
        parts = []
        for i, r in enumerate(sizes):
            x, y = -170 + (i * 7) % 340, -60 + (i * 11) % 120
            parts.append([[[x, y], [x + r, y], [x + r, y + r], [x, y + r], [x, y]]])
        shaped.append((g, parts))
    edges = frame_of(spark, shaped)
    areas = {}
    for r in polygons.part_measures(edges).collect():
        areas.setdefault(r.geom_id, []).append((r.part_id, r.area))
    countries = spark.range(13).select(
        F.col("id").alias("geom_id"), bx.make_box(*[F.lit(float(v)) for v in (1, 2, 3, 4)]).alias("bbox"))
    got = {}
    for r in polygons.seed_boxes(edges, countries).orderBy("geom_id", "seed").collect():
        got.setdefault(r.geom_id, []).append((r.part_id, tuple(r.bbox)))
    assert got[12] == [(None, (1.0, 2.0, 3.0, 4.0))]
    assert set(got) == set(range(13))
    for g, own in areas.items():
        assert_seeds_hold(own, [p for p, _ in got[g]])


def test_largest_part_stays_when_all_are_tiny(spark):
    edges = frame_of(spark, [(1, [[[[x, 0], [x + 1, 0], [x + 1, 1 + x / 100], [x, 0]]] for x in range(3)])])
    countries = spark.range(1, 2).select(
        F.col("id").alias("geom_id"), bx.make_box(*[F.lit(0.0)] * 4).alias("bbox"))
    rows = polygons.seed_boxes(edges, countries, min_part_ratio=0.9).collect()
    assert [r.part_id for r in rows] == [2]


def test_boundary_files(spark, tmp_path):
    records = [
        {"place_id": 1, "display_name": "Squareland", "boundingbox": ["0", "4", "0", "4"],
         "geojson": {"type": "Polygon", "coordinates": HOLED}, "address": {"country_code": "sq"}},
        {"place_id": 2, "display_name": "Nowhere", "boundingbox": ["0", "1", "2", "3", "4"]},
        {"place_id": 3, "display_name": "Twins", "boundingbox": ["-1", "1", "-2", "2"],
         "geojson": {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [SQUARE, SQUARE]}}},
    ]
    path = tmp_path / "b.json"
    path.write_text("\n".join(json.dumps(r) for r in records))
    rows = boundaries.read_boundaries(spark, str(path), country="zz")
    got = {r.geom_id: r for r in rows.collect()}
    assert got[1].country_code == "sq" and got[3].country_code == "zz"
    assert tuple(got[1].bbox) == (0.0, 0.0, 4.0, 4.0) and got[2].bbox is None and got[2].geometry is None
    counts = {(r.geom_id, r.part_id): r["count"] for r in boundaries.edge_table(rows).groupBy("geom_id", "part_id").count().collect()}
    assert counts == {(1, 0): 8, (3, 0): 4, (3, 1): 4}


def test_gazetteer_takes_the_lowest_place_of_a_cell(spark):
    places = spark.createDataFrame([(7, 20, 401, "late"), (3, 20, 401, "early")], "place_id bigint, cell_x int, cell_y int, city string")
    points = spark.createDataFrame([(1, 2.05, 40.15), (2, -0.01, 40.1)], "point_id int, lon double, lat double")
    got = {r.point_id: (r.cell_x, r.city) for r in gazetteer.locate_points(points, places).collect()}
    assert got == {1: (20, "early"), 2: (-1, None)}


# --- nearest places -------------------------------------------------------


def great_circle(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.sin(math.radians(lon2 - lon1) / 2) ** 2 * math.cos(a) * math.cos(b)
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("n_places", [1, 7, 400])
def test_nearest_places_over_the_whole_earth(spark, n_places):
    rng = random.Random(n_places)
    places = [(i, rng.randrange(-1800, 1800), rng.randrange(-900, 900)) for i in range(n_places)]
    places += [(1000, 1799, 0), (1001, -1800, 1), (1002, 5, 899)] if n_places > 1 else []
    places.append((places[0][0] + 5000, *places[0][1:]))  # a second place of one cell
    points = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(300)]
    points += [(300, 0.0, 90.0), (301, 77.0, -90.0), (302, 180.0, 0.0), (303, -180.0, 0.0), (304, 179.99, 0.3), (305, -179.99, -0.3)]
    points += [(306, None, 1.0), (307, 1.0, None), (308, float("nan"), 1.0), (309, 500.0, 1.0)]
    points.append((310, places[0][1] / 10 + 0.05, places[0][2] / 10 + 0.05))  # its own cell has a place
    frame = spark.createDataFrame(points, "point_id int, lon double, lat double")
    table = spark.createDataFrame(places, "place_id bigint, cell_x int, cell_y int")
    cells = {}
    for p, x, y in places:
        cells[x, y] = min(p, cells.get((x, y), p))
    want = {}
    for i, lon, lat in points[:306]:
        if (math.floor(lon * 10), math.floor(lat * 10)) not in cells:
            best = min((math.floor(great_circle(lat, lon, (y + 0.5) / 10, (x + 0.5) / 10) * 1000 + 0.5), p) for (x, y), p in cells.items())
            want[i] = best
    got = {r.point_id: (r.distance_mm, r.place_id) for r in gazetteer.nearest_places(frame, table).collect()}
    assert set(got) == set(want)
    # Two libraries may round the last digit apart.
    assert all(abs(got[i][0] - want[i][0]) <= 1 for i in want)
    assert sum(got[i][1] != want[i][1] for i in want) == 0


def test_nearest_place_of_equals_is_the_lowest(spark):
    places = spark.createDataFrame([(9, 0, 0), (4, 2, 0), (6, 1, 1)], "place_id bigint, cell_x int, cell_y int")
    points = spark.createDataFrame([(1, 0.15, 0.05)], "point_id int, lon double, lat double")
    assert [tuple(r)[:2] for r in gazetteer.nearest_places(points, places).collect()] == [(1, 4)]
    assert gazetteer.nearest_places(points, places.limit(0)).collect() == []


def test_nearest_places_need_no_cross_join(spark):
    places = spark.createDataFrame([(9, 0, 0)], "place_id bigint, cell_x int, cell_y int")
    points = spark.createDataFrame([(1, 5.0, 5.0)], "point_id int, lon double, lat double")
    plan = gazetteer.nearest_places(points, places)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nearest_places_keep_few_candidates_in_the_row_of_a_cube(spark):
    """A far edge of a dense block: a cube keeps the places that some point of it is nearest to, and no row per candidate."""
    table = spark.range(1600).selectExpr("id AS place_id", "CAST(id % 40 AS int) AS cell_x", "CAST(400 + floor(id / 40) AS int) AS cell_y")
    points = spark.range(400).selectExpr("id AS point_id", "-60e0 + id * 5e-3 AS lon", "42e0 + (id % 20) * 5e-3 AS lat")
    placed = table.selectExpr("place_id", "(cell_x + 5e-1) / 10 AS place_lon", "(cell_y + 5e-1) / 10 AS place_lat")
    at = lambda df, lon, lat: df.select("*", *gazetteer._vector(F.col(lon), F.col(lat)))
    cubes = at(points, "lon", "lat").select(*gazetteer._cubes(points)).distinct()
    near = gazetteer._candidates(cubes, at(placed, "place_lon", "place_lat")).select("ix", "iy", "iz", F.size("near").alias("n")).collect()
    assert len(near) == len({r[:3] for r in near}) == cubes.count()
    assert max(r.n for r in near) <= 12
    places = [(r.place_id, r.place_lon, r.place_lat) for r in placed.collect()]
    got = {r.point_id: (r.distance_mm, r.place_id) for r in gazetteer.nearest_places(points, table).collect()}
    for p in points.collect():
        want = min((math.floor(great_circle(p.lat, p.lon, lat, lon) * 1000 + 0.5), i) for i, lon, lat in places)
        assert got[p.point_id][1] == want[1] and abs(got[p.point_id][0] - want[0]) <= 1


def test_broken_boundaries_have_no_edges(spark):
    texts = [
        None, "", "null", "[]", "{", '{"type": "Point", "coordinates": [1, 2]}', '{"type": "Polygon"}', '{"type": "Polygon", "coordinates": "x"}',
        '{"type": "Feature", "geometry": null}', '{"type": "Polygon", "coordinates": [[]]}', '{"type": "Polygon", "coordinates": [[[1, 2]]]}',
    ]
    good = json.dumps({"type": "Feature", "properties": {"type": "Polygon"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 5], [4, 0, 5], [4, 4.5, 5], [0, 0, 5]]]}})
    rows = spark.createDataFrame([*enumerate([*texts, good])], "geom_id int, geometry string")
    got = boundaries.edge_table(rows).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [
        (len(texts), 0, 0, 0, 0.0, 0.0, 4.0, 0.0), (len(texts), 0, 0, 1, 4.0, 0.0, 4.0, 4.5), (len(texts), 0, 0, 2, 4.0, 4.5, 0.0, 0.0),
    ]
