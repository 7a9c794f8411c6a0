"""Boxes, polygons, the density grid and place lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.times import ntz
from ..operators import gazetteer as gz
from ..operators import cover, grid, polygons
from ..operators import task_tree as tt
from ..operators.tasks import apply_splits, next_per_job
from ..sources.views import view, with_views
from .jobs import SHARDS_AS_OF

ROOT = (40.0, 0.0, 48.0, 8.0)
SIDES = ("south", "west", "north", "east")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").withColumn("bbox", bx.make_box(*[F.col(c) for c in SIDES]))


def bbox_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.array("v1", "v2", "v3", "v4", "v5"), lambda v: v.isNotNull())
    rows = view(spark, sf_dir, "box_texts").select("id", bx.parse_box(parts).alias("bbox"))
    again = bx.box_from_list(bx.box_to_list(F.col("bbox")), numeric=True)
    return rows.select(
        "id",
        *[F.col(f"bbox.{s}").alias(s) for s in SIDES],
        F.array_join(F.transform(bx.box_to_list(F.col("bbox")), lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",").alias("as_list"),
        again.getField("north").alias("north_again"),
    )


def bbox_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _boxes(spark, sf_dir).select(
        F.col("box_id").alias("id"),
        F.col("geom_id").cast("string").alias("job_id"),
        "bbox",
        F.lit(3).alias("depth"),
        F.when(F.col("geom_id") % 2 == 0, "running").otherwise("done").alias("status"),
        ntz("1998-01-01 00:00:00").alias("updated_at"),
    )
    running = (F.col("status") == "running") & bx.can_split(F.col("bbox"))
    return apply_splits(tasks, running, ntz(SHARDS_AS_OF)).select(
        "id", "parent_id", "job_id", "depth", "status", "updated_at",
        *[F.round(F.col(f"bbox.{s}"), 6).alias(s) for s in SIDES],
        F.round(bx.center_lat(F.col("bbox")), 5).alias("center_lat"),
        F.round(bx.center_lon(F.col("bbox")), 5).alias("center_lon"),
    )


def split_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of three tasks in four split where they may, then two of their quadrants, then the second quadrant of what waits."""
    now = ntz(SHARDS_AS_OF)
    tasks = _boxes(spark, sf_dir).select(
        F.col("box_id").alias("id"), F.col("geom_id").cast("string").alias("job_id"), "bbox", F.lit(0).alias("depth"),
        F.lit("pending").alias("status"), now.alias("updated_at"),
    )
    for quadrants in ((0, 1, 2, 3), (0, 3), (1,)):
        quadrant = F.when(F.col("depth") == 0, 0).otherwise((F.col("id") % 4).cast("int"))
        waits = (F.col("status") == "pending") & bx.can_split(F.col("bbox")) & quadrant.isin(*quadrants) & (tt.root_of(F.col("id")) % 4 != 0)
        tasks = apply_splits(tasks, waits, now).select(*tasks.columns)
    return tasks


def task_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, attempts and failures of every task's subtree."""
    done = {
        "results": (F.col("id") * 7 % 41).cast("bigint"),
        "attempts": (F.col("id") % 3).cast("bigint"),
        "failures": (F.col("id") % 11 == 0).cast("bigint"),
    }
    return tt.subtree_totals(split_tasks(spark, sf_dir), done)


def next_split_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task that each job takes next where its tasks are children of splits."""
    shards = split_tasks(spark, sf_dir).withColumn("next_run_at", F.col("updated_at"))
    jobs = view(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.lit("running").alias("status"),
        ntz("1998-01-01 00:00:00").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("last_claimed_at"),
        F.col("n_regionkey").cast("bigint").alias("completed_shards"),
    )
    return next_per_job(shards, jobs, ntz(SHARDS_AS_OF)).select("job_id", "shard_id", "shard_status", "depth")


def bbox_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(
        "box_id",
        bx.radius_m(F.col("bbox")).alias("radius_m"),
        bx.radius_m(F.col("bbox"), cap=50000).alias("capped_m"),
    )


def quadtree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid.density_cells(view(spark, sf_dir, "points"), ROOT)
    return cells.select(
        "job_id", "depth", "ix", "iy", *[F.col(f"bbox.{s}").alias(s) for s in SIDES], "n", "exhaustive"
    )


def seeded_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = view(spark, sf_dir, "grid_roots").select("job_id", "seed", bx.make_box(*[F.col(c) for c in SIDES]).alias("bbox"))
    return grid.seeded_cells(view(spark, sf_dir, "points"), roots).select(
        "job_id", "seed", "depth", "ix", "iy", *[F.col(f"bbox.{s}").alias(s) for s in SIDES], "n", "exhaustive"
    )


def polygon_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the zones' covers, and the zones again mirrored to lie in many larger cells."""
    zones = view(spark, sf_dir, "zone_edges")
    grown = [(F.col(c) * 9 - (30.0 if "lon" in c else 390.0)).alias(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    large = zones.select((F.col("geom_id") + 100).alias("geom_id"), "part_id", "ring_id", "seq", *grown)
    cells = cover.polygon_cover(zones.unionByName(large))
    return cells.select(
        "geom_id", "part_id", "level", "cx", "cy", "inside", F.size("edges").cast("long").alias("n_edges")
    )


def points_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each point lies in the zone it names; zones 25 and 26 are not known."""
    points = view(spark, sf_dir, "points").withColumn("geom_id", (F.col("point_id") % 27).cast("bigint"))
    edges = view(spark, sf_dir, "zone_edges").withColumn("geom_id", F.col("geom_id").cast("bigint"))
    return polygons.points_inside(points, edges).select("point_id", "geom_id", "inside")


def point_in_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = polygons.part_measures(view(spark, sf_dir, "zone_edges")).drop("area")
    pairs = polygons.points_in_boxes(view(spark, sf_dir, "points"), parts)
    return pairs.select("point_id", "geom_id", "part_id")


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = polygons.points_in_polygons(
        view(spark, sf_dir, "points"), view(spark, sf_dir, "zone_edges")
    )
    return pairs.select("point_id", "geom_id", "part_id")


def bbox_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.boxes_meet_polygons(
        view(spark, sf_dir, "boxes"), view(spark, sf_dir, "zone_edges")
    )


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.part_measures(view(spark, sf_dir, "parcel_edges")).select(
        "geom_id", "part_id", F.round(F.col("area") / 1e6, 3).alias("area_km2"),
        *[F.round(s, 6).alias(s) for s in SIDES],
    )


def seed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "parcel_edges")
    countries = view(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("geom_id"),
        bx.make_box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("n_nationkey").cast("double")).alias("bbox"),
    )
    # Nation 7 has no boundary: its edges go to a geometry that is no nation's.
    renamed = edges.withColumn("geom_id", F.when(F.col("geom_id") == 7, 107).otherwise(F.col("geom_id")))
    return polygons.seed_boxes(renamed, countries).select(
        "geom_id", "seed", "part_id", *[F.round(F.col(f"bbox.{s}"), 6).alias(s) for s in SIDES]
    )


def gazetteer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gz.locate_points(view(spark, sf_dir, "points"), view(spark, sf_dir, "gazetteer")).select(
        "point_id", "cell_x", "cell_y", "place_id", "city", "state", "postcode"
    )


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of which two thirds are moved off the gazetteer, as far as the other side of the date line."""
    far = F.col("point_id") % 3
    lon = F.when(far == 1, F.col("lon") - 170.0).when(far == 2, F.col("lon") * 20.0 + 15.0).otherwise(F.col("lon"))
    lat = F.when(far == 1, F.col("lat") - 60.0).when(far == 2, (F.col("lat") - 44.0) * 20.0).otherwise(F.col("lat"))
    points = view(spark, sf_dir, "points").select("point_id", lon.alias("lon"), lat.alias("lat"))
    return gz.nearest_places(points, view(spark, sf_dir, "gazetteer"))


_RADIUS = """CAST(ceil(2 * 6371008.8::DOUBLE * greatest(
  atan2(sqrt(a1), sqrt(1 - a1)), atan2(sqrt(a2), sqrt(1 - a2)))) AS BIGINT)"""


def _angles(source: str) -> str:
    return f"""SELECT *, pow(sin(radians(south - (south + north) / 2) / 2), 2) + pow(sin(radians(west - (west + east) / 2) / 2), 2)
        * cos(radians((south + north) / 2)) * cos(radians(south)) AS a1,
      pow(sin(radians(north - (south + north) / 2) / 2), 2) + pow(sin(radians(west - (west + east) / 2) / 2), 2)
        * cos(radians((south + north) / 2)) * cos(radians(north)) AS a2 FROM {source}"""


_PARTS = """, rings AS (SELECT geom_id, part_id, ring_id,
  abs(sum(radians(lon2 - lon1) * (sin(radians(lat1)) + sin(radians(lat2))))) * (6371008.8::DOUBLE * 6371008.8::DOUBLE / 2) AS a,
  min(lat1) AS south, min(lon1) AS west, max(lat1) AS north, max(lon1) AS east FROM {edges} GROUP BY ALL),
parts AS (SELECT geom_id, part_id, sum(CASE WHEN ring_id = 0 THEN a ELSE -a END) AS area,
  min(south) AS south, min(west) AS west, max(north) AS north, max(east) AS east FROM rings GROUP BY geom_id, part_id)
"""

_SIDE = "((lon2 - lon1) * ({lat} - lat1) - ({lon} - lon1) * (lat2 - lat1))"


def _inside(lon: str, lat: str) -> str:
    side = _SIDE.format(lon=lon, lat=lat)
    return f"""(sum(CASE WHEN (lat1 > {lat}) <> (lat2 > {lat}) AND ({side} > 0) = (lat2 > lat1) THEN 1 ELSE 0 END) % 2 = 1
      OR bool_or({side} = 0 AND {lon} BETWEEN least(lon1, lon2) AND greatest(lon1, lon2) AND {lat} BETWEEN least(lat1, lat2) AND greatest(lat1, lat2)))"""


_CORNERS = ", ".join(
    _SIDE.format(lon=lon, lat=lat) for lon in ("west", "east") for lat in ("south", "north")
)

def _recursive(views: str, sql: str) -> str:
    return with_views(views, sql).replace("WITH ", "WITH RECURSIVE ", 1)


_TREE = """, tree AS (
  SELECT box_id AS id, CAST(NULL AS BIGINT) AS parent_id, box_id AS root_id, 0 AS splits, CAST(1 AS BIGINT) AS k, geom_id, south, west, north, east FROM boxes
  UNION ALL
  SELECT ((t.root_id + 1) << 30) | (t.k * 4 + q), t.id, t.root_id, t.splits + 1, t.k * 4 + q, geom_id,
    CASE WHEN q < 2 THEN south ELSE (south + north) / 2 END, CASE WHEN q % 2 = 0 THEN west ELSE (west + east) / 2 END,
    CASE WHEN q < 2 THEN (south + north) / 2 ELSE north END, CASE WHEN q % 2 = 0 THEN (west + east) / 2 ELSE east END
  FROM tree t, (VALUES (0), (1), (2), (3)) v(q)
  WHERE t.root_id % 4 <> 0 AND east - west > 0.05::DOUBLE AND north - south > 0.05::DOUBLE
    AND (t.splits = 0 OR (t.splits = 1 AND t.k % 4 IN (0, 1, 3)) OR (t.splits = 2 AND t.k % 4 = 1 AND (t.k >> 2) % 4 IN (0, 3))))
"""

QUERIES = {
    "bbox_parse": (
        bbox_parse,
        with_views(
            "box_texts",
            """, n AS (SELECT id, v5 IS NULL AS ok, TRY_CAST(nullif(regexp_extract(v1, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS south,
              TRY_CAST(nullif(regexp_extract(v2, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS north,
              TRY_CAST(nullif(regexp_extract(v3, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS west,
              TRY_CAST(nullif(regexp_extract(v4, '^\\s*([+-]?[0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS east FROM box_texts)
            SELECT id, CASE WHEN ok THEN south END AS south, CASE WHEN ok THEN west END AS west, CASE WHEN ok THEN north END AS north,
              CASE WHEN ok THEN east END AS east, CASE WHEN ok THEN concat_ws(',', CAST(round(west * 1000) AS BIGINT), CAST(round(south * 1000) AS BIGINT),
                CAST(round(east * 1000) AS BIGINT), CAST(round(north * 1000) AS BIGINT)) END AS as_list,
              CASE WHEN ok THEN north END AS north_again FROM n""",
        ),
    ),
    "bbox_split": (
        bbox_split,
        with_views(
            "boxes",
            f""", b AS (SELECT *, geom_id % 2 = 0 AND east - west > 0.05::DOUBLE AND north - south > 0.05::DOUBLE AS splits,
              (south + north) / 2 AS lat, (west + east) / 2 AS lon FROM boxes),
            u AS (SELECT box_id AS id, NULL::BIGINT AS parent_id, geom_id, 3 AS depth,
                CASE WHEN splits THEN 'split' WHEN geom_id % 2 = 0 THEN 'running' ELSE 'done' END AS status,
                CASE WHEN splits THEN TIMESTAMP '{SHARDS_AS_OF}' ELSE TIMESTAMP '1998-01-01' END AS updated_at, south, west, north, east FROM b
              UNION ALL SELECT ((box_id + 1) << 30) | 4, box_id, geom_id, 4, 'pending', TIMESTAMP '{SHARDS_AS_OF}', south, west, lat, lon FROM b WHERE splits
              UNION ALL SELECT ((box_id + 1) << 30) | 5, box_id, geom_id, 4, 'pending', TIMESTAMP '{SHARDS_AS_OF}', south, lon, lat, east FROM b WHERE splits
              UNION ALL SELECT ((box_id + 1) << 30) | 6, box_id, geom_id, 4, 'pending', TIMESTAMP '{SHARDS_AS_OF}', lat, west, north, lon FROM b WHERE splits
              UNION ALL SELECT ((box_id + 1) << 30) | 7, box_id, geom_id, 4, 'pending', TIMESTAMP '{SHARDS_AS_OF}', lat, lon, north, east FROM b WHERE splits)
            SELECT id, parent_id, CAST(geom_id AS VARCHAR) AS job_id, depth, status, updated_at, round(south, 6) AS south, round(west, 6) AS west,
              round(north, 6) AS north, round(east, 6) AS east, round((south + north) / 2, 5) AS center_lat, round((west + east) / 2, 5) AS center_lon FROM u""",
        ),
    ),
    "task_tree_rollup": (
        task_tree_rollup,
        _recursive(
            "boxes",
            _TREE
            + """, own AS (SELECT id, id * 7 % 41 AS results, id % 3 AS attempts, CAST(id % 11 = 0 AS BIGINT) AS failures, parent_id, root_id, splits FROM tree),
            up AS (SELECT id AS node, parent_id AS above, results, attempts, failures FROM own
              UNION ALL SELECT o.id, o.parent_id, up.results, up.attempts, up.failures FROM up JOIN own o ON o.id = up.above)
            SELECT o.id, o.root_id, o.parent_id, o.splits, s.tasks, s.results, s.attempts, s.failures FROM own o JOIN (
              SELECT node, count(*) AS tasks, CAST(sum(results) AS BIGINT) AS results, CAST(sum(attempts) AS BIGINT) AS attempts,
                CAST(sum(failures) AS BIGINT) AS failures FROM up GROUP BY node) s ON s.node = o.id""",
        ),
    ),
    "next_split_task": (
        next_split_task,
        _recursive(
            "boxes",
            _TREE
            + """, leaf AS (SELECT * FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.parent_id = t.id))
            SELECT CAST(geom_id AS VARCHAR) AS job_id, id AS shard_id, 'pending' AS shard_status, splits AS depth FROM leaf WHERE geom_id < 25
            QUALIFY row_number() OVER (PARTITION BY geom_id ORDER BY splits DESC, id) = 1""",
        ),
    ),
    "bbox_radius": (
        bbox_radius,
        with_views(
            "boxes",
            f""", a AS ({_angles('boxes')}), r AS (SELECT box_id, {_RADIUS} AS radius_m FROM a)
            SELECT box_id, radius_m, least(radius_m, 50000) AS capped_m FROM r""",
        ),
    ),
    "quadtree_leaves": (
        quadtree_leaves,
        with_views(
            "points",
            f""", leaf AS (SELECT job_id, CAST(least(floor(lon / 8 * 256), 255) AS INT) AS ix, CAST(least(floor((lat - 40) / 8 * 256), 255) AS INT) AS iy, count(*) AS n
              FROM points WHERE lat BETWEEN 40 AND 48 AND lon BETWEEN 0 AND 8 GROUP BY ALL),
            level AS (SELECT CAST(unnest(range(9)) AS INT) AS depth),
            cell AS (SELECT job_id, depth, ix >> (8 - depth) AS ix, iy >> (8 - depth) AS iy, CAST(sum(n) AS BIGINT) AS n FROM leaf, level GROUP BY ALL),
            box AS (SELECT *, 40 + iy * (8 / pow(2, depth)) AS south, ix * (8 / pow(2, depth)) AS west,
              40 + (iy + 1) * (8 / pow(2, depth)) AS north, (ix + 1) * (8 / pow(2, depth)) AS east FROM cell),
            ang AS ({_angles('box')}),
            split AS (SELECT job_id, depth, ix, iy FROM ang WHERE depth < 14 AND 8 / pow(2, depth) > 0.05 AND ({_RADIUS} > 25000 OR n >= 30)),
            named AS (SELECT job_id, depth + 1 AS depth, ix * 2 + dx AS ix, iy * 2 + dy AS iy FROM split, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) q(dx, dy)
              UNION ALL SELECT DISTINCT job_id, 0, 0, 0 FROM cell)
            SELECT m.job_id, m.depth, m.ix, m.iy, 40 + m.iy * (8 / pow(2, m.depth)) AS south, m.ix * (8 / pow(2, m.depth)) AS west,
              40 + (m.iy + 1) * (8 / pow(2, m.depth)) AS north, (m.ix + 1) * (8 / pow(2, m.depth)) AS east,
              coalesce(c.n, 0) AS n, coalesce(c.n, 0) >= 30 AS exhaustive
            FROM named m LEFT JOIN cell c USING (job_id, depth, ix, iy) ANTI JOIN split s USING (job_id, depth, ix, iy)""",
        ),
    ),
    "seeded_grid": (
        seeded_grid,
        with_views(
            "points grid_roots",
            f""", leaf AS (SELECT r.*, CAST(least(floor((lon - west) / (east - west) * 256), 255) AS INT) AS ix,
                CAST(least(floor((lat - south) / (north - south) * 256), 255) AS INT) AS iy, count(*) AS n
              FROM points JOIN grid_roots r USING (job_id) WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east GROUP BY ALL),
            level AS (SELECT CAST(unnest(range(9)) AS INT) AS depth),
            cell AS (SELECT job_id, seed, depth, ix >> (8 - depth) AS ix, iy >> (8 - depth) AS iy, CAST(sum(n) AS BIGINT) AS n FROM leaf, level GROUP BY ALL),
            box AS (SELECT c.*, r.north - r.south AS height, r.east - r.west AS width,
                r.south + iy * ((r.north - r.south) / pow(2, depth)) AS south, r.west + ix * ((r.east - r.west) / pow(2, depth)) AS west,
                r.south + (iy + 1) * ((r.north - r.south) / pow(2, depth)) AS north, r.west + (ix + 1) * ((r.east - r.west) / pow(2, depth)) AS east
              FROM cell c JOIN grid_roots r USING (job_id, seed)),
            ang AS ({_angles('box')}),
            split AS (SELECT job_id, seed, depth, ix, iy FROM ang WHERE depth < 14 AND width / pow(2, depth) > 0.05 AND height / pow(2, depth) > 0.05
              AND ({_RADIUS} > 25000 OR n >= 30)),
            named AS (SELECT job_id, seed, depth + 1 AS depth, ix * 2 + dx AS ix, iy * 2 + dy AS iy FROM split, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) q(dx, dy)
              UNION ALL SELECT job_id, seed, 0, 0, 0 FROM grid_roots)
            SELECT m.job_id, m.seed, m.depth, m.ix, m.iy, r.south + m.iy * ((r.north - r.south) / pow(2, m.depth)) AS south,
              r.west + m.ix * ((r.east - r.west) / pow(2, m.depth)) AS west, r.south + (m.iy + 1) * ((r.north - r.south) / pow(2, m.depth)) AS north,
              r.west + (m.ix + 1) * ((r.east - r.west) / pow(2, m.depth)) AS east, coalesce(c.n, 0) AS n, coalesce(c.n, 0) >= 30 AS exhaustive
            FROM named m JOIN grid_roots r USING (job_id, seed) LEFT JOIN cell c USING (job_id, seed, depth, ix, iy)
            ANTI JOIN split s USING (job_id, seed, depth, ix, iy)""",
        ),
    ),
    "polygon_cover": (
        polygon_cover,
        with_views(
            "zone_edges",
            """, z AS (SELECT geom_id, part_id, lon1, lat1, lon2, lat2 FROM zone_edges UNION ALL
              SELECT geom_id + 100, part_id, lon1 * 9 - 30, lat1 * 9 - 390, lon2 * 9 - 30, lat2 * 9 - 390 FROM zone_edges),
            part AS (SELECT geom_id, part_id, greatest(16, sqrt(count(*))) AS side,
              greatest(max(greatest(lon1, lon2)) - min(least(lon1, lon2)), max(greatest(lat1, lat2)) - min(least(lat1, lat2))) AS extent FROM z GROUP BY ALL),
            lev AS (SELECT geom_id, part_id, CAST(CASE WHEN extent <= side * 360 / 16384 THEN 14 WHEN extent <= side * 360 / 2048 THEN 11
              WHEN extent <= side * 360 / 256 THEN 8 ELSE 5 END AS INT) AS level FROM part),
            e AS (SELECT z.*, level, 360 / pow(2, level) AS size FROM z JOIN lev USING (geom_id, part_id)),
            r AS (SELECT *, unnest(range(CAST(floor((least(lat1, lat2) + 180) / size) AS INT), CAST(floor((greatest(lat1, lat2) + 180) / size) AS INT) + 1)) AS cy FROM e),
            y AS (SELECT *, greatest(least(lat1, lat2), cy * size - 180) AS lo, least(greatest(lat1, lat2), cy * size - 180 + size) AS hi FROM r),
            x AS (SELECT *, CASE WHEN lat1 = lat2 THEN lon1 ELSE lon1 + (lo - lat1) * (lon2 - lon1) / (lat2 - lat1) END AS xa,
              CASE WHEN lat1 = lat2 THEN lon2 ELSE lon1 + (hi - lat1) * (lon2 - lon1) / (lat2 - lat1) END AS xb FROM y),
            reach AS (SELECT geom_id, part_id, level, size, cy, unnest(range(
                CAST(floor((greatest(least(xa, xb) - 1e-9::DOUBLE, least(lon1, lon2)) + 180) / size) AS INT),
                CAST(floor((least(greatest(xa, xb) + 1e-9::DOUBLE, greatest(lon1, lon2)) + 180) / size) AS INT) + 1)) AS cx FROM x),
            border AS (SELECT geom_id, part_id, level, size, cx, cy, count(*) AS n FROM reach GROUP BY ALL),
            rowspan AS (SELECT geom_id, part_id, level, size, cy, min(cx) AS a, max(cx) AS b FROM border GROUP BY ALL),
            leaf AS (SELECT geom_id, part_id, level, size, cy, unnest(range(a, b + 1)) AS cx FROM rowspan),
            plain AS (SELECT *, (cx + 0.5::DOUBLE) * size - 180 AS lon, (cy + 0.5::DOUBLE) * size - 180 AS lat FROM leaf ANTI JOIN border USING (geom_id, part_id, cx, cy)),
            inner1 AS (SELECT p.geom_id, p.part_id, p.level, p.cx, p.cy FROM plain p JOIN z ON z.geom_id = p.geom_id AND z.part_id = p.part_id
              AND (lat1 > lat) <> (lat2 > lat) AND lon < (lon2 - lon1) * (lat - lat1) / (lat2 - lat1) + lon1
              GROUP BY ALL HAVING count(*) % 2 = 1),
            sq1 AS (SELECT geom_id, part_id, CAST(level - 3 AS INT) AS level, cx >> 3 AS cx, cy >> 3 AS cy FROM inner1 WHERE level > 5 GROUP BY ALL HAVING count(*) = 64),
            sq2 AS (SELECT geom_id, part_id, CAST(level - 3 AS INT) AS level, cx >> 3 AS cx, cy >> 3 AS cy FROM sq1 WHERE level > 5 GROUP BY ALL HAVING count(*) = 64),
            found AS (SELECT geom_id, part_id, level, cx, cy, false AS inside, n FROM border
              UNION ALL SELECT geom_id, part_id, level, cx, cy, true, 0 FROM inner1 i ANTI JOIN sq1 s ON s.geom_id = i.geom_id AND s.part_id = i.part_id AND s.level = i.level - 3 AND s.cx = i.cx >> 3 AND s.cy = i.cy >> 3
              UNION ALL SELECT geom_id, part_id, level, cx, cy, true, 0 FROM sq1 i ANTI JOIN sq2 s ON s.geom_id = i.geom_id AND s.part_id = i.part_id AND s.level = i.level - 3 AND s.cx = i.cx >> 3 AND s.cy = i.cy >> 3
              UNION ALL SELECT geom_id, part_id, level, cx, cy, true, 0 FROM sq2)
            SELECT geom_id, part_id, level, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, inside, n AS n_edges FROM found""",
        ),
    ),
    "points_inside": (
        points_inside,
        with_views(
            "points zone_edges",
            f""", p AS (SELECT *, point_id % 27 AS geom_id FROM points),
            h AS (SELECT point_id FROM p JOIN zone_edges USING (geom_id) GROUP BY point_id, part_id, lon, lat HAVING {_inside('lon', 'lat')})
            SELECT point_id, geom_id, geom_id NOT IN (SELECT geom_id FROM zone_edges) OR point_id IN (SELECT point_id FROM h) AS inside FROM p""",
        ),
    ),
    "point_in_bbox": (
        point_in_bbox,
        with_views(
            "points zone_edges",
            _PARTS.format(edges="zone_edges")
            + """SELECT point_id, geom_id, part_id FROM points JOIN parts ON lat BETWEEN south AND north AND lon BETWEEN west AND east""",
        ),
    ),
    "point_in_polygon": (
        point_in_polygon,
        with_views(
            "points zone_edges",
            f"""SELECT point_id, geom_id, part_id FROM points, zone_edges GROUP BY ALL HAVING {_inside('any_value(lon)', 'any_value(lat)')}""".replace(
                "any_value(lon)", "lon"
            ).replace("any_value(lat)", "lat"),
        ),
    ),
    "bbox_intersects": (
        bbox_intersects,
        with_views(
            "boxes zone_edges",
            f""", touch AS (SELECT DISTINCT box_id FROM boxes JOIN zone_edges USING (geom_id)
              WHERE greatest(lon1, lon2) >= west AND least(lon1, lon2) <= east AND greatest(lat1, lat2) >= south AND least(lat1, lat2) <= north
                AND least({_CORNERS}) <= 0 AND greatest({_CORNERS}) >= 0),
            within AS (SELECT box_id FROM boxes JOIN zone_edges USING (geom_id) GROUP BY box_id, part_id, west, south HAVING {_inside('west', 'south')})
            SELECT box_id, geom_id, geom_id > 24 OR box_id IN (SELECT box_id FROM touch) OR box_id IN (SELECT box_id FROM within) AS intersects FROM boxes""",
        ),
    ),
    "polygon_area": (
        polygon_area,
        with_views(
            "parcel_edges",
            _PARTS.format(edges="parcel_edges")
            + """SELECT geom_id, part_id, round(area / 1e6, 3) AS area_km2, round(south, 6) AS south, round(west, 6) AS west,
              round(north, 6) AS north, round(east, 6) AS east FROM parts""",
        ),
    ),
    "seed_boxes": (
        seed_boxes,
        with_views(
            "parcel_edges",
            _PARTS.format(edges="parcel_edges")
            + """, w AS (SELECT *, row_number() OVER o AS seed, sum(area) OVER (PARTITION BY geom_id) AS total,
                coalesce(sum(area) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered
              FROM parts WHERE area > 0 AND geom_id <> 7 WINDOW o AS (PARTITION BY geom_id ORDER BY area DESC, part_id)),
            k AS (SELECT * FROM w WHERE seed = 1 OR (seed <= 32 AND area / total >= 0.0002::DOUBLE AND covered < total * 0.995::DOUBLE))
            SELECT n_nationkey AS geom_id, CAST(coalesce(seed, 1) AS INT) AS seed, part_id, round(coalesce(south, 0), 6) AS south, round(coalesce(west, 0), 6) AS west,
              round(coalesce(north, 1), 6) AS north, round(coalesce(east, n_nationkey), 6) AS east FROM nation LEFT JOIN k ON k.geom_id = n_nationkey""",
        ),
    ),
    "nearest_place": (
        nearest_place,
        with_views(
            "points gazetteer",
            """, g AS (SELECT cell_x, cell_y, min(place_id) AS place_id, (cell_x + 0.5::DOUBLE) / 10 AS plon, (cell_y + 0.5::DOUBLE) / 10 AS plat FROM gazetteer GROUP BY ALL),
            p AS (SELECT point_id, CASE point_id % 3 WHEN 1 THEN lon - 170 WHEN 2 THEN lon * 20 + 15 ELSE lon END AS lon,
              CASE point_id % 3 WHEN 1 THEN lat - 60 WHEN 2 THEN (lat - 44) * 20 ELSE lat END AS lat FROM points),
            q AS (SELECT point_id, lon, lat, CAST(floor(lon * 10) AS INT) AS cell_x, CAST(floor(lat * 10) AS INT) AS cell_y FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
            alone AS (SELECT * FROM q ANTI JOIN gazetteer USING (cell_x, cell_y)),
            d AS (SELECT point_id, place_id, pow(sin(radians(plat - lat) / 2), 2) + pow(sin(radians(plon - lon) / 2), 2) * cos(radians(lat)) * cos(radians(plat)) AS a FROM alone, g),
            m AS (SELECT point_id, place_id, CAST(floor(2 * 6371008.8::DOUBLE * atan2(sqrt(a), sqrt(1 - a)) * 1000 + 0.5::DOUBLE) AS BIGINT) AS distance_mm FROM d)
            SELECT point_id, arg_min(place_id, (distance_mm, place_id)) AS place_id, min(distance_mm) AS distance_mm FROM m GROUP BY point_id""",
        ),
    ),
    "gazetteer_join": (
        gazetteer_join,
        with_views(
            "points gazetteer",
            """, g AS (SELECT * FROM gazetteer QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY place_id) = 1),
            p AS (SELECT point_id, CAST(floor(lon * 10) AS INT) AS cell_x, CAST(floor(lat * 10) AS INT) AS cell_y FROM points)
            SELECT point_id, cell_x, cell_y, place_id, city, state, postcode FROM p LEFT JOIN g USING (cell_x, cell_y)""",
        ),
    ),
}
