"""Scans, pages of rows, JSON columns, stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsons import ADDRESS_DDL, BBOX_DDL, decode, setting
from ..operators import paging
from ..operators.delivery import mask_secret
from ..operators.jobs import lead_coverage
from ..operators.merge import as_sightings, merge_listings
from ..operators.normalize import normalize_listings
from ..sources import listing_pages as lp
from ..sources.boundaries import edge_table
from ..sources.stored import keyed_default
from ..sources.views import view, with_views
from .golden import GOLDEN

SITE = "https://directory.example"


def jobs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.newest_first(view(spark, sf_dir, "jobs"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.by_id(view(spark, sf_dir, "shards"), 42)


def lead_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = as_sightings(view(spark, sf_dir, "observations")).where(F.col("job_id") == "click")
    return paging.listing_page(seen, ("name", "phone", "website"), limit=50, offset=20)


def shard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = view(spark, sf_dir, "shards")
    return paging.task_page(shards, "2-HIGH", "retry", limit=50, offset=10)


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.task_counts(view(spark, sf_dir, "shards"))


def shard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.task_errors(view(spark, sf_dir, "shards")).select(
        "job_id", "id", "status", "last_error", "updated_at", "position"
    )


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_totals(view(spark, sf_dir, "result_pages")).select("query_id", "page", "total")


def full_page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.full_page_prefix(view(spark, sf_dir, "result_pages")).select(
        "query_id", "page", "n_results"
    )


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "stored_listings").select(
        "id",
        decode(F.col("categories_json"), "array<string>").alias("categories"),
        decode(F.col("complete_address_json"), ADDRESS_DDL).alias("address"),
        decode(F.col("source_bbox_json"), BBOX_DDL).alias("bbox"),
        setting(F.col("raw_json"), "k", "int", 0).alias("k"),
        setting(F.col("categories_json"), "missing", "string", "none").alias("fallback"),
    )
    return rows.select(
        "id",
        F.size("categories").alias("n_categories"),
        F.get("categories", F.lit(0)).alias("first_category"),
        "address.street",
        "address.city",
        "address.state",
        "address.postcode",
        "address.country",
        "bbox.south",
        "bbox.west",
        "bbox.north",
        "bbox.east",
        "k",
        "fallback",
    )


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "pages")
    return lp.extract_listings(pages, lp.NAV_LINKS, SITE, "page_id").select(
        "page_id", "position", "name", "listing_id", "listing_url"
    )


SITES = [
    lp.Site("https://us.directory.example", lp.CARD_US), lp.Site("https://au.directory.example", lp.CARD_AU),
    lp.Site("https://ca.directory.example", lp.LISTING_CA), lp.Site("https://nz.directory.example", lp.ITEM_NZ),
]


def _mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "layout_pages").withColumn("seq", F.col("page_id"))
    return lp.extract_mixed(pages, SITES, "page_id", "seq", "job_id", "observed_at")


def masked_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with a secret in two rows of three, of which one is blank; only whether it is set is shown."""
    third = F.col("seq") % 3
    token = F.when(third == 1, F.lit("")).when(third == 2, F.concat(F.lit("t"), F.col("seq").cast("string")))
    return mask_secret(view(spark, sf_dir, "settings_log").withColumn("token", token), "token").select("setting", "seq", "has_token")


def job_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that the tasks of a job may take: by the job's key in any case, else the default."""
    limits = F.create_map(*[F.lit(v) for pair in {"1-urgent": 9, "2-high": 7, "": 1}.items() for v in pair])
    key = F.when(F.col("id") % 10 != 0, F.col("job_id"))
    return view(spark, sf_dir, "shards").select("id", keyed_default(limits, key, F.col("attempt_count")).alias("most_attempts"))


def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges read back from GeoJSON texts: Polygon, MultiPolygon, Feature of either, and broken ones."""
    point = lambda n: F.array(F.col(f"lon{n}"), F.col(f"lat{n}"))
    each = F.sort_array(F.collect_list(F.struct("seq", point(1).alias("a"), point(2).alias("b"))))
    rings = view(spark, sf_dir, "zone_edges").groupBy("geom_id", "part_id", "ring_id").agg(each.alias("e"))
    closed = F.concat(F.col("e.a"), F.array(F.element_at("e.b", -1)))
    parts = rings.groupBy("geom_id", "part_id").agg(F.sort_array(F.collect_list(F.struct("ring_id", closed.alias("ring")))).alias("rings"))
    whole = parts.groupBy("geom_id").agg(F.sort_array(F.collect_list(F.struct("part_id", F.col("rings.ring").alias("r")))).alias("parts"))
    kind = F.col("geom_id") % 6
    first = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.element_at("parts.r", 1).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts.r").alias("coordinates")))
    feature = lambda inner: F.concat(F.lit('{"type": "Feature", "properties": {"type": "x"}, "geometry": '), inner, F.lit("}"))
    text = (
        F.when(kind == 0, many).when(kind == 1, feature(many)).when(kind == 2, first).when(kind == 3, feature(first))
        .when(kind == 4, F.substring(many, 1, 40)).otherwise(many)
    )
    return edge_table(whole.select(F.col("geom_id").cast("bigint").alias("geom_id"), text.alias("geometry")))


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pages of four layouts and of a site that is not known."""
    return _mixed_records(spark, sf_dir).drop("seq", "job_id", "observed_at", "categories", "category")


def pages_to_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored pages to the coverage of each job: read, normalise, merge, count."""
    # The cards of a page are numbered, as arrival has to be unique per listing.
    records = _mixed_records(spark, sf_dir).withColumn("seq", F.col("page_id") * 2 + F.col("position"))
    return lead_coverage(merge_listings(as_sightings(normalize_listings(records, "seq", "job_id", "observed_at"))))


QUERIES = {
    "jobs_listing": (jobs_listing, with_views("jobs", "SELECT * FROM jobs")),
    "point_lookup": (point_lookup, with_views("shards", "SELECT * FROM shards WHERE id = 42")),
    "lead_page": (
        lead_page,
        with_views(
            "observations",
            GOLDEN
            + """SELECT job_id, dedupe_key, id, name, phone, website FROM golden
            WHERE job_id = 'click' ORDER BY id LIMIT 50 OFFSET 20""",
        ),
    ),
    "shard_page": (
        shard_page,
        with_views(
            "shards",
            """SELECT * FROM shards WHERE job_id = '2-HIGH' AND status = 'retry'
            ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 10""",
        ),
    ),
    "shard_counts": (
        shard_counts,
        with_views(
            "shards", "SELECT job_id, status, count(*) AS total FROM shards GROUP BY job_id, status"
        ),
    ),
    "shard_errors": (
        shard_errors,
        with_views(
            "shards",
            """SELECT job_id, id, status, last_error, updated_at,
              CAST(row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, id DESC) AS INT) AS position
            FROM shards WHERE coalesce(last_error, '') <> '' QUALIFY position <= 25""",
        ),
    ),
    "page_totals": (
        page_totals,
        with_views(
            "result_pages",
            """SELECT query_id, page, coalesce(CAST(nullif(replace(regexp_extract(count_text, '(?i)of\\s+([0-9,]+)', 1), ',', ''), '') AS BIGINT), n_results) AS total
            FROM result_pages""",
        ),
    ),
    "full_page_prefix": (
        full_page_prefix,
        with_views(
            "result_pages",
            """SELECT query_id, page, n_results FROM result_pages r WHERE page <= 10 AND NOT EXISTS (
              SELECT 1 FROM result_pages s WHERE s.query_id = r.query_id AND s.page < r.page AND s.n_results < 30)""",
        ),
    ),
    "json_decode": (
        json_decode,
        with_views(
            "stored_listings",
            """, c AS (SELECT *, CASE WHEN json_valid(categories_json) THEN categories_json END AS cat,
              CASE WHEN complete_address_json <> 'null' THEN complete_address_json END AS adr FROM stored_listings)
            SELECT id, CAST(json_array_length(cat) AS INT) AS n_categories, json_extract_string(cat, '$[0]') AS first_category,
              json_extract_string(adr, '$.street') AS street, json_extract_string(adr, '$.city') AS city,
              json_extract_string(adr, '$.state') AS state, json_extract_string(adr, '$.postcode') AS postcode,
              json_extract_string(adr, '$.country') AS country,
              CAST(json_extract_string(source_bbox_json, '$.south') AS DOUBLE) AS south,
              CAST(json_extract_string(source_bbox_json, '$.west') AS DOUBLE) AS west,
              CAST(json_extract_string(source_bbox_json, '$.north') AS DOUBLE) AS north,
              CAST(json_extract_string(source_bbox_json, '$.east') AS DOUBLE) AS east,
              coalesce(CAST(json_extract_string(raw_json, '$.k') AS INT), 0) AS k, 'none' AS fallback
            FROM c""",
        ),
    ),
    "mixed_pages": (
        mixed_pages,
        with_views(
            "layout_pages",
            """, p AS (SELECT *, CASE site WHEN 0 THEN 'US' WHEN 1 THEN 'AU' WHEN 2 THEN 'CA' ELSE 'NZ' END AS country FROM layout_pages WHERE site < 4),
            first AS (SELECT page_id, 0::INT AS position, 'Shop ' || who AS name, CASE WHEN site = 2 THEN '' ELSE 'shop-' END || who AS listing_id,
              'https://' || lower(country) || '.directory.example' || CASE site WHEN 2 THEN '/bus/Ontario/Toronto/Shop/' || who || '.html'
                WHEN 3 THEN '/b/shop-' || who ELSE '/mip/shop-' || who || '?lid=' || page_id END AS listing_url,
              CASE WHEN has_phone THEN CASE site WHEN 2 THEN '555-0100' WHEN 3 THEN 'Ring' ELSE '(555) 0100' END END AS phone,
              CASE WHEN has_site THEN 'http://shop.example' END AS website, CASE WHEN site < 3 THEN '1 Main St' END AS street,
              CASE site WHEN 2 THEN 'Toronto' WHEN 3 THEN 'Auckland' ELSE 'Springfield' END AS city, CASE site WHEN 2 THEN 'ON' WHEN 3 THEN 'AKL' ELSE 'IL' END AS state_region,
              CASE site WHEN 2 THEN 'M5V' WHEN 3 THEN '1010' ELSE '62701' END AS postcode, country,
              CASE WHEN site < 2 THEN 4.5::DOUBLE END AS rating, CASE WHEN site < 2 THEN 12 ELSE 0 END::INT AS review_count FROM p),
            twin AS (SELECT page_id, 1::INT, 'Twin', 'twin-' || who, 'https://' || lower(country) || '.directory.example/mip/twin-' || who, NULL, NULL, NULL, NULL, NULL, NULL,
              country, NULL, 0::INT FROM p WHERE site < 2)
            SELECT * FROM first UNION ALL SELECT * FROM twin""",
        ),
    ),
    "pages_to_coverage": (
        pages_to_coverage,
        with_views(
            "layout_pages",
            """, seen AS (SELECT job_id, CASE WHEN site = 2 THEN '' ELSE 'shop-' END || who AS dedupe_key, has_site, has_phone FROM layout_pages WHERE site < 4
              UNION ALL SELECT job_id, 'twin-' || who, false, false FROM layout_pages WHERE site < 2),
            lead AS (SELECT job_id, dedupe_key, bool_or(has_site) AS w, bool_or(has_phone) AS p FROM seen GROUP BY ALL)
            SELECT job_id, count(*) AS leads, count(*) FILTER (w) AS leads_with_website, count(*) FILTER (p) AS leads_with_phone FROM lead GROUP BY job_id""",
        ),
    ),
    "masked_settings": (
        masked_settings,
        with_views("settings_log", "SELECT setting, seq, seq % 3 = 2 AS has_token FROM settings_log"),
    ),
    "job_limits": (
        job_limits,
        with_views(
            "shards",
            """SELECT id, CASE WHEN id % 10 = 0 THEN 1 WHEN job_id = '1-URGENT' THEN 9 WHEN job_id = '2-HIGH' THEN 7 ELSE attempt_count END::INT AS most_attempts FROM shards""",
        ),
    ),
    "boundary_edges": (
        boundary_edges,
        with_views(
            "zone_edges",
            """, z AS (SELECT * FROM zone_edges WHERE geom_id % 6 <> 4)
            SELECT CAST(geom_id AS BIGINT) AS geom_id, CAST(part_id AS INT) AS part_id,
              CAST(ring_id AS INT) AS ring_id, CAST(seq AS INT) AS seq, lon1, lat1, lon2, lat2 FROM z
            WHERE (geom_id % 6 NOT IN (2, 3) OR part_id = 0)""",
        ),
    ),
    "extract_links": (
        extract_links,
        """WITH found AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs,
          regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names FROM pages),
        links AS (SELECT page_id, unnest(range(len(hrefs))) AS i, hrefs, names FROM found)
        SELECT page_id, CAST(i AS INT) AS position, trim(names[i + 1]) AS name,
          nullif(split_part(list_filter(string_split(hrefs[i + 1], '/'), lambda s: s <> '')[-1], '?', 1), '') AS listing_id,
          CASE WHEN hrefs[i + 1] LIKE 'http%' THEN hrefs[i + 1] ELSE 'https://directory.example' || hrefs[i + 1] END AS listing_url
        FROM links WHERE trim(names[i + 1]) <> ''""",
    ),
}
