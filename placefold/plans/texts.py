"""Text, number and URL expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.jsons import decode
from ..sources.views import view, with_views


def parse_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = tx.parse_locality(F.col("locality"))
    whole = tx.parse_locality(F.col("locality"), full_postcode=True)
    return view(spark, sf_dir, "localities").select(
        "id", place.alias("p"), whole.getField("postcode").alias("full_postcode")
    ).select("id", "p.city", "p.state_region", "p.postcode", "full_postcode")


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_words").select("id", tx.slugify(F.col("title")).alias("slug"))


def keyword_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_words").select("id", tx.clean(F.col("keyword")).alias("keyword"))
    return rows.where(F.col("keyword").isNotNull()).withColumn(
        "search_params", F.to_json(F.struct(F.col("keyword").alias("query")))
    )


def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flag = F.col("number_text"), F.col("flag_text")
    return view(spark, sf_dir, "raw_words").select(
        "id",
        tx.parse_int(n).alias("as_int"),
        tx.parse_float(n).alias("as_float"),
        tx.parse_count(n).alias("as_count"),
        tx.parse_count(n, grouped=False).alias("as_strict_count"),
        tx.parse_bool(flag).alias("as_bool"),
        tx.parse_bool(flag, fallback=True).alias("as_bool_or_true"),
    )


def phone_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = tx.phone_from(F.col("tel_href"), F.col("shown_phone"))
    return view(spark, sf_dir, "raw_words").select("id", phone.alias("phone"))


def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.col("href")
    return view(spark, sf_dir, "raw_words").select(
        "id",
        tx.id_from_href(href).alias("link_id"),
        tx.id_from_document_path(href).alias("document_id"),
        tx.absolute_url(href, "https://directory.example").alias("url"),
    )


def subcategories(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = decode(F.col("categories_json"), "array<string>")
    return (
        view(spark, sf_dir, "stored_listings")
        .select("id", tx.subcategories(F.col("category"), categories).alias("others"))
        .select(
            "id",
            F.coalesce(F.get("others", F.lit(0)), F.lit("")).alias("subcategory"),
            F.array_join("others", " | ").alias("all_subcategories"),
        )
    )


def location_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("city", "town", "village", "suburb", "county", "state", "state_code", "iso_lvl4",
             "postcode", "country_code")
    parts = tx.location_parts(F.struct(*names), F.col("display_name"))
    return (
        view(spark, sf_dir, "place_records")
        .select("place_id", parts.alias("p"))
        .select(
            "place_id",
            "p.location_term",
            "p.city",
            "p.state",
            "p.postcode",
            "p.country_code",
            tx.is_coarse(F.col("p.city"), F.col("p.postcode")).alias("coarse"),
        )
    )


def code_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "raw_words").where(tx.supported_code(F.col("country_code"))).select(
        "id", "country_code"
    )


QUERIES = {
    "parse_locality": (
        parse_locality,
        with_views(
            "localities",
            """, s AS (SELECT id, locality, strpos(locality, ',') > 0 AS has,
              regexp_split_to_array(trim(substr(locality, strpos(locality, ',') + 1)), '\\s+') AS w FROM localities)
            SELECT id, CASE WHEN has THEN trim(split_part(locality, ',', 1)) ELSE nullif(locality, '') END AS city,
              CASE WHEN has THEN nullif(w[1], '') END AS state_region, CASE WHEN has THEN nullif(w[2], '') END AS postcode,
              CASE WHEN has THEN nullif(array_to_string(w[2:], ' '), '') END AS full_postcode FROM s""",
        ),
    ),
    "slugify": (
        slugify,
        with_views(
            "raw_words",
            """SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug
            FROM raw_words""",
        ),
    ),
    "keyword_clean": (
        keyword_clean,
        with_views(
            "raw_words",
            """SELECT id, trim(keyword) AS keyword, '{"query":"' || trim(keyword) || '"}' AS search_params
            FROM raw_words WHERE trim(coalesce(keyword, '')) <> ''""",
        ),
    ),
    "tolerant_numbers": (
        tolerant_numbers,
        with_views(
            "raw_words",
            """SELECT id, TRY_CAST(nullif(regexp_extract(number_text, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS as_int,
              TRY_CAST(nullif(regexp_extract(number_text, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS as_float,
              coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(number_text, '[(),]', '', 'g'), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS as_count,
              coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(number_text, '[()]', '', 'g'), '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS as_strict_count,
              CASE WHEN lower(trim(flag_text)) IN ('1', 'true', 'yes', 'on') THEN TRUE WHEN lower(trim(flag_text)) IN ('0', 'false', 'no', 'off') THEN FALSE END AS as_bool,
              CASE WHEN lower(trim(flag_text)) IN ('0', 'false', 'no', 'off') THEN FALSE ELSE TRUE END AS as_bool_or_true
            FROM raw_words""",
        ),
    ),
    "phone_clean": (
        phone_clean,
        with_views(
            "raw_words",
            """SELECT id, nullif(CASE WHEN coalesce(tel_href, '') <> '' THEN trim(substr(tel_href, 5))
              ELSE trim(regexp_replace(shown_phone, '[^0-9+()\\-\\s]', '', 'g')) END, '') AS phone FROM raw_words""",
        ),
    ),
    "url_ids": (
        url_ids,
        with_views(
            "raw_words",
            """SELECT id, nullif(split_part(list_filter(string_split(href, '/'), lambda s: s <> '')[-1], '?', 1), '') AS link_id,
              nullif(list_filter(string_split(regexp_replace(split_part(href, '?', 1), '\\.html$', ''), '/'), lambda s: s <> '')[-1], '') AS document_id,
              CASE WHEN href LIKE 'http%' THEN href ELSE 'https://directory.example' || nullif(href, '') END AS url FROM raw_words""",
        ),
    ),
    "subcategories": (
        subcategories,
        with_views(
            "stored_listings",
            """, c AS (SELECT id, lower(trim(category)) AS main,
                CASE WHEN json_valid(categories_json) THEN json_extract_string(categories_json, '$[*]') END AS l FROM stored_listings),
            u AS (SELECT id, main, unnest(range(len(l))) AS pos, l FROM c),
            v AS (SELECT id, trim(l[pos + 1]) AS v, min(pos) AS pos FROM u
                WHERE trim(l[pos + 1]) <> '' AND lower(trim(l[pos + 1])) <> main GROUP BY id, trim(l[pos + 1])),
            j AS (SELECT id, arg_min(v, pos) AS first, string_agg(v, ' | ' ORDER BY pos) AS joined FROM v GROUP BY id)
            SELECT s.id, coalesce(j.first, '') AS subcategory, coalesce(j.joined, '') AS all_subcategories
            FROM stored_listings s LEFT JOIN j ON j.id = s.id""",
        ),
    ),
    "location_term": (
        location_term,
        with_views(
            "place_records",
            """, p AS (SELECT place_id, coalesce(nullif(city, ''), nullif(town, ''), nullif(village, ''), nullif(suburb, ''), nullif(county, '')) AS city,
                coalesce(nullif(state_code, ''), nullif(split_part(iso_lvl4, '-', 2), ''), nullif(state, '')) AS state,
                nullif(postcode, '') AS postcode, upper(country_code) AS country_code, nullif(display_name, '') AS shown FROM place_records)
            SELECT place_id, CASE WHEN city IS NOT NULL AND state IS NOT NULL THEN city || ', ' || state
                WHEN country_code = 'US' AND postcode IS NOT NULL THEN postcode WHEN city IS NOT NULL THEN city
                ELSE trim(array_to_string(string_split(shown, ',')[1:2], ',')) END AS location_term,
              city, state, postcode, country_code, city IS NULL AND postcode IS NULL AS coarse FROM p""",
        ),
    ),
    "code_filter": (
        code_filter,
        with_views(
            "raw_words",
            "SELECT id, country_code FROM raw_words WHERE lower(trim(country_code)) IN ('us', 'au', 'ca')",
        ),
    ),
}
