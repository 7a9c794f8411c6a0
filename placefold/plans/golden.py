"""SQL of the golden listings, shared by the oracles of several queries."""

# Behind the observations view.
GOLDEN = """, golden AS (
SELECT job_id, dedupe_key, min(seq) AS id,
  arg_max(place_id, seq) FILTER (WHERE place_id IS NOT NULL) AS place_id,
  arg_max_null(name, seq) AS name,
  coalesce(arg_min(website, seq) FILTER (WHERE website <> ''), arg_max_null(website, seq)) AS website,
  coalesce(arg_min(phone, seq) FILTER (WHERE phone <> ''), arg_max_null(phone, seq)) AS phone,
  coalesce(arg_min(city, seq) FILTER (WHERE city <> ''), arg_max_null(city, seq)) AS city,
  max(review_count) AS review_count,
  arg_max(review_rating, seq) FILTER (WHERE review_rating IS NOT NULL) AS review_rating,
  arg_min_null(email, seq) AS email,
  arg_max_null(raw_json, seq) AS raw_json,
  arg_min_null(observed_at, seq) AS created_at,
  arg_max_null(observed_at, seq) AS updated_at
FROM observations GROUP BY job_id, dedupe_key)
"""

# Behind the parsed_records view: normalised sightings and their golden rows.
NORMALIZED = """, normalized AS (
SELECT seq, job_id, observed_at,
  CASE WHEN coalesce(listing_id, '') <> '' THEN listing_id
    ELSE name || ':' || coalesce(phone, '') || ':' || coalesce(street, '') END AS dedupe_key,
  nullif(listing_id, '') AS place_id, nullif(listing_url, '') AS link, name, coalesce(category, '') AS category,
  coalesce(string_split(categories_text, '|'), []::VARCHAR[]) AS categories,
  nullif(website, '') AS website, nullif(phone, '') AS phone,
  concat_ws(', ', nullif(street, ''), nullif(city, ''), nullif(state_region, ''), nullif(postcode, '')) AS address,
  street AS raw_street, city AS raw_city, state_region AS raw_state, postcode AS raw_postcode, country AS raw_country,
  nullif(city, '') AS city, nullif(state_region, '') AS state_region, nullif(postcode, '') AS postcode,
  nullif(country, '') AS country, coalesce(review_count, 0) AS review_count, nullif(rating, 0) AS review_rating
FROM parsed_records WHERE coalesce(name, '') <> '')
"""


def _first_filled(name: str) -> str:
    return (
        f"coalesce(arg_min({name}, seq) FILTER (WHERE {name} <> ''), "
        f"arg_max_null({name}, seq)) AS {name}"
    )


LISTINGS = (
    NORMALIZED
    + """, listings AS (
SELECT job_id, dedupe_key, min(seq) AS id,
  arg_max(place_id, seq) FILTER (WHERE place_id IS NOT NULL) AS place_id,
  arg_max(link, seq) FILTER (WHERE link IS NOT NULL) AS link,
  arg_max_null(name, seq) AS name, arg_max_null(category, seq) AS category,
  arg_max_null(categories, seq) AS categories,
  arg_max_null(raw_street, seq) AS raw_street, arg_max_null(raw_city, seq) AS raw_city,
  arg_max_null(raw_state, seq) AS raw_state, arg_max_null(raw_postcode, seq) AS raw_postcode,
  arg_max_null(raw_country, seq) AS raw_country,
"""
    + ",\n".join(
        f"  {_first_filled(c)}"
        for c in ("website", "phone", "address", "city", "state_region", "postcode", "country")
    )
    + """,
  max(review_count) AS review_count,
  arg_max(review_rating, seq) FILTER (WHERE review_rating IS NOT NULL) AS review_rating,
  arg_min_null(observed_at, seq) AS created_at, arg_max_null(observed_at, seq) AS updated_at
FROM normalized GROUP BY job_id, dedupe_key)
"""
)
