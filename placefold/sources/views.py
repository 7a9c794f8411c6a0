"""Business-listing views derived from the provided tables.

Each view is one dialect-neutral SELECT. ``{name}`` stands for a provided
table or for another view, so the same text feeds Spark (as DataFrames) and the
SQL oracles (as common table expressions). Literal braces are doubled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import tables

OBSERVATIONS = """
SELECT event_type AS job_id, CAST(user_id AS STRING) AS dedupe_key, event_id AS seq, ts AS observed_at,
  CASE WHEN event_id % 3 <> 0 THEN concat('p', CAST(event_id AS STRING)) END AS place_id,
  CASE WHEN event_id % 11 <> 0 THEN concat('Name ', CAST(event_id % 97 AS STRING)) END AS name,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('http://w', CAST(event_id AS STRING), '.example') END AS website,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('+1 ', CAST(2000000 + event_id AS STRING)) END AS phone,
  CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN NULL ELSE concat('City ', CAST(user_id % 25 AS STRING)) END AS city,
  CAST(floor(value) AS INT) AS review_count,
  CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 50 AS DOUBLE) / 1e1 END AS review_rating,
  CASE WHEN event_id % 2 = 0 THEN concat('e', CAST(event_id AS STRING)) END AS email,
  props AS raw_json
FROM {events}
"""

SHARDS = """
SELECT o_orderkey AS id, o_orderpriority AS job_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'running' WHEN 3 THEN 'done'
    WHEN 4 THEN 'failed' WHEN 5 THEN 'split' WHEN 6 THEN 'skipped' ELSE 'canceled' END AS status,
  CAST(o_orderkey % 15 AS INT) AS depth, CAST((o_orderkey * 7) % 40 AS INT) AS result_count,
  CAST(o_orderkey % 7 AS INT) AS attempt_count,
  CASE o_orderkey % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN '' WHEN 2 THEN 'HTTP 500' END AS last_error,
  o_orderdate AS updated_at, o_orderdate AS next_run_at
FROM {orders}
"""

JOBS = """
SELECT o_orderpriority AS id, concat('kw ', substring(o_orderpriority, 1, 1)) AS keyword, 'us' AS country,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'running' WHEN '2' THEN 'paused' WHEN '3' THEN 'completed'
    WHEN '4' THEN 'partial' ELSE 'running' END AS status,
  min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
FROM {orders} GROUP BY o_orderpriority
"""

POINTS = """
SELECT event_id AS point_id, event_type AS job_id,
  CASE WHEN event_id % 4 = 0 THEN CAST((event_id * 7919) % 8000 AS DOUBLE) / 1e3
       ELSE 2e0 + CAST(user_id % 10 AS DOUBLE) * 3e-1 + CAST((event_id * 7919) % 100 AS DOUBLE) / 1e3 END AS lon,
  4e1 + CASE WHEN event_id % 4 = 0 THEN CAST((event_id * 104729) % 8000 AS DOUBLE) / 1e3
       ELSE 3e0 + CAST(user_id % 7 AS DOUBLE) * 2e-1 + CAST((event_id * 104729) % 100 AS DOUBLE) / 1e3 END AS lat
FROM {events}
"""

# Seed boxes of each job's grid; job quiet has no points.
GRID_ROOTS = """
SELECT DISTINCT event_type AS job_id, 1 AS seed, 4e1 AS south, 0e0 AS west, 4.4e1 AS north, 8e0 AS east FROM {events}
UNION ALL SELECT DISTINCT event_type, 2, 4.4e1, 0e0, 4.8e1, CASE event_type WHEN 'click' THEN 2e0 ELSE 4e0 END FROM {events}
UNION ALL SELECT DISTINCT 'quiet', 1, 4e1, 0e0, 4.1e1, 1e0 FROM {events}
"""

LOCALITIES = """
SELECT s_suppkey AS id, CASE s_suppkey % 5
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('City ', CAST(s_nationkey AS STRING))
    WHEN 2 THEN concat('City ', CAST(s_nationkey AS STRING), ', ST')
    WHEN 3 THEN concat('City ', CAST(s_nationkey AS STRING), ', ON M', CAST(s_suppkey % 10 AS STRING), 'V 2H1')
    ELSE concat('City ', CAST(s_nationkey AS STRING), ', NY ', CAST(10000 + s_suppkey AS STRING)) END AS locality
FROM {supplier}
"""

GAZETTEER = """
SELECT c_custkey AS place_id, CAST(c_custkey % 80 AS INT) AS cell_x,
  CAST(400 + CAST(floor(CAST(c_custkey AS DOUBLE) / 8e1) AS BIGINT) % 80 AS INT) AS cell_y,
  CASE WHEN c_custkey % 9 <> 0 THEN concat('City ', CAST(c_nationkey AS STRING)) END AS city,
  CASE WHEN c_custkey % 4 <> 0 THEN concat('S', CAST(c_nationkey AS STRING)) END AS state,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(10000 + c_custkey AS STRING) END AS postcode
FROM {customer}
"""

RESULT_PAGES = """
SELECT o_custkey AS query_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 30 AS INT) ELSE 30 END AS n_results,
  concat('Showing 1-30 of ', CASE WHEN o_orderkey % 2 = 0 THEN '1,' ELSE '' END, CAST(100 + o_orderkey % 900 AS STRING)) AS count_text
FROM {orders}
"""

# Jobs that own the observations (their ids are the event types).
LISTING_JOBS = """
SELECT event_type AS id, concat('kw, "', event_type, '"') AS keyword, 'us' AS country,
  CASE event_type WHEN 'click' THEN 'United States' WHEN 'view' THEN '' END AS country_name,
  CASE event_type WHEN 'click' THEN 'us' END AS country_code,
  CASE event_type WHEN 'view' THEN 'completed' WHEN 'error' THEN 'paused' ELSE 'running' END AS status,
  min(ts) AS created_at, max(ts) AS updated_at,
  CASE WHEN event_type <> 'click' THEN min(ts) END AS started_at
FROM {events} GROUP BY event_type
"""

# Records as a page extractor emits them, before normalising.
PARSED_RECORDS = """
SELECT event_id AS seq, event_type AS job_id, ts AS observed_at,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '' ELSE concat('Shop ', CAST(user_id AS STRING)) END AS name,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE concat('id', CAST(event_id % 500 AS STRING)) END AS listing_id,
  CASE WHEN event_id % 3 = 2 THEN concat('https://dir.example/', CAST(event_id % 500 AS STRING)) ELSE '' END AS listing_url,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('555-', CAST(event_id % 1000 AS STRING)) END AS phone,
  CASE WHEN event_id % 5 <> 0 THEN concat('http://s', CAST(user_id AS STRING), '.example') ELSE '' END AS website,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(CAST(event_id % 90 AS STRING), ' Main St') END AS street,
  CASE WHEN event_id % 7 <> 0 THEN concat('City ', CAST(user_id % 25 AS STRING)) END AS city,
  CASE WHEN event_id % 8 <> 0 THEN concat('S', CAST(user_id % 9 AS STRING)) ELSE '' END AS state_region,
  CASE WHEN event_id % 9 <> 0 THEN CAST(10000 + user_id AS STRING) END AS postcode,
  CASE WHEN event_id % 10 <> 0 THEN 'US' ELSE '' END AS country,
  CASE WHEN event_id % 4 <> 0 THEN concat('Cat ', CAST(event_id % 12 AS STRING)) END AS category,
  CASE WHEN event_id % 4 <> 0 THEN concat('Cat ', CAST(event_id % 12 AS STRING), '| Extra ', CAST(event_id % 5 AS STRING), ' ||CAT ', CAST(event_id % 12 AS STRING)) END AS categories_text,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 50 AS DOUBLE) / 1e1 END AS rating,
  CASE WHEN event_id % 5 <> 1 THEN CAST(event_id % 300 AS INT) END AS review_count
FROM {events}
"""

# Listing rows with JSON text columns, some of them broken.
STORED_LISTINGS = """
SELECT event_id AS id, event_type AS job_id,
  CASE WHEN event_id % 12 = 0 THEN ' ' ELSE concat(' CAT ', CAST(user_id % 4 AS STRING)) END AS category,
  CASE event_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[broken'
    ELSE concat('["Cat ', CAST(user_id % 4 AS STRING), '"," Cat ', CAST(event_id % 6 AS STRING), ' ","","Cat ', CAST(event_id % 3 AS STRING), '"]') END AS categories_json,
  CASE event_id % 4 WHEN 0 THEN 'null'
    ELSE concat('{{"street":"', CAST(event_id % 90 AS STRING), ' Main St","city":"City ', CAST(user_id % 25 AS STRING), '","state":null,"postcode":"', CAST(10000 + user_id AS STRING), '","country":"US"}}') END AS complete_address_json,
  concat('{{"south":', CAST(event_id % 60 AS STRING), '.5,"west":', CAST(user_id % 80 AS STRING), ',"north":', CAST(event_id % 60 + 1 AS STRING), ',"east":', CAST(user_id % 80 + 2 AS STRING), '.25}}') AS source_bbox_json,
  props AS raw_json
FROM {events}
"""

# Listings whose location fields are partly empty, with the raw record beside.
PARTIAL_LOCATIONS = """
SELECT event_id AS id,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('Kept ', CAST(user_id AS STRING)) END AS city,
  CAST(NULL AS STRING) AS area,
  CASE event_id % 4 WHEN 0 THEN NULL ELSE 'KS' END AS state_region,
  CASE event_id % 5 WHEN 0 THEN '' ELSE '66000' END AS postcode,
  CASE event_id % 2 WHEN 0 THEN NULL ELSE 'US' END AS country,
  CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{{}}'
    WHEN 2 THEN concat('{{"city":"","state_region":"R', CAST(user_id % 9 AS STRING), '","country":"CA"}}')
    ELSE concat('{{"city":"Raw ', CAST(user_id AS STRING), '","stateRegion":"S', CAST(user_id % 9 AS STRING), '","postcode":"', CAST(20000 + user_id AS STRING), '","country":"AU"}}') END AS raw_json
FROM {events}
"""

# Tasks of many small jobs (one per customer), most of them finished.
CUSTOMER_SHARDS = """
SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS job_id,
  CASE WHEN o_custkey % 5 = 0 AND o_orderkey % 4 = 0 THEN 'retry' WHEN o_custkey % 7 = 0 OR (o_custkey % 3 = 0 AND o_orderkey % 9 = 0) THEN 'failed'
    WHEN o_orderkey % 6 = 0 THEN 'split' WHEN o_orderkey % 6 = 1 THEN 'skipped' ELSE 'done' END AS status,
  CAST((o_orderkey * 7) % 40 AS INT) AS result_count
FROM {orders}
"""

# Raw words around the text helpers: one row per order.
RAW_WORDS = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 9 WHEN 0 THEN '12 reviews' WHEN 1 THEN concat('  -', CAST(o_orderkey AS STRING), 'x') WHEN 2 THEN '(1,234)'
    WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN concat(CAST(o_orderkey % 10 AS STRING), '.5 stars')
    WHEN 7 THEN '.25e2' ELSE '99999999999999999999' END AS number_text,
  CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'OFF' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN '' END AS flag_text,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN concat('  kw ', CAST(o_custkey AS STRING), ' ') ELSE concat('kw', CAST(o_custkey AS STRING)) END AS keyword,
  CASE o_orderkey % 4 WHEN 0 THEN concat('O''Brien’s Café, No. ', CAST(o_custkey AS STRING), '!') WHEN 1 THEN '--' WHEN 2 THEN NULL ELSE concat('Plumbers & ', o_orderpriority) END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN concat('tel:+1-555-', CAST(o_custkey AS STRING), ' ') WHEN 1 THEN '' END AS tel_href,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'call us' ELSE concat('Phone: (0', CAST(o_orderkey % 10 AS STRING), ') 555-', CAST(o_custkey AS STRING), ' ext.') END AS shown_phone,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '/' WHEN 2 THEN concat('https://dir.example/us/biz-', CAST(o_orderkey AS STRING), '?ref=1')
    WHEN 3 THEN concat('/bus/City/Name/', CAST(o_orderkey AS STRING), '.html?what=x') ELSE concat('/mip/', CAST(o_orderkey AS STRING), '/') END AS href,
  CASE o_orderkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'au' WHEN 2 THEN ' Ca ' WHEN 3 THEN 'nz' END AS country_code
FROM {orders}
"""

# One geocoded place per customer, fields missing in all combinations.
PLACE_RECORDS = """
SELECT c_custkey AS place_id,
  CASE WHEN c_custkey % 2 = 0 THEN concat('City ', CAST(c_nationkey AS STRING)) ELSE '' END AS city,
  CASE WHEN c_custkey % 3 = 0 THEN concat('Town ', CAST(c_nationkey AS STRING)) END AS town,
  CASE WHEN c_custkey % 5 = 0 THEN 'Village' END AS village,
  CASE WHEN c_custkey % 7 = 0 THEN 'Suburb' END AS suburb,
  CASE WHEN c_custkey % 11 = 0 THEN 'County' END AS county,
  CASE WHEN c_custkey % 4 = 0 THEN concat('State ', CAST(c_nationkey AS STRING)) END AS state,
  CASE WHEN c_custkey % 6 = 0 THEN 'NY' END AS state_code,
  CASE WHEN c_custkey % 9 = 0 THEN concat('US-Z', CAST(c_custkey % 10 AS STRING)) WHEN c_custkey % 9 = 1 THEN 'XX' END AS iso_lvl4,
  CASE WHEN c_custkey % 13 <> 0 THEN CAST(10000 + c_custkey AS STRING) END AS postcode,
  CASE WHEN c_custkey % 2 = 1 THEN 'us' ELSE 'au' END AS country_code,
  CASE WHEN c_custkey % 17 <> 0 THEN concat('Spot ', CAST(c_custkey AS STRING), ', Area ', CAST(c_nationkey AS STRING), ', Land') ELSE '' END AS display_name
FROM {customer}
"""

# What happened to each attempt at a task.
ATTEMPTS = """
SELECT o_orderkey AS shard_id, o_orderpriority AS job_id, CAST(o_orderkey % 15 AS INT) AS depth,
  CAST(o_orderkey % 40 AS DOUBLE) AS south, CAST(o_custkey % 90 AS DOUBLE) AS west,
  CAST(o_orderkey % 40 AS DOUBLE) + CASE WHEN o_orderkey % 3 = 0 THEN 4e-2 ELSE CAST(1 + o_custkey % 9 AS DOUBLE) / 1e1 END AS north,
  CAST(o_custkey % 90 AS DOUBLE) + CAST(1 + o_custkey % 7 AS DOUBLE) / 1e1 AS east,
  CAST((o_orderkey * 7) % 45 AS BIGINT) AS raw_count,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE (o_orderkey * 7) % 30 END AS INT) AS n_leads,
  CAST(1 + o_orderkey % 7 AS INT) AS attempt,
  CASE WHEN o_orderkey % 4 <> 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'COARSE_LOCATION' WHEN o_orderkey % 5 = 1 THEN 'SHARD_EXECUTION_TIMEOUT' ELSE 'OTHER' END AS error_code,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 7 = 0 THEN 'AbortError' WHEN o_orderkey % 4 = 0 THEN 'Error' END AS error_name,
  CASE WHEN o_orderkey % 4 <> 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'Rate-limit hit' WHEN o_orderkey % 9 = 1 THEN 'Blocked by host' WHEN o_orderkey % 9 = 2 THEN NULL ELSE 'socket closed' END AS error_message,
  CASE WHEN o_orderkey % 4 <> 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 429 WHEN o_orderkey % 6 = 2 THEN 500 END AS http_status,
  CASE WHEN o_orderkey % 4 = 0 THEN TRUE ELSE FALSE END AS failed,
  CASE WHEN o_orderkey % 29 = 0 THEN FALSE ELSE TRUE END AS intersects,
  CASE WHEN o_orderkey % 31 = 0 THEN TRUE ELSE FALSE END AS job_canceled
FROM {orders}
"""

# Event log of tasks: eight events per shard, six stories, some stale writes.
SHARD_EVENTS = """
SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) AS shard_id, o_orderkey AS seq, o_orderdate AS ts,
  CASE o_orderkey % 8
    WHEN 0 THEN 'create'
    WHEN 1 THEN 'claim'
    WHEN 2 THEN CASE CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'retry' WHEN 2 THEN 'reclaim' WHEN 3 THEN 'split' WHEN 4 THEN 'failed' ELSE 'skipped' END
    WHEN 3 THEN CASE CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 WHEN 1 THEN 'claim' WHEN 2 THEN 'claim' ELSE 'done' END
    WHEN 4 THEN CASE CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'retry' END
    WHEN 5 THEN CASE WHEN CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 = 2 AND CAST(floor(CAST(o_orderkey AS DOUBLE) / 4e1) AS BIGINT) % 2 = 0 THEN 'retry' ELSE 'cancel' END
    WHEN 6 THEN CASE WHEN CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 = 2 AND CAST(floor(CAST(o_orderkey AS DOUBLE) / 4e1) AS BIGINT) % 2 = 0 THEN 'claim' ELSE 'failed' END
    ELSE 'reclaim' END AS event,
  CASE o_orderkey % 8
    WHEN 1 THEN 't1' WHEN 2 THEN 't1'
    WHEN 3 THEN CASE CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 WHEN 1 THEN 't2' WHEN 2 THEN 't2' ELSE 't1' END
    WHEN 4 THEN CASE CAST(floor(CAST(o_orderkey AS DOUBLE) / 8e0) AS BIGINT) % 6 WHEN 1 THEN 't2' ELSE 't1' END
    WHEN 5 THEN 't2' WHEN 6 THEN 't3' END AS token,
  CASE WHEN o_orderkey % 8 IN (2, 4, 5, 6) THEN concat('error ', CAST(o_orderkey % 100 AS STRING)) END AS error
FROM {orders}
"""

# Event log of jobs, one job per user; a third of the jobs is never seeded.
JOB_EVENTS = """
SELECT concat('job ', CAST(user_id AS STRING)) AS job_id, event_id AS seq, ts,
  CASE event_id % 7 WHEN 0 THEN 'created' WHEN 1 THEN CASE WHEN user_id % 3 = 0 THEN 'paused' ELSE 'seeded' END WHEN 2 THEN 'paused' WHEN 3 THEN 'resumed' WHEN 4 THEN 'canceled'
    WHEN 5 THEN 'failed' ELSE 'finalized' END AS event,
  CASE WHEN event_id % 7 = 6 THEN CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'partial' ELSE 'failed' END END AS status,
  CASE WHEN event_id % 7 >= 5 THEN concat('message ', CAST(event_id % 100 AS STRING)) END AS message,
  CASE WHEN event_id % 7 = 6 AND event_id % 3 <> 2 THEN concat('/exports/', CAST(event_id AS STRING), '.csv') END AS artifact
FROM {events}
"""

# Start, success and failure of delivery runs, in sequence. Job signup has no runs.
SYNC_RUNS = """
SELECT CASE event_type WHEN 'signup' THEN 'import' ELSE event_type END AS job_id, event_id AS seq, ts,
  CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'success' ELSE 'failed' END AS event,
  CASE WHEN event_id % 3 = 1 THEN CAST(floor(CAST(event_id AS DOUBLE) / 2e2) AS BIGINT) END AS last_id,
  CASE WHEN event_id % 3 = 1 THEN CAST(event_id % 40 AS BIGINT) END AS synced,
  CASE event_id % 3 WHEN 1 THEN concat('Synced ', CAST(event_id % 40 AS STRING)) WHEN 2 THEN concat('HTTP ', CAST(500 + event_id % 4 AS STRING)) END AS message
FROM {events}
"""

SETTINGS_LOG = """
SELECT concat('setting ', CAST(user_id AS STRING)) AS setting, event_id AS seq, ts AS updated_at,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS value_json
FROM {events}
"""

# Rows with an expiry time, as a login or cache table would have.
EXPIRING = """
SELECT event_id AS id, user_id, ts AS created_at,
  ts + INTERVAL 1 DAY * CAST(event_id % 30 AS INT) AS expires_at
FROM {events}
"""

# Boxes of tasks, keyed to a country; countries 25 and 26 have no boundary.
BOXES = """
SELECT o_orderkey AS box_id, CAST(o_orderkey % 27 AS INT) AS geom_id,
  4e1 + CAST((o_orderkey * 104729) % 8000 AS DOUBLE) / 1e3 AS south,
  CAST((o_orderkey * 7919) % 8000 AS DOUBLE) / 1e3 AS west,
  4e1 + CAST((o_orderkey * 104729) % 8000 AS DOUBLE) / 1e3 + CAST(1 + o_custkey % 12 AS DOUBLE) / 1e1 AS north,
  CAST((o_orderkey * 7919) % 8000 AS DOUBLE) / 1e3 + CAST(1 + o_custkey % 17 AS DOUBLE) / 1e1 AS east
FROM {orders}
"""

BOX_TEXTS = """
SELECT o_orderkey AS id,
  concat(CAST(o_orderkey % 60 AS STRING), '.25') AS v1, concat(CAST(o_orderkey % 60 + 1 AS STRING), '.5 deg') AS v2,
  CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE concat('-', CAST(o_custkey % 100 AS STRING), '.125') END AS v3,
  CAST(o_custkey % 100 AS STRING) AS v4,
  CASE WHEN o_orderkey % 7 = 0 THEN 'extra' END AS v5
FROM {orders}
"""

# Country boundaries: an octagon per nation, some with a hole or an island.
ZONE_EDGES = """
SELECT n_nationkey AS geom_id, t.part_id AS part_id, t.ring_id AS ring_id, t.seq AS seq,
  8e-1 + 16e-1 * CAST(n_nationkey % 5 AS DOUBLE) + t.x1 * (5e-1 + 1e-1 * CAST(n_nationkey % 5 AS DOUBLE)) AS lon1,
  408e-1 + 16e-1 * floor(CAST(n_nationkey AS DOUBLE) / 5e0) + t.y1 * (5e-1 + 1e-1 * CAST(n_nationkey % 5 AS DOUBLE)) AS lat1,
  8e-1 + 16e-1 * CAST(n_nationkey % 5 AS DOUBLE) + t.x2 * (5e-1 + 1e-1 * CAST(n_nationkey % 5 AS DOUBLE)) AS lon2,
  408e-1 + 16e-1 * floor(CAST(n_nationkey AS DOUBLE) / 5e0) + t.y2 * (5e-1 + 1e-1 * CAST(n_nationkey % 5 AS DOUBLE)) AS lat2
FROM (SELECT n_nationkey, 0 AS shape FROM {nation}
  UNION ALL SELECT n_nationkey, 1 AS shape FROM {nation} WHERE n_nationkey % 3 = 0
  UNION ALL SELECT n_nationkey, 2 AS shape FROM {nation} WHERE n_nationkey % 2 = 0) n
JOIN (VALUES
  (0, 0, 0, 0, 10e-1, 4e-1, 4e-1, 10e-1), (0, 0, 0, 1, 4e-1, 10e-1, -4e-1, 10e-1), (0, 0, 0, 2, -4e-1, 10e-1, -10e-1, 4e-1),
  (0, 0, 0, 3, -10e-1, 4e-1, -10e-1, -4e-1), (0, 0, 0, 4, -10e-1, -4e-1, -4e-1, -10e-1), (0, 0, 0, 5, -4e-1, -10e-1, 4e-1, -10e-1),
  (0, 0, 0, 6, 4e-1, -10e-1, 10e-1, -4e-1), (0, 0, 0, 7, 10e-1, -4e-1, 10e-1, 4e-1),
  (1, 0, 1, 0, 3e-1, 3e-1, -3e-1, 3e-1), (1, 0, 1, 1, -3e-1, 3e-1, -3e-1, -3e-1), (1, 0, 1, 2, -3e-1, -3e-1, 3e-1, -3e-1), (1, 0, 1, 3, 3e-1, -3e-1, 3e-1, 3e-1),
  (2, 1, 0, 0, 9e-1, 9e-1, 12e-1, 9e-1), (2, 1, 0, 1, 12e-1, 9e-1, 12e-1, 13e-1), (2, 1, 0, 2, 12e-1, 13e-1, 9e-1, 9e-1)
) AS t(shape, part_id, ring_id, seq, x1, y1, x2, y2) ON t.shape = n.shape
"""

# Islands of a country: one small polygon per customer, some with a hole.
PARCEL_EDGES = """
SELECT c_nationkey AS geom_id, c_custkey AS part_id, t.ring_id AS ring_id, t.seq AS seq,
  CAST((c_custkey * 37) % 300 - 150 AS DOUBLE) + t.x1 * p.r AS lon1, CAST((c_custkey * 53) % 120 - 60 AS DOUBLE) + t.y1 * p.r AS lat1,
  CAST((c_custkey * 37) % 300 - 150 AS DOUBLE) + t.x2 * p.r AS lon2, CAST((c_custkey * 53) % 120 - 60 AS DOUBLE) + t.y2 * p.r AS lat2
FROM (SELECT c_custkey, c_nationkey, s.ring,
    CASE WHEN c_custkey % 11 = 0 THEN 1e-3 WHEN c_nationkey % 2 = 0 AND c_custkey % 5 = 0 THEN 3e0 + CAST(c_custkey % 97 AS DOUBLE) / 1e2
      ELSE 5e-2 + CAST(c_custkey % 83 AS DOUBLE) / 1e3 END AS r
  FROM (SELECT c_custkey, c_nationkey, 0 AS ring FROM {customer}
    UNION ALL SELECT c_custkey, c_nationkey, 1 AS ring FROM {customer} WHERE c_custkey % 4 = 0) s) p
JOIN (VALUES
  (0, 0, 1e0, -1e0, 1e0, 1e0), (0, 1, 1e0, 1e0, -1e0, 1e0), (0, 2, -1e0, 1e0, -1e0, -1e0), (0, 3, -1e0, -1e0, 1e0, -1e0),
  (1, 0, 5e-1, -5e-1, 5e-1, 5e-1), (1, 1, 5e-1, 5e-1, -5e-1, 0e0), (1, 2, -5e-1, 0e0, 5e-1, -5e-1)
) AS t(ring_id, seq, x1, y1, x2, y2) ON t.ring_id = p.ring
"""

LAYOUT_PAGES = """
SELECT event_id AS page_id, event_type AS job_id, ts AS observed_at, user_id AS who, event_id % 5 AS site, event_id % 3 <> 0 AS has_phone, event_id % 7 = 0 AS has_site,
  concat('https://', CASE event_id % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'au' WHEN 2 THEN 'ca' WHEN 3 THEN 'nz' ELSE 'other' END, '.directory.example/search?p=', CAST(event_id AS STRING)) AS url,
  concat('<html><body>', CASE WHEN event_id % 5 IN (0, 1) THEN concat(
      '<div class="v-card"><a class="business-name" href="/mip/shop-', CAST(user_id AS STRING), '?lid=', CAST(event_id AS STRING), '">Shop ', CAST(user_id AS STRING), '</a>',
      CASE WHEN event_id % 3 <> 0 THEN '<div class="phones phone primary"> (555) 0100 </div>' ELSE '' END,
      CASE WHEN event_id % 7 = 0 THEN '<a class="track website" href="http://shop.example">Site</a>' ELSE '' END,
      '<div class="street-address">1 Main St</div><div class="locality">Springfield, IL 62701</div><div class="rating"><em>4.5</em></div><span class="count">(12)</span></div>',
      '<div class="v-card"><a class="business-name" href="/mip/twin-', CAST(user_id AS STRING), '">Twin</a></div>')
    WHEN event_id % 5 = 2 THEN concat(
      '<div class="listing__content"><a class="listing__name--link">Shop ', CAST(user_id AS STRING), '</a><div data-merchanturl="/bus/Ontario/Toronto/Shop/', CAST(user_id AS STRING), '.html?what=d"></div>',
      CASE WHEN event_id % 3 <> 0 THEN '<a href="tel:555-0100">call</a>' ELSE '' END,
      CASE WHEN event_id % 7 = 0 THEN '<ul><li class="mlr__item--website"><a href="http://shop.example">Site</a></li></ul>' ELSE '<a href="https://ca.directory.example/self">self</a>' END,
      '<span class="listing__address--full">1 Main St, Toronto, ON M5V 2H1</span></div>')
    ELSE concat(
      '<div class="listing-item"><h3><a href="/b/shop-', CAST(user_id AS STRING), '">Shop ', CAST(user_id AS STRING), '</a></h3>',
      CASE WHEN event_id % 3 <> 0 THEN '<a href="tel:0955">Ring</a>' ELSE '' END,
      CASE WHEN event_id % 7 = 0 THEN '<a rel="nofollow" href="http://shop.example">k</a>' ELSE '' END,
      '<div class="item-address">Auckland, AKL 1010</div></div>') END, '</body></html>') AS html
FROM {events}
"""

VIEWS = {
    "observations": OBSERVATIONS,
    "shards": SHARDS,
    "jobs": JOBS,
    "points": POINTS,
    "localities": LOCALITIES,
    "gazetteer": GAZETTEER,
    "result_pages": RESULT_PAGES,
    "listing_jobs": LISTING_JOBS,
    "parsed_records": PARSED_RECORDS,
    "stored_listings": STORED_LISTINGS,
    "partial_locations": PARTIAL_LOCATIONS,
    "customer_shards": CUSTOMER_SHARDS,
    "raw_words": RAW_WORDS,
    "place_records": PLACE_RECORDS,
    "attempts": ATTEMPTS,
    "layout_pages": LAYOUT_PAGES,
    "shard_events": SHARD_EVENTS,
    "job_events": JOB_EVENTS,
    "sync_runs": SYNC_RUNS,
    "settings_log": SETTINGS_LOG,
    "expiring": EXPIRING,
    "boxes": BOXES,
    "box_texts": BOX_TEXTS,
    "grid_roots": GRID_ROOTS,
    "zone_edges": ZONE_EDGES,
    "parcel_edges": PARCEL_EDGES,
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _inputs(name: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(VIEWS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view, or the provided table, as a DataFrame."""
    if name not in VIEWS:
        return tables.load(spark, sf_dir, name)
    inputs = {n: view(spark, sf_dir, n) for n in _inputs(name)}
    return spark.sql(VIEWS[name], **inputs)


def with_views(names: str, body: str) -> str:
    """``body`` behind the named views as common table expressions."""
    ctes = []
    for name in names.split():
        text = VIEWS[name].format(**{n: n for n in _inputs(name)})
        ctes.append(f"{name} AS ({text.strip()})")
    joint = "," if body.lstrip().startswith(",") else ""
    body = body.lstrip().lstrip(",") if joint else body
    return "WITH " + ",\n".join(ctes) + joint + "\n" + body
