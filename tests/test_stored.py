"""Decoding of stored rows."""

from pyspark.sql import functions as F

from placefold.functions.joins import top_per_key
from placefold.sources.stored import camel_case, decode_rows, keyed_default


def test_leads_decode_and_rename(spark):
    rows = spark.createDataFrame(
        [(1, "Food", '["Food","Bar"]', '{"street":"s"}', '{"south":1,"west":2,"north":3,"east":4}'), (2, None, "oops", "null", "")],
        "id int, category string, categories_json string, complete_address_json string, source_bbox_json string",
    )
    frame = camel_case(decode_rows(rows, "leads"))
    assert frame.columns == ["id", "category", "categories", "completeAddress", "sourceBbox", "allSubcategories", "subcategory"]
    one, two = frame.orderBy("id").collect()
    assert (one.categories, one.completeAddress.street, one.sourceBbox.east) == (["Food", "Bar"], "s", 4.0)
    assert (one.subcategory, one.allSubcategories) == ("Bar", ["Bar"])
    assert (two.categories, two.completeAddress, two.sourceBbox, two.subcategory) == (None, None, None, "")


def test_shards_and_state_defaults(spark):
    rows = spark.createDataFrame([("", None, '{"south":1}')], "run_token string, last_synced_id bigint, bbox_json string")
    row = decode_rows(rows, "shards").first()
    assert (row.run_token, row.last_synced_id, row.bbox.south, row.bbox.north) == (None, 0, 1.0, None)


def test_keyed_default(spark):
    overrides = F.create_map(F.lit("us"), F.lit("a"))
    row = spark.range(1).select(
        keyed_default(overrides, F.lit("US"), F.lit("z")).alias("hit"),
        keyed_default(overrides, F.lit("nz"), F.lit("z")).alias("miss"),
    ).first()
    assert (row.hit, row.miss) == ("a", "z")


def test_top_per_key_of_a_hot_key(spark):
    frame = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    top = top_per_key(frame, "k", [F.col("id").desc()], 4, "position", F.col("id"), salts=16)
    assert top.columns == ["k", "id", "position"]
    got = {}
    for r in top.collect():
        got.setdefault(r.k, {})[r.position] = r.id
    want = {}
    for i in range(4999, -1, -1):
        key = "hot" if i % 3 < 2 else f"k{i % 50}"
        if len(want.setdefault(key, {})) < 4:
            want[key][len(want[key]) + 1] = i
    assert got == want
