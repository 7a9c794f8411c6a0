"""Co-trained quality: held-out accuracy, odd rows, missing labels."""

import random

import pytest
from pyspark.sql import functions as F

from placefold.llm import cotrain
from placefold.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    got = cotrain.quality_scores(docs, train).join(test, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [not r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) >= 0.85


def junk(rng):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('xyz')}%%%" for _ in range(40))


def prose(rng):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(60))


def test_views_teach_each_other(spark):
    """Only 12 labels, but each view tells the classes apart: unlabelled rows are scored right."""
    rng = random.Random(5)
    rows = [(i, junk(rng) if i % 2 else prose(rng), "a" if i % 2 else "b", None, 10) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    got = cotrain.quality_scores(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 2 == 0) for r in got)
    assert all((r.p_text > 0.5) == (r.doc_id % 2 == 0) == (r.p_meta > 0.5) for r in got)


def test_query_scores_every_document(spark, sf_dir):
    rows = QUERIES["op7_cotrained_quality"][0](spark, sf_dir)
    assert rows.columns == ["doc_id", "p_text", "p_meta", "score", "kept"]
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows.where("score NOT BETWEEN 0 AND 1").isEmpty()


@pytest.mark.parametrize("kind", ["none", "one class", "both"])
def test_odd_rows_and_labels(spark, odd, frame, kind):
    values = {"none": [], "one class": [(1, 1), (4, 1)], "both": [(i, i % 2) for i in range(14)] * 2 + [(3, None), (77, 1), (None, 0)]}
    labels = spark.createDataFrame(values[kind], "doc_id long, quality int")
    got = cotrain.quality_scores(odd, labels)
    assert got.count() == odd.count()
    wordless = got.join(odd.where(F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")).select("doc_id").distinct(), "doc_id")
    assert not any(r.kept for r in wordless.where("doc_id != 5").collect())
    assert cotrain.quality_scores(frame([]), labels).count() == 0


def test_drop_rejected_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    kept = cotrain.drop_rejected(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in cotrain.quality_scores(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
