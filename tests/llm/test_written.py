"""Shuffle files of a step go when its table is written."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from placefold.llm import ngram_join
from placefold.llm.common import CLEANUP, written


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}


def left(spark, before):
    """Shuffle files that are new and stay; Spark deletes them in the background."""
    for _ in range(50):
        if not (files := shuffled(spark) - before):
            return files
        time.sleep(0.1)
    return files


def test_shuffles_end_with_their_step(spark):
    before, setting = shuffled(spark), spark.conf.get(CLEANUP, None)
    # Held by its name, the plan is never collected.
    held = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    table = written(held, "test")
    assert not left(spark, before)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, held.collect()))
    assert spark.conf.get(CLEANUP, None) == setting


def test_setting_is_put_back(spark):
    setting = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        written(spark.range(3), "test")
        assert spark.conf.get(CLEANUP) == "true"
        spark.conf.set(CLEANUP, "false")
        with pytest.raises(PySparkException):
            written(spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")), "test")
        assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP) if setting is None else spark.conf.set(CLEANUP, setting)


def test_hashes_go_before_slices_are_ranked(spark, frame, monkeypatch):
    after, held, real = {}, [], ngram_join.written

    def seen(df, purpose):
        held.append(df)
        before = shuffled(spark)
        table = real(df, purpose)
        after.setdefault(purpose, left(spark, before))
        return table

    monkeypatch.setattr(ngram_join, "written", seen)
    docs = frame([(i, " ".join(f"w{j + i % 3}" for j in range(60))) for i in range(30)])
    found = ngram_join.jaccard_components(docs).collect()
    assert {(r.doc_id, r.n_shingles) for r in found} == {(i, 56) for i in range(30)}
    assert list(after)[:2] == ["counted", "ranked"]
    assert not any(after.values())
