"""Tables whose extra columns have the names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from placefold.llm import bands, bpe, cotrain, fmindex, lines, minhash, ngram_join, periods, pii, secret_scan, winnow
from test_rows import BYTE

NAMES = [
    "_id", "_row", "_text", "_i", "_r", "_packed", "_", "_lines", "_kept", "_null", "_pos", "starts", "at", "first", "last",
    "ka", "kb", "w", "node", "comp", "bands", "n", "key", "met", "m", "centre", "o", "shingles", "a", "b", "t", "tok", "pos",
    "u", "behind", "shared", "suffixes", "hits", "hash", "item", "items", "is_window", "width", "n_words", "n_hit",
    "n_shingles", "component_id", "kept", "kind", "idx", "len", "s", "left", "seed", "start", "end", "spans", "pattern",
    "label", "fold", "xt", "xm", "some", "score", "p_text", "p_meta", "runs", "ids", "decoded", "path", "dot.ted", "ti`ck",
]


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in NAMES]
    return plain, plain.select(*extra[:30], *plain.columns, *extra[30:])


def rows_by_name(df, names):
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in names]
    return sorted(map(tuple, df.select(*quoted).collect()), key=str)


def filters(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    return {
        "lines": lines.without_repeated_lines,
        "near": minhash.drop_near_duplicates,
        "benchmark": lambda docs: winnow.drop_contaminated(docs, items),
        "quality": lambda docs: cotrain.drop_rejected(docs, labels),
    }


@pytest.mark.parametrize("name", ["lines", "near", "benchmark", "quality"])
def test_filters_hand_on_every_column(spark, tables, name):
    plain, clashing = tables
    keep = filters(spark)[name]
    got = keep(clashing)
    assert got.schema == clashing.schema
    assert rows_by_name(got, plain.columns) == rows_by_name(keep(plain), plain.columns)
    assert all(row[i] == f"{c}:{row[-1]}" for row in rows_by_name(got, [*NAMES, "doc_id"]) for i, c in enumerate(NAMES))


@pytest.mark.parametrize(
    "operator",
    [
        bands.compression_bands, secret_scan.scan_secrets, lines.dedup_lines, lambda d: bpe.encode_decode(d, BYTE),
        minhash.near_duplicates, pii.find_personal_data, fmindex.dedup_substrings, periods.periodic_runs,
        ngram_join.jaccard_components,
    ],
)
def test_results_do_not_depend_on_other_columns(tables, operator):
    plain, clashing = tables
    want = operator(plain)
    got = operator(clashing)
    names = [c for c in want.columns if c not in NAMES or c in ("n_words", "kept", "runs", "ids", "spans", "component_id")]
    assert got.columns == want.columns
    assert rows_by_name(got, names) == rows_by_name(want, names)
