"""The pipeline against plain versions of its stages, and on odd tables."""

import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
import test_lines  # noqa: E402
import test_winnow  # noqa: E402


def one_of_each_group(rows):
    """Smallest ids of the groups linked by five-word shingles at 0.8, by all pairs."""
    kept, groups = [], []
    for i, text in sorted(rows):
        w = text.encode().lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        if not s:
            kept.append((i, text))
            continue
        near = [g for g in groups if any(100 * len(s & t) >= 80 * len(s | t) for t in g["sets"])]
        merged = {"first": min([(i, text), *(g["first"] for g in near)]), "sets": [s, *(t for g in near for t in g["sets"])]}
        groups = [g for g in groups if g not in near] + [merged]
    return kept + [g["first"] for g in groups]


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
        found.append(docs)
    return found


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_every_stage_against_a_plain_version(spark, sf_dir, outputs):
    docs, good, cut, single, clean, coded = outputs
    assert all(d.columns == docs.columns for d in (good, cut, single, clean))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.98 * sum(labels.values())
    assert set(pairs(good)) <= set(pairs(docs)) and good.count() < docs.count()

    lines = test_lines.plain(pairs(good))
    want = sorted((i, "\n".join(x)) for i, x in lines.items() if "".join(x).strip() or not dict(pairs(good))[i].strip())
    assert pairs(cut) == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert pairs(single) == sorted(one_of_each_group(want))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {i: h > 0 and 20 * h >= n for i, n, h, _ in test_winnow.plain(pairs(single), items)}
    assert pairs(clean) == [(i, t) for i, t in pairs(single) if not hit[i]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(pairs(clean))
    assert {r.doc_id for r in coded.collect()} == set(texts)
    for r in coded.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids) and r.decoded == texts[r.doc_id]


def test_run_gives_the_last_stage(spark, sf_dir, outputs):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in outputs[-1].collect())


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", 4), (3, "x " * 90, "en", "s", 180)]
    odd += [(4, " \n \n ", "en", "s", 5), (5, "plain words in a row " * 3, "en", "s", 60), (5, "plain words in a row " * 3, "en", "s", 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= len(rows), name
            if name != "tokens":
                assert out.columns == docs.columns
