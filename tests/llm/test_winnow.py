"""Benchmark passages in documents, against a search of every window."""

import hashlib
import random
import re

import pytest

from placefold.llm import winnow
from placefold.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """Rows of (doc_id, n_words, n_hit, items), looking up each window of each document."""
    found = {}
    for name, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add(str(name) if name is not None else "")
    sizes = {len(g) for g in found}
    rows = []
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                if (g := tuple(w[a : a + size])) in found:
                    hit.update(range(a, a + size))
                    names |= found[g]
        rows.append((i, len(w), len(hit), tuple(sorted(names))))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=str)


def bench(spark, items):
    return spark.createDataFrame([(n, t, 1) for n, t in items], "item_id string, text string, hits int")


def random_case(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Über", "a", "b"]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(f"i{k}", item(n)) for k, n in enumerate([40, 13, 14, 12, 5, 1, 25, 60, 13])]
    items += [("i3", items[0][1]), ("twin", items[0][1]), ("none", None), ("empty", " .. "), (None, item(15))]
    items.append(("same", "a " * 30))
    docs = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(item(rng.randrange(40)))
            w = words(rng.choice(items)[1] or "")
            a = rng.randrange(len(w) + 1)
            parts.append(", ".join(w[a : a + rng.choice([11, 12, 13, 14, 20, 99])]).upper())
        docs.append((k, " ".join(parts)))
    docs += [docs[3], docs[3], (3, "other"), (None, items[1][1]), (None, None), (99, ""), (98, "a " * 500), (97, item(5000))]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("sent_rows", [10**6, 0])
def test_against_every_window(spark, frame, seed, sent_rows):
    docs, items = random_case(seed)
    rule = winnow.WinnowRule(sent_rows=sent_rows)
    got = winnow.find_contamination(frame(docs).repartition(3), bench(spark, items), rule=rule)
    assert rows_of(got) == plain(docs, items)


def test_query_against_every_window(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i: (n, h, names) for i, n, h, names in plain(docs, items)}
    rows = QUERIES["op8_winnow_benchmark"][0](spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, names = want[r.doc_id]
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(names), digest)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


@pytest.mark.parametrize("sent_rows", [10**6, 0])
def test_odd_and_empty_tables(spark, odd, frame, sent_rows):
    rule = winnow.WinnowRule(sent_rows=sent_rows)
    items = bench(spark, [("a", "same line here same line here same line here same line here same line here")])
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = rows_of(winnow.find_contamination(odd, items, rule=rule))
    assert got == plain(docs, [("a", items.first().text)])
    assert all(r[2] == 0 for r in rows_of(winnow.find_contamination(odd, items.limit(0), rule=rule)))
    assert winnow.find_contamination(frame([]), items, rule=rule).count() == 0


def test_drop_contaminated_keeps_columns_and_clean_rows(spark, frame):
    docs, items = random_case(7)
    table = frame(docs)
    kept = winnow.drop_contaminated(table, bench(spark, items))
    assert kept.columns == table.columns
    clean = sorted((i for i, n, h, _ in plain(docs, items) if not (h and 20 * h >= n)), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean
