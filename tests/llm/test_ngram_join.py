"""Components of the n-gram join against all pairs."""

import random

import pytest

from placefold.llm import ngram_join
from placefold.llm.queries import QUERIES, op13_ngram_join


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain(rows):
    """[(id, set size, smallest reachable id)] by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted(((n, len(s), least.get(find(i)) if s else n) for i, ((n, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
    return words


def case(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 5, 6, 9, 60, 150, 300]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5]))
            rows.append((n, " ".join(words[: rng.choice([len(words), len(words), 9 * len(words) // 10])])))
            n += 1
            if rng.random() < 0.3:  # chains: each a small step from the one before
                base = edited(rng, base, len(base) // 40)
    rows += [rows[3], rows[3], (4, "shared id, other text of five words"), (None, rows[10][1]), (None, None), (n, ""), (n + 1, " \n")]
    rows += [(n + 2, "one"), (n + 3, "ONE"), (n + 4, "one two"), (n + 5, "É one two three"), (n + 6, "é one two three")]
    return rows


@pytest.mark.parametrize("seed,stars", [(1, 3), (2, 1), (3, 0)])
def test_against_all_pairs(frame, seed, stars):
    rows = case(seed)
    # Small slices: the documents of a group meet over shards, not within a slice.
    rule = ngram_join.JoinRule(stars=stars, slice_chars=2000, slice_docs=3)
    docs = frame(rows).selectExpr("*", "1 AS node", "2 AS shared", "3 AS tok", "4 AS comp", "5 AS _row", "6 AS _id")
    assert result(ngram_join.jaccard_components(docs, rule=rule)) == plain(rows)


def test_edge_of_the_similarity(frame):
    words = [f"w{i}" for i in range(404)]  # 400 shingles
    rows = [(1, " ".join(words))]
    for k in range(60, 130, 5):  # the tail replaced: similarity falls through 0.8
        rows.append((k, " ".join([*words[: 404 - k], *(f"k{k}x{i}" for i in range(k))])))
        rows.append((1000 + k, " ".join(words[:-k])))
    assert result(ngram_join.jaccard_components(frame(rows))) == plain(rows)


def test_large_group_makes_few_pairs(spark, frame):
    """Copies with an edit each are compared with centres, not with each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(400)]
    made = []
    real = ngram_join._verified

    def counted(pairs, lists, rule):
        made.append(pairs.count())
        return real(pairs, lists, rule)

    ngram_join._verified = counted
    try:
        found = result(ngram_join.jaccard_components(frame(rows)))
    finally:
        ngram_join._verified = real
    assert found == plain(rows)
    assert sum(made) < 4 * len(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(ngram_join.jaccard_components(odd)) == plain(rows)


def test_empty_table(frame):
    assert ngram_join.jaccard_components(frame([])).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_ngram_join(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(got) == plain(rows)
    assert "op13_ngram_join" in QUERIES


@pytest.mark.parametrize("bits", [6, 10, 16, 24])
def test_packed_hashes(bits):
    import numpy as np

    shards = ngram_join.Shards(bits)
    keys = np.sort(shards.keys(np.random.default_rng(bits).integers(0, 2**64, 1000, dtype=np.uint64)))
    assert shards.low_bits <= 48 and shards.low_bits + bits >= 54
    for shard, a, b in shards.cut(keys):
        assert (shards.unpack(shards.pack(keys[a:b]), shard) == keys[a:b]).all()
