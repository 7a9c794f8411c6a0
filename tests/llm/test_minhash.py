"""Near-duplicate groups against all pairs; sketches against true similarity."""

import random

import numpy as np
import pytest

from placefold.llm import components, minhash
from placefold.llm.queries import QUERIES


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


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
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def case(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([3, 4, 9, 60, 150, 300]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            rows.append((n, " ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 5, 8])))))
            n += 1
            if rng.random() < 0.3:  # chains: each a small step from the one before
                base = edited(rng, base, len(base) // 40)
    rows += [rows[3], rows[3], (4, "shared id, other text of five words"), (None, rows[10][1]), (None, None), (n, ""), (n + 1, " \n")]
    rows += [(n + 2, "one"), (n + 3, "ONE"), (n + 4, "one two"), (n + 5, "É one two three"), (n + 6, "é one two three")]
    return rows


@pytest.mark.parametrize("seed,stars", [(1, 6), (2, 6), (3, 0)])
def test_against_all_pairs(frame, seed, stars):
    rows = case(seed)
    rule = minhash.NearRule(stars=stars)
    assert result(minhash.near_duplicates(frame(rows).repartition(4), rule=rule)) == plain(rows)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op5_near_duplicates"][0](spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == plain(rows)


def test_sketches_fill_and_agree_with_similarity():
    rng = np.random.default_rng(1)
    for size, share in ((1, 1.0), (5, 0.6), (40, 0.5), (2000, 0.8)):
        base = rng.integers(0, 2**63, (200, size), dtype=np.uint64)
        other = base.copy()
        other[:, : round(size * (1 - share))] += np.uint64(1)
        starts = np.arange(0, 200 * size + 1, size)
        a, b = (minhash.sketch(x.reshape(-1), starts, 128) for x in (base, other))
        assert not (a == minhash.EMPTY).any()
        same = round(size * share)
        assert (a == b).mean() == pytest.approx(same / (2 * size - same), abs=0.02)
    empty = minhash.sketch(np.empty(0, np.uint64), np.zeros(3, np.int64), 128)
    assert empty.shape == (2, 128) and (empty == minhash.EMPTY).all()


def test_empty_table_and_no_links(frame, odd):
    assert minhash.near_duplicates(frame([])).count() == 0
    assert result(minhash.near_duplicates(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert {r.node: r.comp for r in got} == want and len(got) == len(want)


def test_one_document_of_each_group_stays(frame):
    rows = case(4)
    table = frame(rows)
    kept = minhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    groups = {c for _, n, c in plain(rows) if n}
    assert {r.doc_id for r in kept.collect() if shingle_set(r.text)} == groups
