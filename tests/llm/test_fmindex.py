"""Repeated word windows, against a count of every window; the index against plain search."""

import collections
import hashlib
import random

import numpy as np
import pytest

from placefold.llm import fmindex
from placefold.llm.queries import QUERIES

SPAN = 35


def plain(rows, span=SPAN):
    """[(id, n, removed, kept)] by counting every window; equal rows are one document."""
    docs = {r: (r[1] or "").encode().split() for r in rows}
    many = collections.Counter(tuple(w[i : i + span]) for w in docs.values() for i in range(len(w) - span + 1))
    out = []
    for r in rows:
        w = docs[r]
        gone = {i + k for i in range(len(w) - span + 1) if many[tuple(w[i : i + span])] > 1 for k in range(span)}
        out.append((r[0], len(w), len(gone), " ".join(x.decode() for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for k in range(60):
        w = []
        for _ in range(rng.randrange(1, 4)):
            w += text(rng.randrange(60))
            s = rng.choice(shared)
            a = rng.randrange(3)
            w += s[a:] if rng.random() < 0.5 else s
        rows.append((k, " ".join(w)))
    rows += [(100, "x " * 300), (101, "x y " * 200), (102, " ".join(text(40) * 3)), (103, rows[5][1]), (104, rows[5][1] + "\n")]
    rows += [(105, None), (106, ""), (107, " ".join(shared[0])), (108, " ".join(text(34))), (109, " ".join(text(3000)))]
    rows += [rows[7], rows[7], (7, " ".join(shared[3])), (None, " ".join(shared[3])), (None, None)]
    return rows


@pytest.mark.parametrize(
    "rule",
    [fmindex.ShardRule(), fmindex.ShardRule(shard_words=500, hot_words=100), fmindex.ShardRule(hot_words=0, shard_words=10**9), fmindex.ShardRule(run=3)],
)
def test_against_every_window(frame, rule):
    rows = case(1)
    assert result(fmindex.dedup_substrings(frame(rows).repartition(4), rule=rule)) == plain(rows)


def test_query_against_every_window(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows)}
    got = QUERIES["op10_fm_substrings"][0](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(want)
    assert any(r.n_removed for r in got)


@pytest.mark.parametrize("span", [2, 3, 8, 35])
def test_index_counts_windows(span):
    rng = np.random.default_rng(span)
    lens = rng.integers(0, 90, 60)
    words = rng.integers(0, 3, int(lens.sum())).astype(np.uint64) * np.uint64(10**15)
    words[:200] = 7
    index = fmindex.FMIndex(words, lens, span)
    ends = np.cumsum(lens)
    parts = [words[e - n : e].tolist() for e, n in zip(ends, lens)]
    many = collections.Counter(tuple(p[i : i + span]) for p in parts for i in range(len(p) - span + 1))
    count = index.occurrences()
    for p, a in zip(parts, index.begin):
        for i in range(len(p) - span + 1):
            assert count[a + i] == many[tuple(p[i : i + span])]
    assert (count > 0).sum() == sum(max(0, len(p) - span + 1) for p in parts)


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 37, 1000)
    matrix = fmindex.WaveletMatrix(symbols, 37)
    at, c = rng.integers(0, 1001, 500), rng.integers(0, 37, 500)
    assert matrix.rank(c, at).tolist() == [int((symbols[:i] == s).sum()) for i, s in zip(at, c)]


def test_odd_and_empty_tables(frame, odd):
    assert fmindex.dedup_substrings(frame([])).count() == 0
    assert result(fmindex.dedup_substrings(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
