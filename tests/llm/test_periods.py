"""Periodic runs against a plain search over all lags, and the contract's columns."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placefold.llm import periods
from placefold.llm.queries import op12_periodic_runs, repeat_tails


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        x = 0
        while x < n - q:
            e = x
            while e < n - q and w[e] == w[e + q]:
                e += 1
            length = e - x + q
            if e > x and length >= max(24, 3 * q):
                s = w[x : x + length]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((x, length, q))
            x = max(e, x + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_row(i, text):
    w = words_of(text)
    h = None if i is None else zlib.crc32(str(i).encode())
    if w and h is not None and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    runs = plain_runs(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)),
    )


def test_random_words_against_all_lags():
    rng = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 170), rng.choice([1, 2, 2, 3, 30])
            w = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                for i in range(a, min(n, a + rng.randint(20, 120))):
                    w[i] = w[a + (i - a) % p]
            docs.append(w)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = [[] for _ in docs]
        for d, *run in zip(*[c.tolist() for c in periods.find_runs(np.array(sum(docs, []), np.int64), starts)]):
            got[d].append(tuple(run))
        assert got == [plain_runs(d) for d in docs]


@pytest.mark.parametrize("n", [23, 24, 25, 72, 73])
def test_least_lengths(n):
    flat = np.array(([0] * 24 if n < 30 else list(range(24)) * 4)[:n], np.int64)
    runs = list(zip(*[c.tolist() for c in periods.find_runs(flat, np.array([0, len(flat)]))]))
    assert runs == [(0, *r) for r in plain_runs(flat.tolist())]


def test_long_texts_take_time_in_proportion():
    times = []
    for n in (100_000, 400_000):
        flat = np.concatenate([np.zeros(n, np.int64), np.tile(np.arange(500), n // 500)])
        begin = time.perf_counter()
        runs = list(zip(*periods.find_runs(flat, np.array([0, len(flat)]))))
        times.append(time.perf_counter() - begin)
        assert [tuple(map(int, r[1:])) for r in runs] == [(0, n + 1, 1), (n, n, 500)]
    assert times[1] < 12 * times[0] + 1


def test_odd_rows(odd):
    rows = periods.periodic_runs(odd.select("doc_id", "text", F.lit(1).alias("runs"), F.lit("x").alias("_row")))
    got = sorted(map(repr, ((r.doc_id, [tuple(x) for x in r.runs], r.kept) for r in rows.collect())))
    want = []
    for r in odd.collect():
        w = words_of(r.text)
        runs = plain_runs(w)
        want.append(repr((r.doc_id, runs, collapsed(w, runs))))
    assert got == sorted(want)


def test_empty_table(frame):
    assert periods.periodic_runs(frame([])).collect() == []


def test_query_against_plain_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    got = op12_periodic_runs(spark, sf_dir)
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    short = {r.doc_id for r in rows if len(words_of(r.text)) < 1500}
    assert len(short) > 100
    want = sorted(plain_row(r.doc_id, r.text) for r in rows if r.doc_id in short)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id in short) == want
    assert any(r[1] for r in want)


def test_repeated_tails_keep_other_rows(odd):
    assert repeat_tails(odd).columns == odd.columns
    told = {(r.doc_id, r.text) for r in repeat_tails(odd).collect()}
    for r in odd.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 or not words_of(r.text):
            assert (r.doc_id, r.text) in told
