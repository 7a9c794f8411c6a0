"""Repeated three-line windows, against a plain pass and the SQL."""

import collections
import random

import oracle
from placefold.llm import lines
from placefold.llm.queries import QUERIES


def plain(rows):
    """{(id, text): kept lines} by one pass over all windows in order."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({i for i, _ in docs}) == len(docs), "the order of texts of one id is by hash"
    seen, gone = set(), collections.defaultdict(set)
    for i, text in docs:
        ls = (text or "").split("\n")
        for p in range(len(ls) - 2):
            window = tuple(ls[p : p + 3])
            if not "".join(window).strip(" \t\n\v\f\r"):
                continue
            if window in seen:
                gone[i].update((p, p + 1, p + 2))
            seen.add(window)
    return {i: [x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]] for i, t in docs}


def random_rows(seed):
    rng = random.Random(seed)
    pool = [f"line {k}" for k in range(12)] + ["", " "]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(80)]


def test_against_a_plain_pass(frame):
    rows = random_rows(1) + [(200, "same\n" * 50), (201, "a\nb\nc\n" * 40), (202, None), (203, ""), (None, "line 1\nline 2")]
    rows += [rows[5], rows[5]]
    want = plain(rows)
    got = lines.dedup_lines(frame(rows).repartition(5)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in rows), key=str)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r.kept == "\n".join(want[r.doc_id])
        assert r.n_lines == len(text.split("\n")) and r.n_removed == r.n_lines - len(want[r.doc_id])


def test_every_line_stays_somewhere(frame):
    rows = random_rows(2)
    kept = {x for r in lines.dedup_lines(frame(rows)).collect() for x in r.kept.split("\n")}
    assert {x for _, t in rows for x in t.split("\n")} <= kept | {""}


def test_query_against_sql(spark, sf_dir):
    plan, sql = QUERIES["op3_line_windows"]
    assert oracle.difference(oracle.connect(sf_dir), plan(spark, sf_dir), sql) is None


def test_documents_keep_their_columns(frame, odd):
    rows = [(1, "x\ny\nz\nend"), (2, "x\ny\nz"), (3, "x\ny\nz\n\nmore"), (4, None), (5, ""), (6, "x")]
    table = frame(rows)
    out = lines.without_repeated_lines(table)
    assert out.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None) == [
        (1, "x\ny\nz\nend"), (3, "\nmore"), (5, ""), (6, "x"),
    ]
    assert [r.doc_id for r in out.collect() if r.text is None] == [4]
    assert lines.dedup_lines(odd).count() == odd.count()
    assert lines.dedup_lines(frame([])).count() == 0


def test_no_python_in_the_plan(frame):
    plan = lines.dedup_lines(frame([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))
