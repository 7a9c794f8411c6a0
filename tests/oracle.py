"""Compare a registered Spark query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def spark_side(df):
    return _canonical(df.columns, df.collect())


def duck_side(con, sql):
    cursor = con.execute(sql)
    return _canonical([d[0] for d in cursor.description], cursor.fetchall())


def difference(con, df, sql) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    names, rows = spark_side(df)
    want_names, want = duck_side(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return f"rows {len(rows)} != {len(want)}"
    for got, exp in zip(rows, want):
        if [(type(a), a) for a in got] != [(type(a), a) for a in exp]:
            bad = [(n, a, b) for n, a, b in zip(names, got, exp) if (type(a), a) != (type(b), b)]
            return f"row {got} differs in {bad}"
    return None
