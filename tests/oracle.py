"""Run queries next to their SQL and compare the results."""

from __future__ import annotations

import contextlib
import io
import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def compare(spark, con, sf_dir, fn, sql):
    """None if equal, else a text on what differs."""
    df = fn(spark, sf_dir)
    if any(join in plan(df) for join in ("CartesianProduct", "NestedLoopJoin")):
        return "the plan compares all rows with all rows"
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cursor = con.execute(sql)
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"{len(bad)} rows differ, first: {str(bad[0])[:1500]}"
    if not got[1]:
        return "no rows"
    return None


def run_all(spark, sf_dir, names=None):
    from gradewright.catalog import ORACLES, QUERIES

    con = connect(sf_dir)
    failed = {}
    for name, fn in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, ORACLES.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        print(f"{'ok  ' if problem is None else 'BAD '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        if problem:
            failed[name] = problem
    return failed


if __name__ == "__main__":
    import sys

    sys.path.insert(0, ".")
    from gradewright.session import build_session

    spark = build_session("local[8]")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    failed = run_all(spark, folder, sys.argv[2:])
    print(len(failed), "failed", sorted(failed))
