"""Vector codes: against plain Python that compares every part with every entry."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewright.llm import codes
from tests.llm.cases import plain

SCHEMA = "vec_id long, embedding array<double>, label int"


def naive(rows, parts=16, entries=64, rounds=2):
    """(id, label) -> code, error, label_error and the digest, as sorted rows."""
    kept = [(i, label, [max(-2**63, min(2**63 - 1, math.floor(256 * x))) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(parts, -(-max(len(v) for _, _, v in kept) // parts) * parts)
    kept = [(i, label, v + [0] * (width - len(v)), v) for i, label, v in kept]
    size = width // parts
    cut = lambda v: [v[j * size: (j + 1) * size] for j in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    books = [list(b) for b in zip(*[cut(v) for _, _, v, _ in first])]

    def best(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        own = [[[] for _ in b] for b in books]
        for _, _, v, _ in kept:
            for j, p in enumerate(cut(v)):
                own[j][best(p, books[j])[1]].append(p)
        books = [[[sum(c) // len(ps) for c in zip(*ps)] if ps else e for e, ps in zip(b, o)] for b, o in zip(books, own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [best(p, b) for p, b in zip(cut(v), books)]) for i, label, v, _ in kept]
    errors = [min(sum(d for d, _ in f), 2**63 - 1) for _, _, f in found]
    sums = {}
    for (_, label, _), e in zip(found, errors):
        sums[label] = sums.get(label, 0) + e
    out = [(i, label, [n for _, n in f], e, min(sums[label], 2**63 - 1), sha) for (i, label, f), e in zip(found, errors)]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit(1)).withColumn("error", F.lit(2)).repartition(3)
    return codes.encode(df, **options)


COLUMNS = ("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("dims", [16, 32, 40])
def test_against_all_entries(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i), rng.normal(0, 0.2, dims).round(3).tolist(), int(i) % 3) for i in rng.permutation(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(150)]  # a very common vector and label
    rows += [(5, rows[1][1], None), (5, rows[1][1], None), (3, rows[2][1], 77), (None, rows[3][1], 1), (-4, rows[4][1][:7], 1)]
    rows += [(300, None, 1), (301, [None] * dims, 1), (302, [float("nan")] * dims, 1), (303, [float("inf")] * dims, None)]
    out = made(spark, rows)
    assert plain(out, *COLUMNS) == naive(rows)
    tried = out.agg(F.sum("tried") / F.count("*")).first()[0]
    assert tried < 0.6 * codes.PARTS * codes.ENTRIES


def test_few_rows_and_none(spark):
    rows = [(2, [0.5, 1.0], 1), (1, [], None), (7, [0.5, 1.0], 1)]
    assert plain(made(spark, rows), *COLUMNS) == naive(rows)
    assert made(spark, [(1, None, 1)]).collect() == []
    assert made(spark, rows).where("1 = 0").collect() == []


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(-3, 30)).tolist(), i % 2) for i in range(40)]
    assert plain(made(spark, rows, parts=2, entries=6), *COLUMNS) == naive(rows, 2, 6)


def test_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 20_000).tolist(), 1) for i in range(6)]
    assert plain(made(spark, rows, entries=3), *COLUMNS) == naive(rows, 16, 3)


def test_labels_of_all_sizes(spark):
    # One label of half the rows, many of one row.
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("label"), (F.col("id") % 7).alias("error"))
    found = codes.with_label_error(rows).collect()
    total = sum(i % 7 for i in range(0, 5_000, 2))
    assert len(found) == 5_000 and all(r["label_error"] == (total if r["label"] == -1 else r["error"]) for r in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-40, 40)] * 2), min_size=1, max_size=30), st.lists(st.tuples(*[st.integers(-40, 40)] * 2), min_size=1, max_size=12))
def test_bounds_lose_nothing(parts, entries):
    p, e = np.array(parts, dtype=np.int64), np.array(entries, dtype=np.int64)
    pivots = e[codes.choose_pivots(e)]
    at, best, tried = codes.assign(p, e, codes.roots(p, pivots), pivots)
    every = ((p[:, None] - e[None]) ** 2).sum(axis=2)
    assert at.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()
    assert (tried >= 1).all() and (tried <= len(e)).all()
