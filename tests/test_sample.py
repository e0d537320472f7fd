import hashlib
import heapq
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewright.operators import sample
from tests.oracle import plan


def by_loop(sizes, n):
    """The same allocation as a loop: adjust the largest target by one until it fits."""
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    total = sum(sizes.values())
    targets = {k: round(sizes[k] / total * n) for k in order}
    while sum(targets.values()) != n:
        top = max(order, key=lambda k: targets[k])
        targets[top] += 1 if sum(targets.values()) < n else -1
    return targets


def allocated(spark, tables):
    rows = [(i, k, s, n) for i, (sizes, n) in enumerate(tables) for k, s in sizes.items()]
    df = spark.createDataFrame(rows, "t int, k string, size bigint, n bigint")
    got = [{} for _ in tables]
    for r in sample.allocate(df, ["k"], F.col("n"), ["t"]).collect():
        got[r["t"]][r["k"]] = r["target"]
    return got


def test_allocation_is_the_loops(spark):
    rng = random.Random(1)
    tables = []
    for _ in range(600):
        k = rng.randint(1, 12)
        sizes = {f"{i:02d}": rng.choice([rng.randint(1, 9), rng.randint(1, 300)]) for i in range(k)}
        tables.append((sizes, rng.randint(1, max(2, sum(sizes.values()) // rng.choice([1, 2, 9])))))
    tables += [({"a": 1, "b": 1, "c": 1}, 1), ({"a": 5}, 3), ({f"{i}": 1 for i in range(9)}, 5), ({f"{i}": 3 for i in range(6)}, 9)]
    want = [by_loop(*t) for t in tables]
    assert allocated(spark, tables) == want
    surplus = [sum(round(s / sum(t.values()) * n) for s in t.values()) - n for t, n in tables]
    assert min(surplus) < 0 < max(surplus)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 50), min_size=1, max_size=15), st.integers(1, 200)), min_size=5, max_size=30))
def test_targets_sum_to_n(spark, cases):
    tables = [({f"{i:02d}": s for i, s in enumerate(sizes)}, n) for sizes, n in cases]
    for (sizes, n), got in zip(tables, allocated(spark, tables)):
        assert sum(got.values()) == n and min(got.values()) >= 0
        assert got == by_loop(sizes, n)


def corpus(spark, n, hot=1 / 3):
    """A third of all rows in one stratum, one stratum NULL."""
    share = F.col("id") / n
    stratum = F.when(share < hot, "hot").when(share < 0.5, "b").when(share < 0.51, "tiny").when(share < 0.6, F.lit(None)).otherwise("c")
    return spark.range(n).withColumn("s", stratum)


def test_sample_takes_the_lowest_hashes(spark):
    df = corpus(spark, 5000)
    got = sample.stratified_sample(df, 600, ["s"], "id", 7).collect()
    assert len(got) == 600
    groups = {}
    for r in df.collect():
        groups.setdefault(r["s"], []).append((hashlib.md5(f"{r['id']}|7".encode()).hexdigest(), r["id"]))
    targets = allocated(spark, [({str(k): len(v) for k, v in groups.items()}, 600)])[0]
    want = {i for k, v in groups.items() for _, i in sorted(v)[: targets[str(k)]]}
    assert {r["id"] for r in got} == want


def test_sample_does_not_depend_on_partitions(spark):
    df = corpus(spark, 3000)
    first = {r["id"] for r in sample.stratified_sample(df, 200, ["s"], "id").collect()}
    again = {r["id"] for r in sample.stratified_sample(df.repartition(13).orderBy(F.rand(1)), 200, ["s"], "id").collect()}
    other = {r["id"] for r in sample.stratified_sample(df, 200, ["s"], "id", 43).collect()}
    assert first == again != other


def test_hash_range_with_many_rows(spark, monkeypatch):
    """With one digit a range holds many rows; the ranking inside it decides."""
    monkeypatch.setattr(sample, "HASH_RANGE_DIGITS", 1)
    df = spark.range(2000).withColumn("s", F.lit("all"))
    got = {r["id"] for r in sample.stratified_sample(df, 777, ["s"], "id").collect()}
    order = sorted(range(2000), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    assert got == set(order[:777])


def test_small_stratum_is_short(spark):
    sizes = spark.createDataFrame([("a", 4), ("b", 1)], "s string, size bigint")
    short = sample.shortfall(sample.allocate(sizes, ["s"], 10)).first()
    assert tuple(short) == (10, 5, 5)
    df = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(5)], "id int, s string")
    assert sample.stratified_sample(df, 10, ["s"], "id").count() == 5


def test_splits(spark):
    df = corpus(spark, 4000)
    test, pool = sample.hold_out(df, 300, ["s"], "id")
    assert test.count() == 300 and pool.count() == 3700
    assert sample.overlap(test, pool, "id").first()[0] == 0
    trains = sample.training_sets(pool, [100, 250, 9999], ["s"], "id")
    counts = {r["train_size"]: r["count"] for r in trains.groupBy("train_size").count().collect()}
    assert counts == {100: 100, 250: 250, 9999: 3700}
    assert sample.overlap(test, trains, "id").first()[0] == 0
    small = {r["id"] for r in trains.where("train_size = 100").collect()}
    large = {r["id"] for r in trains.where("train_size = 250").collect()}
    assert not small <= large
    alone = sample.stratified_sample(pool, 250, ["s"], "id", 42 + 250)
    assert {r["id"] for r in alone.collect()} == large
    with pytest.raises(ValueError):
        sample.hold_out(df, 4001, ["s"], "id")


@pytest.mark.parametrize("n, share, want", [(1000, 0.2, 200), (7, 0.2, 2), (1, 0.2, 1), (0, 0.2, 0), (50, 0.0, 0), (50, 1.0, 50)])
def test_random_split_is_exact(spark, n, share, want):
    out = sample.random_split(spark.range(n), "id", share)
    assert out.where("split = 'validation'").count() == want and out.count() == n


def test_random_split_takes_the_lowest_hashes(spark):
    out = sample.random_split(spark.range(500).repartition(5), "id", 0.3, 9)
    order = sorted(range(500), key=lambda i: hashlib.md5(f"{i}|9".encode()).hexdigest())
    assert {r["id"] for r in out.where("split = 'validation'").collect()} == set(order[:150])


@pytest.mark.parametrize("share", [-0.5, -0.01])
def test_missed_bounds_take_all_rows_on(spark, monkeypatch, share):
    """Bounds that lie on the wrong sides of the last hash."""
    monkeypatch.setattr(sample, "_room", lambda target: F.lit(share) * target)
    got = {r["id"] for r in sample.stratified_sample(spark.range(2000).withColumn("s", F.lit("all")), 777, ["s"], "id").collect()}
    order = sorted(range(2000), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
    assert got == set(order[:777])


def test_one_key_in_most_rows(spark):
    """Nine tenths of the rows share a key, half of these are equal: drawn to the row, and alike under another partitioning."""
    i = F.col("id")
    df = spark.range(6_000).select(F.when(i % 10 == 0, i).otherwise(-1).alias("k"), F.when(i % 2 == 0, i).otherwise(0).alias("x"), F.lit("a").alias("s"))
    made = [sorted(map(tuple, sample.stratified_sample(df.repartition(p), 2_000, ["s"], "k").collect())) for p in (3, 8)]
    assert made[0] == made[1] and len(made[0]) == 2_000
    whole = {}
    for r in df.collect():
        whole[tuple(r)] = whole.get(tuple(r), 0) + 1
    assert all(made[0].count(r) <= whole[r] for r in set(made[0]))
    text = plan(sample.stratified_sample(df, 2_000, ["s"], "k"))
    assert "Window" not in text


@pytest.mark.parametrize("few", [1, 1 << 16])
def test_many_strata_of_one_target(spark, monkeypatch, few):
    monkeypatch.setattr(sample, "FEW_STRATA", few)
    sizes = {f"{i:05d}": 3 if i % 50 else 7 for i in range(3_000)}
    tables = [(sizes, 4_000), (sizes, 5_001), ({k: 1 for k in sizes}, 1_501), ({k: 2 for k in sizes}, 2_999)]
    got = allocated(spark, tables)
    for (own, n), found in zip(tables, got):
        assert found == by_levels(own, n) and sum(found.values()) == n
    alone = spark.createDataFrame(list(sizes.items()), "k string, size bigint")
    assert {r["k"]: r["target"] for r in sample.allocate(alone, ["k"], 4_000).collect()} == got[0]


def by_levels(sizes, n):
    """`by_loop` with a heap."""
    order = {k: i for i, k in enumerate(sorted(sizes, key=lambda k: (-sizes[k], k)))}
    total = sum(sizes.values())
    heap = [(-round(s / total * n), order[k], k) for k, s in sizes.items()]
    heapq.heapify(heap)
    left = -sum(t for t, _, _ in heap) - n
    while left:
        step = 1 if left > 0 else -1
        t, i, k = heapq.heappop(heap)
        heapq.heappush(heap, (t + step, i, k))
        left -= step
    return {k: -t for t, _, k in heap}


def test_bound_keeps_little_more_than_the_target(spark):
    df = sample.with_hash(spark.range(100_000).withColumn("s", F.lit("all")), "id", 1)
    targets = spark.createDataFrame([("all", 100_000, 2000)], "s string, size bigint, target bigint")
    assert 2000 <= sample.below_bound(df, targets, ["s"]).count() < 3200


def repeated(spark, seed=0):
    """Every third key twice, once with other columns."""
    rng = random.Random(seed)
    rows = [(f"k{i % 200}", "ab"[i % 2], i) for i in range(300)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, s string, v int")


def test_repeated_keys_do_not_depend_on_partitioning(spark):
    made = []
    for n in (1, 3, 7):
        df = repeated(spark, n).repartition(n)
        test, pool = sample.hold_out(df, 60, ["s"], "k")
        sets = sample.training_sets(pool, [20, 50], ["s"], "k")
        made.append([sorted(map(tuple, d.collect())) for d in (test, pool, sets, sample.stratified_sample(df, 40, ["s"], "k"), sample.random_split(df, "k"))])
        report = sample.hold_out_report(df, test, pool).first()
        assert report["rows"] == 300 and report["test"] == 60 and report["pool"] + report["dropped"] == 240
        assert sample.overlap(test, pool, "k").first()[0] == 0
    assert made[0] == made[1] == made[2]


def test_a_missing_key_is_an_error(spark):
    df = spark.createDataFrame([("a", "s", 1), (None, "s", 2)], "k string, s string, v int")
    for draw in (lambda: sample.stratified_sample(df, 1, ["s"], "k"), lambda: sample.hold_out(df, 1, ["s"], "k"),
                 lambda: sample.training_sets(df, [1], ["s"], "k"), lambda: sample.random_split(df, "k")):
        with pytest.raises(ValueError, match="1 rows have no k"):
            draw()


@pytest.mark.parametrize("few", [1, 10_000])
def test_random_split_narrows_down(spark, few, monkeypatch):
    monkeypatch.setattr(sample, "FEW_ROWS", few)
    monkeypatch.setattr(sample, "HASH_RANGE_DIGITS", 1)
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    made = sample.random_split(df, "k", 0.137)
    assert made.where("split = 'validation'").count() == 137
    same = spark.createDataFrame([("x",)] * 50, "k string")
    assert sample.random_split(same, "k", 0.1).where("split = 'validation'").count() == 50


def test_positional_ids_of_ties(spark):
    from gradewright.operators import curate

    df = spark.range(400).select((F.col("id") % 3).cast("string").alias("p"), F.col("id").alias("v"))
    made = [sorted(map(tuple, curate.positional_ids(df.repartition(n), "p", tie_break=["v"]).collect())) for n in (1, 5)]
    assert made[0] == made[1] and sorted(r[-1] for r in made[0]) == [f"image_{i:04d}" for i in range(400)]
