import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright.functions import grades
from gradewright.operators import compare, evaluate, stats
from gradewright.functions import vectors as vec

NAN = float("nan")


def values(spark, rows):
    return spark.createDataFrame(rows, "g string, v double")


def one(df):
    return df.first().asDict()


def numbers(seed=1, n=3000):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: 10.0 ** rng.randint(-200, 200), lambda: -5.5, lambda: NAN, lambda: None]
    return [("ab"[rng.random() < 0.3] if rng.random() < 0.95 else None, rng.choice(kinds)()) for _ in range(n)]


POINTS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("size", [1, 2, 3, 3000])
def test_percentiles_are_numpys(spark, size):
    rows = [("a", 1.0), *numbers(size, size)]
    got = stats.percentiles(values(spark, rows), "v", POINTS, ["g"]).collect()
    groups = {g for g, v in rows if v is not None and not math.isnan(v)}
    assert {r["g"] for r in got} == groups
    for r in got:
        kept = [v for g, v in rows if g == r["g"] and v is not None and not math.isnan(v)]
        for name, p in POINTS.items():
            assert r[name] == pytest.approx(np.percentile(kept, p * 100), rel=1e-12)


@pytest.mark.parametrize("copies", [1, 5000])
def test_percentiles_of_infinite_and_far_values(spark, copies):
    """Infinite ends, and a range that is no number."""
    found = [float("-inf"), -1.7e308, 0.0, 1.0, 2.0, 1.7e308, float("inf")]
    df = spark.createDataFrame([("a", v) for v in found], "g string, v double").crossJoin(spark.range(copies)).drop("id")
    got = one(stats.percentiles(df, "v", {"lo": 0.0, "q": 1 / 3, "m": 0.5, "hi": 1.0}))
    ranked = sorted(found * copies)
    at = (len(ranked) - 1) / 3
    assert got["lo"] == float("-inf") and got["hi"] == float("inf") and got["m"] == 1.0
    assert got["q"] == pytest.approx(ranked[int(at)] + (ranked[int(at) + 1] - ranked[int(at)]) * (at - int(at)))
    whole = one(stats.summary(df, "v"))
    assert whole["median"] == 1.0 and whole["min"] == float("-inf") and whole["max"] == float("inf") and whole["n"] == 7 * copies


def test_one_value_may_be_most_rows(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 7).alias("v"))
    got = stats.percentiles(df, "v", {"m": 0.5, "q": 0.1}).first()
    kept = [0.25 if i % 3 == 0 else i / 7 for i in range(60_000)]
    assert got["m"] == pytest.approx(np.median(kept)) and got["q"] == pytest.approx(np.percentile(kept, 10))


def ranked(df, points, by=(), **options):
    rows = stats.cut_lineage(df)
    return stats._ranked(rows, stats._sketched(rows, ["v"], points, by), ["v"], points, by, **options)


def hard_numbers(spark, n=40_000):
    """One group of nearly all rows, one number of a third of them, infinite ends, a small and a NULL group."""
    i = F.col("id")
    v = (F.when(i % 3 == 0, 7.25).when(i % 1000 == 1, float("inf")).when(i % 1000 == 2, float("-inf"))
         .otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 3))
    g = F.when(i % 400 == 7, "few").when(i % 500 != 9, "most")
    return spark.range(n).select(g.alias("g"), v.alias("v"))


@pytest.mark.parametrize("margin, few", [(0.01, 1 << 20), (0.01, 50), (-0.2, 1 << 20), (-0.2, 50), (0.3, 3)])
def test_ranks_are_exact_whatever_the_brackets(spark, monkeypatch, margin, few):
    """Wide brackets are narrowed round by round, and those that miss their rank are replaced."""
    monkeypatch.setattr(stats, "MARGIN", margin)
    points = [0.0, 0.02, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = hard_numbers(spark)
    made = {r["g"]: r["_q"] for r in ranked(df, points, ["g"], few=few).collect()}
    kept = {}
    for g, v in df.collect():
        kept.setdefault(g, []).append(v)
    assert set(made) == {"most", "few", None}
    for g, found in made.items():
        values = sorted(kept[g])
        for p, x in zip(points, found):
            at = p * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            want = low if low == high or at == int(at) else low * (1 - at % 1) + high * (at % 1)
            assert x == pytest.approx(want, rel=1e-12)


def test_brackets_hold_few_numbers(spark):
    """Of 400,000 numbers of one group, no more than some percent are counted singly."""
    rows = stats.cut_lineage(spark.range(400_000).select((F.pmod(F.xxhash64("id"), F.lit(10**12)) / 7).alias("v")))
    about = stats._sketched(rows, ["v"], [0.25, 0.5, 0.75], ())
    cells = stats._cells(rows, about, ["v"], [0.25, 0.5, 0.75], ())
    assert cells.count() < 0.1 * 400_000 and cells.where("_v is null").count() == 3


def test_summaries_evaluate_their_input_once(spark):
    """The number of jobs does not depend on values, and the input is read by one of them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(count, "id long")
    stats.summaries(df, {"a_": F.col("id"), "b_": F.col("id") / 7}).collect()
    assert seen.value == 1000


def test_summary(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", NAN), ("a", None), ("b", 5.0), (None, 7.0), ("c", None)]
    got = {r["g"]: r.asDict() for r in stats.summary(values(spark, rows), "v", ["g"]).collect()}
    assert got["a"]["n"] == 3 and got["a"]["invalid"] == 2
    assert got["a"]["std"] == pytest.approx(np.std([1, 2, 4])) and got["a"]["median"] == 2.0
    assert got["a"]["q25"] == 1.5 and got["a"]["q75"] == 3.0
    assert got["b"]["std"] == 0.0 and got[None]["mean"] == 7.0
    assert got["c"]["n"] == 0 and got["c"]["median"] is None and got["c"]["invalid"] == 1
    whole = one(stats.summary(values(spark, rows), "v"))
    assert whole["n"] == 5 and whole["median"] == 4.0


def test_sample_and_population_deviation_differ(spark):
    df = values(spark, [("a", 1.0), ("a", 3.0)])
    assert one(stats.length_summary(df, "v"))["std"] == pytest.approx(math.sqrt(2))
    assert one(stats.summary(df, "v"))["std"] == 1.0


def test_tiers(spark):
    found = [1.0, 0.85, 0.8499, 0.75, 0.65, 0.5, 0.4999, -1.0, NAN, None]
    df = values(spark, [("a", v) for v in found])
    labels = [r[0] for r in df.select(grades.tier("v")).collect()]
    assert labels == ["excellent", "excellent", "good", "good", "acceptable", "poor", "very_poor", "very_poor", None, None]
    spread = stats.tier_distribution(df, "v").orderBy("position").collect()
    assert [(r["tier"], r["n"], r["pct"]) for r in spread] == [
        ("excellent", 2, 20.0), ("good", 2, 20.0), ("acceptable", 1, 10.0), ("poor", 1, 10.0), ("very_poor", 2, 20.0),
    ]
    rolled = one(stats.tier_rollup(stats.tier_distribution(df, "v")))
    assert rolled == {"acceptable_pct": 50.0, "poor_pct": 30.0}


def test_tiers_sum_to_the_rows(spark):
    rows = [(g, v) for g, v in numbers(4) if v is not None and not math.isnan(v)]
    counts = stats.tier_distribution(values(spark, rows), "v", ["g"]).agg(F.sum("n")).first()[0]
    assert counts == len(rows)


def test_empty_tiers_and_levels_are_listed(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("b", 0)], "g string, priority_level int")
    got = {(r["g"], r["level"]): (r["n"], r["pct"]) for r in stats.level_distribution(df, by=["g"]).collect()}
    assert len(got) == 10 and got["a", 3] == (2, 100.0) and got["b", 3] == (0, 0.0)


def test_histogram_is_numpys(spark):
    found = [0, 9, 10, 199, 200, 201, -1, 190, 55, 200]
    rows = stats.histogram(spark.createDataFrame([(v,) for v in found], "v int"), "v").orderBy("bin").collect()
    assert {(r["below"], r["above"]) for r in rows} == {(1, 1)}
    got = [r["n"] for r in rows]
    assert got == np.histogram(found, bins=range(0, 210, 10))[0].tolist()


def test_rates_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "quality_verdict string, prediction string")
    assert one(stats.verdict_rates(df))["pass_pct"] is None
    assert one(stats.error_summary(df))["mean_length"] is None


def test_error_summary(spark):
    df = spark.createDataFrame([("ERROR: x",), ("abcd",), ("ab",), (None,)], "prediction string")
    assert one(stats.error_summary(df)) == {"total": 4, "successful": 3, "errors": 1, "mean_length": 3.0}


def test_calibration(spark):
    df = spark.range(1, 101).select(F.col("id").alias("token_count"))
    low, high = stats.calibrate(df)
    assert (low, high) == (np.percentile(range(1, 101), 5), np.percentile(range(1, 101), 95))
    rows = stats.threshold_rejections(df, [("learned", low, high), ("old", 98, 202)]).collect()
    assert [(r["too_short"], r["too_long"]) for r in rows] == [(5, 5), (97, 0)]


def test_estimates_stay_near(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).alias("token_count"))
    found = one(stats.token_percentiles(df, accuracy=1000))
    assert abs(found["p50"] - 500) <= 2 and found["max"] == 999
    n = one(stats.distinct_counts(df, "token_count", approximate=True))["n_token_count"]
    assert abs(n - 1000) <= 150


def test_lookups(spark):
    df = spark.createDataFrame([("high",), ("x",), (None,)], "k string")
    assert [r[0] for r in df.select(grades.ordinal("k", "severity")).collect()] == [2.0, 0.0, 0.0]
    assert [r[0] for r in values(spark, [("a", v) for v in (-1.0, 0.3, 2.0, None)]).select(grades.clip_unit("v")).collect()] == [0.0, 0.3, 1.0, None]


# --- vectors and evaluation ---------------------------------------------------

def vector_rows(n=200, dim=7, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, dim)).astype(np.float32), rng.normal(size=(n, dim)).astype(np.float32)
    a[3] = 0
    return a, b


def test_metrics_are_numpys(spark):
    a, b = vector_rows()
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))] + [(200, None, [1.0] * 7), (201, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    built = df.orderBy("i").select(vec.cosine_similarity("a", "b"), vec.euclidean_distance("a", "b"), vec.manhattan_distance("a", "b")).collect()
    arrow = [r["m"] for r in df.orderBy("i").select(vec.all_metrics("a", "b").alias("m")).collect()]
    a, b = a.astype(float), b.astype(float)
    for i in range(200):
        norm = np.linalg.norm(a[i]) * np.linalg.norm(b[i])
        want = (None if norm == 0 else pytest.approx(a[i] @ b[i] / norm), pytest.approx(np.linalg.norm(a[i] - b[i])), pytest.approx(np.abs(a[i] - b[i]).sum()))
        assert tuple(built[i]) == want and tuple(arrow[i]) == want
    assert tuple(built[200]) == (None, None, None) == tuple(arrow[200])
    assert tuple(built[201]) == (None, 0.0, 0.0) == tuple(arrow[201])


def test_vectors_of_unequal_length_fail(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different length"):
        df.select(vec.all_metrics("a", "b")).collect()


def test_alignment(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    right = spark.createDataFrame([(2,), (3,), (4,)], "id int")
    assert tuple(evaluate.alignment_report(left, right, "id").first()) == (2, 1, 1, 1)


def test_evaluation(spark):
    import json

    a, b = vector_rows()
    rows = [(str(i), x.tolist(), y.tolist(), "漢字", "abc") for i, (x, y) in enumerate(zip(a, b))]
    pairs = spark.createDataFrame(rows, "image_id string, truth_vector array<float>, prediction_vector array<float>, ground_truth string, prediction string")
    samples = evaluate.evaluate(pairs, "image_id")
    first = samples.first()
    assert (first["ground_truth_length"], first["prediction_length"]) == (2, 3)
    made = json.loads(evaluate.evaluation_json(samples, model_name="m").first()[0])
    kept = np.array([r[0] for r in samples.where("cosine_similarity is not null").select("cosine_similarity").collect()])
    assert len(kept) == 199
    cosine = made["overall_metrics"]["cosine_similarity"]
    assert cosine["mean"] == pytest.approx(kept.mean()) and cosine["q25"] == pytest.approx(np.percentile(kept, 25))
    assert made["quality_distribution"]["very_poor"]["count"] == int((kept < 0.5).sum())


# --- stages -------------------------------------------------------------------

def stages(spark, means):
    return spark.createDataFrame([(f"{i}k", m) for i, m in enumerate(means, 1)], "stage string, mean double")


def test_stage_comparison(spark):
    table = stages(spark, [0.6, 0.65, 0.655, 0.64])
    rows = compare.versus_baseline(table).orderBy("stage").collect()
    assert [r["direction"] for r in rows] == [None, "↑", "↑", "↑"]
    assert rows[1]["improvement_pct"] == pytest.approx(8.3333333)
    assert compare.best_stage(table).first()["stage"] == "3k"
    flat = one(compare.progression(table))
    assert flat["plateau"] is True and flat["average_step"] == pytest.approx(0.04 / 3)
    assert one(compare.progression(stages(spark, [0.1, 0.2, 0.3])))["plateau"] is False
    two = one(compare.progression(stages(spark, [0.1, 0.1])))
    assert two["stages"] == 2 and two["plateau"] is None
    assert compare.best_stage(stages(spark, [0.5, 0.7, 0.7])).first()["stage"] == "2k"
    rated = compare.efficiency(table).orderBy("stage").collect()
    assert rated[0]["efficiency"] == pytest.approx(0.6 / 1.38)
    assert [r["recommended"] for r in rated] == [False, True, False, False]
    assert rated[3]["efficiency"] == pytest.approx(0.04 / (6.32 - 1.38))
    idle = compare.efficiency(table, {"1k": 2.0, "2k": 2.0}).orderBy("stage").collect()
    assert idle[1]["efficiency"] == 0.0 and not any(r["recommended"] for r in idle)


def test_report_tables(spark):
    rng = random.Random(3)
    rows = [(f"{s}k", rng.random()) for s in range(1, 5) for _ in range(50)]
    tables = compare.progress_report(spark.createDataFrame(rows, "stage string, cosine_similarity double"))
    from gradewright.plans.reports import markdown_report

    text = markdown_report("Progress", tables)
    assert "## Summary" in text and "## Versus baseline" in text and text.count("| 2k |") >= 3
    wide = compare.metric_table(tables["summary"], ["1k", "2k", "3k", "4k"])
    assert wide.columns == ["position", "metric", "1k", "2k", "3k", "4k"] and wide.count() == 5


def test_reports_of_any_length(spark):
    from gradewright.plans.reports import markdown_table, report_lines

    text = markdown_table(spark.range(2500).orderBy("id")).split("\n")
    assert text[:3] == ["| id |", "|---|", "| 0 |"] and text[-1] == "| 2,499 |" and len(text) == 2502
    df = spark.createDataFrame([(True, None, 0.5, "a|b"), (None, 1234, None, None)], "b boolean, n int, x double, s string")
    assert markdown_table(df).split("\n")[2:] == ["| yes | - | 0.5000 | a\\|b |", "| - | 1,234 | - | - |"]
    assert report_lines("T", {"one_table": df}).count() == 8
