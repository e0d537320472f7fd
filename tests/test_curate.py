import pytest
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.operators import curate
from gradewright.session import cut_lineage

GOOD = "主桁に軽微な腐食が認められるが進行はない"


def master(spark, rows):
    return spark.createDataFrame(rows, f"`{fv.PATH_COLUMN}` string, `{fv.TEXT_COLUMN}` string")


def test_funnel(spark):
    rows = [
        ("a", GOOD), (None, GOOD), ("b", None), ("c", " 　 " * 10), ("d", "腐食"), ("e", "腐食" * 300), ("f", "-" * 20), ("g", "？" * 20),
        ("h", "あ" * 20), ("i", " " * 20 + "なし "), ("j", "  " + GOOD), ("k", "x" * 15), ("l", "腐食" + "x" * 13), ("m", "腐食" + "x" * 498),
    ]
    kept, counts = curate.funnel(master(spark, rows))
    assert sorted(r[0] for r in kept.select(fv.PATH_COLUMN).collect()) == ["a", "j", "l", "m"]
    got = counts.first().asDict()
    stages = {s: got[s] for s in curate.FUNNEL_STAGES}
    assert stages == {"missing_values": 3, "length_constraint": 2, "excluded_patterns": 3, "missing_keywords": 2}
    assert got["initial_count"] == 14 and got["final_count"] == 4
    assert got["initial_count"] - sum(stages.values()) == got["final_count"]
    table = [tuple(r) for r in curate.funnel_table(counts).orderBy("position").select("removed", "remaining").collect()]
    assert table == [(0, 14), (3, 11), (2, 9), (3, 6), (2, 4)]


def test_blank_text_is_a_length_case_in_the_older_funnel(spark):
    rows = [("c", " " * 20), ("d", " ")]
    _, counts = curate.funnel(master(spark, rows), blank_is_missing=False)
    got = counts.first()
    assert (got["missing_values"], got["length_constraint"], got["excluded_patterns"]) == (0, 1, 1)


def test_funnel_of_nothing(spark):
    _, counts = curate.funnel(master(spark, []))
    assert counts.first()["retention_pct"] is None


def test_required_columns(spark):
    with pytest.raises(ValueError):
        curate.funnel(spark.range(1))


def test_metadata(spark):
    df = master(spark, [("x/1.png", "a"), ("2.png", "b"), (None, "c")])
    meta = spark.createDataFrame(
        [("1.png", "Q5_K_M", "girder", None), ("1.png", "Q8_0", "deck", "crack"), ("2.png", "Q5_K_M", "pier", "crack"), ("2.png", "Q5_K_M", "pier", "rust")],
        "image string, quantization string, component_type string, damage_type string",
    )
    rows = curate.merge_metadata(df, meta).select(fv.TEXT_COLUMN, "component_type", "damage_type").collect()
    assert sorted(map(tuple, rows)) == [("a", "girder", "unknown"), ("b", "pier", "crack"), ("b", "pier", "rust"), ("c", "unknown", "unknown")]
    bare = curate.merge_metadata(df, meta.select("image"))
    assert {tuple(r) for r in bare.select("component_type", "damage_type").collect()} == {("unknown", "unknown")}
    assert curate.merge_metadata(df, None).count() == 3
    assert curate.duplicate_keys(curate.prepare_metadata(meta), "filename").collect()[0]["n"] == 2


def test_files(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "image_path string")
    manifest = spark.createDataFrame([("a",)], "path string")
    marked = curate.mark_missing_files(df, manifest).collect()
    assert sorted((r.image_path or "", r.file_missing) for r in marked) == [("", False), ("", False), ("a", False), ("b", True), ("b", True)]
    audit = curate.missing_file_audit(df.where("image_path != ''"), manifest).first()
    assert tuple(audit) == (2, "b")


def test_positional_ids_do_not_depend_on_partitions(spark):
    df = spark.range(12_345).withColumn("k", (F.col("id") * 7919) % 12_347)
    made = curate.positional_ids(df.repartition(7), "k").orderBy("k").select("image_id").collect()
    assert [r[0] for r in made] == [f"image_{i:04d}" for i in range(12_345)]


def test_first_rows(spark):
    df = spark.range(10)
    assert curate.first_rows(df, None, "id").count() == 10
    assert [r[0] for r in curate.first_rows(df.repartition(4), 3, "id").collect()] == [0, 1, 2]


def test_positional_ids_of_one_value(spark, monkeypatch):
    """One value in all rows: partitions share them, and ids are the same under another partitioning."""
    tables = []
    monkeypatch.setattr(curate, "cut_lineage", lambda df: tables.append(cut_lineage(df)) or tables[-1])
    i = F.col("id")
    df = spark.range(4_000).select(F.lit("same").alias("k"), F.when(i < 2_000, i).otherwise(-1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = [curate.positional_ids(df.repartition(p), "k") for p in (2, 7)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first, second = (sorted((r["image_id"], r["v"]) for r in m.collect()) for m in made)
    assert first == second and [x for x, _ in first] == [f"image_{n:04d}" for n in range(4_000)]
    assert all(t.select("_part").distinct().count() >= 3 for t in tables)
