import json
import os
import re

import pytest
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.catalog import files
from gradewright.operators import guard
from gradewright.plans import curation
from gradewright.sources import readers, writers
from gradewright.streaming import incremental
from tests.oracle import plan

TRICKY = ['漢"字",\n改行', "a,b", "", "back\\slash", ' lead "quote" ', "a\r\nb", "　", None]


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i int, t string")


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(texts(spark), path)
    got = [r["t"] for r in readers.read_csv(spark, path, "i int, t string").orderBy("i").collect()]
    assert [t or "" for t in got] == [t or "" for t in TRICKY]


def test_csv_with_byte_order_mark_and_other_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿i,t\n1,漢\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).select("i").first()[0] == "1"
    (tmp_path / "b.csv").write_bytes("i,t\n1,漢字\n".encode("utf-16"))
    assert readers.read_csv(spark, str(tmp_path / "b.csv"), encoding="UTF-16").first()["t"] == "漢字"


def test_master_needs_its_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text(f"{fv.PATH_COLUMN},{fv.TEXT_COLUMN}\na,b\n")
    assert readers.read_master(spark, str(tmp_path / "m.csv")).count() == 1
    (tmp_path / "n.csv").write_text("x,y\na,b\n")
    with pytest.raises(ValueError):
        readers.read_master(spark, str(tmp_path / "n.csv"))


def evaluation(scores):
    return {
        "metadata": {"model_name": "m", "n_samples": len(scores)},
        "overall_metrics": {"cosine_similarity": {"mean": 0.5}},
        "per_sample_results": [{"image_id": str(i), "cosine_similarity": s} for i, s in enumerate(scores)],
        "quality_distribution": {"good": {"count": 1, "percentage": 50.0}},
    }


def test_evaluations_and_scores(spark, tmp_path):
    full, empty, table = tmp_path / "full.json", tmp_path / "empty.json", tmp_path / "t.csv"
    full.write_text(json.dumps(evaluation([0.5, None, 0.7]), indent=2))
    empty.write_text(json.dumps(evaluation([])))
    table.write_text("image_id,My_Cosine\na,0.25\nb,\nc,x\n")
    row = readers.read_evaluations(spark, str(full)).first()
    assert row["quality_distribution"]["good"]["count"] == 1 and row["metadata"]["n_samples"] == 3
    assert sorted(r[0] for r in readers.per_sample_scores(spark, str(full), str(table)).collect()) == [0.5, 0.7]
    assert [r[0] for r in readers.per_sample_scores(spark, str(empty), str(table)).collect()] == [0.25]
    assert readers.per_sample_scores(spark, str(empty)).count() == 0


def test_manifest(spark, tmp_path):
    for name in ("b.png", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"1234")
    rows = readers.file_manifest(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["name"], r["stem"], r["length"]) for r in rows] == [("a.png", "a", 4), ("b.png", "b", 4)]


def test_stages(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "1k"))
    spark.range(3).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "3k"))
    df = readers.read_stages(spark, {s: str(tmp_path / s) for s in ("1k", "2k", "3k")})
    assert {r["stage"]: r["count"] for r in df.groupBy("stage").count().collect()} == {"1k": 2, "3k": 3}
    with pytest.raises(ValueError):
        readers.read_stages(spark, {"x": str(tmp_path / "absent")})


def test_json_keeps_nulls(spark, tmp_path):
    writers.write_json(texts(spark), str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == len(TRICKY) and all("t" in x for x in lines)


def test_summary_has_six_decimals(spark, tmp_path):
    stats = {c: 0.123456789 for c in ("mean", "std", "median", "q25", "q75", "min", "max")}
    df = spark.createDataFrame([("1k", *stats.values())], "stage string, " + ", ".join(f"{c} double" for c in stats))
    writers.write_summary(df, str(tmp_path / "s"))
    assert readers.read_csv(spark, str(tmp_path / "s")).first()["mean"] == "0.123457"


# --- incremental --------------------------------------------------------------

SCHEMA = "assistant_text string, id int"


def add(spark, folder, ids):
    words = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [(words + ("腐食" if i % 2 else ""), i) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_run_takes_each_row_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = incremental.read_folder_stream(spark, folder, SCHEMA, files_per_batch=1)
        incremental.run_incrementally(stream, guard.calibrated_guard, out, state)
        return sorted((r["id"], r["quality_verdict"]) for r in spark.read.parquet(out).collect())

    add(spark, folder, range(4))
    assert [v for _, v in run()] == ["FAIL", "PASS", "FAIL", "PASS"]
    assert len(run()) == 4
    add(spark, folder, range(4, 7))
    assert [i for i, _ in run()] == list(range(7))
    batch = guard.calibrated_guard(spark.read.schema(SCHEMA).parquet(folder))
    assert sorted((r["id"], r["quality_verdict"]) for r in batch.collect()) == run()


def table_forms(spark, tmp_path):
    """The same documents as one file and as a folder of part files, and none as a folder."""
    ids = range(200)
    docs = spark.createDataFrame(
        [(i, chr(0x4E00 + i) * (i % 90) + "腐食" * (i % 3 == 0), "ja", "web", i) for i in ids], files.DOCUMENTS)
    one, parts, none = (str(tmp_path / x) for x in ("one", "parts", "none"))
    docs.repartition(3).write.parquet(f"{parts}/documents.parquet")
    docs.limit(1).write.parquet(f"{parts}/documents_old.parquet")
    docs.where("doc_id < 0").write.parquet(f"{none}/documents.parquet")
    os.mkdir(one)
    docs.toPandas().to_parquet(f"{one}/documents.parquet")
    os.mkdir(f"{tmp_path}/bare")
    os.mkdir(f"{tmp_path}/bare/documents.parquet")
    return one, parts, none, str(tmp_path / "bare")


def test_guard_run_reads_a_table_of_part_files(spark, tmp_path):
    one, parts, none, bare = table_forms(spark, tmp_path)
    want = sorted(map(tuple, files.t01(spark, one).collect()))
    assert [r[0] for r in want] == list(range(200))
    assert sorted(map(tuple, files.t01(spark, parts).collect())) == want
    assert files.t01(spark, none).collect() == files.t01(spark, bare).collect() == []


def test_running_counters(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for ids, want in ((range(5), {"PASS": 2, "FAIL": 3}), (range(5, 9), {"PASS": 4, "FAIL": 5})):
        add(spark, folder, ids)
        stream = incremental.read_folder_stream(spark, folder, SCHEMA)
        incremental.run_counters(guard.calibrated_guard(stream), ["quality_verdict"], out, state)
        assert {r["quality_verdict"]: r["n"] for r in incremental.latest_counters(spark, out).collect()} == want


def test_counters_read_a_table_of_part_files(spark, tmp_path):
    one, parts, none, bare = table_forms(spark, tmp_path)
    want = sorted(map(tuple, files.t03(spark, one).collect()))
    assert sum(n for _, n in want) == 200
    assert sorted(map(tuple, files.t03(spark, parts).collect())) == want
    assert files.t03(spark, none).collect() == files.t03(spark, bare).collect() == []
    # The first batch takes the place of the empty snapshot.
    folder, out, state = bare + "/documents.parquet", str(tmp_path / "out"), str(tmp_path / "state")
    for ids, want in (((), {}), (range(5), {"PASS": 2, "FAIL": 3})):
        if ids:
            add(spark, folder, ids)
        stream = incremental.read_table_stream(spark, folder, SCHEMA)
        incremental.run_counters(guard.calibrated_guard(stream), ["quality_verdict"], out, state)
        assert {r["quality_verdict"]: r["n"] for r in incremental.latest_counters(spark, out).collect()} == want


def test_counters_of_many_batches_leave_few_snapshots(spark, tmp_path, monkeypatch):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = incremental.read_folder_stream(spark, folder, SCHEMA, files_per_batch=1)
        incremental.run_counters(stream.withColumn("k", F.col("id") % 3), ["k"], out, state)

    def counted():
        return {r["k"]: r["n"] for r in incremental.latest_counters(spark, out).collect()}

    for i in range(8):
        add(spark, folder, range(3 * i, 3 * i + 3))
    run()
    assert counted() == {0: 8, 1: 8, 2: 8}
    assert len([f for f in os.listdir(out) if f.startswith("snapshot-")]) == 2
    # A stop after the snapshot and before the pointer: the old counters are read, and the batch counts once.
    add(spark, folder, [24])
    point = incremental._point
    monkeypatch.setattr(incremental, "_point", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        run()
    assert counted() == {0: 8, 1: 8, 2: 8}
    monkeypatch.setattr(incremental, "_point", point)
    run()
    assert counted() == {0: 9, 1: 8, 2: 8}
    os.remove(f"{out}/current")
    assert counted() == {0: 9, 1: 8, 2: 8}


def test_finished_keys_in_buckets(spark, tmp_path):
    folder = str(tmp_path / "done")
    assert incremental.skip_marked(spark.range(5), folder, "id").count() == 5
    incremental.mark_done(spark.range(0, 3_000), folder, "id")
    incremental.mark_done(spark.range(2_000, 4_000), folder, "id")
    left = incremental.skip_marked(spark.range(3_995, 4_005).unionByName(spark.range(3_999, 4_001)), folder, "id")
    assert sorted(r["id"] for r in left.collect()) == [4_000, *range(4_000, 4_005)]
    text = plan(incremental.skip_marked(spark.range(3), folder, "id"))
    assert re.search(r"PartitionFilters: .*bucket", text)


def test_skip_done(spark):
    assert incremental.skip_done(spark.range(5), spark.range(3).unionByName(spark.range(2)), "id").count() == 2


# --- whole curation -----------------------------------------------------------

def test_curation(spark):
    rows = [(f"d/{i}.png", f"主桁に腐食が見られる番号{i:05d}。" + ("前回より進行。" if i % 3 == 0 else "") + ("補修が必要。" if i % 5 == 0 else "")) for i in range(900)]
    rows += [(f"d/x{i}.png", "前回より進行。") for i in range(50)]
    master = spark.createDataFrame(rows, f"`{fv.PATH_COLUMN}` string, `{fv.TEXT_COLUMN}` string")
    meta = spark.createDataFrame(
        [(f"{i}.png", "girder" if i % 2 else "deck", "corrosion" if i % 7 else "crack") for i in range(0, 900, 2)] + [(f"{i}.png", "pier", None) for i in range(1, 300, 2)],
        "image string, component_type string, damage_type string",
    )
    settings = curation.CurationSettings(test_size=100, train_sizes=(50, 200, 5000))
    made = curation.curate_corpus(master, meta, settings)
    noise = made.noise.first()
    assert tuple(noise) == (300 + 50, 180, 420 + 50, 50)
    counts = made.funnel.first()
    assert (counts["initial_count"], counts["missing_values"], counts["final_count"]) == (950, 50, 900)
    sizes = {r["split"]: r["count"] for r in made.splits.groupBy("split").count().collect()}
    assert sizes == {"test": 100, "train_50": 50, "train_200": 200, "train_5000": 800}
    test_paths = made.splits.where("split = 'test'").select(fv.PATH_COLUMN)
    assert made.splits.where("split != 'test'").join(test_paths, fv.PATH_COLUMN).count() == 0
    assert made.splits.where(F.col(fv.TEXT_COLUMN).contains("前回")).count() == 0
    report = curation.dataset_report(made, settings)
    assert {r["split"]: r["n"] for r in report["split_sizes"].collect()} == sizes
    assert report["component_types"].agg(F.sum("n")).first()[0] == 100
    assert set(report) == {"funnel", "split_sizes", "component_types", "damage_types", "lengths", "distinct", "noise"}


def test_without_metadata_there_is_one_stratum(spark):
    rows = [(f"{i}.png", f"主桁に腐食が見られる番号{i:05d}") for i in range(200)]
    master = spark.createDataFrame(rows, f"`{fv.PATH_COLUMN}` string, `{fv.TEXT_COLUMN}` string")
    made = curation.curate_corpus(master, None, curation.CurationSettings(test_size=20, train_sizes=(30,)))
    assert {r["split"]: r["count"] for r in made.splits.groupBy("split").count().collect()} == {"test": 20, "train_30": 30}


def test_evaluations_by_line_and_by_file(spark, tmp_path):
    docs = [{"metadata": {"model_name": f"m{i}"}, "per_sample_results": [{"image_id": str(i), "cosine_similarity": i / 10}]} for i in range(5)]
    lines, files = tmp_path / "lines", tmp_path / "files"
    lines.mkdir()
    files.mkdir()
    (lines / "all.json").write_text("\n".join(json.dumps(d) for d in docs))
    for i, d in enumerate(docs):
        (files / f"{i}.json").write_text(json.dumps(d, indent=2))
    for folder, whole in ((lines, False), (files, True)):
        for form in (whole, None):
            read = readers.read_evaluations(spark, str(folder), form)
            assert sorted(r[0] for r in read.select("metadata.model_name").collect()) == [f"m{i}" for i in range(5)]
        assert sorted(r[0] for r in readers.per_sample_scores(spark, str(folder), whole_files=whole).collect()) == [i / 10 for i in range(5)]
    for folder, whole in ((lines, True), (files, False)):
        with pytest.raises(Exception, match="(?i)several documents|malformed|failfast"):
            readers.read_evaluations(spark, str(folder), whole).collect()


def test_a_manifest_meets_the_paths_of_data(spark, tmp_path):
    from gradewright.operators import curate

    folder = tmp_path / "im ages é"
    folder.mkdir()
    for name in ("a b.png", "ñ%20.png", "c.txt"):
        (folder / name).write_bytes(b"x")
    there = [f"{folder}/a b.png", f"file:{folder}/a b.png", "file://" + str(folder).replace(" ", "%20").replace("é", "%C3%A9") + "/a%20b.png", f"{folder}/ñ%20.png"]
    rows = [(p, False) for p in there] + [(None, False), ("", False), (f"{folder}/c.txt", True), (f"{folder}/d.png", True)]
    df = spark.createDataFrame(rows, "image_path string, want boolean")
    manifest = readers.file_manifest(spark, str(folder))
    marked = curate.mark_missing_files(df, manifest)
    assert marked.where("file_missing != want").count() == 0 and marked.count() == len(rows)
    assert tuple(curate.missing_file_audit(df, manifest).first()) == (2, f"{folder}/c.txt")
    assert sorted(r["path"] for r in readers.file_manifest(spark, str(folder), root=str(tmp_path)).collect()) == ["im ages é/a b.png", "im ages é/ñ%20.png"]
