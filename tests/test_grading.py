import random
import re

import pytest

from gradewright import fixed_values as fv
from gradewright.functions import answers as an
from gradewright.operators import guard, score, structure
from gradewright.plans import grading
from tests.oracle import plan

LONG = (
    "主桁下面に鉄筋露出（最大幅2cm）が確認された。腐食が著しく進行しており、構造安全性に影響を及ぼす可能性がある。"
    "横桁との接合部付近において剥離も複数箇所で観察され、コンクリートの中性化が進行していることが推測される。"
    "損傷の範囲は桁全長の約30%に及んでいる。また、桁端部の支承周辺でも錆汁の流出痕が見られる。"
)


def predictions(spark, texts, **extra):
    rows = [(str(i), f"img/{i}.png", t, "gt") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "image_id string, image_path string, prediction string, ground_truth string")


def by_id(df, *columns):
    return {r["image_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def tokens(t):
    return len(re.findall("[　-鿿豈-￯]", t)) + len(t.encode("ascii", errors="ignore").split())


def test_classic_guard(spark):
    assert tokens(LONG) >= 98
    repeated = "床版の状態は良好であり損傷はない模様" * 6
    vague = "この写真については撮影の条件が悪く細部の状態まで読み取ることができないため、" + "".join(chr(0x4E00 + i) for i in range(70)) + "確認できません"
    plain = "".join(chr(0x4E00 + i) for i in range(120))
    clause = "主桁の端部に腐食がある。" + "".join(chr(0x4E00 + i) for i in range(100)) + "。主桁の端部に腐食がある。"
    texts = ["USER: q ASSISTANT: 確認できません。", "USER: q ASSISTANT: ひびわれ。", "ASSISTANT: " + LONG, repeated, vague, plain, clause]
    got = by_id(guard.rule_guard(predictions(spark, texts)), "quality_verdict", "reason_code", "rule_triggered")
    assert got == {
        "0": ("FAIL", fv.REASON_NOT_RECOGNIZED, True),
        "1": ("FAIL", fv.REASON_SHORT, True),
        "2": ("PASS", fv.REASON_RULE_ONLY, False),
        "3": ("FAIL", fv.REASON_DIRTY, True),
        "4": ("FAIL", fv.REASON_NOT_RECOGNIZED, True),
        "5": ("PASS", fv.REASON_RULE_ONLY, False),
        "6": ("FAIL", fv.REASON_DIRTY, True),
    }


def test_block_over_a_line_break_depends_on_the_rules(spark):
    block = "".join(chr(0x4E00 + i) for i in range(20)) + "\n" + "".join(chr(0x5E00 + i) for i in range(20))
    words = "鉄筋" + block * 3
    df = predictions(spark, [words])
    # Clauses end at \n, so equal clauses would be found first; split only at 。
    classic = guard.GuardRules(across_lines=True, clause_delimiters="。")
    batch = guard.GuardRules(across_lines=False, clause_delimiters="。")
    assert by_id(guard.rule_guard(df, rules=classic), "reason_code") == {"0": (fv.REASON_DIRTY,)}
    assert by_id(guard.rule_guard(df, rules=batch), "reason_code") == {"0": (fv.REASON_RULE_ONLY,)}


def test_missing_file_comes_first(spark):
    manifest = spark.createDataFrame([("img/0.png",), ("img/0.png",)], "path string")
    df = predictions(spark, [LONG, LONG]).unionByName(
        spark.createDataFrame([("2", "", LONG, ""), ("3", None, LONG, "")], "image_id string, image_path string, prediction string, ground_truth string")
    )
    got = by_id(guard.rule_guard(df, manifest=manifest), "reason_code", "token_count")
    assert got["1"] == (fv.REASON_MISSING_FILE, 0)
    assert {got[k] for k in "023"} == {(fv.REASON_RULE_ONLY, tokens(LONG))}


def test_calibrated_guard(spark):
    filler = "".join(chr(0x4E00 + i) for i in range(40))
    texts = ["短い", filler * 6, filler + "不明", filler + "不明だが腐食", filler, filler + "露出", None]
    df = predictions(spark, texts).withColumnRenamed("prediction", "assistant_text")
    got = by_id(guard.calibrated_guard(df), "reason_code")
    assert [got[str(i)][0] for i in range(6)] == [
        fv.REASON_TOO_SHORT, fv.REASON_TOO_LONG, fv.REASON_NOT_RECOGNIZED, fv.REASON_HIGH_QUALITY, fv.REASON_NO_DAMAGE, fv.REASON_HIGH_QUALITY,
    ]


def test_keyword_structure(spark):
    texts = ["主桁の鉄筋が大きく露出し、著しい", "床版の断面に欠損、軽微", "支承の剥落", "橋台に錆、多数で軽微", "高欄の亀裂", "良好"]
    df = predictions(spark, texts)
    got = by_id(structure.add_keyword_structure(df, "prediction"), *grading.STRUCTURE_COLUMNS)
    assert got == {
        "0": ("rebar_exposure", "high", "girder", "structural"),
        "1": ("section_loss", "low", "deck", "structural"),
        "2": ("spalling", "medium", "bearing", "aesthetic"),
        "3": ("corrosion", "high", "pier", "durability"),
        "4": ("crack", "medium", "railing", "durability"),
        "5": ("unknown", "medium", "unknown", "unknown"),
    }
    same = df.select("image_id", structure.keyword_structure("prediction").alias("s")).select("image_id", "s.*")
    assert by_id(same, *grading.STRUCTURE_COLUMNS) == got


def test_bilingual_structure(spark):
    texts = [
        "鉄筋露出が確認されます。表面が剥離し、鉄筋の腐食も進行しており、構造耐力への影響が懸念される。",
        "Section Loss at the GIRDER bottom, 中程度, 劣化", "Spalling of DECK", "支持部のひび割れ", "",
    ]
    df = structure.structure_batch(predictions(spark, texts), "prediction").select("image_id", "structure.*")
    got = by_id(df, "damage_type", "severity", "location", "risk", "key_features", "confidence")
    assert got["0"] == ("rebar_exposure", "high", "unknown", "structural", ["鉄筋露出", "腐食"], 0.7)
    assert got["1"] == ("section_loss", "medium", "girder_bottom", "durability", [], 0.7)
    assert got["2"] == ("spalling", "low", "deck", "aesthetic", [], 0.7)
    assert got["3"] == ("crack", "low", "support", "aesthetic", ["ひび割れ"], 0.7)
    assert got["4"] == ("unknown", "low", "unknown", "aesthetic", [], 0.7)


FULL = '{"damage_type": "crack", "severity": "low", "location": "deck", "risk": "durability"'


def test_json_structure(spark):
    texts = [
        FULL + "}", f'x {{"a": 1}} y {FULL}, "key_features": ["p", "q"], "description_ja": "漢"}} z', f"```json\n{FULL}, " + '"d": {"e": {"f": 1}}}\n```',
        FULL + ', "key_features": "none", "risk": null}', '{"damage_type": "crack"}', "{not json}", "", None, FULL.replace('"', "'") + "}",
        f'{{"outer": 1}} {FULL}, "n": {{"m": {{"l": 2}}}}}}',
    ]
    df = predictions(spark, texts).select("image_id", an.json_structure("prediction").alias("s")).select("image_id", "s.*")
    got = by_id(df, "damage_type", "risk", "key_features", "description_ja")
    assert got["0"] == ("crack", "durability", [], "")
    assert got["1"] == ("crack", "durability", ["p", "q"], "漢")
    assert got["2"] == ("crack", "durability", [], "")
    assert got["3"][:1] == ("crack",) and got["3"][2] == []
    assert all(got[k] == (None, None, None, None) for k in "45678")
    # Nested twice after another object: only the outermost braces hold it, and they hold two objects.
    assert got["9"] == (None, None, None, None)


def test_flat_structure_and_verdict(spark):
    texts = [
        'VERDICT: PASS\nREASON_CODE: High Quality\n{"damage_type": "crack", "severity_level": "HIGH", "location": ["deck"], "risk_factor": "aesthetic"}',
        "verdict :fail reason_code:  Blurred picture ", "VERDICT: MAYBE", '{"damage_type": "crack"', "REASON_CODE: abc\nVERDICT:PASS", None,
    ]
    df = predictions(spark, texts).select(
        "image_id", an.tagged_verdict("prediction").alias("v"), an.tagged_reason("prediction").alias("r"), an.flat_structure("prediction").alias("s")
    ).select("image_id", "v", "r", "s.*")
    got = by_id(df, "v", "r", *fv.STRUCTURE_DEFAULTS)
    fallback = tuple(fv.STRUCTURE_DEFAULTS.values())
    assert got["0"] == ("PASS", "High Quality", "crack", "medium", "unknown", "aesthetic")
    assert got["1"] == ("FAIL", "Blurred picture", *fallback)
    assert got["2"] == ("FAIL", "Unspecified", *fallback)
    assert got["3"][2:] == fallback
    assert got["4"][:2] == ("PASS", "High Quality")
    assert got["5"][2:] == fallback


def test_scores(spark):
    rows = [
        ("0", "rebar_exposure", "high", "girder_bottom", "structural"), ("1", "crack", "low", "deck", "durability"),
        ("2", "unknown", "medium", "unknown", "unknown"), ("3", "rust", None, "railing", None), ("4", None, "low", "", "aesthetic"),
    ]
    df = spark.createDataFrame(rows, "image_id string, damage_type string, severity string, location string, risk string")
    got = by_id(score.score_rows(df), "raw_score", "priority_level", "priority_description")
    assert [round(got[str(i)][0], 6) for i in range(5)] == [0.9825, 0.5175, 0.54, 0.42, 0.4]
    assert [got[str(i)][1] for i in range(5)] == [5, 3, 3, 2, 2]
    assert got["0"][2] == fv.LEVEL_TEXTS[5]
    medium = by_id(score.score_rows(df, severity_default="medium"), "raw_score")
    assert round(medium["3"][0], 6) == 0.54


def test_bonus_forms_agree(spark):
    bonuses = [
        {"condition": {"damage_type": "crack", "severity": "high"}, "bonus": 0.3}, {"condition": {}, "bonus": 0.01},
        {"condition": {"location": "deck"}, "bonus": 0.02}, {"condition": {"location": "deck"}, "bonus": 0.03},
        {"condition": {"damage_type": "crack", "severity": "high", "location": "deck", "risk": "structural"}, "bonus": 0.9},
    ]
    rows = [("0", "crack", "high", "deck", "structural"), ("1", "crack", "high", None, None), ("2", None, None, "deck", ""), ("3", "x", "y", "z", "w")]
    df = spark.createDataFrame(rows, "image_id string, damage_type string, severity string, location string, risk string")
    table = spark.createDataFrame(
        [tuple(b["condition"].get(a) for a in score.ATTRIBUTES) + (b["bonus"],) for b in bonuses],
        "damage_type string, severity string, location string, risk string, bonus double",
    )
    folded = df.withColumn("bonus", score.bonus({a: a for a in score.ATTRIBUTES}, bonuses))
    want = {"0": 1.26, "1": 0.31, "2": 0.06, "3": 0.01}
    assert {k: round(v[0], 6) for k, v in by_id(folded, "bonus").items()} == want
    assert {k: round(v[0], 6) for k, v in by_id(score.bonus_by_table(df, table), "bonus").items()} == want
    capped = df.select("image_id", score.score_struct({a: a for a in score.ATTRIBUTES}, score.ScoreRules(bonuses=bonuses)).alias("s"))
    assert by_id(capped.select("image_id", "s.raw_score"), "raw_score")["0"] == (1.0,)


def test_ten_thousand_rules(spark):
    """Against the loop over all rules; the rows are read once and not shuffled."""
    rng = random.Random(5)
    names = list(score.ATTRIBUTES)
    value = lambda: rng.choice([None, *range(12)])
    rules = [(*[None if v is None else str(v) for v in (value(), value(), rng.choice([None, None, "3"]), value())], rng.randint(-50, 50) / 100) for _ in range(10_000)]
    rows = [(i, *[None if v is None else str(v) for v in (value() for _ in names)]) for i in range(300)]
    df = spark.createDataFrame(rows, "bonus long, " + ", ".join(f"{n} string" for n in names)).withColumnRenamed("bonus", "id")
    table = spark.createDataFrame(rules, ", ".join(f"{n} string" for n in names) + ", bonus double")
    made = score.bonus_by_table(df, table)
    got = {r["id"]: r["bonus"] for r in made.collect()}
    for i, *own in rows:
        want = sum(b for *given, b in rules if all(g is None or g == v for g, v in zip(given, own)))
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert made.columns == [*df.columns, "bonus"]
    text = plan(made)
    assert "SortMergeJoin" not in text and "Aggregate" not in text
    assert {r["bonus"] for r in score.bonus_by_table(df, table.where("1 = 0")).collect()} == {0.0}


def test_levels(spark):
    values = [1.0, 0.85, 0.8499, 0.7, 0.5, 0.35, 0.0, -1.0, None, float("nan")]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "image_id string, v double")
    got = by_id(df.withColumn("level", score.level("v")), "level")
    assert [got[str(i)][0] for i in range(10)] == [5, 5, 4, 4, 3, 2, 1, 1, None, None]


def test_whole_runs(spark):
    texts = ["ASSISTANT: " + LONG[:90], "ERROR: none", "ASSISTANT: " + LONG]
    df = predictions(spark, texts)
    out = grading.grade_by_keywords(df)
    assert tuple(out.columns) == fv.SCORED_14
    got = by_id(out, "quality_verdict", "damage_type", "priority_level", "priority_description", "priority_score")
    assert got["1"] == ("FAIL", None, 0, fv.NO_SCORE, None)
    assert got["0"][:2] == ("PASS", "rebar_exposure") and got["0"][4] > 0.8
    rule_only = grading.grade_with_answers(df)
    assert tuple(rule_only.columns) == fv.SCORED_22
    got = by_id(rule_only, "quality_verdict", "priority_score", "priority_level", "priority_description")
    assert got["2"] == ("PASS", None, 0, fv.RULE_ONLY_SCORE)
    assert got["1"] == ("FAIL", None, 0, fv.NO_SCORE_CLASSIC)
    answers = spark.createDataFrame(
        [("2", "VERDICT: PASS", "no json here"), ("1", "VERDICT: PASS", "")], "image_id string, judge_answer string, structure_answer string"
    )
    judged = by_id(grading.grade_with_answers(df, answers), "quality_verdict", "priority_score", "priority_level", "fallback_used", "llm_used")
    assert judged["2"] == ("PASS", 0.54, 3, True, True)
    assert judged["1"] == ("FAIL", None, 0, None, False)
    assert judged["0"] == ("FAIL", None, 0, None, False)


def test_rules_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"damage_type_scores": {"crack": 1}, "priority_thresholds": {"5": 0.9, "1": 0},\n "combination_bonuses": [{"condition": {"risk": "x"}, "bonus": 0.1}]}')
    rules = score.load_rules(spark, str(path))
    assert rules.tables["damage_type"] == {"crack": 1} and rules.tables["risk"] == fv.SCORE_TABLES["risk"]
    assert rules.thresholds == {5: 0.9, 1: 0.0} and len(rules.bonuses) == 1
    assert score.load_rules(spark, str(tmp_path / "absent.json")) is score.DEFAULT_RULES


def test_a_missing_text_passes_no_guard(spark):
    df = spark.createDataFrame([("1", "p", None, "g"), ("2", "p", "", "g")], "image_id string, image_path string, prediction string, ground_truth string")
    for rules in (guard.CLASSIC_RULES, guard.BATCH_RULES):
        for r in guard.rule_guard(df, "prediction", rules).collect():
            assert (r["quality_verdict"], r["token_count"], r["assistant_text"]) == ("FAIL", 0, "")
            assert r["reason_code"] == fv.REASON_NOT_RECOGNIZED
    for made in (guard.calibrated_guard(df, "prediction"), grading.grade_by_keywords(df)):
        for r in made.collect():
            assert (r["quality_verdict"], r["token_count"], r["reason_code"]) == ("FAIL", 0, fv.REASON_TOO_SHORT)
    answers = spark.createDataFrame([("1", "VERDICT: PASS", "{}")], "image_id string, judge_answer string, structure_answer string")
    assert {r["quality_verdict"] for r in grading.grade_with_answers(df, answers).collect()} == {"FAIL"}


def test_repeated_answers_do_not_repeat_rows(spark):
    text = "USER: x ASSISTANT: " + "鉄筋露出が見られる。" * 1 + "".join(chr(0x4E00 + i) for i in range(120))
    df = spark.createDataFrame([("1", "p", text, "g")], "image_id string, image_path string, prediction string, ground_truth string")
    rows = [("1", None, None), ("1", "VERDICT: PASS", "{}"), ("1", "VERDICT: FAIL\nREASON_CODE: Dirty or Noisy image", None), (None, "VERDICT: PASS", "{}")]
    answers = spark.createDataFrame(rows, "image_id string, judge_answer string, structure_answer string")
    made = guard.apply_answers(guard.rule_guard(df), answers, "image_id").collect()
    assert [(r["quality_verdict"], r["reason_code"]) for r in made] == [("FAIL", "Dirty or Noisy image")]
