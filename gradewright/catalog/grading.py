"""Guards (G), structure (C), scores (R) and the counts made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.catalog import registry as reg
from gradewright.catalog.registry import query, rounded, sql_any, sql_blocks, sql_lookup, sql_rules, sql_strip, sql_tokens, table
from gradewright.functions import text as tx
from gradewright.operators import curate, guard, keywords, score, stats, structure
from gradewright.plans import grading as plans

GUARD = dict(low=30, high=200, damage_words=reg.DAMAGE_WORDS, vague_words=reg.VAGUE_WORDS)
RULES = dict(types=reg.TYPE_RULES, severities=reg.SEVERITY_RULES, locations=reg.LOCATION_RULES)
BILINGUAL = dict(
    types=reg.BILINGUAL_TYPES, severities=reg.BILINGUAL_SEVERITIES, locations=reg.BILINGUAL_LOCATIONS,
    risks=reg.BILINGUAL_RISKS, features=reg.FEATURE_RULES,
)
CLASSIC = guard.GuardRules(
    low=98, damage_words=reg.DAMAGE_WORDS, vague_words=reg.VAGUE_WORDS, clause_delimiters=".,\n",
    across_lines=True, answer_by_pattern=False, test_blocks=False,
)


def inference(spark, d):
    """Assistant turns as inference results; every 20th one is an error, the one after it has none."""
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    prediction = F.when(F.col("conv_id") % 20 == 0, "ERROR: file not found").when(F.col("conv_id") % 20 != 1,
        F.concat(F.lit("USER: describe. ASSISTANT: "), F.col("text"))
    )
    return turns.select(
        F.concat_ws("_", "conv_id", "turn").alias("image_id"),
        F.concat(F.lit("images/"), F.col("conv_id").cast("string"), F.lit(".png")).alias("image_path"),
        prediction.alias("prediction"),
        F.col("text").alias("ground_truth"),
    )


INFERENCE = """(SELECT conv_id || '_' || turn AS image_id, 'images/' || conv_id || '.png' AS image_path, conv_id,
  CASE WHEN conv_id % 20 = 0 THEN 'ERROR: file not found' WHEN conv_id % 20 <> 1 THEN 'USER: describe. ASSISTANT: ' || text END AS prediction, text AS ground_truth
FROM conversations WHERE role = 'assistant')"""

ANSWERED = f"""(SELECT *, coalesce({sql_strip("CASE WHEN contains(prediction, 'ASSISTANT:') THEN substr(prediction, strpos(prediction, 'ASSISTANT:') + 10) ELSE prediction END")}, '') AS assistant_text
FROM {INFERENCE})"""


def sql_calibrated(text: str, tokens: str) -> str:
    damage, vague = sql_any(text, reg.DAMAGE_WORDS), sql_any(text, reg.VAGUE_WORDS)
    return f"""CASE WHEN {tokens} < 30 THEN 'Too short / Error output' WHEN {tokens} > 200 THEN 'Too long / Possible repetition'
      WHEN {vague} AND NOT {damage} THEN 'Not recognized from only image' WHEN NOT {damage} THEN 'No damage keywords detected'
      ELSE 'High Quality' END"""


GUARDED = f"""(SELECT *, {sql_calibrated('assistant_text', 'token_count')} AS reason_code
FROM (SELECT *, {sql_tokens('assistant_text')} AS token_count FROM {ANSWERED}))"""


def sql_structure(text: str) -> str:
    return f"""{sql_rules(text, reg.TYPE_RULES, 'unknown')} AS damage_type, {sql_rules(text, reg.SEVERITY_RULES, 'medium')} AS severity_level,
      {sql_rules(text, reg.LOCATION_RULES, 'unknown')} AS location"""


RISK = sql_lookup("damage_type", fv.RISK_OF_TYPE, "'unknown'")


def sql_points(attribute: str, value: str, tables=fv.SCORE_TABLES) -> str:
    return sql_lookup(value, tables[attribute], "0.5::DOUBLE", "DOUBLE")


def sql_raw(damage: str, severity: str, location: str, risk: str, tables=fv.SCORE_TABLES) -> str:
    return (
        f"least(1.0::DOUBLE, {sql_points('damage_type', damage, tables)} * 0.35::DOUBLE + {sql_points('severity', severity, tables)} * 0.40::DOUBLE"
        f" + {sql_points('location', location, tables)} * 0.15::DOUBLE + {sql_points('risk', risk, tables)} * 0.10::DOUBLE)"
    )


def sql_level(raw: str) -> str:
    return f"CAST(CASE WHEN {raw} >= 0.85 THEN 5 WHEN {raw} >= 0.70 THEN 4 WHEN {raw} >= 0.50 THEN 3 WHEN {raw} >= 0.35 THEN 2 ELSE 1 END AS INTEGER)"


LEVEL_TEXT = sql_lookup("priority_level", fv.LEVEL_TEXTS, "'優先度不明'")

SCORED = f"""(SELECT image_id, image_path, assistant_text, token_count, CAST(NULL AS DOUBLE) AS cosine_similarity, quality_verdict, reason_code,
  damage_type, severity_level, location, risk_factor, round_even(raw, 4) AS priority_score, coalesce(priority_level, 0) AS priority_level,
  CASE WHEN quality_verdict = 'PASS' THEN {LEVEL_TEXT} ELSE 'No Score due to Low Quality' END AS priority_description
FROM (SELECT *, {sql_level('raw')} * CASE WHEN raw IS NULL THEN NULL ELSE 1 END AS priority_level
 FROM (SELECT *, CASE WHEN quality_verdict = 'PASS' THEN {sql_raw('damage_type', 'severity_level', 'location', 'risk_factor')} END AS raw
  FROM (SELECT *, CASE WHEN quality_verdict = 'PASS' THEN {RISK} END AS risk_factor
   FROM (SELECT * REPLACE (CASE WHEN quality_verdict = 'PASS' THEN damage_type END AS damage_type,
           CASE WHEN quality_verdict = 'PASS' THEN severity_level END AS severity_level, CASE WHEN quality_verdict = 'PASS' THEN location END AS location)
    FROM (SELECT *, CASE WHEN reason_code = 'High Quality' THEN 'PASS' ELSE 'FAIL' END AS quality_verdict, {sql_structure('assistant_text')} FROM {GUARDED}))))))"""


def scored(spark, d, *columns):
    return plans.grade_by_keywords(inference(spark, d), GUARD, RULES, columns=columns or fv.SCORED_14)


# --- guards -------------------------------------------------------------------

@query("g02_calibrated_guard", f"""
SELECT doc_id, token_count, {sql_calibrated('text', 'token_count')} AS reason_code,
  CASE WHEN {sql_calibrated('text', 'token_count')} = 'High Quality' THEN 'PASS' ELSE 'FAIL' END AS quality_verdict
FROM (SELECT doc_id, text, {sql_tokens('text')} AS token_count FROM documents)""")
def g02(spark, d):
    return guard.calibrated_guard(table(spark, d, "documents"), "text", **GUARD).select("doc_id", "token_count", "reason_code", "quality_verdict")


def sql_classic(text: str, tokens: str) -> str:
    damage, vague = sql_any(text, reg.DAMAGE_WORDS), sql_any(text, reg.VAGUE_WORDS)
    parts = f"list_filter(list_transform(regexp_split_to_array({text}, '[.,\\n]'), lambda s: {sql_strip('s')}), lambda s: length(s) > 5)"
    return f"""CASE WHEN {tokens} < 98 AND NOT {damage} THEN 'Not recognized from only image' WHEN {tokens} < 98 THEN 'Short description'
      WHEN len({parts}) > len(list_distinct({parts})) THEN 'Dirty or Noisy image'
      WHEN NOT {damage} AND {vague} THEN 'Not recognized from only image' END"""


CASCADE = f"""(SELECT *, CASE WHEN no_file THEN 'No such file or directory' ELSE rule END AS failed
FROM (SELECT *, {sql_classic('assistant_text', 'tokens')} AS rule FROM (SELECT *, {sql_tokens('assistant_text')} AS tokens, conv_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es') AS no_file FROM {ANSWERED})))"""


def image_manifest(spark, d):
    """Files that exist: one per document that is not in Spanish."""
    docs = table(spark, d, "documents").where("lang <> 'es'")
    return docs.select(F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))


@query("g03_rule_cascade", f"""
SELECT image_id, CASE WHEN failed IS NULL THEN 'PASS' ELSE 'FAIL' END AS quality_verdict, coalesce(failed, 'High Quality (rule only)') AS reason_code,
  CASE WHEN no_file THEN 0 ELSE tokens END AS token_count, failed IS NOT NULL AS rule_triggered, FALSE AS llm_used FROM {CASCADE}""")
def g03(spark, d):
    guarded = guard.rule_guard(inference(spark, d), "prediction", CLASSIC, image_manifest(spark, d))
    return guarded.select("image_id", "quality_verdict", "reason_code", "token_count", "rule_triggered", "llm_used")


def sql_rule_guard() -> str:
    answer = sql_strip(r"CASE WHEN regexp_matches(text, '(?is)ASSISTANT\s*:\s*.') THEN regexp_extract(text, '(?is)ASSISTANT\s*:\s*(.+)', 1) ELSE text END")
    damage, vague = sql_any("t", reg.DAMAGE_WORDS), sql_any("t", reg.VAGUE_WORDS)
    parts = f"list_filter(list_transform(regexp_split_to_array(t, '[.\\n]'), lambda s: {sql_strip('s')}), lambda s: length(s) > 5)"
    return f"""WITH answered AS MATERIALIZED (SELECT doc_id, {answer} AS t FROM documents), blocks AS MATERIALIZED (SELECT * FROM {sql_blocks("SELECT doc_id, t FROM answered")}),
counted AS (SELECT doc_id, t, {sql_tokens("t")} AS token_count FROM answered), judged AS (
  SELECT doc_id, token_count, CASE WHEN token_count < 98 AND NOT {damage} THEN 'Not recognized from only image' WHEN token_count < 98 THEN 'Short description'
    WHEN anywhere OR len({parts}) > len(list_distinct({parts})) THEN 'Dirty or Noisy image'
    WHEN NOT {damage} AND {vague} THEN 'Not recognized from only image' END AS failed
  FROM counted JOIN blocks USING (doc_id))
SELECT doc_id, CASE WHEN failed IS NULL THEN 'PASS' ELSE 'FAIL' END AS quality_verdict, coalesce(failed, 'High Quality (rule only)') AS reason_code,
  token_count, failed IS NOT NULL AS rule_triggered, FALSE AS llm_used FROM judged"""


@query("g01_rule_guard", sql_rule_guard())
def g01(spark, d):
    rules = guard.GuardRules(damage_words=reg.DAMAGE_WORDS, vague_words=reg.VAGUE_WORDS, clause_delimiters=".\n", across_lines=True)
    guarded = guard.rule_guard(table(spark, d, "documents").withColumnRenamed("text", "prediction"), "prediction", rules)
    return guard.guard_struct(guarded).select("doc_id", "guard.*")


def answers(spark, d):
    """Judge and structurer answers made from the conversation ids."""
    i = F.col("conv_id")
    judge = (
        F.when(i % 5 == 0, "VERDICT: FAIL\nREASON_CODE: Dirty or Noisy image")
        .when(i % 5 == 1, "I think\nverdict : pass\nreason_code : High Quality")
        .when(i % 5 == 2, "no verdict at all")
        .when(i % 5 == 3, "VERDICT: PASS")
    )
    made = F.concat(
        F.lit('Sure: {"damage_type": "'), F.element_at(F.array(*map(F.lit, ("crack", "corrosion", "rust", "section_loss"))), (i % 4 + 1).cast("int")),
        F.lit('", "severity_level": "'), F.element_at(F.array(*map(F.lit, ("high", "low", "severe"))), (i % 3 + 1).cast("int")),
        F.lit('", "location": "deck", "extra": 1}'),
    )
    structured = F.when(i % 7 == 0, "no json").when(i % 7 == 1, '{"damage_type": crack}').otherwise(made)
    return table(spark, d, "conversations").where("role = 'assistant'").select(
        F.concat_ws("_", "conv_id", "turn").alias("image_id"), judge.alias("judge_answer"), structured.alias("structure_answer")
    )


ANSWERS = """(SELECT conv_id || '_' || turn AS id,
  CASE conv_id % 5 WHEN 0 THEN 'VERDICT: FAIL' || chr(10) || 'REASON_CODE: Dirty or Noisy image' WHEN 1 THEN 'I think' || chr(10) || 'verdict : pass' || chr(10) || 'reason_code : High Quality'
    WHEN 2 THEN 'no verdict at all' WHEN 3 THEN 'VERDICT: PASS' END AS judge_answer,
  CASE WHEN conv_id % 7 = 0 THEN 'no json' WHEN conv_id % 7 = 1 THEN '{"damage_type": crack}' ELSE 'Sure: {"damage_type": "'
    || ['crack', 'corrosion', 'rust', 'section_loss'][conv_id % 4 + 1] || '", "severity_level": "' || ['high', 'low', 'severe'][conv_id % 3 + 1]
    || '", "location": "deck", "extra": 1}' END AS structure_answer FROM conversations WHERE role = 'assistant')"""


def sql_field(block: str, field: str, default: str) -> str:
    allowed = ", ".join(f"'{v}'" for v in fv.STRUCTURE_VALUES[field])
    value = f"CASE WHEN json_valid({block}) THEN json_extract_string({block}, '$.{field}') END"
    return f"CASE WHEN {value} IN ({allowed}) THEN {value} ELSE '{default}' END"


JUDGED = f"""(SELECT *, judged AS llm_used,
    CASE WHEN NOT judged THEN CASE WHEN failed IS NULL THEN 'PASS' ELSE 'FAIL' END
         WHEN upper(regexp_extract(judge_answer, '(?i)VERDICT\\s*:\\s*(PASS|FAIL)', 1)) = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS quality_verdict,
    CASE WHEN no_file THEN 0 ELSE tokens END AS token_count,
    regexp_extract(coalesce(structure_answer, ''), '\\{{[^{{}}]+\\}}') AS block
  FROM (SELECT *, failed IS NULL AND judge_answer IS NOT NULL AS judged FROM {CASCADE} JOIN {ANSWERS} a ON image_id = a.id))"""

JUDGED_FULL = f"""(SELECT *, CASE WHEN judged AND quality_verdict = 'PASS' THEN 'High Quality'
    WHEN judged THEN CASE WHEN regexp_extract(judge_answer, '(?i)REASON_CODE\\s*:\\s*(.{{5,80}})', 1) <> ''
      THEN {sql_strip("regexp_extract(judge_answer, '(?i)REASON_CODE" + chr(92) + "s*:" + chr(92) + "s*(.{5,80})', 1)")} ELSE 'Unspecified' END
    ELSE coalesce(failed, 'High Quality (rule only)') END AS reason_code,
    {", ".join(f"CASE WHEN judged AND quality_verdict = 'PASS' THEN {sql_field('block', f, v)} END AS {f}" for f, v in fv.STRUCTURE_DEFAULTS.items())},
    CASE WHEN judged AND quality_verdict = 'PASS' THEN NOT (block <> '' AND json_valid(block)) END AS fallback_used FROM {JUDGED})"""


@query("g04_j04_judge_answers", f"""
SELECT image_id, quality_verdict, reason_code, token_count, llm_used, damage_type, severity_level, location, risk_factor, fallback_used FROM {JUDGED_FULL}""")
def g04(spark, d):
    guarded = guard.rule_guard(inference(spark, d), "prediction", CLASSIC, image_manifest(spark, d))
    judged = guard.apply_answers(guarded, answers(spark, d), "image_id")
    return judged.select("image_id", "quality_verdict", "reason_code", "token_count", "llm_used",
                         "damage_type", "severity_level", "location", "risk_factor", "fallback_used")


# --- structure ----------------------------------------------------------------

@query("c01_keyword_structure", f"""
SELECT doc_id, damage_type, severity_level, location, {RISK} AS risk_factor FROM (SELECT doc_id, {sql_structure('text')} FROM documents)""")
def c01(spark, d):
    return structure.add_keyword_structure(table(spark, d, "documents"), "text", **RULES).select("doc_id", *plans.STRUCTURE_COLUMNS)


def sql_bilingual(text: str) -> str:
    features = ", ".join(
        f"CASE WHEN {' OR '.join(f'contains({text}, {chr(39)}{w[0]}{chr(39)})' for w in words)} THEN '{label}' END" for label, words in reg.FEATURE_RULES
    )
    return f"""{sql_rules(text, reg.BILINGUAL_TYPES, 'unknown', f'lower({text})')} AS damage_type,
  {sql_rules(text, reg.BILINGUAL_SEVERITIES, 'low')} AS severity, {sql_rules(text, reg.BILINGUAL_LOCATIONS, 'unknown', f'lower({text})')} AS location,
  {sql_rules(text, reg.BILINGUAL_RISKS, 'aesthetic')} AS risk, list_filter([{features}], lambda x: x IS NOT NULL) AS key_features, 0.7::DOUBLE AS confidence"""


@query("c02_bilingual_structure", f"SELECT doc_id, array_to_string(key_features, ',') AS key_features, damage_type, severity, location, risk, confidence FROM (SELECT doc_id, {sql_bilingual('text')} FROM documents)")
def c02(spark, d):
    made = structure.structure_batch(table(spark, d, "documents"), "text", **BILINGUAL).select("doc_id", "structure.*")
    return made.withColumn("key_features", F.array_join("key_features", ",")).drop("description_ja")


ANSWER_JSON = """CASE WHEN doc_id % 3 = 0 THEN 'Here: {"damage_type": "crack", "severity": "low", "location": "' || lang || '", "risk": "durability"} done'
  WHEN doc_id % 3 = 1 THEN '{"damage_type": "crack", "severity": "low"}' END"""


def json_answers(spark, d):
    i = F.col("doc_id")
    complete = F.concat(F.lit('Here: {"damage_type": "crack", "severity": "low", "location": "'), F.col("lang"), F.lit('", "risk": "durability"} done'))
    answer = F.when(i % 3 == 0, complete).when(i % 3 == 1, '{"damage_type": "crack", "severity": "low"}')
    return table(spark, d, "documents").withColumn("answer", answer)


@query("c03_c04_structure_with_fallback", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'crack' ELSE damage_type END AS damage_type, CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE severity END AS severity,
  CASE WHEN doc_id % 3 = 0 THEN lang ELSE location END AS location, CASE WHEN doc_id % 3 = 0 THEN 'durability' ELSE risk END AS risk,
  CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE confidence END AS confidence
FROM (SELECT doc_id, lang, {sql_bilingual('text')} FROM documents WHERE doc_id % 11 <> 0)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 11 = 0""")
def c03(spark, d):
    df = json_answers(spark, d).withColumn("text", F.when(F.col("doc_id") % 11 != 0, F.col("text")))
    made = structure.structure_batch(df, "text", "answer", **BILINGUAL)
    return made.select("doc_id", *[f"structure.{c}" for c in ("damage_type", "severity", "location", "risk", "confidence")])


# --- score --------------------------------------------------------------------

ORDER_TABLES = {
    "damage_type": {"1-URGENT": 1.0, "2-HIGH": 0.95, "3-MEDIUM": 0.85, "5-LOW": 0.6},
    "severity": {"R": 1.0, "A": 0.6, "N": 0.3},
    "location": {"F": 0.95, "O": 0.7},
    "risk": {"F": 1.0, "O": 0.75, "P": 0.3},
}
ORDER_COLUMNS = {"damage_type": "o_orderpriority", "severity": "l_returnflag", "location": "l_linestatus", "risk": "o_orderstatus"}
ORDER_RULES = score.ScoreRules(tables=ORDER_TABLES)
BONUSES = (
    {"condition": {"damage_type": "1-URGENT", "severity": "R"}, "bonus": 0.05},
    {"condition": {"location": "F"}, "bonus": 0.02},
    {"condition": {"damage_type": "5-LOW", "severity": "N", "location": "O", "risk": "O"}, "bonus": 0.11},
    {"condition": {}, "bonus": 0.003},
)


def graded_lines(spark, d):
    """Order lines with the four attributes of the score."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


LINES = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
ORDER_RAW = sql_raw("o_orderpriority", "l_returnflag", "l_linestatus", "o_orderstatus", ORDER_TABLES)


@query("r01_r03_r04_r05_score_rows", f"""
SELECT l_orderkey, l_linenumber, round(raw, 6) AS raw_score, priority_level, {LEVEL_TEXT} AS priority_description, damage_type_score, severity_score, location_score, risk_score
FROM (SELECT *, {sql_level('raw')} AS priority_level FROM (SELECT *, {ORDER_RAW} AS raw,
  {sql_points('damage_type', 'o_orderpriority', ORDER_TABLES)} AS damage_type_score, {sql_points('severity', 'l_returnflag', ORDER_TABLES)} AS severity_score,
  {sql_points('location', 'l_linestatus', ORDER_TABLES)} AS location_score, {sql_points('risk', 'o_orderstatus', ORDER_TABLES)} AS risk_score FROM {LINES}))""")
def r01(spark, d):
    out = score.score_rows(graded_lines(spark, d), ORDER_COLUMNS, ORDER_RULES)
    return rounded(out, "raw_score").select(
        "l_orderkey", "l_linenumber", "raw_score", "priority_level", "priority_description",
        *[f"{a}_score" for a in score.ATTRIBUTES],
    )


BONUS_SQL = """(CASE WHEN o_orderpriority = '1-URGENT' AND l_returnflag = 'R' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN l_linestatus = 'F' THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN o_orderpriority = '5-LOW' AND l_returnflag = 'N' AND l_linestatus = 'O' AND o_orderstatus = 'O' THEN 0.11::DOUBLE ELSE 0.0::DOUBLE END + 0.003::DOUBLE)"""


@query("r02_bonus_and_cap", f"""
SELECT l_orderkey, l_linenumber, round({BONUS_SQL}, 6) AS combination_bonus, round(least(1.0::DOUBLE, {ORDER_RAW} + {BONUS_SQL}), 6) AS raw_score FROM {LINES}""")
def r02(spark, d):
    rules = score.ScoreRules(tables=ORDER_TABLES, bonuses=BONUSES)
    values = {a: F.col(c) for a, c in ORDER_COLUMNS.items()}
    scored_lines = graded_lines(spark, d).withColumn("s", score.score_struct(values, rules))
    return rounded(scored_lines.select("l_orderkey", "l_linenumber", "s.combination_bonus", "s.raw_score"), "combination_bonus", "raw_score")


@query("j06_bonus_by_table", f"SELECT l_orderkey, l_linenumber, round({BONUS_SQL}, 6) AS bonus FROM {LINES}")
def j06(spark, d):
    """Rules as a table: the conditions of BONUSES, NULL where they do not constrain."""
    rules = spark.createDataFrame(
        [tuple(b["condition"].get(a) for a in score.ATTRIBUTES) + (b["bonus"],) for b in BONUSES],
        ", ".join(f"{ORDER_COLUMNS[a]} string" for a in score.ATTRIBUTES) + ", bonus double",
    )
    lines = score.bonus_by_table(graded_lines(spark, d), rules, attributes=[ORDER_COLUMNS[a] for a in score.ATTRIBUTES])
    return rounded(lines.select("l_orderkey", "l_linenumber", "bonus"), "bonus")


@query("r06_r07_scored_14_columns", f"SELECT * FROM {SCORED}")
def r07(spark, d):
    return scored(spark, d)


@query("r06_r07_scored_22_columns", f"""
SELECT image_id, image_path, prediction, ground_truth, CAST(NULL AS DOUBLE) AS cosine_similarity, assistant_text, token_count, quality_verdict, reason_code,
  failed IS NOT NULL AS rule_triggered, llm_used, CAST(NULL AS DOUBLE) AS guard_elapsed_sec, damage_type, severity_level, location, risk_factor,
  round_even(raw, 4) AS priority_score, coalesce(priority_level, 0) AS priority_level,
  CASE WHEN raw IS NOT NULL THEN {LEVEL_TEXT} WHEN quality_verdict = 'PASS' THEN 'PASS (rule-only, no LLM structuring)' ELSE 'No Score due to Low Quality Image' END AS priority_description,
  CASE WHEN raw IS NOT NULL THEN {sql_points('damage_type', 'damage_type')} END AS raw_damage_score,
  CASE WHEN raw IS NOT NULL THEN {sql_points('severity', 'severity_level')} END AS raw_severity_score,
  CASE WHEN raw IS NOT NULL THEN {sql_points('location', 'location')} END AS raw_location_score, fallback_used
FROM (SELECT *, CASE WHEN raw IS NOT NULL THEN {sql_level('raw')} END AS priority_level
  FROM (SELECT *, CASE WHEN damage_type IS NOT NULL THEN {sql_raw('damage_type', 'severity_level', 'location', 'risk_factor')} END AS raw FROM {JUDGED_FULL}))""")
def r07_answers(spark, d):
    return plans.grade_with_answers(inference(spark, d), answers(spark, d), image_manifest(spark, d), CLASSIC)


@query("p05_flat_report", f"""
SELECT image_name, damage_type, severity, location, risk, round(raw, 6) AS priority_score, priority_level, CASE WHEN status = 'success' THEN {LEVEL_TEXT} END AS priority_description,
  CASE WHEN status = 'success' THEN CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END END AS description, CAST(NULL AS DOUBLE) AS processing_time, status
FROM (SELECT *, CASE WHEN raw IS NOT NULL THEN {sql_level('raw')} END AS priority_level FROM (SELECT *, {sql_raw('damage_type', 'severity', 'location', 'risk')} AS raw, 'success' AS status
  FROM (SELECT doc_id || '.png' AS image_name, text, {sql_bilingual('text')} FROM documents WHERE doc_id % 10 <> 0))
UNION ALL BY NAME SELECT doc_id || '.png' AS image_name, 'error' AS status FROM documents WHERE doc_id % 10 = 0)""")
def p05(spark, d):
    return rounded(plans.flat_report(_nested(spark, d)), "priority_score")


def _nested(spark, d):
    described = table(spark, d, "documents").select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"),
        F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("description"),
    )
    return plans.nested_results(described, "path", "description", BILINGUAL)


# --- counts of graded rows ----------------------------------------------------

@query("a01_reason_counts", f"""
SELECT reason_code, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM {SCORED} GROUP BY reason_code""")
def a01(spark, d):
    counts = stats.count_by(scored(spark, d, "reason_code"), "reason_code").orderBy(F.desc("n"), "reason_code")
    return rounded(counts, "pct")


@query("a02_f10_level_counts", f"""
SELECT priority_level, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM {SCORED}
WHERE quality_verdict = 'PASS' GROUP BY priority_level""")
def a02(spark, d):
    passed = scored(spark, d).where(F.col("quality_verdict") == "PASS")
    return rounded(stats.count_by(passed, "priority_level").orderBy("priority_level"), "pct")


@query("a03_verdict_rates", f"""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (quality_verdict = 'PASS') AS BIGINT) AS n_pass, CAST(count(*) FILTER (quality_verdict = 'FAIL') AS BIGINT) AS n_fail,
  round(count(*) FILTER (quality_verdict = 'PASS') * 100.0::DOUBLE / count(*), 6) AS pass_pct, round(count(*) FILTER (quality_verdict = 'FAIL') * 100.0::DOUBLE / count(*), 6) AS fail_pct FROM {SCORED}""")
def a03(spark, d):
    return rounded(stats.verdict_rates(scored(spark, d, "quality_verdict")), "pass_pct", "fail_pct")


@query("a04_mean_score", f"SELECT round(avg(priority_score), 6) AS mean_score, round(avg(token_count) FILTER (quality_verdict = 'PASS'), 6) AS mean_tokens FROM {SCORED}")
def a04(spark, d):
    passed = F.col("quality_verdict") == "PASS"
    means = scored(spark, d).agg(stats.mean_where("priority_score").alias("mean_score"),
                                 stats.mean_where(F.col("token_count").cast("double"), passed).alias("mean_tokens"))
    return rounded(means, "mean_score", "mean_tokens")


@query("a15_verdict_medians", f"""
SELECT quality_verdict, CAST(count(token_count) AS BIGINT) AS n_token_count, CAST(count(assistant_length) AS BIGINT) AS n_assistant_length,
  round(median(token_count), 6) AS median_token_count, round(median(assistant_length), 6) AS median_assistant_length
FROM (SELECT *, length(assistant_text) AS assistant_length FROM {SCORED}) GROUP BY quality_verdict""")
def a15(spark, d):
    df = scored(spark, d).withColumn("assistant_length", F.length("assistant_text"))
    medians = stats.verdict_medians(df, ["token_count", "assistant_length"])
    return rounded(medians, "median_token_count", "median_assistant_length")


@query("e08_run_summary", f"""
WITH r AS (SELECT status, {sql_level('raw')} AS lv FROM (SELECT 'success' AS status, {sql_raw('damage_type', 'severity', 'location', 'risk')} AS raw
    FROM (SELECT {sql_bilingual('text')} FROM documents WHERE doc_id % 10 <> 0))
  UNION ALL SELECT 'error', NULL FROM documents WHERE doc_id % 10 = 0)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS success, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error,
  CAST(NULL AS DOUBLE) AS mean_seconds, {", ".join(f"CAST(count(*) FILTER (lv = {k}) AS BIGINT) AS level_{k}" for k in (5, 4, 3, 2, 1))} FROM r""")
def e08(spark, d):
    return stats.run_summary(plans.flat_report(_nested(spark, d)))


# --- keyword frequency --------------------------------------------------------

def sql_labels(words: dict, names: str) -> str:
    rows = ", ".join(f"('{w}', '{label}')" for w, label in words.items())
    return f"(VALUES {rows}) AS {names}(word, label)"


@query("j08_matching_words", f"""
SELECT doc_id, label FROM documents JOIN {sql_labels(reg.MEMBERS, 'm')} ON contains(text, word)""")
def j08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.matching_words("text", reg.MEMBERS)).alias("label"))


@query("a10_keyword_frequency", f"""
SELECT label, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS pct
FROM documents JOIN {sql_labels(reg.MEMBERS, 'm')} ON contains(text, word) GROUP BY label""")
def a10(spark, d):
    return rounded(keywords.frequency(table(spark, d, "documents"), "text", reg.MEMBERS), "pct")


@query("l02_l03_top_labels", f"""
SELECT label, CAST(count(*) AS BIGINT) AS n FROM documents JOIN {sql_labels(reg.MEMBERS, 'm')} ON contains(text, word)
GROUP BY label ORDER BY n DESC, label LIMIT 5""")
def l02(spark, d):
    counts = keywords.frequency(table(spark, d, "documents"), "text", reg.MEMBERS)
    return counts.orderBy(F.desc("n"), "label").limit(5).select("label", "n")


TOPS = f"""
  hits_m AS (SELECT doc_id, lang, label FROM documents JOIN {sql_labels(reg.MEMBERS, 'm')} ON contains(text, word)),
  hits_d AS (SELECT doc_id, lang, label FROM documents JOIN {sql_labels(reg.DAMAGES, 'd')} ON contains(text, word))"""


@query("a11_cooccurrence", f"""
WITH {TOPS},
top_m AS (SELECT label FROM hits_m GROUP BY label ORDER BY count(*) DESC, label LIMIT 8),
top_d AS (SELECT label FROM hits_d GROUP BY label ORDER BY count(*) DESC, label LIMIT 8)
SELECT m.label AS member, d.label AS damage, CAST((SELECT count(*) FROM hits_m hm JOIN hits_d hd USING (doc_id) WHERE hm.label = m.label AND hd.label = d.label) AS BIGINT) AS n
FROM top_m m, top_d d""")
def a11(spark, d):
    return keywords.cooccurrence(table(spark, d, "documents"), "text", reg.MEMBERS, reg.DAMAGES)


@query("a11_cooccurrence_matrix", f"""
WITH {TOPS}, top_m AS (SELECT label FROM hits_m GROUP BY label ORDER BY count(*) DESC, label LIMIT 8)
SELECT m.label AS member, {", ".join(f'CAST((SELECT count(*) FROM hits_m hm JOIN hits_d hd USING (doc_id) WHERE hm.label = m.label AND hd.label = {chr(39)}{x}{chr(39)}) AS BIGINT) AS "{x}"' for x in ('D-thble', 'D-anea', 'D-keit'))} FROM top_m m""")
def a11_matrix(spark, d):
    long = keywords.cooccurrence(table(spark, d, "documents"), "text", reg.MEMBERS, reg.DAMAGES)
    return keywords.as_matrix(long, ["D-thble", "D-anea", "D-keit"])


@query("e07_corpus_frequency", f"""
WITH {TOPS}, sizes AS (SELECT lang, count(*) AS whole FROM documents GROUP BY lang)
SELECT lang AS corpus, label, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / any_value(whole), 6) AS pct FROM hits_m JOIN sizes USING (lang) GROUP BY lang, label""")
def e07(spark, d):
    df = table(spark, d, "documents").withColumnRenamed("lang", "corpus")
    return rounded(keywords.frequency(df, "text", reg.MEMBERS, ["corpus"]), "pct")


@query("e07_corpus_cooccurrence", f"""
WITH {TOPS},
top_m AS (SELECT lang, label FROM hits_m GROUP BY lang, label QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, label) <= 8),
top_d AS (SELECT lang, label FROM hits_d GROUP BY lang, label QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, label) <= 8),
both_hit AS (SELECT hm.lang, hm.label AS member, hd.label AS damage, count(*) AS n FROM hits_m hm JOIN hits_d hd USING (doc_id) GROUP BY ALL)
SELECT m.lang AS corpus, m.label AS member, d.label AS damage, CAST(coalesce(n, 0) AS BIGINT) AS n FROM top_m m JOIN top_d d ON m.lang = d.lang
LEFT JOIN both_hit b ON b.lang = m.lang AND b.member = m.label AND b.damage = d.label""")
def e07_cooccurrence(spark, d):
    df = table(spark, d, "documents").withColumnRenamed("lang", "corpus")
    return keywords.cooccurrence(df, "text", reg.MEMBERS, reg.DAMAGES, by=["corpus"])


@query("a17_level_distribution", f"""
WITH graded AS (SELECT lang, {sql_level('raw')} AS lv FROM (SELECT lang, {sql_raw('damage_type', 'severity_level', 'location', 'risk_factor')} AS raw
  FROM (SELECT *, {RISK} AS risk_factor FROM (SELECT lang, {sql_structure('text')} FROM documents))))
SELECT lang AS corpus, CAST(l AS INTEGER) AS level, CAST(count(*) FILTER (lv = l) AS BIGINT) AS n, round(count(*) FILTER (lv = l) * 100.0::DOUBLE / count(*), 6) AS pct
FROM graded, generate_series(1, 5) AS g(l) GROUP BY lang, l""")
def a17(spark, d):
    df = structure.add_keyword_structure(table(spark, d, "documents"), "text", **RULES).withColumnRenamed("lang", "corpus")
    names = dict(zip(score.ATTRIBUTES, plans.STRUCTURE_COLUMNS))
    return rounded(stats.level_distribution(score.score_rows(df, names), by=["corpus"]), "pct")


@query("f14_file_audit_of_inference", """
SELECT CAST(count(*) AS BIGINT) AS missing, min('images/' || conv_id || '.png') AS first_missing FROM conversations WHERE role = 'assistant' AND conv_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'es')""")
def f14(spark, d):
    return curate.missing_file_audit(inference(spark, d), image_manifest(spark, d))
