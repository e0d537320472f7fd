"""Parsing of answers (X12 to X14) made from documents, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.catalog.registry import query, sql_strip, table
from gradewright.functions import answers as an


@query("x12_tagged_verdict", rf"""
SELECT o_orderkey, CASE WHEN upper(v) = 'PASS' THEN 'PASS' ELSE 'FAIL' END AS verdict,
  CASE WHEN r <> '' THEN {sql_strip('r')} WHEN upper(v) = 'PASS' THEN 'High Quality' ELSE 'Unspecified' END AS reason
FROM (SELECT o_orderkey, regexp_extract(a, '(?i)VERDICT\s*:\s*(PASS|FAIL)', 1) AS v, regexp_extract(a, '(?i)REASON_CODE\s*:\s*(.{{5,80}})', 1) AS r
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'verdict: Fail' || chr(10) WHEN 'O' THEN 'So: VERDICT :  PASS' || chr(10) ELSE 'Maybe.' || chr(10) END ||
  CASE WHEN o_orderpriority = '5-LOW' THEN 'REASON_CODE: low' WHEN o_orderpriority = '2-HIGH' THEN '' ELSE 'reason_code : ' || o_orderpriority || ' ' END AS a FROM orders))""")
def x12(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "F", "verdict: Fail\n").when(F.col("o_orderstatus") == "O", "So: VERDICT :  PASS\n").otherwise("Maybe.\n")
    reason = (
        F.when(F.col("o_orderpriority") == "5-LOW", "REASON_CODE: low")
        .when(F.col("o_orderpriority") == "2-HIGH", "")
        .otherwise(F.concat(F.lit("reason_code : "), "o_orderpriority", F.lit(" ")))
    )
    answer = table(spark, d, "orders").select("o_orderkey", F.concat(verdict, reason).alias("a"))
    return answer.select("o_orderkey", an.tagged_verdict("a").alias("verdict"), an.tagged_reason("a").alias("reason"))


def _field(field: str) -> str:
    allowed = ", ".join(f"'{v}'" for v in fv.STRUCTURE_VALUES[field])
    value = f"CASE WHEN json_valid(b) THEN json_extract_string(b, '$.{field}') END"
    return f"CASE WHEN {value} IN ({allowed}) THEN {value} ELSE '{fv.STRUCTURE_DEFAULTS[field]}' END AS {field}"


@query("x13_flat_structure", f"""
SELECT o_orderkey, {", ".join(_field(f) for f in fv.STRUCTURE_DEFAULTS)}
FROM (SELECT o_orderkey, regexp_extract(a, '\\{{[^{{}}]+\\}}') AS b FROM (SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'none'
  WHEN o_custkey % 6 = 1 THEN '{{"damage_type": "crack", broken}}'
  ELSE 'x {{"damage_type": "' || CASE o_orderpriority WHEN '1-URGENT' THEN 'rebar_exposure' WHEN '2-HIGH' THEN 'corrosion' WHEN '3-MEDIUM' THEN 'rust' ELSE 'crack' END
    || '", "severity_level": "' || CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'HIGH' END || '", "risk_factor": "structural", "other": ' || o_custkey || '}} {{}}' END AS a FROM orders))""")
def x13(spark, d):
    damage = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "rebar_exposure").when(F.col("o_orderpriority") == "2-HIGH", "corrosion")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "rust").otherwise("crack")
    )
    severity = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "low").otherwise("HIGH")
    made = F.concat(
        F.lit('x {"damage_type": "'), damage, F.lit('", "severity_level": "'), severity,
        F.lit('", "risk_factor": "structural", "other": '), F.col("o_custkey").cast("string"), F.lit("} {}"),
    )
    kind = F.col("o_custkey") % 6
    answer = F.when(kind == 0, "none").when(kind == 1, '{"damage_type": "crack", broken}').otherwise(made)
    return table(spark, d, "orders").select("o_orderkey", an.flat_structure(answer).alias("s")).select("o_orderkey", "s.*")


def _rendered(spark, d):
    """Answers around the JSON of an event: bare, fenced, nested, incomplete, none."""
    props = F.concat(
        F.lit('{"damage_type": "'), F.col("event_type"), F.lit('", "severity": "low", "location": "deck", "risk": "'), F.col("user_id").cast("string"),
        F.lit('", "detail": '), F.col("props"), F.lit("}"),
    )
    kind = F.col("event_id") % 6
    answer = (
        F.when(kind == 0, props)
        .when(kind == 1, F.concat(F.lit("Result {not json} ```json\n"), props, F.lit("\n``` end")))
        .when(kind == 2, F.concat(F.lit("```\n"), props, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit('{"a": 1} and '), props, F.lit(' and {"damage_type": "later"}')))
        .when(kind == 4, F.concat(F.lit('{"damage_type": "only", "p": '), F.col("props"), F.lit("}")))
        .otherwise(F.lit("nothing"))
    )
    return table(spark, d, "events").select("event_id", answer.alias("answer"))


@query("x14_json_structure", """
SELECT event_id, CASE WHEN event_id % 6 < 4 THEN event_type END AS damage_type, CASE WHEN event_id % 6 < 4 THEN 'low' END AS severity,
  CASE WHEN event_id % 6 < 4 THEN 'deck' END AS location, CASE WHEN event_id % 6 < 4 THEN CAST(user_id AS VARCHAR) END AS risk,
  CASE WHEN event_id % 6 < 4 THEN '' END AS description_ja, CASE WHEN event_id % 6 < 4 THEN 0 END AS features FROM events""")
def x14(spark, d):
    made = _rendered(spark, d).select("event_id", an.json_structure("answer").alias("s"))
    return made.select(
        "event_id", "s.damage_type", "s.severity", "s.location", "s.risk", "s.description_ja",
        F.when(F.col("s").isNotNull(), F.size("s.key_features")).alias("features"),
    )
