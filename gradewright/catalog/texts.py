"""Scalar text functions (X) and projections (P) on the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewright.catalog.registry import DAMAGE_WORDS, query, sql_any, sql_blocks, sql_strip, sql_tokens, table
from gradewright.session import settle
from gradewright.functions import repeats
from gradewright.functions import text as tx
from gradewright.functions.grades import clip_unit, ordinal, round_half_even, tier
from gradewright.operators import curate

# Whitespace that Python strips but SQL's trim() leaves.
PADDED = "chr(12288) || chr(8232) || text || chr(160) || chr(10)"


def padded(text="text"):
    return F.concat(F.lit("　 "), F.col(text), F.lit("\xa0\n"))


def dialogue(text="text", marker="ASSISTANT:", key="doc_id"):
    """Generated text with a marker in two of three rows."""
    kind = F.col(key) % 3
    return (
        F.when(kind == 0, F.concat(F.lit("USER: describe this. " + marker + " "), F.col(text)))
        .when(kind == 1, F.concat(F.lit("user: describe this. Assistant :\n"), F.col(text), F.lit(" " + marker + " end")))
        .otherwise(F.concat(F.lit("  "), F.col(text)))
    )


DIALOGUE = """CASE doc_id % 3
  WHEN 0 THEN 'USER: describe this. ASSISTANT: ' || text
  WHEN 1 THEN 'user: describe this. Assistant :' || chr(10) || text || ' ASSISTANT: end'
  ELSE '  ' || text END"""


@query("x01_token_count", f"SELECT doc_id, {sql_tokens('text')} AS token_count FROM documents")
def x01(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_count("text").alias("token_count"))


@query("x02_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents")
def x02(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("text_length"))


@query("x03_strip", f"SELECT doc_id, {sql_strip(PADDED)} AS stripped FROM documents")
def x03(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.strip(padded()).alias("stripped"))


@query("x04_answer_after_marker", f"""
SELECT doc_id, {sql_strip("CASE WHEN contains(t, 'ASSISTANT:') THEN substr(t, strpos(t, 'ASSISTANT:') + 10) ELSE t END")} AS answer
FROM (SELECT doc_id, {DIALOGUE} AS t FROM documents)""")
def x04(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.answer_after_marker(dialogue()).alias("answer"))


@query("x05_answer_after_pattern", rf"""
SELECT doc_id, {sql_strip(r"CASE WHEN regexp_matches(t, '(?is)ASSISTANT\s*:\s*.') THEN regexp_extract(t, '(?is)ASSISTANT\s*:\s*(.+)', 1) ELSE t END")} AS answer
FROM (SELECT doc_id, {DIALOGUE} AS t FROM documents)""")
def x05(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.answer_after_pattern(dialogue()).alias("answer"))


@query("x05_answer_or_raw", f"""
SELECT doc_id, CASE WHEN contains(t, 'ASSISTANT:') THEN {sql_strip("substr(t, strpos(t, 'ASSISTANT:') + 10)")} ELSE t END AS answer
FROM (SELECT doc_id, {DIALOGUE} AS t FROM documents)""")
def x05_raw(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.answer_or_raw(dialogue()).alias("answer"))


@query("x06_answer_after_last", f"""
SELECT conv_id, turn, {sql_strip("string_split('user ' || text || ' assistant ' || reverse(text) || ' ', 'assistant')[-1]")} AS answer
FROM conversations""")
def x06(spark, d):
    told = F.concat(F.lit("user "), F.col("text"), F.lit(" assistant "), F.reverse("text"), F.lit(" "))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.answer_after_last(told).alias("answer"))


@query("x07_contains_any", f"SELECT doc_id, {sql_any('text', DAMAGE_WORDS)} AS has_damage FROM documents")
def x07(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.contains_any("text", DAMAGE_WORDS).alias("has_damage"))


@query("x08_split_keeping_end", """
WITH parts AS (SELECT doc_id, string_split(text, '.') AS p FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS position, p[i] || CASE WHEN i < len(p) THEN '.' ELSE '' END AS sentence
FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM parts)""")
def x08(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(tx.split_keeping_end("text", ".")).alias("i", "sentence"))
    return parts.select("doc_id", (F.col("i") + 1).alias("position"), "sentence")


@query("x10_duplicate_clause", f"""
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,\\n]'), lambda s: {sql_strip('s')}), lambda s: length(s) > 5) AS p
  FROM documents)
SELECT doc_id, len(p) > len(list_distinct(p)) AS has_duplicate FROM parts""")
def x10(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.has_duplicate_clause("text", ".,\n").alias("has_duplicate"))


# The tests also compare with a regex and a plain search.
@query("x11_repeated_block", f"SELECT doc_id, anywhere AS repeats, in_line AS repeats_in_line FROM {sql_blocks('SELECT doc_id, text AS t FROM documents')}")
def x11(spark, d):
    both = settle(table(spark, d, "documents"), both=repeats.repeated_blocks("text"))
    return both.select("doc_id", F.col("both.anywhere").alias("repeats"), F.col("both.in_line").alias("repeats_in_line"))


@query("x15_as_json", """
SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","quality":' || coalesce(CAST(quality AS VARCHAR), 'null') || '}' AS record
FROM documents LEFT JOIN labels USING (doc_id)""")
def x15(spark, d):
    from gradewright.functions.answers import as_json

    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.select("doc_id", as_json("doc_id", "lang", "quality").alias("record"))


@query("x18_tier", """
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN NULL WHEN value >= 85 THEN 'excellent' WHEN value >= 75 THEN 'good'
  WHEN value >= 65 THEN 'acceptable' WHEN value >= 50 THEN 'poor' ELSE 'very_poor' END AS tier
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value FROM events)""")
def x18(spark, d):
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    bounds = (("excellent", 85.0), ("good", 75.0), ("acceptable", 65.0), ("poor", 50.0))
    return table(spark, d, "events").select("event_id", tier(value, bounds).alias("tier"))


@query("x19_round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * l_discount / 7, 4) AS rounded FROM lineitem""")
def x19(spark, d):
    value = F.col("l_extendedprice") * F.col("l_discount") / 7
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round_half_even(value, 4).alias("rounded"))


@query("x20_clip_unit", """
SELECT event_id, round(least(greatest(value / 20 - 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS clipped FROM events""")
def x20(spark, d):
    return table(spark, d, "events").select("event_id", F.round(clip_unit(F.col("value") / 20 - 0.5), 6).alias("clipped"))


@query("x21_blank_as", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'empty' ELSE text END AS embedded FROM documents""")
def x21(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(" 　\n")).when(F.col("doc_id") % 5 != 1, F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.blank_as(text).alias("embedded"))


@query("x22_fold_case", "SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'der ') AS found FROM documents")
def x22(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.contains_any("text", ("the ", "der "), fold_case=True).alias("found"))


@query("x23_ordinal", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 ELSE 0 END AS DOUBLE) AS code
FROM orders""")
def x23(spark, d):
    codes = {"priority": {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "5-LOW": 1}}
    return table(spark, d, "orders").select("o_orderkey", ordinal("o_orderpriority", "priority", codes).alias("code"))


@query("x24_strata_key", """
SELECT lang || '_' || coalesce(CAST(quality AS VARCHAR), 'unknown') AS strata, CAST(count(*) AS BIGINT) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def x24(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("unknown"))
    return df.groupBy(tx.strata_key("lang", quality).alias("strata")).agg(F.count(F.lit(1)).alias("n"))


@query("p01_path_parts", """
SELECT page_id, u AS path, list_extract(string_split(rtrim(u, '/'), '/'), -1) AS name,
  regexp_replace(list_extract(string_split(rtrim(u, '/'), '/'), -1), '^(.+)\\.[^.]+$', '\\1') AS stem,
  CASE WHEN u LIKE '/%' THEN u ELSE '/data/' || u END AS joined
FROM (SELECT page_id, regexp_replace(url, '^https?:/', CASE WHEN page_id % 2 = 0 THEN '' ELSE 'site' END) AS u FROM pages)""")
def p01(spark, d):
    pages = table(spark, d, "pages")
    prefix = F.when(F.col("page_id") % 2 == 0, "").otherwise("site")
    path = F.regexp_replace("url", F.lit("^https?:/"), prefix)
    return pages.select("page_id", path.alias("path")).select(
        "page_id", "path", tx.file_name("path").alias("name"), tx.file_stem("path").alias("stem"),
        tx.join_path("/data/", "path").alias("joined"),
    )


@query("p02_rename_and_p03_fill", """
SELECT d.doc_id, d.lang AS component_type, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS damage_type, 'unknown' AS location
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p03(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    df = df.withColumnsRenamed({"lang": "component_type", "quality": "damage_type", "absent": "ignored"})
    filled = curate.fill_attributes(df, {"component_type": "unknown", "damage_type": "unknown", "location": "unknown"})
    return filled.select("doc_id", "component_type", "damage_type", "location")


@query("p04_shorten", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short FROM documents")
def p04(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.shorten("text").alias("short"))


@query("p06_or_default", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' WHEN doc_id % 3 = 1 THEN 'unknown' ELSE lang END AS damage_type FROM documents""")
def p06(spark, d):
    value = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", tx.or_default(value, "unknown").alias("damage_type"))


@query("p07_prompts", """
SELECT doc_id,
  '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'You judge texts.'
  || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || 'Text: ' || substr(text, 1, 800) || ' Answer in two lines.'
  || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS judge,
  'USER: <image>' || chr(10) || 'Describe the picture.' || chr(10) || 'ASSISTANT: ' || text AS training
FROM documents""")
def p07(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        tx.judge_prompt("text", "You judge texts.", "Text: {text} Answer in two lines.").alias("judge"),
        tx.training_text("text", "Describe the picture.").alias("training"),
    )


@query("p08_positional_ids", """
SELECT doc_id, CASE WHEN n < 10000 THEN 'image_' || lpad(CAST(n AS VARCHAR), 4, '0') ELSE 'image_' || n END AS image_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)""")
def p08(spark, d):
    return curate.positional_ids(table(spark, d, "documents").select("doc_id"), "doc_id")
