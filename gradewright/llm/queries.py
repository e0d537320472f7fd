"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.llm import (
    codes, grouping, infill, licenses, nearest, packing, pages, pieces, quality, sharding, simhash, surrogates, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _license_sql() -> str:
    """Every key phrase at every place, without an index."""
    found = " UNION ALL ".join(
        f"SELECT doc_id, p, '{t.label}' AS label, {str(t.base).lower()} AS base, "
        f"list_sum(list_transform(range({len(t.words)}), lambda i: CASE WHEN w[p + i + 1] = ({_sql_list(t.words)})[i + 1] THEN 1 ELSE 0 END)) / {float(len(t.words))} AS share "
        f"FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM tok) WHERE w[p + 1] = '{t.key[0]}' AND w[p + 1 : p + {len(t.key)}] = {_sql_list(t.key)}"
        for t in licenses.TEMPLATES
    )
    return rf"""
WITH tok AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), hits AS ({found}), per AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(p) FILTER (WHERE base) AS first_word,
    max(p) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(share), 6) AS score
  FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM tok LEFT JOIN per USING (doc_id)"""


@query("op2_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text", "matches")


def quality_sql(documents: str = "documents", columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    def bound(r) -> str:
        value = f"(CASE WHEN {r.per} > 0 THEN CAST({r.measure} AS DOUBLE) / {r.per} ELSE 0.0 END)" if r.per else f"CAST({r.measure} AS DOUBLE)"
        sides = [f"{value} < {r.low}" if r.low is not None else "", f"{value} > {r.high}" if r.high is not None else ""]
        return f"(({' OR '.join(s for s in sides if s)}) AND n_words >= {r.at_least_words})"

    return rf"""
WITH q_doc AS (
  SELECT *, coalesce(text, '') AS q_body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS q_words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS q_lines
  FROM {documents}
), q_win AS (
  SELECT doc_id, i, array_to_string(q_words[i + 1 : i + 8], ' ') AS win
  FROM (SELECT doc_id, q_words, unnest(range(len(q_words) - 7)) AS i FROM q_doc WHERE len(q_words) >= 8)
), q_rep AS (
  SELECT doc_id, i FROM q_win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), q_cov AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM q_rep, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), q_measured AS (
  SELECT q_doc.*, CAST(len(q_words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(q_words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(q_body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(q_body, '[^!?]', '', 'g')) AS BIGINT) AS n_marks,
    CAST(len(list_filter(q_words, lambda w: list_contains({_sql_list(quality.STOP_WORDS)}, lower(w)))) AS BIGINT) AS n_stop_words,
    CAST(len(q_lines) AS BIGINT) AS n_lines, CAST(len(q_lines) - len(list_distinct(q_lines)) AS BIGINT) AS n_dup_lines,
    coalesce(q_cov.n, 0) AS n_repeat_words
  FROM q_doc LEFT JOIN q_cov USING (doc_id)
), q_judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    {' OR '.join(bound(r) for r in quality.RULES)} AS rule_failed
  FROM q_measured
), q_all AS (SELECT *, NOT base_failed AND NOT rule_failed AS kept FROM q_judged)
SELECT {columns} FROM q_all"""


@query("op10_quality_rules", quality_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a vocabulary's merges. Tested against the library on whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_dynamic_packing")
def dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a tokenizer and a dynamic program. Tested against all cuts tried."""
    made = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return made.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op9_simhash_classes")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: XXH64. Tested against all pairs compared."""
    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op5_histogram_shards")
def histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: splitters by rounds of counting. Tested against the stated law."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 40).select(
        "doc_id",
        sharding.size_of("text").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a trained classifier. Tested by held-out accuracy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op8_page_templates")
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: parsing of markup. Tested against pages whose article is known."""
    made = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    made = made.select("page_id", "url", F.inline(F.array(F.struct(F.col("main_text").alias("text")))))
    return made.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_surrogates")
def surrogate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: keyed hashes with collision rounds. Tested by its properties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = surrogates.replace(docs)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


@query("op1_kd_tree_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""")
def kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


@query("op13_piece_table_infill", r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok
  FROM documents
), drawn AS (
  SELECT *, CAST(len(tok) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(tok) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(tok) + 1) AS c2,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50
      THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(tok[1 : least(c1, c2)], '') AS prefix, array_to_string(tok[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
    array_to_string(tok[greatest(c1, c2) + 1 :], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts""")
def piece_table_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infill.transform(docs, output=False).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _codes_sql() -> str:
    """Every part against every entry, round after round."""

    def nearest(entries: str) -> str:
        return (f"SELECT rid, part, p, entry, d FROM (SELECT c.rid, c.part, c.p, e.entry, "
                f"list_sum(list_transform(range(len(c.p)), lambda i: (c.p[i + 1] - e.p[i + 1]) * (c.p[i + 1] - e.p[i + 1]))) AS d "
                f"FROM cells c JOIN {entries} e USING (part)) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1")

    def averaged(assigned: str, entries: str) -> str:
        return (f"SELECT e.part, e.entry, coalesce(m.p, e.p) AS p FROM {entries} e LEFT JOIN ("
                f"SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM ("
                f"SELECT part, entry, i, CAST(sum(p[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS i FROM {assigned}) "
                f"GROUP BY part, entry, i) GROUP BY part, entry) m ON e.part = m.part AND e.entry = m.entry")

    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
  SELECT rid, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS p FROM (SELECT rid, q, unnest(range(16)) AS part FROM v)
), e0 AS MATERIALIZED (SELECT part, CAST(rid - 1 AS INTEGER) AS entry, p FROM cells WHERE rid <= 64),
a0 AS MATERIALIZED ({nearest("e0")}), e1 AS MATERIALIZED ({averaged("a0", "e0")}),
a1 AS MATERIALIZED ({nearest("e1")}), e2 AS MATERIALIZED ({averaged("a1", "e1")}),
a2 AS MATERIALIZED ({nearest("e2")}), coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) FROM (SELECT part, entry, i, CAST(p[i] AS VARCHAR) AS x FROM (SELECT part, entry, p, unnest(range(1, len(p) + 1)) AS i FROM e2))) AS codebooks_sha256
FROM coded JOIN v USING (rid)"""


@query("op11_pivot_codes", _codes_sql())
def pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return made.select("vec_id", codes.hex_code("code").alias("code"), "error", "label_error", "codebooks_sha256")


@query("op12_grouped_packing")
def grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a tokenizer and a linear program. Tested against the library and by its laws."""
    made = grouping.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
