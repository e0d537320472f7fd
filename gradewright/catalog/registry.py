"""Registry of queries and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id, with SQL for the same result."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; an engine may add in another order."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# --- tables of different columns as one long table ------------------------------


def long_rows(name: str, df: DataFrame, keys, columns) -> DataFrame:
    """Rows of a report table as table_name, key, metric, value; absent values have no row."""
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    cells = [
        F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("int" if df.schema[c].dataType.simpleString() == "boolean" else "double").cast("double"), 6).alias("value"))
        for c in columns
    ]
    made = df.select(F.lit(name).alias("table_name"), key.alias("key"), F.explode(F.array(*cells)).alias("c"))
    return made.select("table_name", "key", "c.*").where("value IS NOT NULL")


def sql_long(name: str, sql: str, keys, columns) -> str:
    key = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) or "''"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {key} AS key, '{c}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM ({sql}) WHERE {c} IS NOT NULL" for c in columns
    )


# --- dictionaries of word parts that occur in the test texts ------------------
DAMAGE_WORDS = ("thble", "erwh", "éeaux", "erkeit", "ciónll", "anea", "ouai")
VAGUE_WORDS = ("onre", "enst", "éan", "osga")
TYPE_RULES = (
    ("rebar_exposure", (("thblere",), ("erwh", "onnd"))),
    ("section_loss", (("eaux", "èvi"), ("keitpf",))),
    ("spalling", (("thsh",), ("ungtz",), ("ciónll",))),
    ("corrosion", (("eran",), ("ouai",), ("ñas",))),
    ("crack", (("thti",), ("enbe",), ("ment",))),
)
SEVERITY_RULES = (
    ("high", (("edes",), ("éonç",), ("chver",))),
    ("low", (("ingon",), ("leux",), ("osra",))),
)
LOCATION_RULES = (
    ("girder", (("thhe",), ("aule",))),
    ("deck", (("ernt",), ("enge",))),
    ("bearing", (("wher",),)),
    ("pier", (("lyre",), ("éçle",), ("zuver",))),
    ("railing", (("stou",), ("ouou",))),
)
FEATURE_RULES = (("edge", (("edge",),)), ("ring", (("ering",), ("erung",))), ("thing", (("thing",),)))
BILINGUAL_TYPES = (
    ("rebar_exposure", (("thblere",), ("Thsh",))),
    ("corrosion", (("eran",), ("éré",))),
    ("crack", (("thti",), ("enbe",))),
)
BILINGUAL_SEVERITIES = (("high", (("edes",), ("éonç",))), ("medium", (("ingon",), ("leux",))))
BILINGUAL_LOCATIONS = (("girder", (("thhe",), ("aule",))), ("deck", (("ernt",), ("enge",))))
BILINGUAL_RISKS = (("structural", (("ther",), ("ierê",))), ("durability", (("lich",), ("mente",))))
MEMBERS = {
    "thon": "M-thon", "than": "M-than", "thre": "M-thre", "erin": "M-erin", "eron": "M-eron",
    "eau": "M-eau", "ung": "M-ung", "mente": "M-mente", "lich": "M-lich", "zzzz": "M-never",
}
DAMAGES = {
    "thble": "D-thble", "erwh": "D-erwh", "anea": "D-anea", "ouai": "D-ouai", "éan": "D-éan",
    "keit": "D-keit", "ción": "D-ción", "enst": "D-enst", "qqqq": "D-never",
}


# --- SQL of the same expressions ----------------------------------------------


def sql_strip(text: str) -> str:
    codes = (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
    chars = " || ".join(f"chr({c})" for c in codes)
    return f"trim({text}, {chars})"


def sql_tokens(text: str) -> str:
    return (
        rf"CAST(len(regexp_extract_all({text}, '[\x{{3000}}-\x{{9fff}}\x{{f900}}-\x{{ffef}}]')) + "
        rf"len(regexp_extract_all(regexp_replace({text}, '[^\x00-\x7F]', '', 'g'), '[^ \t\n\x0B\f\r]+')) AS INTEGER)"
    )


def sql_blocks(source: str, smallest: int = 10) -> str:
    """doc_id, anywhere, in_line: whether a block of `smallest` or more characters comes three times in a row.

    `source` has doc_id and t. A block of length p comes three times where 2p characters in a row equal those p
    further on, so where 2p - smallest + 1 grams in a row do; within a line, where none of these has a line break.
    """
    def runs(condition: str) -> str:
        return f"""SELECT DISTINCT doc_id FROM (
  SELECT doc_id, p, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS run FROM block_pairs WHERE {condition}
) GROUP BY doc_id, p, run HAVING count(*) >= 2 * p - {smallest - 1}"""

    return f"""(WITH block_grams AS MATERIALIZED (
  SELECT doc_id, n, i, substr(t, i, {smallest}) AS g FROM (
    SELECT doc_id, t, length(t) AS n, unnest(range(1, length(t) - {smallest - 2})) AS i FROM ({source}) WHERE length(t) >= {3 * smallest})
), block_pairs AS MATERIALIZED (
  SELECT a.doc_id, a.i, b.i - a.i AS p, a.g FROM block_grams a JOIN block_grams b ON a.doc_id = b.doc_id AND a.g = b.g
  WHERE b.i - a.i >= {smallest} AND 3 * (b.i - a.i) <= a.n
), block_any AS ({runs("TRUE")}), block_line AS ({runs("NOT contains(g, chr(10))")})
SELECT doc_id, doc_id IN (SELECT doc_id FROM block_any) AS anywhere, doc_id IN (SELECT doc_id FROM block_line) AS in_line FROM ({source}))"""


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def sql_rules(text: str, rules, default: str, folded: str | None = None) -> str:
    def found(word: str) -> str:
        return f"contains({folded if folded and word.isascii() else text}, '{word}')"

    whens = " ".join(
        "WHEN " + " OR ".join("(" + " AND ".join(found(w) for w in words) + ")" for words in alternatives) + f" THEN '{label}'"
        for label, alternatives in rules
    )
    return f"CASE {whens} ELSE '{default}' END"


def sql_lookup(key: str, table: dict, default: str, kind: str | None = None) -> str:
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {kind})" if kind else str(v)

    whens = " ".join(f"WHEN {lit(k) if isinstance(k, str) else k} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"
