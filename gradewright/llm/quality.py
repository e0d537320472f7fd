"""Quality rules: one table of thresholds, compiled into one projection.

Only DataFrame functions. Nothing is shuffled: every measure of a document is
an expression over its own words and lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import SPACED_WORD, col, free_names, stage, without

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that for it with as was on be by this are from or an at not have which "
    "de la le les et des un une du que en dans pour est qui sur par pas au avec "
    "der die das und von zu mit den im ein eine auf ist für nicht sich dem auch als es "
    "el los las y del se por con una su para al lo como más o pero sus"
).split()
MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Fails a text whose measure, per unit of another one, leaves [low, high]."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    at_least_words: int = 0  # shorter texts are not judged by this rule

    def broken(self, m: dict[str, Column]) -> Column:
        value = m[self.measure].cast("double")
        if self.per:
            value = F.when(m[self.per] > 0, value / m[self.per]).otherwise(F.lit(0.0))
        out = F.lit(False)
        if self.low is not None:
            out = out | (value < self.low)
        if self.high is not None:
            out = out | (value > self.high)
        return out & (m["n_words"] >= self.at_least_words)


#: The method's own table. Ratios are per word, line ratios per line with a word.
RULES = (
    Rule("too_long", "n_words", high=10_000_000),
    Rule("short_words", "word_chars", per="n_words", low=2.0),
    Rule("long_words", "word_chars", per="n_words", high=14.0),
    Rule("symbols", "n_symbols", per="n_words", high=0.25),
    Rule("marks", "n_marks", per="n_words", high=0.60),
    Rule("stop_words", "n_stop_words", per="n_words", low=0.02, at_least_words=50),
    Rule("dup_lines", "n_dup_lines", per="n_lines", high=0.50),
)


def _without_chars(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _shifted(a: Column, by: int, size: Column) -> Column:
    return F.slice(a, by + 1, F.greatest(size - by, F.lit(0)))


def _window_hashes(words: Column, n: Column) -> Column:
    """A 64-bit hash of every 8-word window, made by doubling: 1, 2, 4, 8 words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    width = 1
    while width < WINDOW:
        h = F.zip_with(h, _shifted(h, width, n), lambda a, b: F.xxhash64(a, b))
        width *= 2
    return F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The eight measures of every text, as columns MEASURES (long).

    Words are runs of anything but ASCII white space. NULL and empty texts
    measure 0 everywhere. Repeated rows are measured alike, ties cannot occur.
    Columns of the input keep their names; those called like a measure give way.
    """
    docs = without(docs, *MEASURES)
    body, words, lines, n, hashes, order = free_names(docs, "_body", "_words", "_lines", "_n", "_hashes", "_order")
    whole = F.coalesce(col(text), F.lit(""))
    df = stage(docs, **{words: F.regexp_extract_all(whole, F.lit(SPACED_WORD), 0), body: whole})
    # A line counts if it has a word.
    lined = F.filter(F.split(col(body), "\n"), lambda x: x.rlike(SPACED_WORD))
    df = stage(df, **{n: F.size(col(words)), lines: lined})
    df = stage(df, **{
        hashes: _window_hashes(col(words), col(n)),
        "n_stop_words": F.size(F.filter(col(words), lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
    })
    # Only texts with a repeated window go on: their windows in order of hash and place.
    m = F.size(col(hashes))
    repeated = m > F.size(F.array_distinct(col(hashes)))
    placed = F.zip_with(col(hashes), F.sequence(F.lit(0), m - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = stage(df, **{order: F.when(repeated, F.array_sort(placed))})
    same = F.zip_with(col(order), F.slice(col(order), 2, F.size(col(order))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    flags = free_names(df, "_same")[0]
    df = stage(df, **{flags: same})
    either = F.zip_with(col(flags), F.concat(F.array(F.lit(False)), col(flags)), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    at = F.zip_with(F.slice(either, 1, F.size(col(order))), col(order), lambda f, x: F.when(f, x["i"]))
    places = free_names(df, "_places")[0]
    df = stage(df, **{places: F.array_sort(F.array_compact(at))})
    # A window covers 8 words, or fewer up to the next repeated one.
    covered = F.zip_with(
        col(places), F.slice(col(places), 2, F.size(col(places))), lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long")
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select(
        *[col(c) for c in docs.columns],
        col(n).cast("long").alias("n_words"),
        F.char_length(_without_chars(col(body), " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        (F.char_length(col(body)) - F.char_length(_without_chars(col(body), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.char_length(col(body)) - F.char_length(_without_chars(col(body), "!?"))).cast("long").alias("n_marks"),
        col("n_stop_words"),
        F.size(col(lines)).cast("long").alias("n_lines"),
        (F.size(col(lines)) - F.size(F.array_distinct(col(lines)))).cast("long").alias("n_dup_lines"),
        F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, `base_failed`, the names of broken rules and `kept`.

    A text is kept if neither the base nor a rule of the table fails it. NULL
    and empty texts fail the base (`too_short`). One projection evaluates the
    whole table.
    """
    df = measures(without(docs, "base_failed", "broken_rules", "kept"), text)
    m = {name: col(name) for name in MEASURES}
    # In whole numbers, so that exactly 30 percent is no failure.
    base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    broken = F.array_compact(F.array(*[F.when(r.broken(m), F.lit(r.name)) for r in rules]))
    df = df.select("*", base.alias("base_failed"), broken.alias("broken_rules"))
    return df.select("*", (~col("base_failed") & (F.size(col("broken_rules")) == 0)).alias("kept"))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes, with the columns of the input."""
    held = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(text).alias("text"))
    return judge(held, "text", rules).where("kept").select("row.*")
