"""Scalar text functions: built-in column expressions, but for searches by large dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright import fixed_values as fv

# Everything Python's str.strip() removes; Java's \s and trim() know fewer.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

CJK = "[　-鿿豈-￯]"
# First visible ASCII character of a block, then the block up to ASCII space.
# Non-ASCII characters neither start nor end a block, as if they were deleted.
ASCII_BLOCK = r"[\x00-\x08\x0E-\x1F\x21-\x7F][^ \t\n\x0B\f\r]*+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for an expression that needs it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column | str) -> Column:
    """Remove Unicode whitespace on both ends."""
    return F.trim(col(text), F.lit(WHITESPACE))


def is_blank(text: Column | str) -> Column:
    return strip(text) == ""


def token_count(text: Column | str) -> Column:
    """CJK code points plus whitespace-separated ASCII blocks."""
    text = col(text)
    cjk = F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(
        F.regexp_count(text, F.lit(CJK))
    )
    return (cjk + F.regexp_count(text, F.lit(ASCII_BLOCK))).cast("int")


def answer_after_marker(text: Column | str, marker: str = "ASSISTANT:") -> Column:
    """Text after the first marker, else the whole text; stripped."""
    text = col(text)
    at = F.locate(marker, text)
    return strip(F.when(at > 0, F.substr(text, at + len(marker))).otherwise(text))


def answer_after_pattern(text: Column | str, word: str = "ASSISTANT") -> Column:
    """Text after `word :` in any case, if any text follows; stripped. Texts without
    a colon are spared the regex."""
    text = col(text)
    after = F.regexp_replace(text, rf"(?isuU)\A.*?{word}\s*:\s*(?=.)", "")
    return strip(F.when(text.contains(":"), after).otherwise(text))


def answer_or_raw(text: Column | str, marker: str = "ASSISTANT:") -> Column:
    """Stripped text after the first marker, else the text untouched."""
    text = col(text)
    return F.when(text.contains(marker), answer_after_marker(text, marker)).otherwise(text)


def answer_after_last(text: Column | str, marker: str = "assistant") -> Column:
    """Text after the last marker, else the whole text; stripped."""
    return strip(F.substring_index(col(text), marker, -1))


MANY_WORDS = 200  # from here on one automaton finds all words in one pass over the text


def contains_any(text: Column | str, words: Iterable[str], fold_case: bool = False) -> Column:
    """True if one of the words occurs. With fold_case the text is lowercased
    and the words are taken as given. A large dictionary is searched in one pass."""
    text = F.lower(col(text)) if fold_case else col(text)
    words = list(words)
    if len(words) >= MANY_WORDS:
        return F.size(_occurring(text, words, 1)) > 0
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def _occurring(text: Column, words: Sequence[str], most: int | None = None) -> Column:
    """Places in the dictionary, ascending, of the words that occur, of at most `most`
    the first found; NULL for NULL.

    An automaton over all words (Aho and Corasick) reads each text once, however many
    words there are; it is made anew by each task.
    """
    words = list(words)

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            places.setdefault(word, []).append(i)
        everywhere = places.pop("", [])
        automaton = ahocorasick.Automaton()
        for word, found in places.items():
            automaton.add_word(word, found)
        if places:
            automaton.make_automaton()
        for texts in batches:
            made: list[list[int] | None] = []
            for t in texts:
                if not t.is_valid:
                    made.append(None)
                    continue
                seen: dict[int, list[int]] = {}
                for _, found in automaton.iter(t.as_py()) if places else ():
                    seen[found[0]] = found
                    if most is not None and len(seen) >= most:
                        break
                made.append(sorted([*everywhere, *(i for found in seen.values() for i in found)]))
            yield pa.array(made, pa.list_(pa.int32()))

    return find(text)


def contains_all(text: Column | str, words: Iterable[str]) -> Column:
    text = col(text)
    return reduce(lambda a, b: a & b, [text.contains(w) for w in words])


def matching_words(text: Column | str, labels: dict[str, str]) -> Column:
    """Array of the labels whose word occurs in the text, in dictionary order. A large
    dictionary is searched in one pass."""
    text = col(text)
    if len(labels) >= MANY_WORDS:
        names = F.array(*[F.lit(label) for label in labels.values()])
        return F.transform(F.coalesce(_occurring(text, list(labels)), F.array().cast("array<int>")), lambda i: F.get(names, i))
    hits = [F.when(text.contains(w), F.lit(label)) for w, label in labels.items()]
    return F.array_compact(F.array(*hits))


def python_regex(pattern: str) -> str:
    """Java form of a Python pattern: `.` stops at \\n only, classes are Unicode."""
    return f"(?dU){pattern}"


def matches_any(text: Column | str, patterns: Sequence[str | tuple[str, str]]) -> Column:
    """Search for any of the patterns.

    A pattern may come as (literal, pattern): the literal is part of every match.
    A plain search for the literal then spares most texts the regex.
    """
    text = col(text)
    found = F.lit(False)
    for pattern in patterns:
        if not isinstance(pattern, str):
            literal, pattern = pattern
            found = found | (text.contains(literal) & text.rlike(python_regex(pattern)))
    plain = [f"(?:{p})" for p in patterns if isinstance(p, str)]
    return found | text.rlike(python_regex("|".join(plain))) if plain else found


def split_keeping_end(text: Column | str, end: str = fv.SENTENCE_END) -> Column:
    """Sentences with their end mark; the part after the last mark comes last."""
    return F.split(col(text), rf"(?<=\Q{end}\E)")


def clauses(text: Column | str, delimiters: str = fv.CLAUSE_DELIMITERS,
            min_length: int = fv.MIN_CLAUSE) -> Column:
    """Stripped clauses of at least min_length characters."""
    escaped = "".join(f"\\x{{{ord(d):x}}}" for d in delimiters)
    parts = F.transform(F.split(col(text), f"[{escaped}]"), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_length)


def has_duplicate_clause(text: Column | str, delimiters: str = fv.CLAUSE_DELIMITERS,
                         min_length: int = fv.MIN_CLAUSE) -> Column:
    return let(clauses(text, delimiters, min_length), lambda parts: F.size(parts) > F.size(F.array_distinct(parts)))


def file_name(path: Column | str) -> Column:
    """Last component of a path."""
    return F.substring_index(F.rtrim(col(path), F.lit("/")), "/", -1)


def file_stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]+$", "")


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)"


def plain_path(path: Column | str) -> Column:
    """A path without scheme and host, in the one form that file lists and data share.

    With a scheme it is an address, whose percent signs are decoded, as Spark's
    readers report it; a plain path is taken as it is.
    """
    path = col(path)
    rest = F.regexp_replace(path, SCHEME, "")
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    return F.when(path.rlike(SCHEME), decoded).otherwise(path)


def join_path(folder: Column | str, path: Column | str) -> Column:
    """Path below a folder; an absolute path stands for itself."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    path = col(path)
    return F.when(path.startswith("/"), path).otherwise(
        F.concat_ws("/", F.rtrim(folder, F.lit("/")), path)
    )


def shorten(text: Column | str, limit: int = 200) -> Column:
    """First `limit` characters and `...` where the text is longer."""
    text = col(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def or_default(value: Column | str, default: str) -> Column:
    """Default for NULL and for the empty string."""
    return F.coalesce(F.nullif(col(value), F.lit("")), F.lit(default))


def blank_as(text: Column | str, word: str = "empty") -> Column:
    """The word for NULL or blank text, else the text."""
    text = col(text)
    return F.when(text.isNull() | is_blank(text), F.lit(word)).otherwise(text)


def strata_key(*columns: Column | str) -> Column:
    return F.concat_ws("_", *[col(c).cast("string") for c in columns])


def fill_template(template: str, **fields: Column) -> Column:
    """Put columns into the `{name}` places of a template."""
    parts: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find(f"{{{n}}}"), n) for n in fields if f"{{{n}}}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(fields[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts) if parts else F.lit("")


def chat_prompt(system: str, user: Column) -> Column:
    """Prompt in the public Llama-3 chat format, open for the assistant's turn."""
    head = "<|start_header_id|>{role}<|end_header_id|>\n\n"
    before = "<|begin_of_text|>" + head.format(role="system") + system + "<|eot_id|>" + head.format(role="user")
    return F.concat(F.lit(before), user, F.lit("<|eot_id|>" + head.format(role="assistant")))


def judge_prompt(text: Column | str, system: str, template: str,
                 limit: int = fv.JUDGE_TEXT_LENGTH) -> Column:
    """Chat prompt over the first `limit` characters of the text, which is the
    prompt's own format; use STRUCTURER_TEXT_LENGTH for a structurer prompt."""
    return chat_prompt(system, fill_template(template, text=F.substring(col(text), 1, limit)))


def training_text(text: Column | str, instruction: str) -> Column:
    """Question and answer as one training text."""
    return F.concat(F.lit(f"USER: <image>\n{instruction}\nASSISTANT: "), col(text))
