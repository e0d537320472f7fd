"""Fill-in-the-middle by a piece table.

A document is never copied or cut as a string. Two buffers stay as they are: its
UTF-8 bytes and the sentinels. A sequence of descriptors (buffer, start, length)
says what a text consists of. Cutting splits the descriptor of the whole text in
two places, an arrangement is a permutation of descriptors with sentinels between,
and hashes and outputs stream through the descriptors. Reading back describes the
written output by the places of its sentinels and applies the inverse permutation.

Cuts fall between tokens, a token being white space with the word after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import col, without

SEED = 42
FIM_PERCENT = 50  # of the documents, the share that is rearranged
SPM_PERCENT = 80  # of these, the share whose suffix comes first

TEXT, SENTINELS = 0, 1
MARKS = ("<P>", "<S>", "<M>")
#: For each form the order of prefix (0), middle (1) and suffix (2), and the mark before each.
FORMS: Mapping[str, Sequence[tuple[int, str]]] = {
    "psm": ((0, "<P>"), (2, "<S>"), (1, "<M>")),
    "spm": ((2, "<S>"), (0, "<P>"), (1, "<M>")),
}
PLAIN = "plain"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def split(pieces: Sequence[Piece], at: int) -> list[Piece]:
    """The descriptors with a border at a place of the described text; empty parts stay."""
    out, before = [], 0
    for i, p in enumerate(pieces):
        if before <= at <= before + p.length:
            cut = at - before
            return [*out, Piece(p.buffer, p.start, cut), Piece(p.buffer, p.start + cut, p.length - cut), *pieces[i + 1:]]
        out.append(p)
        before += p.length
    raise ValueError(f"no place {at} in a text of {before}")


def arrange(parts: Sequence[Piece], form: str, marks: Sequence[str] = MARKS) -> list[Piece]:
    """Prefix, middle and suffix in the order of a form, each behind its mark."""
    starts = dict(zip(marks, np.cumsum([0, *[len(m.encode()) for m in marks]]).tolist()))
    out = []
    for part, mark in FORMS[form]:
        out += [Piece(SENTINELS, starts[mark], len(mark.encode())), parts[part]]
    return out


def read_back(output: bytes, form: str, marks: Sequence[str] = MARKS) -> list[Piece]:
    """Descriptors of the original text over an output of `arrange`.

    The marks are found in their order; no text that holds one is ever arranged,
    and a mark cannot begin within a part and end in the next mark.
    """
    if form == PLAIN:
        return [Piece(TEXT, 0, len(output))]
    order = FORMS[form]
    found, at = [], 0
    for _, mark in order:
        at = output.index(mark.encode(), at)
        found.append((at, at := at + len(mark.encode())))
    ends = [start for start, _ in found[1:]] + [len(output)]
    parts = {part: Piece(TEXT, body, end - body) for (part, _), (_, body), end in zip(order, found, ends)}
    return [parts[i] for i in sorted(parts)]


def stream(buffers: Sequence[bytes], pieces: Iterable[Piece]) -> Iterator[memoryview]:
    for p in pieces:
        yield memoryview(buffers[p.buffer])[p.start: p.start + p.length]


def digest(buffers: Sequence[bytes], pieces: Iterable[Piece]) -> str:
    made = hashlib.sha256()
    for part in stream(buffers, pieces):
        made.update(part)
    return made.hexdigest()


def token_ends(text: bytes) -> np.ndarray:
    """Where the tokens of a text end, in bytes: behind each word, and behind white space that no word follows."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    if not len(space):
        return np.empty(0, np.int64)
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def code_points(text: bytes, start: int, length: int) -> int:
    part = np.frombuffer(text, np.uint8)[start: start + length]
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers that depend on seed and key alone."""
    hexed = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(hexed[8 * i: 8 * i + 8], 16) for i in range(4)]


def plan(text: bytes, key: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[str, int, list[Piece]]:
    """Form, number of tokens and the descriptors of the output."""
    h1, h2, h3, h4 = draws(key, seed)
    ends = token_ends(text)
    n = len(ends)
    whole = [Piece(TEXT, 0, len(text))]
    if not n or h3 % 100 >= fim_percent or any(m.encode() in text for m in MARKS):
        return PLAIN, n, whole
    form = "spm" if h4 % 100 < spm_percent else "psm"
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    bounds = np.concatenate(([0], ends))
    # The second place first, so that the first cut finds the left part in front.
    parts = split(split(whole, int(bounds[second])), int(bounds[first]))
    return form, n, arrange(parts, form)


_FIELDS = [
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
    ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))),
    ("output", pa.large_binary()),
]
_SQL = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output_sha256": "string",
        "restored_sha256": "string", "pieces": "array<struct<buffer:int,start:long,length:long>>", "output": "string"}


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT, output: bool = True) -> DataFrame:
    """The rows with n (tokens), form, prefix_chars, middle_chars (NULL if plain),
    output_sha256, restored_sha256, pieces (descriptors in bytes of the buffers)
    and, unless switched off, the output itself.

    A pass without a shuffle. Rows of one key are cut alike in proportion, repeated
    rows exactly alike. A NULL key draws as an empty one; a NULL text counts as
    empty; a text that is empty or holds a mark stays plain. Further columns are
    kept, save those of the names above.
    """
    names = [n for n in _SQL if output or n != "output"]
    made_type = pa.struct([(n, pa.string() if n == "output" else t) for n, t in _FIELDS if n in names])
    marks = "".join(MARKS).encode()

    @F.arrow_udf(f"struct<{','.join(f'{n}:{_SQL[n]}' for n in names)}>")
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for k, t in zip(keys, texts):
            body = t.as_buffer().to_pybytes() if t.is_valid else b""
            form, n, pieces = plan(body, k.as_py(), seed, fim_percent, spm_percent)
            written = body if form == PLAIN else b"".join(stream((body, marks), pieces))
            back = read_back(written, form)
            row = {
                "n": n, "form": form, "prefix_chars": None, "middle_chars": None, "output_sha256": digest((body, marks), pieces),
                "restored_sha256": digest((written,), back), "pieces": [p._asdict() for p in pieces],
            }
            if form != PLAIN:
                row["prefix_chars"], row["middle_chars"] = (code_points(written, p.start, p.length) for p in back[:2])
            if output:
                row["output"] = written.decode("utf-8", "replace")
            rows.append(row)
        return pa.array(rows, made_type)

    plain_key = F.coalesce(col(key).cast("string"), F.lit(""))
    kept = [c for c in without(docs, *names).columns]
    body = F.coalesce(col(text), F.lit("")).cast("binary")
    made = docs.select(*[col(c) for c in kept], run(plain_key, body).alias("__made"))
    return made.select(*[col(c) for c in kept], *[F.col("__made")[n].alias(n) for n in names])


def restore(outputs: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """The original texts from outputs and their forms; NULL for a NULL output."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, forms: pa.Array) -> pa.Array:
        made = []
        for t, f in zip(texts, forms):
            whole = t.as_buffer().to_pybytes() if t.is_valid else None
            made.append(None if whole is None else b"".join(stream((whole,), read_back(whole, f.as_py()))).decode("utf-8", "replace"))
        return pa.array(made, pa.string())

    kept = without(outputs, name)
    return kept.withColumn(name, run(col(output).cast("binary"), col(form)))
