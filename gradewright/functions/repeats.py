"""Test for a block that occurs three times in a row.

Spark has no such function, and a backreference regex takes more than linear
time on long texts. The test runs on Arrow batches instead.

A block of length p repeated three times means text[i] == text[i+p] over 2p
positions. Two facts keep the search short and exact:
* all k-grams inside such a stretch (k = smallest block) occur elsewhere too,
  so only stretches of repeated k-grams can hold one;
* 2p equal positions cover one whole block aligned at a multiple of p, so
  comparing hashes of neighbouring aligned blocks finds every candidate p.
Hashes only propose; equality of characters decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright import fixed_values as fv
from gradewright.functions.text import col

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, dtype=np.uint64))), dtype=np.uint64)


def _longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _stretch_has_cube(codes: np.ndarray, smallest: int) -> bool:
    n = len(codes)
    powers = _powers(n)
    # Block [a, b) has the sum of code * base^position; shifting it by p
    # multiplies it by base^p.
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * powers[:n], dtype=np.uint64)))
    for p in range(smallest, n // 3 + 1):
        blocks = np.diff(sums[: (n // p) * p + 1: p])
        if not (blocks[1:] == blocks[:-1] * powers[p]).any():
            continue
        if _longest_run(codes[:-p] == codes[p:]) >= 2 * p:
            return True
    return False


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-gram, put together from hashes of halves."""
    made, length, power = codes, 1, np.array([_BASE])
    for bit in bin(k)[3:]:
        made = made[:-length] * power + made[length:]
        length, power = 2 * length, power * power
        if bit == "1":
            made = made[:-1] * _BASE + codes[length: length + len(made) - 1]
            length, power = length + 1, power * _BASE
    return made


def _repeated(grams: np.ndarray) -> np.ndarray:
    """Which k-grams occur elsewhere, too, by the top bits of their hash. A chance
    collision only lets one that is unique be taken for repeated.

    One byte for each of 4 to 8 slots per character, and 32-bit slot numbers.
    """
    bits = min(max(len(grams).bit_length() + 2, 8), 31)
    slots = (grams >> np.uint64(64 - bits)).astype(np.uint32)
    ranked = np.sort(slots)
    twice = np.zeros(1 << bits, dtype=bool)
    twice[ranked[1:][ranked[1:] == ranked[:-1]]] = True
    return twice[slots]


def _cube_in(codes: np.ndarray, repeated: np.ndarray, smallest: int) -> bool:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts + smallest - 1 >= 3 * smallest
    return any(
        _stretch_has_cube(codes[start: end + smallest - 1], smallest) for start, end in zip(starts[long], ends[long])
    )


def has_cubes(text: str, smallest: int = fv.MIN_BLOCK, across_lines: bool = True, in_line: bool = True) -> tuple[bool, bool]:
    """Whether a block of at least `smallest` code points occurs 3 times in a row,
    anywhere and within one line; False for the form not asked for."""
    if len(text) < 3 * smallest:
        return False, False
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    repeated = _repeated(_grams(codes, smallest))
    anywhere = _cube_in(codes, repeated, smallest) if across_lines else False
    if not in_line or (across_lines and not anywhere):
        return anywhere, False
    breaks = np.concatenate(([0], np.cumsum(codes == 10)))
    return anywhere, _cube_in(codes, repeated & (breaks[smallest:] == breaks[:-smallest]), smallest)


def has_cube(text: str, smallest: int = fv.MIN_BLOCK, across_lines: bool = True) -> bool:
    """True if a block of at least `smallest` code points occurs 3 times in a row."""
    return any(has_cubes(text, smallest, across_lines, not across_lines))


def repeated_block(text: Column | str, smallest: int = fv.MIN_BLOCK, across_lines: bool = True) -> Column:
    """Column form of has_cube. NULL in, NULL out: blank out rows that need no
    test, and their text never leaves the JVM."""

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else has_cube(t, smallest, across_lines) for t in (x.as_py() for x in texts)], pa.bool_())

    return test(col(text))


def repeated_blocks(text: Column | str, smallest: int = fv.MIN_BLOCK) -> Column:
    """Both forms in one pass: struct of `anywhere` and `in_line`; NULL in, NULLs out."""

    @F.arrow_udf("struct<anywhere:boolean,in_line:boolean>")
    def test(texts: pa.Array) -> pa.Array:
        made = [(None, None) if t is None else has_cubes(t, smallest) for t in (x.as_py() for x in texts)]
        return pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.bool_()) for i in (0, 1)], names=["anywhere", "in_line"])

    return test(col(text))
