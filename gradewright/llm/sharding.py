"""Sharding by histogram sort: shards of near-equal bytes in the order of a key.

Rows are ordered by a hash of their text and, within equal texts, by their id, so
copies stand together and a run of copies of any length can still be cut. Each
round counts, over all partitions, the exact bytes and rows below candidate
boundaries; the interval of each splitter shrinks until its byte count is within
the tolerance, or no row is left between its ends. Rows are then exchanged once,
into as many parts as the bytes call for, and numbered.

The driver holds the splitters and one round's counts: a few numbers for each
part, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradewright.llm.common import col, free_names, without
from gradewright.session import cut_lineage

ROW_BYTES = 16  # counted for a row besides its text
TOLERANCE = 0.005  # of a part's bytes
PART_BYTES = 128 << 20
PROBES = 32  # candidate boundaries of each splitter in a round
_OFF = 1 << 63


def size_of(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long") + ROW_BYTES


def order_of(df: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """The two 64-bit numbers rows are ordered by."""
    whole = isinstance(df.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    second = col(key).cast("long") if whole else F.xxhash64(col(key))
    return F.xxhash64(F.coalesce(col(text), F.lit(""))), F.coalesce(second, F.lit(-_OFF))


@dataclass
class Bound:
    """A boundary with the exact bytes and rows below it."""

    key: int  # both numbers as one, from 0
    size: int
    rows: int

    @property
    def pair(self) -> tuple[int, int]:
        return (self.key >> 64) - _OFF, (self.key & (2 * _OFF - 1)) - _OFF


def below(h: np.ndarray, t: np.ndarray, at_h: np.ndarray, at_t: np.ndarray) -> np.ndarray:
    """How many of the ascending boundaries are not above each row."""
    first, last = np.searchsorted(at_h, h, "left"), np.searchsorted(at_h, h, "right")
    tied = last > first
    for value in np.unique(h[tied]):
        rows = np.flatnonzero(h == value)
        a, b = first[rows[0]], last[rows[0]]
        first[rows] = a + np.searchsorted(at_t[a:b], t[rows], "right")
    return first


def _arrays(bounds: list[Bound]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [b.pair for b in bounds]
    return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)


def histogram(keys: DataFrame, probes: list[int]) -> list[Bound]:
    """Exact bytes and rows below each of the ascending probes."""
    at_h, at_t = _arrays([Bound(p, 0, 0) for p in probes])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(at_h) + 1, dtype=np.int64), np.zeros(len(at_h) + 1, dtype=np.int64)
        for b in batches:
            h, t, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = below(h, t, at_h, at_t)
            np.add.at(size, at, n)
            rows += np.bincount(at, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, size[at], rows[at])], names=["bucket", "size", "rows"])

    counted = keys.select("h", "t", "size").mapInArrow(count, "bucket long, size long, rows long")
    found = counted.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in found:
        size[r["bucket"]], rows[r["bucket"]] = r["size"], r["rows"]
    out, s, n = [], 0, 0
    for i, p in enumerate(probes):
        s, n = s + size[i], n + rows[i]
        out.append(Bound(p, s, n))
    return out


def _probes(lo: Bound, hi: Bound, target: int) -> list[int]:
    """Candidates between two boundaries: around the interpolated place, and evenly spread."""
    width = hi.key - lo.key
    guess = lo.key + width * (target - lo.size) // max(1, hi.size - lo.size)
    near = [guess + s * width // d for d in (64, 512, 4096) for s in (-1, 1)] + [guess]
    even = [lo.key + width * i // (PROBES - 6) for i in range(1, PROBES - 6)]
    unit = 1 << 64
    if width > unit:  # between texts first, so that copies stay together where they can
        return sorted({p // unit * unit for p in near + even if lo.key < p // unit * unit < hi.key})
    return sorted({p for p in near + even if lo.key < p < hi.key})


def splitters(keys: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[Bound]:
    """parts + 1 boundaries, first and last included, between parts of near-equal bytes."""
    ends = keys.agg(
        F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(F.struct("h", "t")).alias("lo"), F.max(F.struct("h", "t")).alias("hi")
    ).first()
    if not ends["rows"]:
        return [Bound(0, 0, 0) for _ in range(parts + 1)]
    lo, hi = (((e["h"] + _OFF) << 64) + e["t"] + _OFF for e in (ends["lo"], ends["hi"]))
    first, last = Bound(lo, 0, 0), Bound(hi + 1, ends["size"], ends["rows"])
    targets = [last.size * i // parts for i in range(1, parts)]
    state = {g: [first, last] for g in targets}
    slack = tolerance * last.size / parts

    def best(g: int) -> Bound:
        return min(state[g], key=lambda b: (abs(b.size - g), b.key))

    open_ = set(targets)
    while open_:
        wanted = sorted({p for g in open_ for p in _probes(*state[g], g)})
        known = histogram(keys, wanted) if wanted else []
        for g in list(open_):
            for b in known:
                a, z = state[g]
                if a.key < b.key < z.key:
                    state[g][0 if b.size <= g else 1] = b
            a, z = state[g]
            if abs(best(g).size - g) <= slack or z.rows - a.rows <= 1 or not _probes(a, z, g):
                open_.discard(g)
    return [first, *[best(g) for g in targets], last]


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text",
          tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows in `shard` order, each partition a part of one shard, with `shard` and `slot`.

    Law: shards have near-equal bytes (UTF-8 bytes of the text plus 16 per row).
    Slots count from 0 without a gap in each shard, in the order of text hash and
    id. NULL texts count as empty, NULL ids come first. A row that is repeated with
    its id cannot be told from its twin and goes where that goes. No rows, no
    shards. Input columns called `shard` or `slot` give way.
    """
    docs = without(docs, "shard", "slot")
    h, t, part = free_names(docs, "_h", "_t", "_part")
    first, second = order_of(docs, key, text)
    keys = cut_lineage(docs.select(first.alias("h"), second.alias("t"), size_of(text).alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = max(1, -(-total // (shards * part_bytes)))
    bounds = splitters(keys, shards * per, tolerance)
    at_h, at_t = _arrays(bounds[1:-1])

    @F.arrow_udf("int")
    def part_of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(below(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), at_h, at_t), pa.int32())

    placed = docs.withColumns({h: first, t: second})
    placed = placed.withColumn(part, part_of(col(h), col(t))).repartitionById(shards * per, col(part))
    # Rows of a shard before each of its parts.
    before = F.array(*[F.lit(b.rows - bounds[i // per * per].rows) for i, b in enumerate(bounds[:-1])])
    # A window over a part, whose rows are already together.
    rank = F.row_number().over(Window.partitionBy(part).orderBy(h, t)) - 1
    return placed.select(
        *[col(c) for c in docs.columns],
        (col(part) / per).cast("int").alias("shard"),
        (F.get(before, col(part)) + rank).cast("long").alias("slot"),
    )
