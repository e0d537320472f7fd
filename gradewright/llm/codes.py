"""Product codes of vectors, with exact integer assignments pruned by fixed pivots (LAESA).

A vector of whole numbers is cut into equal parts; every part position has a
codebook of its own. Rounds of assignment and averaging refine the codebooks.

A few pivots per part position, taken from the first codebook, never change. The
distance of each part to each pivot is computed once and written with the parts. In
every round the distance of an entry to a pivot differs from that of a part by at most
the distance of part and entry, so the largest difference over the pivots is a
lower bound. Entries are tried in the order of their bounds, with exact integers,
until the next bound is above the best distance found. Bounds carry a margin for
the rounding of roots, so results are those of comparing everything.

A round is one pass: tasks add up the parts of each entry, and what they shuffle
and the driver receives is a codebook, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.llm.common import col, free_names
from gradewright.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
PIVOTS = 4
SLACK = 1e-6  # of the distances: roots are kept as 32-bit floats, whose relative error is below 6e-8
SAFE = 1 << 24  # from here on squares are summed as Python's integers
CHUNK = 4_096  # rows compared at once
LONG_MAX = (1 << 63) - 1
FREQUENT = 1_000  # a label of more than this fraction of the rows is looked up apart


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: float = SCALE) -> DataFrame:
    """The rows that take part, with `q`, floor(scale * x) of each component, as a further column."""
    x = col(vector)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    q = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    return vectors.where(x.isNotNull() & sound).withColumn("q", q)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones filled with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    made = np.zeros((len(sizes), width), dtype=np.int64)
    made[np.arange(width) < sizes[:, None]] = flat
    return made


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """64-bit integers where squared distances surely fit, else Python's."""
    small = all(not a.size or (int(a.max()) < SAFE and int(a.min()) > -SAFE) for a in arrays)
    return [a.astype(np.int64 if small else object) for a in arrays]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows that belong together, in whole numbers."""
    d = a - b
    return (d * d).sum(axis=-1)


def roots(parts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of every part to every other row, as 32-bit floats."""
    p, o = exact(parts, others)
    return np.sqrt(squared(p[:, None, :], o[None, :, :]).astype(np.float64)).astype(np.float32)


def choose_pivots(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Places of the entries that serve as pivots: each as far as possible from those before it.

    The first is the entry farthest from the first one; equal entries are taken once.
    """
    (e,) = exact(entries)
    chosen = [int(np.argmax(squared(e, e[:1])))]
    nearest = squared(e, e[chosen[0]])
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squared(e, e[chosen[-1]]))
    return np.array(chosen)


def assign(parts: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part the nearest entry (ties to the lower place), its squared distance, and how many entries were tried.

    to_pivots: distances of the parts to the pivots, made once.
    """
    p, e = exact(parts, entries)
    between = roots(pivots, entries).astype(np.float64)
    bound = np.zeros((len(p), len(e)))
    for i, row in enumerate(between):
        own = to_pivots[:, i, None].astype(np.float64)
        np.maximum(bound, np.abs(own - row) - SLACK * (own + row), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    bound *= bound * (1 - SLACK)
    best_at = order[:, 0].copy()
    best = squared(p, e[best_at])
    tried = np.ones(len(p), dtype=np.int64)
    left = np.arange(len(p))
    for turn in range(1, len(e)):
        left = left[bound[left, turn] <= best[left].astype(np.float64)]
        if not len(left):
            break
        at = order[left, turn]
        found = squared(p[left], e[at])
        better = (found < best[left]) | ((found == best[left]) & (at < best_at[left]))
        best[left[better]], best_at[left[better]] = found[better], at[better]
        tried[left] += 1
    return best_at, best, tried


def _rounded_up(n: int, parts: int) -> int:
    return max(parts, -(-n // parts) * parts)


def digest(books: np.ndarray) -> str:
    """Hex SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


class Coder:
    """Codebooks (part, entry, component) and fixed pivots (part, pivot, component)."""

    def __init__(self, books: np.ndarray, pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Row by row the distances of each part to its pivots; unused places are zero."""
        n, (parts, _, size) = len(q), self.books.shape
        most = max(len(p) for p in self.pivots)
        made = np.zeros((n, parts, most), dtype=np.float32)
        cut = q.reshape(n, parts, size)
        for a in range(0, n, CHUNK):
            for j, p in enumerate(self.pivots):
                made[a: a + CHUNK, j, : len(p)] = roots(cut[a: a + CHUNK, j], p)
        return made.reshape(n, parts * most)

    def encode(self, q: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the entries of its parts, their squared distances, and how many entries were tried."""
        n, (parts, _, size) = len(q), self.books.shape
        cut, to_pivots = q.reshape(n, parts, size), distances.reshape(n, parts, -1)
        at, error, tried = np.zeros((n, parts), dtype=np.int64), np.zeros((n, parts), dtype=object), np.zeros(n, dtype=np.int64)
        for a in range(0, n, CHUNK):
            part = slice(a, a + CHUNK)
            for j in range(parts):
                own = to_pivots[part, j, : len(self.pivots[j])]
                at[part, j], error[part, j], count = assign(cut[part, j], self.books[j], own, self.pivots[j])
                tried[part] += count
        return at, error, tried


def _first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows of smallest key, NULL keys last, equal keys by their numbers."""
    first = rows.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    width = _rounded_up(rows.agg(F.max(F.size("q"))).first()[0] or 0, parts)
    made = np.array([r["q"] + [0] * (width - len(r["q"])) for r in first], dtype=np.int64)
    return made.reshape(len(first), parts, width // parts).transpose(1, 0, 2)


def _averaged(rows: DataFrame, coder: Coder) -> np.ndarray:
    """Codebooks after one round: of each entry the floor of the mean of its parts; unused entries stay."""
    parts, entries, size = coder.books.shape
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("part", "entry", "place")] + [T.StructField(c, T.LongType()) for c in ("n", "high", "low")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), dtype=np.int64)
        # Sums of 64-bit numbers, exact as two sums of their halves.
        halves = np.zeros((2, parts, entries, size), dtype=np.int64)
        for b in batches:
            q = matrix(b.column(0), coder.width)
            at, _, _ = coder.encode(q, matrix_of_floats(b.column(1), q))
            cut = q.reshape(len(q), parts, size)
            for j in range(parts):
                counts[j] += np.bincount(at[:, j], minlength=entries)
                np.add.at(halves[0, j], at[:, j], cut[:, j] >> 32)
                np.add.at(halves[1, j], at[:, j], cut[:, j] & 0xFFFFFFFF)
        j, i = np.nonzero(counts)
        places = [np.repeat(j, size), np.repeat(i, size), np.tile(np.arange(size), len(j))]
        columns = [pa.array(c, pa.int32()) for c in places]
        columns += [pa.array(c, pa.int64()) for c in (np.repeat(counts[j, i], size), halves[0, j, i].ravel(), halves[1, j, i].ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    made = rows.select("q", "d").mapInArrow(run, schema).groupBy("part", "entry", "place").agg(*sums)
    books = coder.books.copy()
    for r in made.collect():  # a row per component of the codebooks at most
        books[r["part"], r["entry"], r["place"]] = ((int(r["high"]) << 32) + int(r["low"])) // int(r["n"])
    return books


def matrix_of_floats(column: pa.Array, q: np.ndarray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(q), -1)


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """The key, code (array of entry numbers), error, label_error and codebooks_sha256.

    A codebook starts as the parts of the rows of smallest key; NULL keys come last,
    equal keys by their numbers. With fewer rows than entries it has as many entries.
    Repeated rows count each. Rows with a NULL vector or a NULL or non-finite component
    take no part; a shorter vector counts as filled with zeros up to the longest, and
    that up to a multiple of `parts`. Scaled numbers beyond 64 bits stay at their
    limit, and so do errors and their sums. label_error is the error summed over the
    rows of an equal label, NULLs together. `tried` is the number of distances that
    were computed for the code; without bounds it would be parts * entries. Other columns
    are not read.
    """
    kind, label_kind = vectors.schema[key].dataType, vectors.schema[label].dataType
    numbers = whole_numbers(vectors.select(col(key).alias("id"), col(label).alias("label"), col(vector).alias("vector")), "id", "vector", scale)
    rows = cut_lineage(numbers.select("id", "label", "q"))
    books = _first_books(rows, parts, entries)
    coder = Coder(books, [b[choose_pivots(b)] if len(b) else b for b in books])

    def measured(column: pa.Array) -> pa.Array:
        q = matrix(column, coder.width)
        d = coder.distances(q)
        offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * d.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(d.ravel(), pa.float32()))

    measure = F.arrow_udf(measured, "array<float>")
    rows = cut_lineage(rows.select("id", "label", "q", measure("q").alias("d")))
    for _ in range(rounds if len(books[0]) else 0):
        coder = Coder(_averaged(rows, coder), coder.pivots)

    def coded(q: pa.Array, d: pa.Array) -> pa.Array:
        whole = matrix(q, coder.width)
        at, error, tried = coder.encode(whole, matrix_of_floats(d, whole))
        total = [min(sum(e), LONG_MAX) for e in error.tolist()]
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1], pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(at.ravel(), pa.int32())), pa.array(total, pa.int64()), pa.array(tried, pa.int64())],
            names=["code", "error", "tried"])

    code = F.arrow_udf(coded, "struct<code:array<int>,error:long,tried:long>")
    made = cut_lineage(rows.select("id", "label", code("q", "d").alias("made")).select("id", "label", "made.*"))
    summed = with_label_error(made)
    return summed.select(
        col("id").cast(kind).alias(key), col("label").cast(label_kind).alias("label"), "code", "error", "label_error",
        F.lit(digest(coder.books)).alias("codebooks_sha256"), "tried")


def with_label_error(rows: DataFrame) -> DataFrame:
    """The rows with the sum of `error` over their label.

    Labels that hold more than a thousandth of the rows are at most a thousand: their
    sums are broadcast. No other label is large, so the rest is a plain equality join.
    """
    of, total, n = free_names(rows, "of", "label_error", "n")
    exact_sum = F.least(F.sum(col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = cut_lineage(rows.groupBy("label").agg(exact_sum.alias(total), F.count(F.lit(1)).alias(n)).withColumnRenamed("label", of))
    most = (sums.agg(F.sum(n)).first()[0] or 0) / FREQUENT
    often, seldom = sums.where(col(n) > most).drop(n), sums.where(col(n) <= most).drop(n)
    same = col("label").eqNullSafe(col(of))
    looked_up = rows.join(F.broadcast(often), same, "left")
    found = looked_up.where(col(total).isNotNull()).drop(of)
    rest = rows.join(F.broadcast(often.select(of)), same, "left_anti")
    return found.unionByName(rest.join(seldom, same).drop(of))


def hex_code(code: Column | str) -> Column:
    """Two lowercase hex digits an entry, in the order of the parts."""
    return F.lower(F.array_join(F.transform(col(code), lambda c: F.lpad(F.hex(c), 2, "0")), ""))
