"""Exact top-k by inner product with a KD-tree per shard.

Rows are dealt into shards of bounded size. Each shard's tree splits at the median
of its widest dimension and keeps the tight box of every node. No vector in a box
has a larger product with q than the box's corner: q+ . hi + q- . lo. A search
opens subtrees best bound first, and only where a bound reaches the k-th best score so
far. A query first searches its own shard; the k-th score found there goes along to
all other shards, which prune by it from the start.

Queries are dealt into blocks of bounded size; a block meets every shard by an
equi-join on the shard's number.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewright.llm.common import col
from gradewright.session import cut_lineage

SHARD = 16_384  # rows of a shard, about
BLOCK = 2_048  # queries that meet a shard at once, about
LEAF = 64
STEP = 16  # leaves opened at once
K = 20


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Tree over the rows: `order` of rows, and of each node its box, its range in that order and its children (-1: leaf)."""
    order = np.arange(len(vectors))
    lo, hi, span, kids = [], [], [], []

    def node(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        me = len(lo)
        low, high = own.min(axis=0), own.max(axis=0)
        lo.append(low)
        hi.append(high)
        span.append((a, b))
        kids.append((-1, -1))
        if b - a > LEAF and (high > low).any():
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int((high - low).argmax())], m)]
            kids[me] = node(a, a + m), node(a + m, b)
        return me

    node(0, len(vectors))
    return {"order": order, "lo": np.array(lo), "hi": np.array(hi), "span": np.array(span), "kids": np.array(kids)}


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not a.size or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return a.astype(kind)
    return a


def exact(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest numbers that hold every sum of products exactly."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def search(tree: dict, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray,
           own: np.ndarray, bound: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query its best (scores, ids) in the shard, at most k, none below its bound.

    own: the queries' row numbers, which are no candidates. Equal scores go to smaller ids.

    All queries go through the tree together. Subtrees of STEP leaves are opened best
    bound first, by the mean over the queries. A query takes part in those with a leaf
    whose bound reaches its k-th best score so far, and one product gives the scores of
    all that do. Where boxes exclude nothing, this is a plain matrix product.
    """
    kind = exact(queries, np.concatenate((vectors, tree["lo"], tree["hi"])))
    q, v = queries.astype(kind), vectors[tree["order"]].astype(kind)
    ids, rows = ids[tree["order"]], rows[tree["order"]]
    leaves = np.flatnonzero(tree["kids"][:, 0] < 0)
    leaves = leaves[np.argsort(tree["span"][leaves, 0], kind="stable")]  # neighbours in the tree are neighbours here
    tops = np.maximum(q, 0) @ tree["hi"][leaves].T.astype(kind) + np.minimum(q, 0) @ tree["lo"][leaves].T.astype(kind)
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    kth = np.array([b if b > -(2**62) else least for b in bound], dtype=np.float64 if kind is not np.int64 else np.int64)
    found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]  # query, score, row

    def settle(parts: list[np.ndarray]) -> list[np.ndarray]:
        """The k best of each query, ties to smaller ids."""
        order = np.lexsort((ids[parts[2]], -parts[1], parts[0]))
        parts = [p[order] for p in parts]
        place = np.arange(len(order)) - np.searchsorted(parts[0], parts[0], side="left")
        return [p[place < k] for p in parts]

    groups = [leaves[a: a + STEP] for a in range(0, len(leaves), STEP)]
    means = [tops[:, a: a + STEP].max(axis=1).mean() for a in range(0, len(leaves), STEP)]
    for g in np.argsort(-np.array(means), kind="stable"):
        own_tops = tops[:, g * STEP: g * STEP + STEP]
        reached = own_tops >= kth[:, None]
        asked = np.flatnonzero(reached.any(axis=1))
        opened = groups[g][reached.any(axis=0)]
        if not len(asked):
            continue
        at = np.concatenate([np.arange(a, b) for a, b in tree["span"][opened]])
        scores = q[asked] @ v[at].T
        scores[own[asked, None] == rows[at]] = least
        bar = kth[asked]
        fresh = np.flatnonzero(bar == least)  # no bound yet: the k-th score of these leaves is one
        if len(fresh) and scores.shape[1] > k:
            bar[fresh] = np.partition(scores[fresh], scores.shape[1] - k, axis=1)[:, -k]
        new = np.nonzero((scores >= bar[:, None]) & (scores > least))
        found = settle([np.concatenate((f, n)) for f, n in zip(found, (asked[new[0]], scores[new].astype(np.int64), at[new[1]]))])
        last = np.searchsorted(found[0], np.arange(len(q)), side="right") - 1
        full = np.bincount(found[0], minlength=len(q)) == k
        kth[full] = np.maximum(kth[full], found[1][last[full]])
    of, scores, at = found
    ends = np.searchsorted(of, np.arange(len(q) + 1))
    return [(scores[a:b], ids[at[a:b]]) for a, b in zip(ends[:-1], ends[1:])]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of numbers; shorter ones are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    made = np.zeros((len(sizes), max(sizes, default=0)), dtype=np.int64)
    made[np.arange(made.shape[1]) < sizes[:, None]] = flat
    return made


def _padded(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and q, floor(64 * x) of every component, of the rows that take part."""
    x = col(vector)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    q = F.transform(x, lambda e: F.floor(F.lit(64.0) * e.cast("double")))
    return vectors.where(col(key).isNotNull() & x.isNotNull() & sound).select(col(key).cast("long").alias("id"), q.alias("q"))


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K,
            shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product.

    Queries are the rows whose key is divisible by `every`; candidates all rows but
    the query's own, repeated rows too. Equal scores go to the smaller key. Rows
    with a NULL key, a NULL vector, or a NULL or non-finite component take no part;
    a shorter vector counts as filled with zeros. Other columns are not read.
    """
    rows = cut_lineage(quantised(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    shards = max(1, -(-n // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    def plant(group: pa.Table) -> pa.Table:
        v = _matrix(group.column("q"))
        tree = build(v)
        file = io.BytesIO()
        arrays = {name: small(a) for name, a in tree.items()}
        np.savez(file, v=small(v), ids=group.column("id").to_numpy(), rows=group.column("row").to_numpy(), **arrays)
        return pa.table({"shard": group.column("shard")[:1], "tree": pa.array([file.getvalue()], pa.binary())})

    trees = cut_lineage(rows.groupBy("shard").applyInArrow(plant, "shard int, tree binary"))

    def seek(trees: pa.Table, asked: pa.Table) -> pa.Table:
        query, ids, scores = [], [], []
        if trees.num_rows and asked.num_rows:
            with np.load(io.BytesIO(trees.column("tree")[0].as_py())) as file:
                t = dict(file)
            q = _matrix(asked.column("q"))
            width = max(q.shape[1], t["v"].shape[1])
            for name in ("v", "lo", "hi"):
                t[name] = _padded(t[name].astype(np.int64), width)
            own = asked.column("row").to_numpy()
            bound = asked.column("bound").to_pylist()
            bound = [-(2**62) if b is None else b for b in bound]
            for me, (s, found) in zip(own, search(t, t["v"], t["ids"], t["rows"], _padded(q, width), own, bound, k)):
                query += [me] * len(s)
                scores.append(s)
                ids.append(found)
        flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.table({"row": pa.array(query, pa.int64()), "vec_id": pa.array(flat(ids), pa.int64()), "score": pa.array(flat(scores), pa.int64())})

    def met(queries: DataFrame, trees: DataFrame, *on: str) -> DataFrame:
        return trees.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(seek, "row long, vec_id long, score long")

    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    home = met(queries.withColumn("bound", F.lit(None).cast("long")), trees, "shard")
    home = home.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    home = cut_lineage(home.select(col("row").alias("of"), F.when(col("n") >= k, col("low")).alias("bound")))
    blocks = max(1, -(-n // (every * block)))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = queries.join(home, col("row") == col("of"), "left").select(
        "row", "q", "bound", F.pmod(F.hash("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(everywhere).alias("shard"))
    found = met(asked, trees.select("tree", "shard", F.explode(numbers).alias("block")), "shard", "block")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.select("*", place.alias("rank")).where(col("rank") <= k)
    names = queries.select(col("row").alias("of"), col("id").alias("query_id"))
    return ranked.join(names, col("row") == col("of")).select("query_id", col("rank").cast("int").alias("rank"), "vec_id", "score")
