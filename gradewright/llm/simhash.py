"""SimHash near-dedup by multi-index hashing.

Fingerprints of at most three differing bits agree, up to one bit, on one of
their two halves. So each distinct fingerprint looks up, for either half, the 33
values within one bit in a table of all fingerprints by half, and whole
distances are verified where a value is met.

What meets at a value is linked within the bucket, and a bucket gives no more
links than it has members: a star per group of connected fingerprints, not its
pairs. Buckets above CELL members are dealt into cells in which every home
member meets every prober once, so no task holds an unbounded group. Connected
components of the links follow by star contraction, in written rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradewright.llm.common import col
from gradewright.session import cut_lineage

RADIUS = 3
SHINGLE = 3
SEED = 42
HALF = 32
CELL = 1 << 16  # members of a bucket that one task links


def fingerprint_of(text: str) -> int:
    """64-bit SimHash of a text's 3-word shingles, as a signed number.

    A-Z are lower-cased, words end at ASCII white space, repeats count. Fewer
    than three words are one shingle, no word is fingerprint 0.
    """
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a: a + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column | str) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py() or "") for t in texts], pa.int64())

    return run(F.coalesce(col(text), F.lit("")))


def hex_of(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(col(fp)), 16, "0"))


def stars(members: np.ndarray, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Links that connect all members of a chain of distances up to `radius`.

    One star per connected group. A member is compared only with those not yet
    connected, so a dense group takes few passes.
    """
    left = np.unique(members).view(np.uint64)
    heads, others = [], []
    while len(left) > 1:
        head, left = left[0], left[1:]
        waiting = [head]
        while waiting and len(left):
            near = np.bitwise_count(left ^ waiting.pop()) <= radius
            if near.any():
                met, left = left[near], left[~near]
                heads += [int(head.view(np.int64))] * len(met)
                others += met.view(np.int64).tolist()
                waiting += list(met)
    return heads, others


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column fp) within RADIUS."""
    upper = F.shiftrightunsigned(col("fp"), HALF)
    lower = col("fp").bitwiseAND(F.lit((1 << HALF) - 1)).bitwiseOR(F.lit(1 << HALF))
    halves = F.array(upper, lower)
    flips = F.array(*[F.lit(1 << b) for b in range(HALF)])
    balls = F.flatten(F.transform(halves, lambda h: F.transform(flips, lambda f: h.bitwiseXOR(f))))
    home = fps.select(F.explode(halves).alias("key"), "fp", F.lit(True).alias("home"))
    probes = fps.select(F.explode(balls).alias("key"), "fp", F.lit(False).alias("home"))
    # Most of a ball's values are nobody's; only those met go on.
    met = probes.join(home.select("key"), "key", "left_semi")
    members = cut_lineage(home.unionByName(met))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut_lineage(sizes.select("key", F.ceil(col("n") / cell).cast("int").alias("k")))
    dealt = members.join(sizes, "key")
    # k x k cells: a home member takes a row of them, a prober a column.
    own = F.pmod(F.xxhash64("fp"), col("k")).cast("int")
    every = F.sequence(F.lit(0), col("k") - 1)
    cells = F.when(col("home"), F.transform(every, lambda j: own * col("k") + j)).otherwise(
        F.transform(every, lambda i: i * col("k") + own))
    # Home members meet each other as well: they probe, too, at distance 0.
    also = F.when(col("home") & (col("k") > 1), F.concat(cells, F.transform(every, lambda i: i * col("k") + own))).otherwise(cells)
    buckets = (
        dealt.select("key", "fp", F.explode(F.array_distinct(also)).alias("cell"))
        .groupBy("key", "cell").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    )

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def link(groups: pa.Array) -> pa.Array:
        offsets, a, b = [0], [], []
        for g in groups:
            heads, others = stars(np.array(g.values.to_numpy(zero_copy_only=False), dtype=np.int64))
            a += heads
            b += others
            offsets.append(len(a))
        pairs = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    return buckets.select(F.inline(link("fps"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of every node of the links (a, b), the smallest connected node: (node, root).

    Large and small stars in turn until nothing changes. A hub's neighbours are
    never gathered: its minimum is an aggregate, written and joined back.
    """

    def star(pairs: DataFrame, kept: Column) -> DataFrame:
        lowest = cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("m")))
        return pairs.where(kept).join(lowest, "u").select(col("v").alias("a"), F.least("m", "u").alias("b"))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut_lineage(edges.select("a", "b"))
    before = None
    while True:
        both = edges.select(col("a").alias("u"), col("b").alias("v")).union(edges.select(col("b"), col("a")))
        large = cut_lineage(star(both, col("v") > col("u")).where("a != b").distinct())
        # Every node, with its smaller neighbours.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(lowest, "u").select(col("v").alias("a"), col("m").alias("b")).where("a != b")
        small = small.union(lowest.select(col("u").alias("a"), col("m").alias("b")))
        edges = cut_lineage(small.distinct())
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(col("a").alias("node"), col("b").alias("root"))
    return roots.unionByName(roots.select(col("root").alias("node"), "root").distinct())


def reached(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) with root, the smallest one that a chain of links reaches."""
    roots = cut_lineage(components(links(fps.select("fp"))))
    return fps.join(roots, col("fp") == col("node"), "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))


def labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark (a hash of the text), fp, component_id and root, the component's
    smallest fingerprint; a written table of numbers, without the texts."""
    ids = cut_lineage(docs.select(
        col(key).alias("key"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("mark"), fingerprint(text).alias("fp")))
    fps = cut_lineage(ids.groupBy("fp").agg(F.min("key").alias("first")))
    linked = cut_lineage(reached(fps))
    named = cut_lineage(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    found = cut_lineage(linked.select("fp", "root").join(named, "root"))
    return ids.join(found, "fp")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, `fingerprint` (16 hex digits) and `component_id` of every row.

    The component is named by its smallest key; NULL keys do not name one, so it
    is NULL where no row of a component has a key. NULL texts count as empty;
    texts without words share fingerprint 0 and link like any other. Repeated rows
    fall into one component and stay repeated. Other columns are not read.
    """
    return labelled(docs, key, text).select(col("key").alias(key), hex_of("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of the input.

    The smallest key's row stays; among texts of that key the one of smallest
    hash, and of rows that agree in key and text any. A component without keys
    keeps the text of smallest hash.
    """
    place = F.struct(col("key").isNull().alias("none"), "key", "mark")
    return rows_of(docs, labelled(docs, key, text).groupBy("root").agg(F.min(place).alias("first")), key, text)


def rows_of(docs: DataFrame, first: DataFrame, key: str, text: str) -> DataFrame:
    """One input row for each key and mark in the column `first`."""
    first = cut_lineage(first.select(F.xxhash64("first.key").alias("of"), F.col("first.mark").alias("text_mark")))
    held = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), F.xxhash64(col(key)).alias("key"),
        F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("mark"))
    kept = held.join(first, (col("key") == col("of")) & (col("mark") == col("text_mark")))
    # Texts move once: both steps go by the same two numbers, so rows are together for both.
    rank = F.row_number().over(Window.partitionBy("key", "mark").orderBy(F.lit(0)))
    return kept.withColumn("rank", rank).where("rank = 1").select("row.*")
