"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash: every class that `simhash` links by fingerprints is a
bucket. It cannot find all pairs: at 0.8 fingerprints of 64 bits lie 10 bits apart on
average and up to 17, where balls hold most of what any index could keep apart. The
rest come from min-hashes in bands, a bucket each: texts of similarity 0.8 share one
with a chance of 0.9999, those above it sooner.

Buckets that share members are one group; what meets in a group is compared by the
whole sets of shingles, so that every link is exact, and a group gives no more links
than it has members. Groups above CELL shingles are taken apart into buckets again,
and buckets above it are dealt into cells in which any two members meet. Connected
components of the links follow as in `simhash`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import col
from gradewright.llm.simhash import components, fingerprint, reached, rows_of
from gradewright.session import cut_lineage

SHINGLE = 5
SIMILAR = (4, 5)  # as a fraction, so that the bound itself is exact
BANDS, ROWS = 24, 5
SEED = 42
CELL = 1 << 21  # shingles of a bucket that one task compares
MOST_BITS = 1 << 28

_RANDOM = np.random.default_rng(SEED)
ODD = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)


def shingles_of(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending.

    A-Z are lower-cased, words end at ASCII white space. Fewer words than a shingle
    has are one shingle, no word is none.
    """
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII rules only
    if not words:
        return np.array([], dtype="<u8")
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in parts], dtype="<u8"))


def bands_of(hashes: np.ndarray) -> list[int]:
    """A number for each band of min-hashes, none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype="<u8")
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[a: a + 512] ^ FLIP) * ODD).min(axis=1))
    made = [xxhash.xxh64_intdigest(least[b * ROWS: (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(made, dtype="<u8").view("<i8").tolist()


def sketch(text: Column) -> Column:
    """Of each text a number of its set of shingles, their count and the bands."""

    @F.arrow_udf("struct<set:long,n:int,bands:array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        import xxhash

        sets, sizes, bands = [], [], []
        for t in texts:
            hashes = shingles_of(t.as_py() or "")
            sets.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
            sizes.append(len(hashes))
            bands.append(bands_of(hashes))
        return pa.StructArray.from_arrays(
            [pa.array(np.array(sets, dtype="<u8").view("<i8")), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
            names=["set", "n", "bands"])

    return run(F.coalesce(text, F.lit("")))


def hashes(text: Column) -> Column:
    """The text's distinct shingle hashes, ascending, as bytes."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingles_of(t.as_py() or "").tobytes() for t in texts], pa.binary())

    return run(F.coalesce(text, F.lit("")))


def stars(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (places in the list) that connect all members of a chain of similar sets.

    One star per connected group. A member is compared only with those not yet
    connected, and of these only with sets whose size allows the similarity.
    """
    up, down = SIMILAR
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    out = []
    while len(left) > 1:
        head, left = int(left[0]), left[1:]
        waiting = [head]
        while waiting and len(left):
            own = sets[waiting.pop()]
            other = sizes[left]
            fit = (down * other >= up * len(own)) & (down * len(own) >= up * other)
            tried = left[fit]
            if not len(tried):
                continue
            flat = np.concatenate([sets[i] for i in tried])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            starts = np.concatenate(([0], np.cumsum(sizes[tried])[:-1]))
            shared = np.add.reduceat(hit.astype(np.int64), starts)
            met = tried[(up + down) * shared >= up * (len(own) + sizes[tried])]
            if len(met):
                left = left[~np.isin(left, met)]
                out += [(head, i) for i in met.tolist()]
                waiting += met.tolist()
    return out


def fingerprint_buckets(ids: DataFrame) -> DataFrame:
    """set, n and band: each class of `simhash`, by its root, with the sets of its texts. ids: set, n, fp.

    Texts of one set may differ in fingerprint, which counts repeats; such a set is in several classes.
    """
    prints = cut_lineage(ids.where("n > 0").select("set", "n", "fp").distinct())
    classes = reached(cut_lineage(prints.select("fp").distinct()))
    return prints.join(classes, "fp").select("set", "n", col("root").alias("band")).distinct()


def links(sets: DataFrame, alike: DataFrame, docs: DataFrame, key: str, text: str, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect similar sets. sets: set, n, bands and first (the row to read it from);
    alike: set, n and band of further buckets.

    Buckets that share a member are one group, found from numbers alone, so a set's
    shingles move once, however many buckets it is in. Only groups above `cell`
    shingles are taken bucket by bucket, and buckets above it by cells.
    """
    members = cut_lineage(sets.select("set", "n", F.explode("bands").alias("band")).unionByName(alike))
    held = members.groupBy("band").agg(F.count("*").alias("members"), F.min("set").alias("least")).where("members > 1")
    held = cut_lineage(held.select("band", "least"))
    chained = members.join(held, "band").where("set != least").select(col("set").alias("a"), col("least").alias("b")).distinct()
    groups = cut_lineage(components(chained).select(col("node").alias("set"), col("root").alias("own")))
    grouped = sets.select("set", "n", "first").join(groups, "set")
    large = cut_lineage(grouped.groupBy("own").agg(F.sum("n").alias("total")).where(col("total") > cell).select(col("own").alias("too_large")))
    grouped = cut_lineage(grouped.join(large, col("own") == col("too_large"), "left"))
    single = F.array(F.struct(col("own").alias("bucket"), F.lit(0).alias("cell")))
    dealt = grouped.where("too_large is null").select("set", single.alias("places"))
    if not large.isEmpty():
        apart = members.join(grouped.where("too_large is not null").select("set"), "set", "left_semi")
        dealt = dealt.unionByName(_places(apart, cell))
    wanted = grouped.join(dealt, "set").select("set", F.col("first.key").alias("of"), F.col("first.mark").alias("text_mark"), "places")
    wanted = cut_lineage(wanted)
    # Only texts that met another are read again.
    texts = docs.select(col(key).alias("key"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("mark"), col(text).alias("text"))
    texts = among(texts, "mark", wanted, "text_mark")
    read = texts.join(wanted, col("key").eqNullSafe(col("of")) & (col("mark") == col("text_mark")))
    read = read.select("set", "places", hashes(col("text")).alias("hashes")).select("set", "hashes", F.inline("places"))
    # A set and not a list: repeated rows give the same text again.
    buckets = read.groupBy("bucket", "cell").agg(F.collect_set(F.struct("set", "hashes")).alias("own")).where(F.size("own") > 1)

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def link(groups: pa.Array) -> pa.Array:
        offsets, a, b = [0], [], []
        for g in groups:
            names = g.values.field("set").to_pylist()
            for i, j in stars([np.frombuffer(x.as_py(), "<u8") for x in g.values.field("hashes")]):
                a.append(names[i])
                b.append(names[j])
            offsets.append(len(a))
        pairs = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    return buckets.select(F.inline(link("own"))).distinct()


def among(df: DataFrame, mark: str, wanted: DataFrame, wanted_mark: str, most: int = MOST_BITS) -> DataFrame:
    """The rows whose hash `mark` is wanted, and a few others: what a join would move for nothing goes before.

    One bit for each wanted hash in a bitmap of at most `most` bits, so what is broadcast
    is bounded, 32 MB by default. Where far more hashes are wanted than there are bits, most
    rows pass, and the join that follows decides alone. `wanted` is a table.
    """
    bits = min(most, max(1 << 15, 1 << (16 * wanted.count()).bit_length()))
    slot = lambda c: F.pmod(col(c), F.lit(bits))
    maps = wanted.groupBy(F.bitmap_bucket_number(slot(wanted_mark)).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot(wanted_mark))).alias("__bits"))
    maps = cut_lineage(maps)  # at most bits / 2 ** 15 rows of 4 KB
    place = F.bitmap_bit_position(slot(mark))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    held = df.join(F.broadcast(maps), F.bitmap_bucket_number(slot(mark)) == F.col("__bucket"))
    return held.where(met).select(*[col(c) for c in df.columns])


def _places(members: DataFrame, cell: int) -> DataFrame:
    """set and its places (bucket, cell): any two members of a bucket meet in a cell."""
    # Bands that hold the same sets are one bucket.
    held = members.groupBy("band").agg(
        F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("set")).alias("mixed"), F.min("set").alias("least"))
    held = held.where("members > 1").groupBy("members", "total", "mixed", "least").agg(F.min("band").alias("band"))
    parts = F.when(col("total") <= cell, 1).otherwise(F.ceil(2 * col("total") / cell)).cast("int")
    sizes = cut_lineage(held.select("band", parts.alias("k")))
    own = F.pmod(F.xxhash64("set"), col("k")).cast("int")
    every = F.sequence(F.lit(0), col("k") - 1)
    cells = F.transform(every, lambda j: F.struct(col("band").alias("bucket"), (F.least(own, j) * col("k") + F.greatest(own, j) + 1).alias("cell")))
    dealt = members.join(sizes, "band").select("set", F.explode(cells).alias("place"))
    return dealt.groupBy("set").agg(F.collect_list("place").alias("places"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """One row of each group of copies and near copies, with the columns of the input.

    The smallest key's row stays; among texts of that key the one of smallest
    hash, and of rows that agree in key and text any. A group without keys keeps
    the text of smallest hash. Texts without words, NULL included, are copies of
    each other.
    """
    ids = docs.select(
        col(key).alias("key"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("mark"), sketch(col(text)).alias("made"),
        fingerprint(text).alias("fp"))
    ids = cut_lineage(ids.select("key", "mark", "made.*", "fp"))
    place = F.struct(col("key").isNull().alias("none"), "key", "mark")
    sets = cut_lineage(ids.groupBy("set").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    roots = cut_lineage(components(links(sets, fingerprint_buckets(ids), docs, key, text, cell)))
    named = sets.select("set", "first").join(roots, col("set") == col("node"), "left")
    first = named.groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("first").alias("first"))
    return rows_of(docs, first, key, text)
