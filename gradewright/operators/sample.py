"""Exact proportional stratified samples and disjoint splits.

NumPy's sampler cannot be repeated on a cluster. Rows are ordered by the md5 of
`key|seed` instead, so a sample depends on rows and seed only, not on the
partitioning. Rows are drawn singly: of rows that share a key, those whose other
columns hash lowest come first; rows that agree in all columns are alike. A NULL
key is an error.

A stratum may hold most of the rows, so no stratum is ever sorted or ranked:
* The sizes give the targets. Hashes are uniform, so the rows of lowest hash lie
  below a bound near target / size. Rows above it are dropped as they are read;
  what is left, about as many rows as asked for, is written out.
* The last hash of a sample lies between two such bounds. Tasks count the rows below
  the lower one and, by hash, the few between; a running sum over these tells the
  last hash. Drawing is then a projection: a row is in if its hash is below it.
* Rows that share the last hash share their key. Which of them are in is settled the
  same way by a hash of their other columns, and among equal rows by one of their
  ordinals, so not even a key that all rows have is gathered.
* Should a bound have missed, which the counts show, all rows are taken on, and the
  first digits of their hashes, counted, tell where the last one lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gradewright import fixed_values as fv
from gradewright.operators.stats import join_groups
from gradewright.session import cut_lineage, settle

HASH_RANGE_DIGITS = 4
BOUND_DIGITS = 12
FEW_ROWS = 10_000
FEW_STRATA = 1 << 16  # strata of one target that one window ranks
SPREAD = 1_024  # parts in which a window goes over strata that need no rank


def sampling_hash(key: Column | str, seed: Column | int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(key.cast("string"), F.lit("|"), seed.cast("string")))


def strata_counts(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))


def _sizes(df: DataFrame, strata: Sequence[str], key: str) -> DataFrame:
    """Stratum sizes and the number of their rows without a key, written."""
    return cut_lineage(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col(key).isNull()).alias("_nulls")))


def _no_nulls(n: int | None, key: str) -> None:
    if n:
        raise ValueError(f"{n} rows have no {key}; drop them or give them one before sampling")


def allocate(sizes: DataFrame, strata: Sequence[str], n: int | Column, by: Sequence[str] = (),
             whole_if_short: bool = False) -> DataFrame:
    """Rows to draw per stratum so that the targets sum to n.

    The target is the rounded proportional share. Whatever rounding leaves over
    goes to the largest target; what it adds too much is taken from the largest
    targets, one by one, always from the currently largest. Ties go to the larger
    stratum, then to the smaller key.

    Taking units that way lowers the largest targets to a common level, like water. The
    level follows from how many strata there are of each size. Different sizes are
    few, at most the root of twice the rows, so their counts fit the driver; strata may be
    any number. Only the strata of one target may have to be ranked, see `_places`.

    `sizes` has one row per stratum. `by` allocates several tables at once, a
    handful; `whole_if_short` targets every row where there are fewer than n.
    """
    return _allocated(cut_lineage(sizes), strata, n, by, whole_if_short)[0]


def _level(sizes: Sequence[tuple[int, int]], n: int) -> dict[str, int | None]:
    """How targets differ from rounded shares, from the numbers of strata of each size.

    Targets above `level` come down to it and to `even` below. Of the strata in
    descending order the first ones then differ by `more`: all with a share above
    `cross`, and `need` of the `there` whose share is `cross`. `asked` is the number of
    strata with a target above zero.
    """
    total = sum(size * m for size, m in sizes)
    shares: dict[int, int] = {}
    for size, m in sizes:
        share = round(size / total * n)
        shares[share] = shares.get(share, 0) + m
    down = sorted(shares.items(), reverse=True)
    surplus = sum(share * m for share, m in down) - n
    level, even, cross, need, there, more = None, 0, None, 0, 0, 0
    if surplus < 0:
        (cross, there), need, more = down[0], 1, -surplus
    elif surplus > 0:
        reached = above = 0
        for share, m in down:
            reached, above = reached + m, above + share * m
            # Units to take until all so far are as low as this share.
            if above - reached * share > surplus:
                break
            level, number, cost = share, reached, above - reached * share
        even, extra = divmod(surplus - cost, number)
        for share, m in down:
            if 0 < extra <= m:
                cross, need, there, more = share, extra, m, -1
            extra -= m
    asked = 0
    for share, m in down:
        base = level - even if level is not None and share >= level else share
        first = 0 if cross is None or share < cross else need if share == cross else m if more < 0 else 0
        asked += (m - first) * (base > 0) + first * (base + more > 0)
    return {"total": total, "level": level, "even": even, "cross": cross, "need": need, "there": there, "more": more, "asked": asked}


def _allocated(sizes: DataFrame, strata: Sequence[str], n: int | Column, by: Sequence[str] = (),
               whole_if_short: bool = False) -> tuple[DataFrame, "About"]:
    """Targets from a written table of sizes, and what is known of them."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    nulls = F.sum("_nulls") if "_nulls" in sizes.columns else F.lit(0)
    tables: dict[tuple, list] = {}
    for *group, size, asked, m, without in sizes.groupBy(*by, "size", n.alias("_n")).agg(F.count(F.lit(1)), nulls).collect():
        tables.setdefault((*group, asked), []).append((size, m, without))
    levels = [(*group, asked, *_level([(size, m) for size, m, _ in rows], asked).values()) for (*group, asked), rows in tables.items()]
    names = ("_n", "_total", "_level", "_even", "_cross", "_need", "_there", "_more", "_asked")
    if by:
        schema = ", ".join([*[f"`{b}` {sizes.schema[b].dataType.simpleString()}" for b in by], *[f"{c} bigint" for c in names]])
        known = join_groups(sizes, F.broadcast(sizes.sparkSession.createDataFrame(levels, schema)), by)
    else:
        known = sizes.withColumns({c: F.lit(v).cast("bigint") for c, v in zip(names, levels[0] if levels else [None] * len(names))})
    known = known.withColumn("_share", F.bround(F.col("size") / F.col("_total") * F.col("_n")).cast("bigint"))
    at = F.col("_share") == F.col("_cross")
    split = F.col("_need") < F.col("_there")
    most = max((there for *_, need, there, _, _ in levels if need < there), default=0)
    order = [F.desc("size"), *strata]
    if most > FEW_STRATA:
        known = known.where(~F.coalesce(at & split, F.lit(False))).withColumn("_place", F.lit(0).cast("bigint")).unionByName(
            _places(known.where(at & split), by, order))
    elif most:
        # Strata of other shares have places of their own, which are not looked at.
        key = F.when(at & split, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*strata), F.lit(SPREAD)))
        known = known.withColumn("_place", F.row_number().over(W.Window.partitionBy(*by, key).orderBy(*order)))
    else:
        known = known.withColumn("_place", F.lit(0))
    first = F.coalesce((F.col("_share") > F.col("_cross")) | at & (~split | (F.col("_place") <= F.col("_need"))), F.lit(False))
    differ = F.when(first & ((F.col("_more") < 0) | at), F.col("_more")).otherwise(0)
    lowered = F.when(F.col("_share") >= F.col("_level"), F.col("_level") - F.col("_even")).otherwise(F.col("_share"))
    target = lowered + differ
    if whole_if_short:
        target = F.when(F.col("_total") < F.col("_n"), F.col("size")).otherwise(target)
    every = [row for found in tables.values() for row in found]
    asked = sum(
        sum(m for _, m, _ in found) if whole_if_short and level[names.index("_total") - len(names)] < level[-len(names)] else level[-1]
        for found, level in zip(tables.values(), levels))
    about = About(sum(size * m for size, m, _ in every), sum(without for *_, without in every), asked)
    return known.select(*by, *strata, "size", target.cast("bigint").alias("target")), about


class About(NamedTuple):
    rows: int
    nulls: int  # rows without a key, where the sizes count them
    asked: int  # strata with a target above zero


def _places(rows: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """The rows with their `_place`, from 1, within each table of `by`, without a task per table.

    They are written in order, over all partitions, with an ordinal; a place follows
    from the ordinal and the numbers of rows in the partitions before.
    """
    sequence = [*by, *order]
    rows = cut_lineage(rows.repartitionByRange(*sequence).sortWithinPartitions(*sequence).withColumn("_o", F.monotonically_increasing_id()))
    part = F.shiftright("_o", 33)
    parts = rows.groupBy(*by, part.alias("_part")).agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.Window.partitionBy(*by).orderBy("_part")) - F.col("_rows")
    parts = parts.withColumn("_before", before).select(*[F.col(b).alias(f"_{b}_") for b in by], "_part", "_first", "_before")
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}_")) for b in by], part == F.col("_part"))
    placed = rows.join(parts, match).withColumn("_place", F.col("_before") + F.col("_o") - F.col("_first") + 1)
    return placed.select(*[c for c in rows.columns if c != "_o"], "_place")


def _null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on columns where NULL equals NULL; keeps the left columns."""
    renamed = right.select(*[F.col(c).alias(f"_{c}_") if c in columns else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in columns])
    return left.join(renamed, match).drop(*[f"_{c}_" for c in columns])


def with_hash(df: DataFrame, key: str, seed: Column | int) -> DataFrame:
    return settle(df, _hash=sampling_hash(key, seed))


def _bound(rows_wanted: Column, size: Column) -> Column:
    """The hash below which so many of a stratum's rows lie on average."""
    bits = F.greatest(F.least(rows_wanted / size, F.lit(1.0)), F.lit(0.0)) * F.lit(float(16**BOUND_DIGITS))
    text = F.lpad(F.lower(F.hex(F.ceil(bits).cast("bigint"))), BOUND_DIGITS, "0")
    # 'g' is above every hash.
    return F.when(rows_wanted >= size, "g").otherwise(text)


def _room(target: Column) -> Column:
    """Ten standard deviations of the number of rows below a bound, and more for small numbers."""
    return 10 * F.sqrt(target) + 100


def below_bound(rows: DataFrame, targets: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows whose hash may be among the lowest of their stratum: below the share
    asked for and ten standard deviations more. `_near` marks those that are not ten
    deviations below it either, `_target` is the number of rows to draw."""
    target = F.least("target", "size")
    bound, floor = _bound(target + _room(target), F.col("size")), _bound(target - _room(target), F.col("size"))
    wanted = targets.where(F.col("target") > 0).select(
        *strata, target.alias("_target"), bound.alias("_bound"), F.when(target > _room(target), floor).otherwise("").alias("_floor"))
    kept = _null_safe(rows, wanted, strata).where(F.col("_hash") < F.col("_bound"))
    return kept.withColumn("_near", F.col("_hash") >= F.col("_floor")).drop("_bound", "_floor")


def _last_hashes(shown: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Of each stratum its `_last` hash, how many rows of that hash are wanted (`_need`)
    and there (`_have`); NULL or no row where the rows shown do not tell.

    `shown` has `_target`, and as `_shown` the hash of rows near the last one, NULL for
    those surely below.
    """
    counts = shown.groupBy(*strata, "_target", "_shown").agg(F.count(F.lit(1)).alias("_n"))
    through = F.sum("_n").over(W.Window.partitionBy(*strata).orderBy(F.col("_shown").asc_nulls_first()))
    reached = counts.withColumn("_to", through).where(F.col("_to") >= F.col("_target"))
    first = reached.groupBy(*strata).agg(F.min(F.struct("_to", "_shown", "_n", "_target")).alias("_c"))  # sums ascend, so the first to reach it
    return first.select(*strata, F.col("_c._shown").alias("_last"),
                        (F.col("_c._target") - F.col("_c._to") + F.col("_c._n")).alias("_need"), F.col("_c._n").alias("_have"))


def _in_last_range(kept: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Hashes to show, told by exact counts of their first digits."""
    digits = F.substring("_hash", 1, HASH_RANGE_DIGITS)
    ranges = cut_lineage(_last_hashes(kept.select(*strata, "_target", digits.alias("_shown")), strata))
    near = _null_safe(kept.select(*strata, "_target", "_hash"), ranges.select(*strata, "_last"), strata).where(digits <= F.col("_last"))
    return near.select(*strata, "_target", F.when(digits == F.col("_last"), F.col("_hash")).alias("_shown"))


def take(rows: DataFrame, targets: DataFrame, strata: Sequence[str], key: str, asked: int) -> DataFrame:
    """The `target` rows of lowest hash per stratum, all if there are fewer. `rows`
    carries `_hash`; `targets` has target and size per stratum, `asked` of them above zero."""
    others = [c for c in rows.columns if c not in ("_hash", key)]
    # What tells rows of one key apart, and then equal rows; only those of a last hash are looked at.
    rest = F.md5(F.to_json(F.struct(F.lit(0).alias("k"), *others), {"ignoreNullFields": "false"}))
    return _lowest(rows, targets, strata, asked, [rest, F.md5(F.col("_ordinal").cast("string"))]).select(key, *others)


def _lowest(rows: DataFrame, targets: DataFrame, strata: Sequence[str], asked: int, then: Sequence[Column]) -> DataFrame:
    added = ("_target", "_near")

    def written(df: DataFrame) -> DataFrame:
        return cut_lineage(df if "_ordinal" in df.columns else df.withColumn("_ordinal", F.monotonically_increasing_id()))

    def told(shown: DataFrame) -> tuple[DataFrame, int, int]:
        last = cut_lineage(_last_hashes(shown, strata))
        found, tied = last.agg(F.count_if(F.col("_last").isNotNull()), F.count_if(F.col("_have") > F.col("_need"))).first()
        return last, asked - found, tied

    kept = written(below_bound(rows, targets, strata))
    last, missed, tied = told(kept.select(*strata, "_target", F.when(F.col("_near"), F.col("_hash")).alias("_shown")))
    if missed:
        every = targets.where(F.col("target") > 0).select(*strata, F.least("target", "size").alias("_target"), F.lit(True).alias("_near"))
        kept = written(_null_safe(rows, every, strata))
        last, _, tied = told(_in_last_range(kept, strata))
    columns = [c for c in kept.columns if c not in added]
    near = _null_safe(kept, last, strata)
    at = F.col("_hash") == F.col("_last")
    made = near.where((F.col("_hash") < F.col("_last")) | at & (F.col("_have") <= F.col("_need"))).select(*columns)
    if tied:
        equal = near.where(at & (F.col("_have") > F.col("_need"))).select(*columns).withColumn("_hash", then[0])
        again = last.where(F.col("_have") > F.col("_need")).select(*strata, F.col("_need").alias("target"), F.col("_have").alias("size"))
        made = made.unionByName(_lowest(equal, again, strata, tied, then[1:]))
    return made


def stratified_sample(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: int = fv.SEED) -> DataFrame:
    """n rows with the strata in proportion. A stratum smaller than its target
    gives all its rows, so the result may be short; see `shortfall`."""
    targets, about = _allocated(_sizes(df, strata, key), strata, n)
    _no_nulls(about.nulls, key)
    return take(with_hash(df, key, seed), targets, strata, key, about.asked)


def shortfall(allocation: DataFrame) -> DataFrame:
    """Rows asked for beyond what the strata hold."""
    return allocation.agg(
        F.sum("target").cast("bigint").alias("requested"),
        F.sum(F.least("target", "size")).cast("bigint").alias("drawn"),
        F.sum(F.greatest(F.col("target") - F.col("size"), F.lit(0))).cast("bigint").alias("short"),
    )


def hold_out(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: int = fv.SEED) -> tuple[DataFrame, DataFrame]:
    """Fixed test set of n rows and the remaining pool, disjoint by key. The test
    set is read from written tables, so passes over the pool do not draw it again.

    An undrawn row that shares its key with a drawn one is in neither; see
    `hold_out_report`.
    """
    targets, about = _allocated(_sizes(df, strata, key), strata, n)
    _no_nulls(about.nulls, key)
    if about.rows < n:
        raise ValueError(f"{about.rows} rows are fewer than the {n} asked for")
    test = take(with_hash(df, key, seed), targets, strata, key, about.asked)
    return test, df.join(test.select(key), key, "left_anti")


def hold_out_report(df: DataFrame, test: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of the whole, the test set and the pool, and those dropped since the
    test set has their key."""
    parts = [d.select(F.lit(n).alias("part")) for n, d in (("rows", df), ("test", test), ("pool", pool))]
    counts = reduce(DataFrame.unionAll, parts).groupBy().agg(*[F.count_if(F.col("part") == n).alias(n) for n in ("rows", "test", "pool")])
    return counts.withColumn("dropped", F.col("rows") - F.col("test") - F.col("pool"))


def training_sets(pool: DataFrame, sizes: Sequence[int], strata: Sequence[str], key: str, seed: int = fv.SEED,
                  name: str = "train_size") -> DataFrame:
    """Independent samples of several sizes in one table, told apart by `name`.

    Each size has its own seed, so the sets are not nested. A size the pool
    cannot fill gets the whole pool. All sizes are drawn in the same pass over the
    pool, after one that counts its strata.
    """
    wanted = F.explode(F.array(*[F.lit(int(s)) for s in sizes])).alias(name)
    groups = [name, *strata]
    sizes = _sizes(pool, strata, key).select("*", wanted)
    targets, about = _allocated(sizes, strata, F.col(name), [name], whole_if_short=True)
    _no_nulls(about.nulls, key)
    rows = with_hash(pool.select("*", wanted), key, F.col(name) + seed)
    return take(rows, targets.select(*groups, "size", "target"), groups, key, about.asked)


def random_split(df: DataFrame, key: str, share: float = fv.VALIDATION_SHARE, seed: int = fv.SEED,
                 name: str = "split") -> DataFrame:
    """Mark ceil(share x n) rows as validation, the others as train: the rows of
    lowest hash. The number is exact for unique keys; rows of one key stay
    together, so repeated ones may add the twins of the last.

    The last hash is narrowed down by counting its next digits, a pass per four
    digits, until few rows are left to choose from. Marking is a plain projection.
    """
    rows = with_hash(df, key, seed)
    total, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    _no_nulls(nulls, key)
    left = math.ceil(round(total * share, 6))
    if not left:
        return df.withColumn(name, F.lit("train"))
    prefix, size = "", total
    while len(prefix) < 32 and (not prefix or size > FEW_ROWS):
        digits = F.substring("_hash", len(prefix) + 1, HASH_RANGE_DIGITS).alias("d")
        # At most 16 ** HASH_RANGE_DIGITS counts.
        counts = rows.where(F.startswith("_hash", F.lit(prefix))).groupBy(digits).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(counts.collect()):
            if left <= r["n"]:
                prefix, size = prefix + r["d"], r["n"]
                break
            left -= r["n"]
    # Few rows, or rows of one hash, of which any is the last.
    last = rows.where(F.startswith("_hash", F.lit(prefix))).select("_hash").orderBy("_hash").limit(min(left, size, FEW_ROWS)).agg(F.max("_hash")).first()[0]
    return rows.withColumn(name, F.when(F.col("_hash") <= last, "validation").otherwise("train")).drop("_hash")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Number of keys that are in both sets; 0 if they are disjoint."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def split_sizes(df: DataFrame, split: str = "split", test: str = "test") -> DataFrame:
    """Rows per split, and the share each split has of itself plus the test set."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    tested = F.max(F.when(F.col(split) == test, F.col("n"))).over(W.Window.partitionBy())
    largest = F.max(F.when(F.col(split) != test, F.col("n"))).over(W.Window.partitionBy())
    other = F.when(F.col(split) == test, F.coalesce(largest, F.lit(0))).otherwise(F.coalesce(tested, F.lit(0)))
    return counts.withColumn("pct", F.try_divide(F.col("n") * 100.0, F.col("n") + other))
