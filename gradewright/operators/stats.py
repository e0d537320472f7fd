"""Counts, rates, summary statistics, percentiles and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gradewright import fixed_values as fv
from gradewright.functions.grades import is_number, tier, tier_names
from gradewright.functions.text import col
from gradewright.session import cut_lineage


def share(part: Column, whole: Column) -> Column:
    """Percentage, NULL on an empty whole."""
    return F.try_divide(part * 100.0, whole)


# --- counts ------------------------------------------------------------------

def count_by(df: DataFrame, *by: str) -> DataFrame:
    """Rows per value and their percentage of all rows.

    The total is the sum of the counts as a scalar subquery, so neither the rows
    nor the counts are gathered in one task.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", share(F.col("n"), counts.agg(F.sum("n")).scalar()))


def count_listed(df: DataFrame, value: Column | str, listed: Sequence, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per listed value, zeros included, with the percentage of all rows of
    the group. One conditional count per listed value, so absent values need no
    join; rows with another value only add to the whole."""
    value = col(value)
    aggs = [F.count_if(value == v).alias(f"_{i}") for i, v in enumerate(listed)]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), *aggs)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(v).alias(name), F.col(f"_{i}").alias("n"))
            for i, v in enumerate(listed)
        ]
    )
    return wide.select(*by, "_all", F.explode(cells).alias("c")).select(
        *by, "c.*", share(F.col("c.n"), F.col("_all")).alias("pct")
    )


def verdict_rates(df: DataFrame, verdict: Column | str = "quality_verdict", by: Sequence[str] = ()) -> DataFrame:
    """Rows, PASS and FAIL with their percentages."""
    verdict = col(verdict)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.count_if(verdict == "PASS").alias("n_pass"),
        F.count_if(verdict != "PASS").alias("n_fail"),
    ).withColumn("pass_pct", share(F.col("n_pass"), F.col("n"))).withColumn(
        "fail_pct", share(F.col("n_fail"), F.col("n"))
    )


def mean_where(value: Column | str, condition: Column | None = None) -> Column:
    """Mean of the numbers among the rows that meet the condition."""
    value = col(value)
    usable = is_number(value) if condition is None else is_number(value) & condition
    return F.avg(F.when(usable, value))


def error_summary(df: DataFrame, text: Column | str = "prediction", length: Column | str | None = None,
                  mark: str = "ERROR") -> DataFrame:
    """Total, rows without and with the error mark, mean length of the former."""
    text = col(text)
    failed = F.coalesce(text.contains(mark), F.lit(False))
    size = F.length(text) if length is None else col(length)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed).alias("successful"),
        F.count_if(failed).alias("errors"),
        F.avg(F.when(~failed, size)).alias("mean_length"),
    )


def run_summary(df: DataFrame, status: str = "status", seconds: str = "processing_time",
                level: str = "priority_level") -> DataFrame:
    """Totals, mean time of successes and the level counts of one batch run."""
    good = F.col(status) == "success"
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("success"),
        F.count_if(F.col(status) == "error").alias("error"),
        mean_where(seconds, good).alias("mean_seconds"),
        *[F.count_if(good & (F.col(level) == k)).alias(f"level_{k}") for k in (5, 4, 3, 2, 1)],
    )


def distinct_counts(df: DataFrame, *columns: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column; `approximate` for HyperLogLog."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*by).agg(*[count(c).alias(f"n_{c}") for c in columns])


# --- tiers and levels --------------------------------------------------------

def tier_distribution(df: DataFrame, value: Column | str, by: Sequence[str] = (),
                      tiers: Sequence[tuple[str, float]] = fv.TIERS, lowest: str = fv.LOWEST_TIER) -> DataFrame:
    """Rows and percentage per tier, empty tiers included. NULL and NaN are in no
    tier but count as rows, so the shares may sum to less than 100."""
    return count_listed(df, tier(value, tiers, lowest), tier_names(tiers, lowest), "tier", by)


def tier_rollup(distribution: DataFrame, by: Sequence[str] = (),
                good: Sequence[str] = ("excellent", "good", "acceptable")) -> DataFrame:
    """Share of the acceptable tiers and of the others."""
    ok = F.col("tier").isin(*good)
    return distribution.groupBy(*by).agg(
        F.sum(F.when(ok, F.col("pct")).otherwise(0.0)).alias("acceptable_pct"),
        F.sum(F.when(ok, 0.0).otherwise(F.col("pct"))).alias("poor_pct"),
    )


def level_distribution(df: DataFrame, level: Column | str = "priority_level", by: Sequence[str] = (),
                       levels: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Rows and percentage per level, empty levels included."""
    return count_listed(df, level, levels, "level", by).drop("position")


def histogram(df: DataFrame, value: Column | str, width: int = 10, top: int = 200) -> DataFrame:
    """Counts in bins [lo, lo + width) from 0 to top; the last bin is closed.

    Every row also has `below` and `above`, the numbers of values outside.
    """
    value = col(value)
    bins = list(range(0, top, width))
    lo = F.when(value == top, bins[-1]).otherwise(F.floor(value / width) * width).cast("int")
    wide = df.agg(
        F.count_if(value < 0).alias("below"), F.count_if(value > top).alias("above"),
        *[F.count_if(lo == b).alias(f"_{b}") for b in bins],
    )
    cells = F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"_{b}").alias("n")) for b in bins])
    return wide.select(F.inline(cells), "below", "above")


# --- exact percentiles -------------------------------------------------------

def quantiles(value: Column, probabilities: Mapping[str, float], accuracy: int | None = None) -> Column:
    """Array of percentiles in one aggregate. Exact with linear interpolation by
    default, which holds every distinct value of a group: for values of bounded
    range, such as lengths, token counts or levels. `accuracy` switches to
    percentile_approx."""
    points = [float(p) for p in probabilities.values()]
    if accuracy is not None:
        return F.percentile_approx(value, points, accuracy)
    return F.percentile(value, points)


def spread(array: str, names: Sequence[str]) -> list[Column]:
    return [F.col(array)[i].alias(n) for i, n in enumerate(names)]


def number(value: Column | str) -> Column:
    """The value as a double, NULL for NaN."""
    value = col(value).cast("double")
    return F.when(is_number(value), value)


SKETCH = 800  # size of the quantile sketches; their ranks are off by less than 0.4 % of the numbers
MARGIN = 0.01  # of the numbers, to either side of a rank, that a bracket takes in
SMALL = 400  # numbers below which a group is its own bracket: there the margin is two places or less
FEW = 1 << 20  # different numbers among which a rank is looked up by a sorted window
PIECES = 64  # parts of a bracket that holds more


def percentiles(df: DataFrame, value: Column | str, probabilities: Mapping[str, float],
                by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, per group, for values of any
    range and groups of any size. Infinite values take part; a group without
    numbers has no row."""
    rows = cut_lineage(df.select(*by, number(value).alias("_0")))
    points = [float(p) for p in probabilities.values()]
    found = _ranked(rows, _sketched(rows, ["_0"], points, by), ["_0"], points, by)
    return found.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(probabilities)])


def _sketched(rows: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str], *aggs: Column) -> DataFrame:
    """Per group, written: the aggregates and, of each column, `_all` (its numbers) and
    `_bracket` (from, to, from, to ... for the points), told by a quantile sketch."""
    made = rows.groupBy(*by).agg(*aggs, *[F.count(c).alias(f"_all{c}") for c in columns],
                                 *[F.kll_sketch_agg_double(c, F.lit(SKETCH)).alias(f"_sketch{c}") for c in columns])

    def bracket(c: str) -> Column:
        near = [min(max(p + side * MARGIN, 0.0), 1.0) for p in points for side in (-1, 1)]
        found = lambda ranks: F.kll_sketch_get_quantile_double(f"_sketch{c}", F.array(*[F.lit(float(r)) for r in ranks]))
        n = F.col(f"_all{c}")
        return F.when(n >= SMALL, found(near)).when(n > 0, found([0, 1] * len(points)))

    return cut_lineage(made.withColumns({f"_bracket{c}": bracket(c) for c in columns}).drop(*[f"_sketch{c}" for c in columns]))


def _cells(rows: DataFrame, about: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str],
           wanted: DataFrame | None = None) -> DataFrame:
    """Counts of the numbers in each bracket, and in one row without a number of all below it.

    `_i` is the place of the column, `_j` that of the point. With `wanted`, whole
    groups are counted, for its (group, `_i`, `_j`) only.
    """
    near = join_groups(rows, about.select(*by, *[n + c for c in columns for n in ("_all", "_bracket")]), by)
    inside, below, held = [], {}, []
    for i, c in enumerate(columns):
        for j in range(len(points)):
            v, low, high = F.col(c), F.col(f"_bracket{c}")[2 * j], F.col(f"_bracket{c}")[2 * j + 1]
            inside.append((v.isNotNull() if wanted is not None else (v >= low) & (v <= high), _cell(i, j, f"_all{c}", v)))
            below[f"_below{i}_{j}"] = F.count_if(v < low)
            held.append(_cell(i, j, f"_all{c}", F.lit(None).cast("double"), F.col(f"_below{i}_{j}")))
    few = near.where(reduce(lambda a, b: a | b, [met for met, _ in inside]))
    cells = few.select(*by, F.explode(F.array_compact(F.array(*[F.when(met, cell) for met, cell in inside]))).alias("_c")).select(*by, "_c.*")
    if wanted is not None:
        cells = _of(cells, wanted, by)
    cells = cells.groupBy(*by, "_i", "_j", "_all", "_v").agg(F.sum("_n").alias("_n"))
    if wanted is None:
        counts = near.groupBy(*by).agg(*[F.max(f"_all{c}").alias(f"_all{c}") for c in columns], *[n.alias(k) for k, n in below.items()])
        cells = cells.unionByName(counts.select(*by, F.inline(F.array(*held))).where("_n > 0"))
    return cut_lineage(cells)


def _cell(i: int, j: int, n: str, value: Column, times: Column | None = None) -> Column:
    return F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.col(n).alias("_all"), value.alias("_v"),
                    (F.lit(1).cast("long") if times is None else times).alias("_n"))


def _of(cells: DataFrame, wanted: DataFrame, by: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Cells of the wanted (group, `_i`, `_j`), a NULL group being equal to itself, or all others by `left_anti`."""
    keys = [*by, "_i", "_j"]
    other = wanted.select(*[F.col(k).alias(f"_of{k}") for k in keys])
    return cells.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]), how)


def _places(point: Column, n: Column) -> tuple[Column, Column, Column]:
    """Places, from 0, of the two numbers that a percentile lies between, and the weight of the second."""
    at = point * (n - 1)
    low = F.floor(at)
    return low, F.least(low + 1, n - 1), at - low


def _ranked(rows: DataFrame, about: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str],
            few: int = FEW) -> DataFrame:
    """Percentiles of several columns: the group, `_i` (place of the column) and `_q`
    (array, one number per point). `rows` and `about` are tables.

    Bracketed selection. Sketches, merged from all tasks, told between which two
    numbers a rank lies for sure. One pass counts exactly what is below a bracket and,
    by number, the few percent inside, with map-side combining. A rank is then a
    running sum over one bracket. Brackets that hold more than `few` different
    numbers are narrowed first, and a bracket that missed its rank, which the counts
    show, is replaced by its whole group: the result is exact in any case.
    """
    point = F.element_at(F.array(*[F.lit(p) for p in points]), F.col("_j") + 1)
    low, high, weight = _places(point, F.col("_all"))
    keys = [*by, "_i", "_j"]

    def state(cells: DataFrame) -> DataFrame:
        below = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0))
        held = cells.groupBy(*keys).agg(F.max("_all").alias("_all"), below.alias("_below"), F.sum("_n").alias("_to"), F.count("_v").alias("_different"))
        return held.select("*", ((F.col("_below") > low) | (F.col("_to") <= high)).alias("_missed"))

    cells = _cells(rows, about, columns, points, by)
    while True:
        states = state(cells)
        missed, wide = states.agg(F.count_if("_missed"), F.count_if((F.col("_different") > few) & ~F.col("_missed"))).first()
        if missed:
            lost = cut_lineage(states.where("_missed"))
            cells = _of(cells, lost, by, "left_anti").unionByName(_cells(rows, about, columns, points, by, lost))
        elif wide:
            cells = _narrowed(cells, cut_lineage(states.where(F.col("_different") > few)), by, low, high)
        else:
            break
    through = W.Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    summed = cells.withColumn("_to", F.sum("_n").over(through)).where("_v is not null")
    ends = summed.groupBy(*keys).agg(
        F.min(F.when(F.col("_to") > low, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_to") > high, F.col("_v"))).alias("_b"), F.max(weight).alias("_t"))
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    value = F.when((t == 0) | (a == b), a).otherwise(a * (1 - t) + b * t)
    at = F.array_sort(F.collect_list(F.struct("_j", value.alias("_x"))))
    return ends.groupBy(*by, "_i").agg(F.transform(at, lambda s: s["_x"]).alias("_q"))


def _narrowed(cells: DataFrame, wide: DataFrame, by: Sequence[str], low: Column, high: Column) -> DataFrame:
    """The cells with the brackets of `wide` cut down to the parts that hold their ranks.

    A sketch of a bracket's different numbers cuts it into parts of about equal many;
    the exact counts of the parts tell which to keep.
    """
    keys = [*by, "_i", "_j"]
    same = lambda names: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in names])
    renamed = lambda df: df.select(*[F.col(k).alias(f"_of{k}") if k in keys else F.col(k) for k in df.columns])
    kept, held = _of(cells, wide, by, "left_anti"), _of(cells, wide, by)
    ranks = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    cuts = held.where("_v is not null").groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_s"))
    cuts = cut_lineage(cuts.select(*keys, F.kll_sketch_get_quantile_double("_s", ranks).alias("_cuts")))
    part = F.when(F.col("_v").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    dealt = cut_lineage(held.join(renamed(cuts), same(keys)).select(*held.columns, part.alias("_part")))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"), F.max("_all").alias("_all"))
    through = F.sum("_n").over(W.Window.partitionBy(*keys).orderBy("_part"))  # a row per part
    placed = sums.withColumns({"_to": through, "_from": through - F.col("_n")})
    holds = (F.col("_from") <= high) & (F.col("_to") > low) & (F.col("_part") >= 0)
    placed = placed.withColumn("_holds", holds)
    chosen = cut_lineage(placed.where("_holds").select(*keys, "_part"))
    inner = dealt.join(renamed(chosen).withColumnRenamed("_part", "_of_part"), same(keys) & (F.col("_part") == F.col("_of_part")), "left_semi").drop("_part")
    below = placed.where((F.col("_to") <= low) & ~F.col("_holds")).groupBy(*keys).agg(
        F.max("_all").alias("_all"), F.lit(None).cast("double").alias("_v"), F.sum("_n").alias("_n"))
    return cut_lineage(kept.select(*cells.columns).unionByName(inner.select(*cells.columns)).unionByName(below.select(*cells.columns)))


# --- summaries ---------------------------------------------------------------

STATISTICS = ("n", "mean", "std", "median", "min", "max", "q25", "q75", "invalid")
QUARTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def summary(df: DataFrame, value: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, population std, median, min, max, quartiles and the number of
    rows without a number, per group."""
    return summaries(df, {"": value}, by)


def summaries(df: DataFrame, values: Mapping[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """The statistics of several values side by side, each under its prefix.

    The groups and numbers are written once, so the input is evaluated once.
    """
    columns = {f"_{i}": prefix for i, prefix in enumerate(values)}
    rows = cut_lineage(df.select(*by, *[number(v).alias(c) for c, v in zip(columns, values.values())]))
    aggs = []
    for c, prefix in columns.items():
        v = F.col(c)
        found = {
            "n": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v),
            "invalid": F.count_if(v.isNull()),
        }
        aggs += [made.alias(prefix + n) for n, made in found.items()]
    points = list(QUARTILES.values())
    about = _sketched(rows, list(columns), points, by, *aggs)
    ranked = _ranked(rows, about, list(columns), points, by)
    wide = ranked.groupBy(*by).agg(*[
        F.max(F.when(F.col("_i") == i, F.col("_q")[j])).alias(prefix + name)
        for i, prefix in enumerate(values) for j, name in enumerate(QUARTILES)
    ])
    out = join_groups(about, wide, by)
    return out.select(*by, *[prefix + n for prefix in values for n in STATISTICS])


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two per-group results; a NULL group matches itself. Without groups the
    right one is a single row and becomes a scalar subquery."""
    if not by:
        row = right.select(F.struct(*right.columns)).scalar()
        return left.withColumn("_row", row).select("*", "_row.*").drop("_row")
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return left.join(renamed, match, "left").drop(*[f"__{c}" for c in by])


def length_summary(df: DataFrame, length: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, sample std, min and max of text lengths per split."""
    length = col(length)
    return df.groupBy(*by).agg(
        F.count(length).alias("n"),
        F.avg(length).alias("mean"),
        F.percentile(length, 0.5).alias("median"),
        F.stddev_samp(length).alias("std"),
        F.min(length).alias("min"),
        F.max(length).alias("max"),
    )


def token_percentiles(df: DataFrame, tokens: Column | str = "token_count", accuracy: int | None = None,
                      by: Sequence[str] = ()) -> DataFrame:
    """p5, p25, p50, p75, p95 and max of a count."""
    tokens = col(tokens)
    points = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    found = df.groupBy(*by).agg(quantiles(tokens, points, accuracy).alias("_q"), F.max(tokens).alias("max"))
    return found.select(*by, *spread("_q", list(points)), "max")


def calibrate(df: DataFrame, tokens: Column | str = "token_count", low: float = 0.05, high: float = 0.95) -> tuple[float, float]:
    """Token thresholds at two percentiles, to be passed to a guard."""
    row = df.agg(quantiles(col(tokens), {"low": low, "high": high}).alias("q")).first()
    return tuple(row["q"])


def cumulative_counts(df: DataFrame, tokens: Column | str = "token_count") -> DataFrame:
    """A written table of the different counts: `value`, the rows `below` it and `through` it, `n` of all.

    Any number of thresholds is then a look-up. The running sum goes over different
    counts, not over rows: as many as the longest text has tokens.
    """
    counts = df.select(col(tokens).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    through = F.sum("_n").over(W.Window.orderBy("value"))
    return cut_lineage(counts.select("value", (through - F.col("_n")).alias("below"), through.alias("through"), F.sum("_n").over(W.Window.partitionBy()).alias("n")))


def threshold_rejections(df: DataFrame, thresholds: Sequence[tuple[str, float, float]],
                         tokens: Column | str = "token_count") -> DataFrame:
    """Rows each candidate (name, low, high) would reject as too short or too long.

    One pass over the rows, whatever the number of candidates: each bound is
    attached to the last count below it, by a running maximum over counts and bounds.
    """
    known = cumulative_counts(df, tokens)
    named = [(i, name, float(low), float(high)) for i, (name, low, high) in enumerate(thresholds)]
    if not named:
        return known.sparkSession.createDataFrame([], "candidate string, low double, high double, too_short bigint, too_long bigint, n bigint")
    asked = known.sparkSession.createDataFrame(named, "_i int, candidate string, low double, high double")
    sides = asked.select("_i", F.inline(F.array(
        F.struct(F.col("low").alias("at"), F.lit(0).alias("side")), F.struct(F.col("high").alias("at"), F.lit(2).alias("side")))))
    # At equal numbers a lower bound comes before the count, an upper one after it.
    counts = known.select(F.lit(None).cast("int").alias("_i"), F.col("value").cast("double").alias("at"), F.lit(1).alias("side"), "through")
    both = sides.withColumn("through", F.lit(None).cast("bigint")).unionByName(counts)
    reached = F.coalesce(F.max("through").over(W.Window.orderBy("at", "side")), F.lit(0))
    found = both.withColumn("_rows", reached).where("_i is not null").groupBy("_i").agg(
        F.max(F.when(F.col("side") == 0, F.col("_rows"))).alias("too_short"), F.max(F.when(F.col("side") == 2, F.col("_rows"))).alias("_kept"))
    total = F.coalesce(known.agg(F.max("n")).scalar(), F.lit(0))
    return asked.join(found, "_i").withColumn("n", total).select(
        "candidate", "low", "high", "too_short", (F.col("n") - F.col("_kept")).alias("too_long"), "n")


def verdict_medians(df: DataFrame, values: Sequence[str], verdict: str = "quality_verdict") -> DataFrame:
    """Count and median of each value, PASS against FAIL."""
    found = summaries(df, {f"{v}_": v for v in values}, [verdict])
    kept = [F.col(f"{v}_{s}").alias(f"{n}_{v}") for n, s in (("n", "n"), ("median", "median")) for v in values]
    return found.select(verdict, *kept)
