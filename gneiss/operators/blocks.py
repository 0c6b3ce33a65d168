"""Block, lag and rolling statistics of panels. ``keys`` name one series; values are ordered by ``day_idx``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.robust import guarded_correlation

LEAST_BLOCKS = 30
LEAST_FRACTION = 0.8


def block_means(series: DataFrame, keys: list[str], sizes: list[int], *, phase: int = 0) -> DataFrame:
    """(keys, n, block, value): means of whole blocks of n days from ``phase``; null with under 80 % observed days.

    Every size is made from one pass: sums run along a series, and a block's is the one at its last day less what was
    before its first, so each day has a row only for the sizes whose blocks begin or end there. All later steps are
    partitioned as that pass is. Block numbers count from 0 and incomplete blocks are left out.
    """
    along = Window.partitionBy(*keys).orderBy("day_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = series.where(F.col("day_idx") >= phase).select(*keys, "day_idx", "value").select(
        *keys, (F.col("day_idx") - phase).alias("_d"), "value", F.coalesce(F.sum("value").over(along), F.lit(0.0)).alias("_sum"), F.count("value").over(along).alias("_seen"), F.count(F.lit(1)).over(along).alias("_days"))
    before = (F.col("_sum") - F.coalesce("value", F.lit(0.0)), F.col("_seen") - F.col("value").isNotNull().cast("long"), F.col("_days") - 1)

    def mark(n: int, total: Column, seen: Column, days: Column) -> Column:
        return F.struct(F.lit(n).cast("long").alias("n"), F.floor(F.col("_d") / n).alias("block"), total.alias("total"), seen.alias("seen"), days.alias("days"))

    begins = [F.when(F.col("_d") % n == 0, mark(n, *(-x for x in before))) for n in sizes]
    ends = [F.when(F.col("_d") % n == n - 1, mark(n, F.col("_sum"), F.col("_seen"), F.col("_days"))) for n in sizes]
    marks = rows.select(*keys, F.explode(F.array_compact(F.array(*begins, *ends))).alias("m")).select(*keys, "m.*")
    grouped = marks.groupBy(*keys, "n", "block").agg(F.count(F.lit(1)).alias("marks"), F.sum("days").alias("days"), F.sum("seen").alias("seen"), F.sum("total").alias("total"))
    whole = grouped.where((F.col("marks") == 2) & (F.col("days") == F.col("n")))
    return whole.select(*keys, "n", "block", F.when(F.col("seen") >= F.ceil(LEAST_FRACTION * F.col("n")), F.col("total") / F.nullif("seen", F.lit(0))).alias("value"))


def _next(keys: list[str], wrap: bool = False, order: str = "block", value: str = "value") -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    following = F.lead(value).over(w)
    if wrap:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) == 1
        first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return F.when(last, first).otherwise(following)
    return following


def block_persistence(series: DataFrame, keys: list[str], sizes: list[int], *, phase: int = 0, cyclic: bool = False, by_pairs: bool = False, compress: bool = False) -> DataFrame:
    """(keys, n, score): lag-1 correlation of consecutive block means, null where it isn't defined.

    At least 30 observed blocks are needed, or 30 pairs with ``by_pairs``. ``cyclic`` adds the pair (last, first).
    ``compress`` drops missing blocks before pairing instead of pairs that miss one.
    """
    blocks = block_means(series, keys, sizes, phase=phase)
    if compress:
        blocks = blocks.where(F.col("value").isNotNull())
    group = [*keys, "n"]
    paired = blocks.withColumn("next", _next(group, cyclic))
    pairs = F.count_if(F.col("value").isNotNull() & F.col("next").isNotNull())
    enough = pairs >= LEAST_BLOCKS if by_pairs else (F.count("value") >= LEAST_BLOCKS) & (pairs >= 2)
    return paired.groupBy(*group).agg(F.when(enough, guarded_correlation("value", "next")).alias("score"))


def rolling_persistence(series: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """(keys, n, score): lag-1 correlation of rolling n-day means with at least 80 % observed days, from 30 pairs."""
    rows = series.select(*keys, "day_idx", "value", F.explode(F.array(*(F.lit(n).cast("long") for n in sizes))).alias("n"))
    out = None
    for n in sizes:
        order = Window.partitionBy(*keys, "n").orderBy("day_idx")
        frame = order.rowsBetween(0, n - 1)
        mean = F.when((F.count(F.lit(1)).over(frame) == n) & (F.count("value").over(frame) >= F.ceil(F.lit(LEAST_FRACTION * n))), F.avg("value").over(frame))
        one = rows.where(F.col("n") == n).withColumn("value", mean).withColumn("next", F.lead("value").over(order))
        pairs = F.count_if(F.col("value").isNotNull() & F.col("next").isNotNull())
        scored = one.groupBy(*keys, "n").agg(F.when(pairs >= LEAST_BLOCKS, guarded_correlation("value", "next")).alias("score"))
        out = scored if out is None else out.union(scored)
    return out


def closure_error(series: DataFrame, keys: list[str], sizes: list[int], *, least_pairs: int = 365) -> DataFrame:
    """(keys, n, error): rms of x[t] - x[t + n] over rms of x; null with fewer pairs or a vanishing rms."""
    order = Window.partitionBy(*keys).orderBy("day_idx")
    ahead = series.select(*keys, "day_idx", "value", *(F.lead("value", n).over(order).alias(f"_a{n}") for n in sizes))
    long = ahead.select(*keys, "value", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.col(f"_a{n}").alias("ahead")) for n in sizes))).alias("e")).select(*keys, "value", "e.n", "e.ahead")
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    return long.groupBy(*keys, "n").agg(
        F.when((F.count(F.col("value") - F.col("ahead")) >= least_pairs) & (rms > 1e-12), F.sqrt(F.avg(F.pow(F.col("value") - F.col("ahead"), 2))) / rms).alias("error"))


def closure_winner(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, winner): the n with the least error, the smaller n on ties."""
    return errors.where(F.col("error").isNotNull()).groupBy(*keys).agg(F.min_by("n", F.struct("error", "n")).alias("winner"))


def winner_mode(winners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, winner, votes): the most frequent winner, the smaller on ties."""
    counts = winners.groupBy(*keys, "winner").agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct(-F.col("votes"), "winner"))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.winner").alias("winner"), (-F.col("b.col1")).alias("votes"))


def series_metrics(series: DataFrame, keys: list[str], size: int, *, phase: int = 0) -> DataFrame:
    """Mechanism metrics of each series' block means: variance, lag covariance and correlation, mean variance
    within blocks, adjacency of extreme blocks (10 % and 90 % of the daily values), mean run length about the
    median, rate of reversion to it, and blocks that cross a month's end. Null below 3 observed blocks."""
    blocks = block_means(series, keys, [size], phase=phase)
    paired = blocks.withColumn("next", _next(keys))
    both = F.col("value").isNotNull() & F.col("next").isNotNull()
    lagged = paired.groupBy(*keys).agg(
        F.count("value").alias("blocks"), F.var_pop("value").alias("block_variance"),
        F.covar_pop(F.when(both, F.col("value")), F.when(both, F.col("next"))).alias("lag_covariance"), guarded_correlation("value", "next").alias("lag_correlation"))
    inside = series.where(F.col("day_idx") >= phase).withColumn("block", F.floor((F.col("day_idx") - phase) / size))
    inside = inside.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("days"), F.count("value").alias("seen"), F.var_pop("value").alias("v"), (F.trunc(F.min("day"), "month") != F.trunc(F.max("day"), "month")).cast("long").alias("crosses"))
    inside = inside.where(F.col("days") == size).groupBy(*keys).agg(F.avg(F.when(F.col("seen") > 1, F.col("v"))).alias("within_variance"), F.sum("crosses").alias("month_crossings"))
    limits = series.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    centre = blocks.groupBy(*keys).agg(F.median("value").alias("centre"))
    seen = blocks.where(F.col("value").isNotNull()).join(limits, keys).join(centre, keys)
    order = Window.partitionBy(*keys).orderBy("block")
    seen = seen.withColumn("extreme", (F.col("value") <= F.col("q")[0]) | (F.col("value") >= F.col("q")[1])).withColumn("sign", F.col("value") >= F.col("centre")).withColumn("c", F.col("value") - F.col("centre"))
    seen = seen.select(*keys, "sign", (F.col("extreme") & F.lead("extreme").over(order)).alias("touch"), F.lag("sign").over(order).alias("was"), (F.col("c") * (F.lead("c").over(order) - F.col("c")) < 0).alias("back"))
    shape = seen.groupBy(*keys).agg(
        F.avg(F.col("touch").cast("double")).alias("extreme_adjacency"), (F.count(F.lit(1)) / F.count_if(F.col("was").isNull() | (F.col("was") != F.col("sign")))).alias("mean_run_length"), F.avg(F.col("back").cast("double")).alias("reversion_rate"))
    out = lagged.join(inside, keys).join(shape, keys)
    return out.where("blocks >= 3")


def phase_summary(scores: DataFrame) -> DataFrame:
    """From (parent, phase, score): by phase the median over parents, then the share of phases below 0, their spread and class."""
    medians = scores.groupBy("phase").agg(F.median("score").alias("m"))
    out = medians.agg(F.count(F.lit(1)).alias("phases"), F.avg((F.col("m") < 0).cast("double")).alias("fraction_negative"), F.stddev_pop("m").alias("phase_spread"))
    kind = F.when(F.col("fraction_negative") == 1, "ALL_NEGATIVE").when(F.col("fraction_negative") == 0, "ALL_NONNEGATIVE").otherwise("MIXED")
    return out.withColumn("phase_class", kind)


def calendar_alignment(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alignment, score): 7-day blocks from the first Monday, and lag correlations of month and year means."""
    first = series.where(F.weekday("day") == 0).groupBy(*keys).agg(F.min("day_idx").alias("monday"))
    shifted = series.join(first, keys).where(F.col("day_idx") >= F.col("monday")).withColumn("day_idx", F.col("day_idx") - F.col("monday")).drop("monday")
    out = block_persistence(shifted, keys, [7]).select(*keys, F.lit("week_aligned").alias("alignment"), "score")
    for label, unit in (("month_local", "month"), ("year_local", "year")):
        means = series.groupBy(*keys, F.trunc("day", unit).alias("block")).agg(F.avg("value").alias("value"))
        means = means.withColumn("next", _next(keys))
        out = out.union(means.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 2, guarded_correlation("value", "next")).alias("score")).select(*keys, F.lit(label).alias("alignment"), "score"))
    return out


def pairwise_correlation(series: DataFrame, key: str = "parent") -> DataFrame:
    """(left, right, r, days) of all pairs of series over days that both have.

    Equal days meet by a join on the day; partial sums by pair go over the exchange.
    """
    rows = series.where(F.col("value").isNotNull())
    other = rows.select("day_idx", F.col(key).alias("right"), F.col("value").alias("y"))
    joined = rows.select("day_idx", F.col(key).alias("left"), F.col("value").alias("x")).join(other, "day_idx")
    return joined.groupBy("left", "right").agg(guarded_correlation("x", "y").alias("r"), F.count(F.lit(1)).alias("days"))


def dependence(correlations: DataFrame) -> DataFrame:
    """Mean off-diagonal correlation, design-effect count n / (1 + (n - 1) max(rho, 0)), and effective rank
    (sum of eigenvalues squared over the sum of their squares = n^2 / sum of r^2 for a unit diagonal)."""
    out = correlations.agg(F.count_distinct("left").alias("parents"), F.avg(F.when(F.col("left") != F.col("right"), F.col("r"))).alias("mean_rho"), F.sum(F.col("r") * F.col("r")).alias("squares"))
    n = F.col("parents").cast("double")
    return out.select("parents", "mean_rho", (n / (1 + (n - 1) * F.greatest("mean_rho", F.lit(0.0)))).alias("effective_count"), (n * n / F.col("squares")).alias("effective_rank"))
