"""Robust statistics, exact tests and multiple-testing corrections on columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robust_scale_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``centre`` (median), ``mad`` and ``scale`` = 1.4826 * mad of a column; nulls don't count."""
    centres = rows.groupBy(*keys).agg(F.median(value).alias("centre"))
    spread = rows.join(centres, keys).groupBy(*keys).agg(F.first("centre").alias("centre"), F.median(F.abs(F.col(value) - F.col("centre"))).alias("mad"))
    return spread.withColumn("scale", 1.4826 * F.col("mad"))


def binomial_upper(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair coins (n <= 60, by products that stay exact in double up to there); null for n <= 0."""
    def term(acc: Column, j: Column) -> Column:
        choose = acc["choose"] * (n - j + 1) / j
        return F.struct(choose.alias("choose"), (acc["total"] + F.when(j >= k, choose).otherwise(0.0)).alias("total"))

    start = F.struct(F.lit(1.0).alias("choose"), F.when(k <= 0, 1.0).otherwise(0.0).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, term, lambda acc: acc["total"])
    return F.when(n > 0, total / F.pow(F.lit(2.0), n))


def two_sided_sign(positive: Column, negative: Column) -> Column:
    """Exact two-sided sign test; 1 where nothing is signed."""
    n = positive + negative
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_upper(F.greatest(positive, negative), n)))


def holm(rows: DataFrame, family: list[str], p: str, key: str, out: str = "holm_p") -> DataFrame:
    """Holm's step-down adjustment of ``p`` within ``family``; equal p go by ``key``; null p stay null and don't count."""
    known = F.col(p).isNotNull()
    order = Window.partitionBy(*family, known).orderBy(p, key)
    every = Window.partitionBy(*family, known)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1) * F.col(p))
    staged = rows.withColumn("_step", step)
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return staged.withColumn(out, F.when(known, running)).drop("_step")


def guarded_correlation(left: str, right: str, floor: float = 1e-12) -> Column:
    """Pearson correlation of pairs without nulls; null where a side's deviation is at most ``floor``."""
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    x, y = F.when(both, F.col(left)), F.when(both, F.col(right))
    return F.when((F.stddev_pop(x) > floor) & (F.stddev_pop(y) > floor), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a proportion."""
    p, n = successes / total, total.cast("double")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def tie_tolerance(value: Column) -> Column:
    """Differences up to this count as ties in permutation tests."""
    return F.greatest(F.lit(1e-10), F.abs(value) * 1e-10)
