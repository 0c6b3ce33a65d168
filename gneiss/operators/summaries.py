"""Counts, shares and gates of results: one aggregate or one expression each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.robust import binomial_upper

LEVELS = 2


def result_statistics(points: DataFrame, by: str, value: str) -> DataFrame:
    """Per class: points and mean value."""
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("points"), F.avg(value).alias(f"mean_{value}"))


def winner_histogram(rows: DataFrame, winner: str = "winner") -> DataFrame:
    """How often each winner occurs; rows without one don't count."""
    return rows.where(F.col(winner).isNotNull()).groupBy(winner).agg(F.count(F.lit(1)).alias("n"))


def p90(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The 90 % quantile by linear interpolation; infinity where there is no value."""
    return rows.groupBy(*keys).agg(F.coalesce(F.percentile(value, F.lit(0.9)), F.lit(float("inf"))).alias("p90"))


def method_metrics(rows: DataFrame, keys: list[str], truth: str, claim: str) -> DataFrame:
    """True and false positives, power, false rate and agreement of claims with the truth."""
    yes, said = F.col(truth), F.col(claim)
    return rows.groupBy(*keys).agg(
        F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.avg(F.when(yes, said.cast("double"))).alias("power"),
        F.avg(F.when(~yes, said.cast("double"))).alias("false_rate"), F.avg((said == yes).cast("double")).alias("agreement"))


def failure_fraction(rows: DataFrame, failed: Column, keys: list[str] | None = None) -> DataFrame:
    """Share of rows that failed."""
    return rows.groupBy(*(keys or [])).agg((F.count_if(failed) / F.count(F.lit(1))).alias("failure_fraction"))


def power(scores: DataFrame, keys: list[str], threshold: float, score: str = "score") -> DataFrame:
    """Share of known scores above a threshold, and their number."""
    return scores.groupBy(*keys).agg(F.avg((F.col(score) > threshold).cast("double")).alias("power"), F.count(score).alias("series"))


def magnitudes(grid: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Root of the sum of the components' squares by keys: a scalar for vectors."""
    total = reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in components))
    return grid.groupBy(*keys).agg(F.sqrt(F.sum(total)).alias("size"))


def comparator_pairs(errors: DataFrame, n: int) -> DataFrame:
    """Per other size: pairs of parents that have both, how often size ``n`` errs less, exact sign p. (parent, n, error)."""
    other = errors.where(F.col("n") != n).select("parent", "n", F.col("error").alias("other"))
    pairs = errors.where(F.col("n") == n).select("parent", "error").join(other, "parent")
    out = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("error") < F.col("other")).alias("better"))
    return out.withColumn("sign_p", binomial_upper(F.col("better"), F.col("pairs")))


def inventories(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Every key of some table, and whether each table has it: full outer joins of distinct keys."""
    marked = [t.select(key).distinct().withColumn(f"in_{name}", F.lit(True)) for name, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), marked)
    return joined.select(key, *(F.coalesce(f"in_{name}", F.lit(False)).alias(f"in_{name}") for name in tables))


def claim_ceiling(*levels: Column, most: int = LEVELS) -> Column:
    """The least of the levels that evidence, request and domain allow, and of the highest there is."""
    return F.least(*(x.cast("long") for x in levels), F.lit(most).cast("long"))


def applicable(*conditions: Column) -> Column:
    """Whether all conditions hold; an unknown one doesn't."""
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


def converted(value: Column, factor: float, digits: int = 9) -> Column:
    """A measurement in another unit; what isn't finite is null."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.round(value * factor, digits) + F.lit(0.0))
