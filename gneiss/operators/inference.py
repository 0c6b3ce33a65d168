"""Cells, surfaces and joint nulls: from observed and null scores to tests that keep parents apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.robust import binomial_upper, holm, robust_scale_of, tie_tolerance, two_sided_sign, wilson
from gneiss.operators.nulls import draw

LOCAL_ALPHA, FAMILY_ALPHA, UI_MIN, NSS_MIN = 0.05, 0.05, 0.5, 2.0


def _median_of(ordered: Column) -> Column:
    n = F.size(ordered)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


def parent_cells(scores: DataFrame, keys: list[str], children: int, *, score: str = "score") -> DataFrame:
    """Per cell, from the scores of child 0 (observed) and of its null children 1..``children``: observed score, null
    median and MAD, local p = (1 + #{null >= observed}) / (children + 1), robust z.

    A cell is eligible if its score and all its null scores are known; others have nulls and an issue code. A cell's
    null scores, at most ``children``, are gathered in one row, so scores are computed and exchanged once.
    """
    known = F.array_sort(F.collect_list(F.when(F.col("child") > 0, F.col(score))))
    cells = scores.groupBy(*keys).agg(F.max(F.when(F.col("child") == 0, F.col(score))).alias("observed"), known.alias("known"))
    cells = cells.withColumn("null_median", _median_of(F.col("known"))).withColumn("null_mad", _median_of(F.array_sort(F.transform("known", lambda x: F.abs(x - F.col("null_median"))))))
    cells = cells.withColumn("eligible", F.col("observed").isNotNull() & (F.size("known") == children))

    def count(test) -> Column:
        return F.size(F.filter("known", test)).cast("long")

    only = lambda c: F.when(F.col("eligible"), c)
    effect = F.col("observed") - F.col("null_median")
    return cells.select(
        *keys, "eligible", only(F.col("observed")).alias("observed"), only(F.col("null_median")).alias("null_median"), only(F.col("null_mad")).alias("null_mad"),
        only((count(lambda x: x >= F.col("observed")) + 1) / (children + 1)).alias("local_p"), only(effect / F.greatest(1.4826 * F.col("null_mad"), F.lit(1e-12))).alias("robust_z"),
        only((count(lambda x: x <= F.col("observed")) + 1) / (children + 1)).alias("lower_p"), only(count(lambda x: x < F.col("observed")) + 1).alias("rank"),
        F.when(F.col("eligible"), "").otherwise("CELL_NONFINITE_OR_INCOMPLETE_NULLS").alias("issue"))


def signed_cells(cells: DataFrame, keys: list[str], children: int) -> DataFrame:
    """Two-sided p, quantile (rank - 1/2) / (children + 1) and direction of eligible cells."""
    effect = F.col("observed") - F.col("null_median")
    return cells.where("eligible").select(
        *keys, "observed", effect.alias("effect"), F.col("robust_z").alias("signed_z"), F.abs("robust_z").alias("absolute_z"), F.col("local_p").alias("upper_p"), "lower_p",
        F.least(F.lit(1.0), 2 * F.least("local_p", "lower_p")).alias("two_sided_p"), "rank", ((F.col("rank") - 0.5) / (children + 1)).alias("null_quantile"),
        F.when(effect > 0, "POSITIVE").when(effect < 0, "NEGATIVE").otherwise("TIE").alias("direction"))


def surface(cells: DataFrame, family: list[str], *, least_parents: int = 10) -> DataFrame:
    """Per (family, n): eligible parents, UI (share with local p <= 0.05), NSS (median robust z), parents above
    their null median, exact sign p, Holm p over the family's n, and SEP (all thresholds met)."""
    ok = F.col("eligible")
    rows = cells.groupBy(*family, "n").agg(
        F.count_if(ok).alias("parents"), F.avg(F.when(ok, (F.col("local_p") <= LOCAL_ALPHA).cast("double"))).alias("ui"),
        F.median(F.when(ok, F.col("robust_z"))).alias("nss"), F.count_if(ok & (F.col("observed") > F.col("null_median"))).alias("positive"))
    rows = rows.withColumn("sign_p", binomial_upper(F.col("positive"), F.col("parents")))
    rows = holm(rows, family, "sign_p", "n")
    sep = (F.col("parents") >= least_parents) & (F.col("ui") >= UI_MIN) & (F.col("nss") >= NSS_MIN) & (F.col("holm_p") <= FAMILY_ALPHA)
    return rows.withColumn("sep", F.coalesce(sep, F.lit(False)))


def leave_one_out(cells: DataFrame, parents: DataFrame, family: list[str], *, least_parents: int = 10) -> DataFrame:
    """The surface without each parent in turn: (omitted, family, n, ...). The parents' table is small: one row each."""
    omitted = parents.select(F.col("parent").alias("omitted")).distinct()
    crossed = cells.join(omitted, F.col("parent") != F.col("omitted"))
    return surface(crossed, ["omitted", *family], least_parents=least_parents)


def bidirectional_separation(observed: DataFrame, nulls: DataFrame, *, family_size: int = 1) -> DataFrame:
    """One row: median paired effect, robustly standardised, against the medians over parents of each child index."""
    own = nulls.groupBy("parent").agg(F.median("score").alias("own"))
    paired = observed.join(own, "parent").select("parent", (F.col("score") - F.col("own")).alias("d"), F.lit(1).alias("one"))
    effect = robust_scale_of(paired, ["one"], "d").select("one", F.col("centre").alias("effect"), F.col("scale").alias("paired_scale"), F.col("mad").alias("paired_mad"))
    rest = nulls.join(own, "parent").select("child", (F.col("score") - F.col("own")).alias("d"), F.lit(1).alias("one"))
    pooled = robust_scale_of(rest, ["one"], "d").select("one", F.col("scale").alias("pooled_scale"))
    pseudo = rest.groupBy("one", "child").agg(F.median("d").alias("m")).join(effect, "one")
    tails = pseudo.groupBy("one").agg(F.count(F.lit(1)).alias("children"), F.count_if(F.col("m") >= F.col("effect")).alias("up"), F.count_if(F.col("m") <= F.col("effect")).alias("down"))
    count = paired.groupBy("one").agg(F.count(F.lit(1)).alias("parents"))
    eps = F.lit(2.220446049250313e-16)
    scale = F.when(F.col("paired_scale") <= eps, F.col("pooled_scale")).otherwise(F.col("paired_scale"))
    upper, lower = (F.col("up") + 1) / (F.col("children") + 1), (F.col("down") + 1) / (F.col("children") + 1)
    two = F.least(F.lit(1.0), 2 * F.least(upper, lower))
    return effect.join(pooled, "one").join(tails, "one").join(count, "one").select(
        "effect", upper.alias("upper_p"), lower.alias("lower_p"), two.alias("two_sided_p"), F.least(F.lit(1.0), two * max(1, family_size)).alias("familywise_p"),
        (F.col("effect") / F.greatest(scale, eps)).alias("standardized"), F.when(F.col("effect") > 0, "UPPER").when(F.col("effect") < 0, "LOWER").otherwise("ZERO").alias("direction"),
        F.col("parents"), (1.4826 * F.col("paired_mad") / F.sqrt("parents")).alias("uncertainty"), F.col("children").alias("pseudo_effects"))


def joint_null(observed: DataFrame, nulls: DataFrame, children: int, keys: list[str], *, replicates: int = 999, seed: str = "joint") -> DataFrame:
    """Per key: median over parents against medians of replicates that draw one child of each parent.

    Differences up to max(1e-10, |a| * 1e-10) are ties and count on both sides.
    """
    spark = observed.sparkSession
    draws = observed.select(*keys, "parent").crossJoin(F.broadcast(spark.range(1, replicates + 1).withColumnRenamed("id", "replicate")))
    draws = draws.withColumn("child", draw(children, seed, F.col("replicate"), F.col("parent")) + 1)
    joint = draws.join(nulls.select(*keys, "parent", "child", "score"), [*keys, "parent", "child"]).groupBy(*keys, "replicate").agg(F.median("score").alias("joint"))
    centre = observed.groupBy(*keys).agg(F.median("score").alias("observed"), F.count(F.lit(1)).alias("parents"))
    rows = joint.join(centre, keys) if keys else joint.crossJoin(F.broadcast(centre))
    one = keys or ["_one"]
    rows = rows if keys else rows.withColumn("_one", F.lit(1))
    tolerance = tie_tolerance(F.col("observed"))
    tails = rows.groupBy(*one).agg(
        F.first("observed").alias("observed"), F.first("parents").alias("parents"), F.count(F.lit(1)).alias("replicates"),
        F.count_if(F.col("joint") >= F.col("observed") - tolerance).alias("up"), F.count_if(F.col("joint") <= F.col("observed") + tolerance).alias("down"),
        F.percentile("joint", F.lit(0.025)).alias("q025"), F.percentile("joint", F.lit(0.975)).alias("q975"))
    spread = robust_scale_of(rows, one, "joint").select(*one, F.col("centre").alias("joint_median"), F.col("scale").alias("joint_scale"))
    upper, lower = (F.col("up") + 1) / (F.col("replicates") + 1), (F.col("down") + 1) / (F.col("replicates") + 1)
    return tails.join(spread, one).select(
        *keys, "observed", "joint_median", (F.col("observed") - F.col("joint_median")).alias("difference"), "joint_scale", "q025", "q975", upper.alias("upper_p"), lower.alias("lower_p"),
        F.least(F.lit(1.0), 2 * F.least(upper, lower)).alias("two_sided_p"), "parents", "replicates")


def channel_summary(nulls: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Null median, 2.5 % and 97.5 % quantiles, and the observed score less the median."""
    q = nulls.groupBy(*keys).agg(F.percentile("score", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.join(observed, keys).select(*keys, F.col("q")[0].alias("q025"), F.col("q")[1].alias("null_median"), F.col("q")[2].alias("q975"), (F.col("score") - F.col("q")[1]).alias("difference"))


def paired_deltas(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, delta): scores of one role less those of the other, child by child."""
    return left.select(*keys, F.col("score").alias("a")).join(right.select(*keys, F.col("score").alias("b")), keys).select(*keys, (F.col("a") - F.col("b")).alias("delta"))


def rates(outcomes: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Successes, trials, rate and Wilson's 95 % interval of a boolean column."""
    counts = outcomes.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("successes"), F.count(F.lit(1)).alias("trials"))
    low, high = wilson(F.col("successes").cast("double"), F.col("trials"))
    return counts.select(*keys, "successes", "trials", (F.col("successes") / F.col("trials")).alias("rate"), low.alias("wilson_low"), high.alias("wilson_high"))


def sign_tests(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Exact upper, lower and two-sided sign tests of a column's signs."""
    counts = rows.groupBy(*keys).agg(F.count_if(value > 0).alias("positive"), F.count_if(value < 0).alias("negative"))
    n = F.col("positive") + F.col("negative")
    return counts.select(*keys, "positive", "negative", binomial_upper(F.col("positive"), n).alias("upper_p"), binomial_upper(F.col("negative"), n).alias("lower_p"), two_sided_sign(F.col("positive"), F.col("negative")).alias("two_sided_p"))


def minimum_detectable(power: DataFrame, keys: list[str], effect: str, *, target: float = 0.8) -> DataFrame:
    """The least effect whose power reaches ``target``; null where none does."""
    return power.groupBy(*keys).agg(F.min(F.when(F.col("power") >= target, F.col(effect))).alias("minimum_effect"))
