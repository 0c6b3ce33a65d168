"""Ordered ladders (ladder, pos from 1, value): coherence, similarity, harmonics, closure scores, nulls, trajectories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.nulls import draw, permuted_within

TWO_PI = 2 * math.pi


def neighbours(ladders: DataFrame, keys: list[str]) -> DataFrame:
    """Circular ``left`` and ``right`` neighbours of every position."""
    order = Window.partitionBy(*keys).orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ladders.select(*keys, "pos", "value",
                          F.coalesce(F.lag("value").over(order), F.last("value").over(whole)).alias("left"),
                          F.coalesce(F.lead("value").over(order), F.first("value").over(whole)).alias("right"))


def cyclic_coherence(ladders: DataFrame, keys: list[str]) -> DataFrame:
    """1 - mean |x[i+1] - x[i]| / (1.25 range), around the circle, clamped to [0, 1]; 0 below two items, 1 at range 0."""
    stats = neighbours(ladders, keys).groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg(F.abs(F.col("right") - F.col("value"))).alias("step"), (F.max("value") - F.min("value")).alias("range"))
    score = F.when(F.col("n") < 2, 0.0).when(F.col("range") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("step") / (1.25 * F.col("range")))))
    return stats.select(*keys, "n", score.alias("coherence"))


def similarity(ladders: DataFrame, parents: DataFrame, keys: list[str], parent_key: str) -> DataFrame:
    """exp(-rms(x - parent) / max(population deviation of parent, 1e-9)) of ladders against their parent's positions."""
    joined = ladders.join(parents.select(parent_key, "pos", F.col("value").alias("p")), [parent_key, "pos"])
    rms, spread = F.sqrt(F.avg(F.pow(F.col("value") - F.col("p"), 2))), F.stddev_pop("p")
    return joined.groupBy(*keys).agg(F.exp(-rms / F.greatest(spread, F.lit(1e-9))).alias("similarity"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(values), F.lit(0))


def _turned(v: Column) -> Column:
    """An array's circular right neighbours."""
    return F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))), F.slice(v, 1, 1))


def array_coherence(v: Column) -> Column:
    """``cyclic_coherence`` of a ladder held in one array."""
    spread = F.array_max(v) - F.array_min(v)
    step = _mean(F.zip_with(v, _turned(v), lambda a, b: F.abs(b - a)))
    return F.when(F.size(v) < 2, 0.0).when(spread == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - step / F.nullif(1.25 * spread, F.lit(0.0)))))


def array_deviation(v: Column) -> Column:
    """Population deviation of an array."""
    return F.transform(F.array(_mean(v)), lambda m: F.sqrt(_mean(F.transform(v, lambda x: (x - m) * (x - m)))))[0]


def array_similarity(v: Column, parent: Column, deviation: Column) -> Column:
    """``similarity`` of two ladders held in arrays, with the parent's deviation."""
    return F.exp(-F.sqrt(_mean(F.zip_with(v, parent, lambda a, b: (a - b) * (a - b)))) / F.greatest(deviation, F.lit(1e-9)))


def relaxed_array(v: Column, parent: Column, anchoring: Column) -> Column:
    """``relax`` of a ladder held in one array."""
    left = F.concat(F.slice(v, -1, 1), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))))
    smooth = F.zip_with(F.zip_with(left, _turned(v), lambda a, b: a + b), v, lambda x, y: (x + 2 * y) / 4)
    pulled = F.zip_with(smooth, parent, lambda x, p: (1 - anchoring) * x + anchoring * p)
    return F.zip_with(v, pulled, lambda x, y: 0.58 * x + 0.42 * y)


def harmonic_winner(ladders: DataFrame, keys: list[str], *, most: int = 12) -> DataFrame:
    """The frequency k = 1..min(12, n div 2) with the largest Fourier amplitude, the higher k on ties; null below 4 items."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = ladders.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.col("k") <= F.floor(F.col("n") / 2))
    angle = F.lit(-TWO_PI) * F.col("k") * (F.col("pos") - 1) / F.col("n")
    amplitude = F.sqrt(F.pow(F.sum(F.col("value") * F.cos(angle)), 2) + F.pow(F.sum(F.col("value") * F.sin(angle)), 2))
    waves = rows.groupBy(*keys, "k").agg(F.round(amplitude, 9).alias("amplitude"), F.first("n").alias("n"))
    best = waves.where("n >= 4").groupBy(*keys).agg(F.max(F.struct("amplitude", "k")).alias("b"))
    return ladders.select(*keys).distinct().join(best, keys, "left").select(*keys, F.col("b.k").cast("long").alias("winner"), F.col("b.amplitude").alias("amplitude"))


def with_sigma(ladders: DataFrame, sigma: Column) -> DataFrame:
    """omega = ln(value) and its deviation sigma / value, for positive values with sigma >= 0; others leave."""
    return ladders.withColumn("sigma", sigma).where((F.col("value") > 0) & (F.col("sigma") >= 0)).withColumn("omega", F.log("value")).withColumn("sigma_omega", F.col("sigma") / F.col("value"))


def chi(ladders: DataFrame, keys: list[str], omega: str = "omega") -> DataFrame:
    """Sum of omega[i] / i over positions from 1."""
    return ladders.groupBy(*keys).agg(F.sum(F.col(omega) / F.col("pos")).alias("chi"))


def closure_scores(chis: DataFrame, keys: list[str], window: tuple[int, int]) -> DataFrame:
    """|chi - 2 pi / N| for every N of the window."""
    grid = F.explode(F.sequence(F.lit(window[0]).cast("long"), F.lit(window[1]).cast("long")))
    return chis.withColumn("N", grid).select(*keys, "N", F.abs(F.col("chi") - TWO_PI / F.col("N")).alias("rms"))


def closure_winner(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Winner and runner-up by rms, the lower N on ties, and their margin."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rms", "N"))
    top = scores.withColumn("place", place).where("place <= 2")
    pick = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    return top.groupBy(*keys).agg(pick(1, "N").alias("winner"), pick(1, "rms").alias("winner_rms"), pick(2, "N").alias("runner"), pick(2, "rms").alias("runner_rms")).withColumn("margin", F.col("runner_rms") - F.col("winner_rms"))


def closed(winners: DataFrame, centre: int, least_margin: float) -> DataFrame:
    """Whether the winner is the centre with at least the margin."""
    return winners.withColumn("closed", (F.col("winner") == centre) & (F.col("margin") >= least_margin))


def null_ladders(ladders: DataFrame, children: int, *, seed: str = "ladder") -> DataFrame:
    """Children with each ladder's values permuted: (ladder, child, pos, value)."""
    return permuted_within(ladders, ["ladder"], "pos", [F.lit(0)], children, seed=seed)


def relax(ladders: DataFrame, parents: DataFrame, keys: list[str], parent_key: str, anchoring: float) -> DataFrame:
    """One step 0.58 v + 0.42 ((1 - a) (left + 2 v + right) / 4 + a parent)."""
    joined = neighbours(ladders, keys).join(parents.select(parent_key, "pos", F.col("value").alias("p")), [parent_key, "pos"])
    smooth = (F.col("left") + 2 * F.col("value") + F.col("right")) / 4
    return joined.select(*keys, "pos", (0.58 * F.col("value") + 0.42 * ((1 - anchoring) * smooth + anchoring * F.col("p"))).alias("value"))


def anchor(ladders: DataFrame, parents: DataFrame, parent_key: str, alpha: float) -> DataFrame:
    """(1 - alpha) x + alpha parent; unchanged for alpha <= 0."""
    if alpha <= 0:
        return ladders
    joined = ladders.join(parents.select(parent_key, "pos", F.col("value").alias("p")), [parent_key, "pos"])
    return joined.withColumn("value", (1 - alpha) * F.col("value") + alpha * F.col("p")).drop("p")


def hash_normal(*parts: Column | str | int) -> Column:
    """A standard normal number by Box and Muller from two hashed uniforms."""
    u = (draw(2**40, "u", *parts) + 0.5) / float(2**40)
    v = (draw(2**40, "v", *parts) + 0.5) / float(2**40)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(TWO_PI) * v)


def value_noise(ladders: DataFrame, epsilon: float, *, seed: str = "noise") -> DataFrame:
    """omega + epsilon sigma_omega times a hashed normal number of (ladder, pos)."""
    return ladders.withColumn("omega", F.col("omega") + epsilon * F.col("sigma_omega") * hash_normal(seed, F.col("ladder"), F.col("pos")))


def flips(states: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Number of neighbours that differ, of each key's states in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return states.withColumn("_next", F.lead(state).over(w)).groupBy(*keys).agg(F.count_if(F.col(state) != F.col("_next")).alias("flips"), F.count(F.lit(1)).alias("steps"))


def transitions(states: DataFrame, keys: list[str], order: list[str], state: str, group: list[str]) -> DataFrame:
    """Counts of (from, to) between neighbours, by group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = states.withColumn("to_state", F.lead(state).over(w)).where(F.col("to_state").isNotNull())
    return moved.groupBy(*group, F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("count"))


def last_of_phase(states: DataFrame, keys: list[str], phase: str, t: str, columns: list[str]) -> DataFrame:
    """The last row of each phase."""
    best = F.max_by(F.struct(*columns), F.col(t))
    return states.groupBy(*keys, phase).agg(best.alias("b")).select(*keys, phase, "b.*")


def trial_summary(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Escape rate, return rate given escape, conditional mean steps, mean and 90 % quantile of flips of
    (escaped, returned, escape_steps, return_steps, flips)."""
    escaped, returned = F.col("escaped"), F.col("escaped") & F.col("returned")
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(escaped).alias("escaped_count"), F.count_if(returned).alias("returned_count"), F.avg(escaped.cast("double")).alias("escape_rate"),
        F.avg(F.when(escaped, returned.cast("double"))).alias("return_rate"), F.avg(F.when(escaped, F.col("escape_steps"))).alias("mean_escape_steps"),
        F.avg(F.when(returned, F.col("return_steps"))).alias("mean_return_steps"), F.avg("flips").alias("mean_flips"), F.percentile("flips", F.lit(0.9)).alias("p90_flips"))


def minimum_audit(traces: DataFrame, keys: list[str], order: str, value: str, *, tolerance: float = 1e-10) -> DataFrame:
    """The minimum, how many coordinates tie with it, the first of them, and whether it sits on or next to an end."""
    w = Window.partitionBy(*keys)
    marked = traces.withColumn("_least", F.min(value).over(w)).withColumn("_low", F.min(order).over(w)).withColumn("_high", F.max(order).over(w))
    ties = marked.where(F.col(value) <= F.col("_least") + tolerance)
    return ties.groupBy(*keys).agg(
        F.min("_least").alias("minimum"), F.count(F.lit(1)).alias("tied"), F.min(order).alias("coordinate"),
        F.bool_or((F.col(order) == F.col("_low")) | (F.col(order) == F.col("_high"))).alias("boundary"),
        F.bool_or((F.col(order) == F.col("_low") + 1) | (F.col(order) == F.col("_high") - 1)).alias("next_to_boundary"))


def relative_curvature(traces: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """-(second difference of ln(value)) of interior coordinates, ranked from the largest (the lower coordinate on ties)."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = F.log(value)
    bend = traces.select(*keys, order, (-(F.lead(x).over(w) - 2 * x + F.lag(x).over(w))).alias("curvature")).where(F.col("curvature").isNotNull())
    return bend.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("curvature"), order)))


def joined_greedy(correlations: DataFrame, candidates: list[str], most: float) -> list[str]:
    """Names, in the order given, whose |r| with each one chosen before is at most ``most``. A handful of rows."""
    known = {(r.left, r.right): r.r for r in correlations.where(F.col("left").isin(candidates) & F.col("right").isin(candidates)).collect()}
    chosen: list[str] = []
    for name in candidates:
        if all(abs(known[(name, c)]) <= most for c in chosen):
            chosen.append(name)
    return chosen
