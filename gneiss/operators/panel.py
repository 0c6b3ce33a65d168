"""Parent-by-day panels: daily robust values, densification, month centring, scaling, perturbed conditions.

A panel has (parent, day_idx, day, value); a missing day is a row with a null value, never a NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.robust import robust_scale_of

MAD_TO_SIGMA = 1.4826
SCALE_FLOOR = 1e-12


def daily_log_medians(readings: DataFrame, *, min_count: int = 18) -> DataFrame:
    """(parent, day, value, n): median of ln(1 + x) of the finite readings of each day; null below ``min_count``."""
    finite = F.when(~F.isnan("reading") & (F.abs("reading") < float("inf")), F.col("reading"))
    logged = readings.select("parent", "day", F.log(1 + finite).alias("x"))
    return logged.groupBy("parent", "day").agg(F.count("x").alias("n"), F.median("x").alias("m")).select(
        "parent", "day", F.when(F.col("n") >= min_count, F.col("m")).alias("value"), "n")


def densify(daily: DataFrame) -> DataFrame:
    """Every parent on every calendar day between the first and last day of the table, indexed from 0.

    The spine has a row per calendar day and is made from one aggregate row, so its size is the calendar's.
    """
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = span.select("first", F.explode(F.sequence("first", "last")).alias("day")).select("day", F.datediff("day", "first").alias("day_idx"))
    spine = daily.select("parent").distinct().crossJoin(F.broadcast(days))
    return spine.join(daily, ["parent", "day"], "left").select("parent", F.col("day_idx").cast("long").alias("day_idx"), "day", "value")


def month_centred(panel: DataFrame) -> DataFrame:
    """Subtract each parent's month-of-year median (over observed days).

    The median is a window over the parent's days of that month, so the panel is computed once.
    """
    centre = F.median("value").over(Window.partitionBy("parent", F.month("day")))
    return panel.select("parent", "day_idx", "day", (F.col("value") - centre).alias("value"))


def scaled(panel: DataFrame) -> DataFrame:
    """Divide by 1.4826 times the median absolute deviation; null where that is at most 1e-12."""
    whole = Window.partitionBy("parent")
    spread = panel.withColumn("_c", F.median("value").over(whole)).withColumn("_s", MAD_TO_SIGMA * F.median(F.abs(F.col("value") - F.col("_c"))).over(whole))
    return spread.select("parent", "day_idx", "day", F.when(F.col("_s") > SCALE_FLOOR, F.col("value") / F.col("_s")).alias("value"))


def canonical(panel: DataFrame) -> DataFrame:
    """Month-centred, robustly scaled panel."""
    return scaled(month_centred(panel))


def canonical_audit(panel: DataFrame) -> DataFrame:
    """Per parent: observed days, their fraction, residual centre, MAD and robust scale of the centred panel."""
    centred = month_centred(panel)
    spread = robust_scale_of(centred, ["parent"], "value")
    counts = panel.groupBy("parent").agg(F.count("value").alias("observed_days"), (F.count("value") / F.count(F.lit(1))).alias("observed_fraction"))
    return counts.join(spread, "parent").select("parent", "observed_days", "observed_fraction", F.col("centre").alias("residual_centre"), F.col("mad").alias("residual_mad"), F.col("scale").alias("robust_scale"))


def eligibility(checks: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``eligible`` and ``reasons`` (codes of the rules that hold, joined by ``;``, in the order given)."""
    codes = F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items())))
    return checks.withColumn("reasons", F.array_join(codes, ";")).withColumn("eligible", F.size(codes) == 0)


def hourly_order(readings: DataFrame) -> DataFrame:
    """Per parent: rows, duplicate timestamps, and whether timestamps go up by exactly one hour."""
    order = Window.partitionBy("parent").orderBy("ts")
    gap = readings.select("parent", "ts", (F.col("ts") - F.lag("ts").over(order) == F.expr("INTERVAL '1' HOUR")).alias("step"))
    return gap.groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicates"),
        F.coalesce(F.bool_and("step"), F.lit(True)).alias("hourly"))


CONDITIONS = ("baseline", "scale_095", "scale_105", "outage_6h_30d", "outage_24h_90d", "day_swap_010")


def perturbed(readings: DataFrame, condition: str, *, seed: str = "swap") -> DataFrame:
    """One registered perturbation of (parent, day, day_idx, hour, reading).

    Calibration scales multiply; outages blank the first 6 or 24 hours of every 30th or 90th day; ``day_swap_010``
    exchanges a tenth of each parent's month's days in pairs drawn by md5 order.
    """
    if condition == "baseline":
        return readings
    if condition in ("scale_095", "scale_105"):
        return readings.withColumn("reading", F.col("reading") * F.lit(0.95 if condition == "scale_095" else 1.05))
    if condition in ("outage_6h_30d", "outage_24h_90d"):
        hours, every = (6, 30) if condition == "outage_6h_30d" else (24, 90)
        out = (F.col("day_idx") % every == 0) & (F.col("hour") < hours)
        return readings.withColumn("reading", F.when(~out, F.col("reading")))
    if condition == "day_swap_010":
        swaps = day_swaps(readings.select("parent", "day", "day_idx").distinct(), seed=seed)
        moved = readings.join(swaps, ["parent", "day_idx"], "left")
        return moved.withColumn("day", F.coalesce("to_day", "day")).withColumn("day_idx", F.coalesce("to_idx", "day_idx")).drop("to_day", "to_idx")
    raise ValueError(f"unregistered condition: {condition}")


def day_swaps(days: DataFrame, *, seed: str = "swap", fraction: float = 0.10) -> DataFrame:
    """(parent, day_idx, to_idx, to_day): disjoint pairs of days within each parent's year and month."""
    month = [F.col("parent"), F.trunc("day", "month")]
    order = Window.partitionBy(*month).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("parent").cast("string"), F.col("day_idx").cast("string"))))
    ranked = days.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*month)))
    chosen = ranked.where(F.col("place") < 2 * F.floor(F.lit(fraction) * F.col("n") / 2)).withColumn("pair", F.floor(F.col("place") / 2)).withColumn("month", F.trunc("day", "month"))
    other = chosen.select("parent", "month", "pair", F.col("place").alias("other_place"), F.col("day_idx").alias("to_idx"), F.col("day").alias("to_day"))
    return chosen.join(other, ["parent", "month", "pair"]).where("place <> other_place").select("parent", "day_idx", "to_idx", "to_day")


def without_common_factor(panel: DataFrame) -> DataFrame:
    """Subtract the mean over parents of each day."""
    mean = F.avg("value").over(Window.partitionBy("day_idx"))
    return panel.withColumn("value", F.col("value") - mean)


def year_month_residual(panel: DataFrame) -> DataFrame:
    """Subtract each parent's median of each calendar month."""
    medians = panel.groupBy("parent", F.trunc("day", "month").alias("month")).agg(F.median("value").alias("centre"))
    return panel.withColumn("month", F.trunc("day", "month")).join(medians, ["parent", "month"]).select("parent", "day_idx", "day", (F.col("value") - F.col("centre")).alias("value"))


def climatology_ar1(panel: DataFrame, *, train_fraction: float = 0.75) -> DataFrame:
    """Per parent: AR(1) coefficient around the training months' medians, and test RMSE of that model, of the
    climatology alone and of the training mean."""
    n = panel.groupBy("parent").agg(F.count(F.lit(1)).alias("n_days"))
    marked = panel.join(n, "parent").withColumn("train", F.col("day_idx") < F.floor(F.lit(train_fraction) * F.col("n_days"))).withColumn("season", F.month("day"))
    climate = marked.where("train").groupBy("parent", "season").agg(F.median("value").alias("climate"))
    order = Window.partitionBy("parent").orderBy("day_idx")
    rows = (marked.join(climate, ["parent", "season"], "left").withColumn("c", F.col("value") - F.col("climate"))
            .withColumn("before", F.lag("c").over(order)))
    fitted = rows.where("train").groupBy("parent").agg(
        F.sum(F.col("before") * F.col("c")).alias("xy"), F.sum(F.when(F.col("c").isNotNull(), F.col("before") * F.col("before"))).alias("xx"), F.avg("value").alias("mean"))
    fitted = fitted.select("parent", F.when(F.col("xx") > 1e-12, F.col("xy") / F.col("xx")).otherwise(0.0).alias("phi"), "mean")
    scored = rows.where("not train").join(fitted, "parent").groupBy("parent").agg(
        F.first("phi").alias("phi"), F.count(F.col("c") - F.col("before")).alias("model_count"),
        F.sqrt(F.avg(F.pow(F.col("c") - F.col("phi") * F.col("before"), 2))).alias("model_rmse"),
        F.sqrt(F.avg(F.pow("c", 2))).alias("climate_rmse"), F.sqrt(F.avg(F.pow(F.col("value") - F.col("mean"), 2))).alias("mean_rmse"))
    return scored
