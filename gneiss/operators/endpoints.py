"""Endpoints of surfaces and traces. Emergence, survival and closure stay in columns of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous_runs(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, first, last, size) of every run of neighbouring rows where ``flag`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))
    marked = rows.withColumn("_island", island).where(F.col(flag))
    return marked.groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("size")).drop("_island")


def family_survival(surface: DataFrame, *, least_passes: int = 4) -> DataFrame:
    """(n, survives): the baseline separates and so do ``least_passes`` of the other conditions."""
    return surface.groupBy("n").agg(
        (F.max(F.when(F.col("condition") == "baseline", F.col("sep")).otherwise(False)) & (F.count_if((F.col("condition") != "baseline") & F.col("sep")) >= least_passes)).alias("survives"))


def population_endpoints(surface: DataFrame, *, least_parents: int = 10, least_passes: int = 4) -> DataFrame:
    """One row: T_e (least separated baseline n, null if none), size of the surviving region from T_e, S_e and
    AUC (shares of separated cells in the region and everywhere), longest surviving run, share of perturbed
    conditions that separate at T_e."""
    t_e = surface.where("condition = 'baseline'").agg(F.min(F.when(F.col("sep"), F.col("n"))).alias("t_e"))
    survive = family_survival(surface, least_passes=least_passes)
    runs = contiguous_runs(survive.withColumn("all", F.lit(1)), ["all"], "n", "survives")
    longest = runs.agg(F.coalesce(F.max("size"), F.lit(0)).alias("longest_run"))
    region = t_e.join(runs, F.col("first").isNotNull() & (F.col("t_e") >= F.col("first")) & (F.col("t_e") <= F.col("last")), "left").select("t_e", F.col("last").alias("region_end"))
    cells = surface.crossJoin(F.broadcast(region))
    inside = (F.col("n") >= F.col("t_e")) & (F.col("n") <= F.col("region_end"))
    counted = F.col("parents") >= least_parents
    out = cells.groupBy("t_e", "region_end").agg(
        F.count_distinct(F.when(inside, F.col("n"))).alias("region_size"),
        F.coalesce(F.avg(F.when(counted & inside, F.col("sep").cast("double"))), F.lit(0.0)).alias("s_e"),
        F.coalesce(F.avg(F.when(counted, F.col("sep").cast("double"))), F.lit(0.0)).alias("auc_sep"),
        F.avg(F.when((F.col("condition") != "baseline") & (F.col("n") == F.col("t_e")), F.col("sep").cast("double"))).alias("perturbation_survival"))
    return out.crossJoin(F.broadcast(longest)).select("t_e", "region_size", "s_e", "auc_sep", "longest_run", "perturbation_survival")


def parent_endpoints(cells: DataFrame, grid_size: int, *, alpha: float = 0.05, least_z: float = 2.0) -> DataFrame:
    """Per parent: T_e, the number of contiguous passing n from it, and their share of the grid (0 without T_e)."""
    flagged = cells.withColumn("passes", F.coalesce(F.col("eligible") & (F.col("local_p") <= alpha) & (F.col("robust_z") >= least_z), F.lit(False)))
    runs = contiguous_runs(flagged, ["parent"], "n", "passes")
    first = runs.groupBy("parent").agg(F.min_by(F.struct("first", "size"), "first").alias("r"))
    return cells.select("parent").distinct().join(first, "parent", "left").select(
        "parent", F.col("r.first").alias("t_e"), F.coalesce("r.size", F.lit(0)).cast("long").alias("contiguous"), (F.coalesce("r.size", F.lit(0)) / grid_size).alias("s_e"))


def trace_endpoints(trace: DataFrame, keys: list[str], *, similar: float) -> DataFrame:
    """From (keys, step, separated, similarity): emergence step, survival from it on, recovery step.

    A trace recovers at the first step whose similarity reaches ``similar`` if step 0 is below it; else null.
    """
    born = trace.groupBy(*keys).agg(
        F.min(F.when(F.col("separated"), F.col("step"))).alias("t_e"), F.min(F.when(F.col("similarity") >= similar, F.col("step"))).alias("back"),
        F.min_by("similarity", "step").alias("start"))
    alive = trace.join(born.select(*keys, "t_e"), keys).where(F.col("step") >= F.col("t_e")).groupBy(*keys).agg(F.avg(F.col("separated").cast("double")).alias("survival"))
    return born.join(alive, keys, "left").select(*keys, "t_e", F.coalesce("survival", F.lit(0.0)).alias("survival"), (F.col("start") < similar).alias("escaped"), F.when(F.col("start") < similar, F.col("back")).alias("recovery_step"))


def classify(points: DataFrame) -> DataFrame:
    """RECOVERED, ESCAPED, BOUNDED, NULL_LIKE or UNRESOLVED, the first that holds."""
    return points.withColumn("classification", F.when(F.coalesce("recovered", F.lit(False)), "RECOVERED").when(F.col("escaped"), "ESCAPED").when(F.col("bounded"), "BOUNDED").when(F.col("null_like"), "NULL_LIKE").otherwise("UNRESOLVED"))


def surface_deltas(surface: DataFrame) -> DataFrame:
    """UI and NSS of every perturbed cell less the baseline's at the same n."""
    base = surface.where("condition = 'baseline'").select("n", F.col("ui").alias("base_ui"), F.col("nss").alias("base_nss"))
    return surface.where("condition <> 'baseline'").join(base, "n").select("condition", "n", (F.col("ui") - F.col("base_ui")).alias("delta_ui"), (F.col("nss") - F.col("base_nss")).alias("delta_nss"))
