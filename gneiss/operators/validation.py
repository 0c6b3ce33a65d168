"""Structural checks of fields and graphs, look-ups, candidate scores and mutation suites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_up(key: Column, values: dict[str, object]) -> Column:
    """A registry's value for a key, null for unknown keys; registries are constants of a few entries."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def field_checks(grid: DataFrame) -> DataFrame:
    """One row: no observed cell lacks its value, the grid is a full rectangle, no cell repeats."""
    span = (F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1)
    known = F.col("value").isNotNull() & ~F.coalesce(F.isnan("value"), F.lit(False))
    return grid.agg(F.bool_and(~F.col("seen") | known).alias("finite_where_seen"), (F.count(F.lit(1)) == span).alias("dense"), (F.count(F.lit(1)) == F.count_distinct("i", "j")).alias("single"))


def graph_checks(edges: DataFrame) -> DataFrame:
    """One row: weights are symmetric, there are no self-loops. One full outer join of edges and reversed edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    both = edges.join(back, ["src", "dst"], "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.coalesce("w", F.lit(0.0)) == F.coalesce("back", F.lit(0.0))), F.lit(True)).alias("symmetric"),
                    F.coalesce(F.bool_and(F.col("src") != F.col("dst")), F.lit(True)).alias("loop_free"))


def candidate_scores(rows: DataFrame, parts: dict[str, Column], bounds: tuple[int, int], exclusions: list[Column]) -> DataFrame:
    """``subtotal``: sum of the parts less 100 for each exclusion; ``eligible``: none holds and all parts are in bounds."""
    hits = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(False)).cast("int") for x in exclusions), F.lit(0))
    within = reduce(lambda a, b: a & b, (F.coalesce(p.between(*bounds), F.lit(False)) for p in parts.values()), F.lit(True))
    total = reduce(lambda a, b: a + b, parts.values()) - 100 * hits
    return rows.withColumn("subtotal", total).withColumn("eligible", (hits == 0) & within)


def mutated(rows: DataFrame, changes: dict[str, dict[str, Column]], rules: dict[str, Column]) -> DataFrame:
    """Every row under every named change of some columns, with the codes of the rules that then hold."""
    every = [rows.select(F.lit(name).alias("mutation"), *(change.get(c, F.col(c)).cast(t).alias(c) for c, t in rows.dtypes)) for name, change in changes.items()]
    codes = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())))
    return reduce(DataFrame.union, every).withColumn("codes", F.array_join(codes, ";"))
