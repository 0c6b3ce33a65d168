"""Panel queries: suppliers' line items as 12 parents, shipping days as days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.robust import robust_scale_of, wilson
from gneiss.operators import blocks, endpoints, inference, nulls, panel
from gneiss.plans.storage import stored
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

#: Null children of each parent, and block sizes.
CHILDREN, SIZES = 127, list(range(6, 15))

CTES = {
    "readings": "SELECT l_suppkey % 12 AS parent, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS reading FROM lineitem",
    "daily": "SELECT parent, day, count(reading) AS n, CASE WHEN count(reading) >= 1 THEN median(ln(1 + reading)) END AS value FROM readings GROUP BY 1, 2",
    "panel": """SELECT p.parent, CAST(d.day - f.first AS BIGINT) AS day_idx, d.day, daily.value FROM (SELECT DISTINCT parent FROM daily) p
      CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE) AS day) d
      CROSS JOIN (SELECT min(day) AS first FROM daily) f LEFT JOIN daily ON daily.parent = p.parent AND daily.day = d.day""",
    "centred": "SELECT parent, day_idx, day, value - median(value) OVER (PARTITION BY parent, month(day)) AS value FROM panel",
    "scales": "SELECT parent, centre, median(abs(value - centre)) AS mad FROM (SELECT *, median(value) OVER (PARTITION BY parent) AS centre FROM centred) GROUP BY 1, 2",
    "canonical": "SELECT c.parent, day_idx, day, CASE WHEN 1.4826 * mad > 1e-12 THEN value / (1.4826 * mad) END AS value FROM centred c JOIN scales s ON c.parent = s.parent",
}


def null_cte(children: int, source: str = "canonical", seed: str = "null") -> str:
    return f"""SELECT t.parent, t.child, t.day_idx, s.day, s.value AS value FROM
      (SELECT parent, child, day_idx, date_trunc('month', day) AS m, row_number() OVER (PARTITION BY parent, child, date_trunc('month', day) ORDER BY day_idx) AS k
       FROM {source}, (SELECT unnest(range(1, {children + 1})) AS child)) t JOIN
      (SELECT parent, child, day, value, date_trunc('month', day) AS m, row_number() OVER (PARTITION BY parent, child, date_trunc('month', day)
         ORDER BY md5(concat_ws('|', '{seed}', CAST(child AS VARCHAR), CAST(parent AS VARCHAR), CAST(day_idx AS VARCHAR))), day_idx) AS k
       FROM {source}, (SELECT unnest(range(1, {children + 1})) AS child)) s
      ON t.parent = s.parent AND t.child = s.child AND t.m = s.m AND t.k = s.k"""


CTES["nulls"] = null_cte(CHILDREN)
CTES["joined"] = "SELECT parent, 0 AS child, day_idx, value FROM canonical UNION ALL SELECT parent, child, day_idx, value FROM nulls"


def block_cte(source: str, keys: str, sizes: list[int], phase: str = "0") -> str:
    return f"""SELECT {keys}, n, block, CASE WHEN seen >= ceil(0.8 * n) THEN mean END AS value FROM (
      SELECT {keys}, n, (day_idx - {phase}) // n AS block, count(*) AS days, count(value) AS seen, avg(value) AS mean
      FROM {source}, (SELECT unnest({sizes}) AS n) WHERE day_idx >= {phase} GROUP BY ALL) WHERE days = n"""


def corr_sql(x: str, y: str) -> str:
    ok = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"CASE WHEN stddev_pop({x}) {ok} > 1e-12 AND stddev_pop({y}) {ok} > 1e-12 THEN covar_pop({y}, {x}) {ok} / (stddev_pop({x}) {ok} * stddev_pop({y}) {ok}) END"


def score_cte(source: str, keys: str, gate: str = "count(value) >= 30 AND count(CASE WHEN next IS NOT NULL THEN value END) >= 2") -> str:
    return f"SELECT {keys}, n, CASE WHEN {gate} THEN {corr_sql('value', 'next')} END AS score FROM (SELECT *, lead(value) OVER (PARTITION BY {keys}, n ORDER BY block) AS next FROM {source}) GROUP BY ALL"


CTES["blocks"] = block_cte("joined", "parent, child", SIZES)
CTES["scores"] = score_cte("blocks", "parent, child")


def cell_ctes(scores: str, children: int, keys: str = "parent, n") -> dict[str, str]:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    plain = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return {
        "paired": f"SELECT {plain}, a.score AS null_score, b.score AS observed FROM {scores} a JOIN {scores} b ON {on} AND b.child = 0 WHERE a.child > 0",
        "stats": f"""SELECT {keys}, first(observed) AS obs, count(null_score) AS known, median(null_score) AS med, count(*) FILTER (WHERE null_score >= observed) AS up,
           count(*) FILTER (WHERE null_score <= observed) AS down, count(*) FILTER (WHERE null_score < observed) AS below FROM paired GROUP BY {keys}""",
        "mads": f"SELECT {plain}, median(abs(null_score - med)) AS mad FROM paired a JOIN stats b ON {on} GROUP BY {plain}",
        "cells": f"""SELECT {plain}, ok AS eligible, CASE WHEN ok THEN obs END AS observed, CASE WHEN ok THEN med END AS null_median, CASE WHEN ok THEN mad END AS null_mad,
           CASE WHEN ok THEN (up + 1) / {children + 1}.0 END AS local_p, CASE WHEN ok THEN (obs - med) / greatest(1.4826 * mad, 1e-12) END AS robust_z,
           CASE WHEN ok THEN (down + 1) / {children + 1}.0 END AS lower_p, CASE WHEN ok THEN below + 1 END AS rank,
           CASE WHEN ok THEN '' ELSE 'CELL_NONFINITE_OR_INCOMPLETE_NULLS' END AS issue
           FROM (SELECT *, obs IS NOT NULL AND known = {children} AS ok FROM stats) a JOIN mads b ON {on}""",
    }


CTES |= cell_ctes("scores", CHILDREN)
SIGN_UPPER = "(SELECT sum(factorial(CAST({n} AS INTEGER)) / (factorial(CAST(j AS INTEGER)) * factorial(CAST({n} - j AS INTEGER)))) FROM range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1) t(j)) / pow(2.0, {n})"


def binomial_sql(k: str, n: str) -> str:
    """P(X >= k) from logarithms of factorials, which suits any engine."""
    return f"CASE WHEN {n} > 0 THEN coalesce(list_sum(list_transform(range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1), lambda j: exp(lgamma({n} + 1.0) - lgamma(j + 1.0) - lgamma({n} - j + 1.0) - {n} * ln(2.0)))), 0.0) END"


def surface_ctes(cells: str, family: str, least: int) -> dict[str, str]:
    return {
        "raw_surface": f"""SELECT {family}, n, count(*) FILTER (WHERE eligible) AS parents, avg(CASE WHEN eligible THEN CAST(local_p <= 0.05 AS DOUBLE) END) AS ui,
            median(robust_z) FILTER (WHERE eligible) AS nss, count(*) FILTER (WHERE eligible AND observed > null_median) AS positive FROM {cells} GROUP BY {family}, n""",
        "tested": f"SELECT *, {binomial_sql('positive', 'parents')} AS sign_p FROM raw_surface",
        "stepped": f"SELECT *, least(1.0, (count(*) OVER (PARTITION BY {family}, sign_p IS NOT NULL) - row_number() OVER (PARTITION BY {family}, sign_p IS NOT NULL ORDER BY round(sign_p, 12), n) + 1) * sign_p) AS step FROM tested",
        "surface": f"""SELECT * EXCLUDE (step), coalesce(parents >= {least} AND ui >= 0.5 AND nss >= 2.0 AND holm_p <= 0.05, false) AS sep FROM (
            SELECT *, CASE WHEN sign_p IS NOT NULL THEN max(step) OVER (PARTITION BY {family}, sign_p IS NOT NULL ORDER BY round(sign_p, 12), n ROWS UNBOUNDED PRECEDING) END AS holm_p FROM stepped)""",
    }


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("parent"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("reading"))


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.densify(panel.daily_log_medians(readings(spark, sf_dir), min_count=1))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.canonical(day_panel(spark, sf_dir))


def with_nulls(series: DataFrame, children: int) -> DataFrame:
    observed = series.select("parent", F.lit(0).cast("long").alias("child"), "day_idx", "value")
    return observed.union(nulls.month_strata_nulls(series, children))


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = blocks.block_persistence(with_nulls(canonical(spark, sf_dir), CHILDREN), ["parent", "child"], SIZES)
    return inference.parent_cells(scores, ["parent", "n"], CHILDREN)


@query(with_ctes(CTES, "readings daily panel centred scales canonical nulls joined blocks scores paired stats mads cells", f"SELECT parent, CAST(n AS BIGINT) AS n, eligible, {r('observed', 'observed')}, {r('null_median', 'null_median')}, {r('local_p', 'local_p')}, {r('robust_z', 'robust_z', 4)} FROM cells"))
def flagship_block_persistence_null_test(spark, sf_dir):
    """Panel, canonicalization, 127 matched null children, block persistence at all sizes, local tests."""
    cells = cells_of(spark, sf_dir)
    return result(cells.select("parent", "n", "eligible", "observed", "null_median", "local_p", F.round("robust_z", 4).alias("robust_z")))


@query(with_ctes(CTES, "readings daily", f"SELECT parent, day, n, {r('value', 'value')} FROM daily"))
def ag9_daily_log_median(spark, sf_dir):
    return result(panel.daily_log_medians(readings(spark, sf_dir), min_count=1).select("parent", "day", "n", "value"))


@query(with_ctes(CTES, "readings daily panel", f"SELECT parent, day_idx, day, {r('value', 'value')} FROM panel"))
def wn1_dense_day_index(spark, sf_dir):
    return result(day_panel(spark, sf_dir))


@query(with_ctes(CTES, "readings daily panel centred", f"SELECT parent, day_idx, day, {r('value', 'value')} FROM centred"))
def ag10_month_centring(spark, sf_dir):
    return result(panel.month_centred(day_panel(spark, sf_dir)))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", f"SELECT parent, day_idx, day, {r('value', 'value')} FROM canonical"))
def ag11_canonical_scaling(spark, sf_dir):
    return result(canonical(spark, sf_dir))


@query(with_ctes(CTES, "readings daily panel centred scales", f"SELECT parent, {r('centre', 'centre')}, {r('mad', 'mad')}, {r('1.4826 * mad', 'scale')} FROM scales"))
def ag3_robust_scale(spark, sf_dir):
    return result(robust_scale_of(panel.month_centred(day_panel(spark, sf_dir)), ["parent"], "value"))


@query(with_ctes(CTES, "readings daily panel centred scales", """, checks AS (SELECT p.parent, count(p.value) AS observed_days, count(p.value) / count(*)::DOUBLE AS fraction, first(1.4826 * mad) AS scale FROM panel p JOIN scales s ON p.parent = s.parent GROUP BY 1)
SELECT parent, observed_days, round(fraction, 6) + 0.0 AS observed_fraction, reasons = '' AS eligible, reasons FROM (SELECT *, concat_ws(';', CASE WHEN observed_days < 2000 THEN 'PARENT_RAW_ROW_COUNT_INVALID' END, CASE WHEN fraction < 0.87 THEN 'PARENT_DAILY_FINITE_FRACTION_LOW' END, CASE WHEN coalesce(scale, 0) <= 1e-12 THEN 'PARENT_ROBUST_SCALE_INVALID' END) AS reasons FROM checks)"""))
def pf5_parent_eligibility(spark, sf_dir):
    audit = panel.canonical_audit(day_panel(spark, sf_dir))
    rules = {
        "PARENT_RAW_ROW_COUNT_INVALID": F.col("observed_days") < 2000,
        "PARENT_DAILY_FINITE_FRACTION_LOW": F.col("observed_fraction") < 0.87,
        "PARENT_ROBUST_SCALE_INVALID": F.coalesce("robust_scale", F.lit(0.0)) <= 1e-12,
    }
    return result(panel.eligibility(audit, rules).select("parent", "observed_days", "observed_fraction", "eligible", "reasons"))


@query("""WITH e AS (SELECT user_id % 5 AS parent, date_trunc('hour', ts) AS ts FROM events), g AS (SELECT parent, ts, ts - lag(ts) OVER (PARTITION BY parent ORDER BY ts) = INTERVAL 1 HOUR AS step FROM e)
SELECT parent, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS duplicates, coalesce(bool_and(step), true) AS hourly FROM g GROUP BY 1""")
def wn15_hourly_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("parent"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return result(panel.hourly_order(events))


HOURLY = "SELECT user_id % 3 AS parent, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS BIGINT) AS day_idx, hour(ts) AS hour, value AS reading FROM events"


def hourly(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("parent"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.col("value").alias("reading"))
    first = events.agg(F.min("day").alias("first"))
    return events.crossJoin(F.broadcast(first)).select("parent", "day", F.datediff("day", "first").cast("long").alias("day_idx"), "hour", "reading")


@query("WITH h AS (" + HOURLY + """), days AS (SELECT DISTINCT parent, day, day_idx FROM h), ranked AS (SELECT *, row_number() OVER (PARTITION BY parent, date_trunc('month', day) ORDER BY md5(concat_ws('|', 'swap', CAST(parent AS VARCHAR), CAST(day_idx AS VARCHAR)))) - 1 AS place, count(*) OVER (PARTITION BY parent, date_trunc('month', day)) AS n FROM days),
chosen AS (SELECT *, place // 2 AS pair, date_trunc('month', day) AS m FROM ranked WHERE place < 2 * floor(0.10 * n / 2)), swaps AS (SELECT a.parent, a.day_idx, b.day_idx AS to_idx FROM chosen a JOIN chosen b ON a.parent = b.parent AND a.m = b.m AND a.pair = b.pair AND a.place <> b.place),
conditions AS (SELECT 'baseline' AS condition, parent, day_idx, reading FROM h UNION ALL SELECT 'scale_095', parent, day_idx, reading * 0.95 FROM h UNION ALL SELECT 'scale_105', parent, day_idx, reading * 1.05 FROM h
 UNION ALL SELECT 'outage_6h_30d', parent, day_idx, CASE WHEN NOT (day_idx % 30 = 0 AND hour < 6) THEN reading END FROM h UNION ALL SELECT 'outage_24h_90d', parent, day_idx, CASE WHEN NOT (day_idx % 90 = 0 AND hour < 24) THEN reading END FROM h
 UNION ALL SELECT 'day_swap_010', h.parent, coalesce(s.to_idx, h.day_idx), reading FROM h LEFT JOIN swaps s ON h.parent = s.parent AND h.day_idx = s.day_idx)
SELECT condition, parent, day_idx, count(reading) AS n, round(sum(reading), 4) + 0.0 AS total FROM conditions GROUP BY 1, 2, 3""")
def pe7_panel_conditions(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    every = reduce(DataFrame.union, (panel.perturbed(rows, c).select(F.lit(c).alias("condition"), "parent", "day_idx", "reading") for c in panel.CONDITIONS))
    return every.groupBy("condition", "parent", "day_idx").agg(F.count("reading").alias("n"), (F.round(F.sum("reading"), 4) + 0.0).alias("total"))


@query(with_ctes(CTES, "readings daily panel", f"SELECT parent, day_idx, {r('value - avg(value) OVER (PARTITION BY day_idx)', 'value')} FROM panel"))
def ag43_common_factor_removal(spark, sf_dir):
    return result(panel.without_common_factor(day_panel(spark, sf_dir)).select("parent", "day_idx", "value"))


@query(with_ctes(CTES, "readings daily panel", f"SELECT parent, day_idx, {r('''value - median(value) OVER (PARTITION BY parent, date_trunc('month', day))''', 'value')} FROM panel"))
def ag43_year_month_residual(spark, sf_dir):
    return result(panel.year_month_residual(day_panel(spark, sf_dir)).select("parent", "day_idx", "value"))


@query(with_ctes(CTES, "readings daily panel", """, marked AS (SELECT *, day_idx < floor(0.75 * count(*) OVER (PARTITION BY parent)) AS train, month(day) AS season FROM panel),
climate AS (SELECT parent, season, median(value) AS climate FROM marked WHERE train GROUP BY 1, 2), c AS (SELECT m.*, m.value - climate AS c FROM marked m LEFT JOIN climate USING (parent, season)),
l AS (SELECT *, lag(c) OVER (PARTITION BY parent ORDER BY day_idx) AS b FROM c), fit AS (SELECT parent, CASE WHEN sum(CASE WHEN c IS NOT NULL THEN b * b END) > 1e-12 THEN sum(b * c) / sum(CASE WHEN c IS NOT NULL THEN b * b END) ELSE 0.0 END AS phi, avg(value) AS mean FROM l WHERE train GROUP BY 1)
SELECT l.parent, round(first(phi), 6) + 0.0 AS phi, count(c - b) AS model_count, round(sqrt(avg((c - phi * b) * (c - phi * b))), 6) + 0.0 AS model_rmse, round(sqrt(avg(c * c)), 6) + 0.0 AS climate_rmse, round(sqrt(avg((value - mean) * (value - mean))), 6) + 0.0 AS mean_rmse FROM l JOIN fit ON l.parent = fit.parent WHERE NOT train GROUP BY 1"""))
def ag36_climatology_ar1(spark, sf_dir):
    return result(panel.climatology_ar1(day_panel(spark, sf_dir)))


@query(with_ctes(CTES, "readings daily panel centred scales canonical nulls", f"SELECT parent, CAST(child AS BIGINT) AS child, CAST(date_trunc('month', day) AS DATE) AS month, count(value) AS known, {r('sum(value * (day_idx + 1)) / 1000', 'moment')} FROM nulls JOIN (SELECT DISTINCT day_idx AS d, day AS first_day FROM canonical) ON d = day_idx GROUP BY 1, 2, 3").replace("date_trunc('month', day) AS DATE", "date_trunc('month', first_day) AS DATE"))
def nu3_month_strata_permutation(spark, sf_dir):
    """All children of all parents, as a moment of each month that depends on the days' order."""
    series = stored(canonical(spark, sf_dir), "canonical")
    children = nulls.month_strata_nulls(series, CHILDREN).join(F.broadcast(series.select("day_idx", "day").distinct()), "day_idx")
    out = children.groupBy("parent", "child", F.trunc("day", "month").alias("month")).agg(F.count("value").alias("known"), (F.sum(F.col("value") * (F.col("day_idx") + 1)) / 1000).alias("moment"))
    return result(out)


CTES["sized"] = "SELECT *, count(*) OVER (PARTITION BY parent) AS len FROM panel"
DRAW = "CAST(CAST('0x' || substr(md5(concat_ws('|', {0})), 1, 12) AS BIGINT) % ({1}) AS BIGINT)"


def draw_sql(n: str, *parts: str) -> str:
    return DRAW.format(", ".join(p if p.startswith("'") else f"CAST({p} AS VARCHAR)" for p in parts), n)


@query(with_ctes(CTES, "readings daily panel sized", f"""SELECT parent, CAST(child AS BIGINT) AS child, CAST((day_idx + 31 + {draw_sql('len - 61', "'shift'", 'child', 'parent')}) % len AS BIGINT) AS day_idx, {r('value', 'value')} FROM sized, (SELECT unnest(range(1, 4)) AS child)"""))
def nu8_circular_shift(spark, sf_dir):
    return result(nulls.shift_nulls(day_panel(spark, sf_dir), 3))


@query(with_ctes(CTES, "readings daily panel sized", """, numbered AS (SELECT *, day_idx // 7 AS block, len // 7 AS full_blocks FROM sized), kids AS (SELECT unnest(range(1, 4)) AS child),
moves AS (SELECT parent, child, block, row_number() OVER (PARTITION BY parent, child ORDER BY md5(concat_ws('|', 'block', CAST(child AS VARCHAR), CAST(parent AS VARCHAR), CAST(block AS VARCHAR))), block) - 1 AS to_block FROM (SELECT DISTINCT parent, block FROM numbered WHERE block < full_blocks), kids)
SELECT n.parent, CAST(m.child AS BIGINT) AS child, CAST(to_block * 7 + day_idx % 7 AS BIGINT) AS day_idx, round(value, 6) + 0.0 AS value FROM numbered n JOIN moves m ON n.parent = m.parent AND n.block = m.block
UNION ALL SELECT parent, CAST(child AS BIGINT), day_idx, round(value, 6) + 0.0 FROM numbered, kids WHERE block >= full_blocks"""))
def nu9_block_permutation(spark, sf_dir):
    return result(nulls.block_nulls(day_panel(spark, sf_dir), 3))


@query(with_ctes(CTES, "readings daily panel sized", f""", kids AS (SELECT unnest(range(1, 4)) AS child), flags AS (SELECT parent, child, day_idx, len, CASE WHEN day_idx = 0 OR {draw_sql('7', "'boot'", "'r'", 'child', 'parent', 'day_idx')} = 0 THEN day_idx END AS f FROM sized, kids),
since AS (SELECT *, max(f) OVER (PARTITION BY parent, child ORDER BY day_idx ROWS UNBOUNDED PRECEDING) AS since FROM flags), src AS (SELECT *, ({draw_sql('len', "'boot'", "'s'", 'child', 'parent', 'since')} + day_idx - since) % len AS source FROM since)
SELECT s.parent, CAST(child AS BIGINT) AS child, s.day_idx, round(p.value, 6) + 0.0 AS value FROM src s JOIN panel p ON p.parent = s.parent AND p.day_idx = s.source"""))
def nu10_stationary_bootstrap(spark, sf_dir):
    return result(nulls.stationary_bootstrap(day_panel(spark, sf_dir), 3))


CTES["demeaned"] = "SELECT parent, day_idx, day, value - avg(value) OVER (PARTITION BY parent, date_trunc('month', day)) AS value FROM panel"
CTES["demeaned_nulls"] = null_cte(3, "demeaned", "demeaned")


@query(with_ctes(CTES, "readings daily panel demeaned demeaned_nulls", f"SELECT parent, CAST(child AS BIGINT) AS child, day_idx, {r('value', 'value')} FROM demeaned_nulls"))
def nu13_demeaned_permutation(spark, sf_dir):
    return result(nulls.demeaned_nulls(day_panel(spark, sf_dir), 3))


@query(with_ctes(CTES, "readings daily panel", """, k AS (SELECT *, date_trunc('month', day) AS m, row_number() OVER (PARTITION BY parent, date_trunc('month', day) ORDER BY day_idx) - 1 AS k, count(*) OVER (PARTITION BY parent, date_trunc('month', day)) // 3 AS full_blocks FROM panel), kids AS (SELECT unnest(range(1, 4)) AS child),
moves AS (SELECT parent, child, m, block, row_number() OVER (PARTITION BY parent, child, m ORDER BY md5(concat_ws('|', 'short', CAST(child AS VARCHAR), CAST(parent AS VARCHAR), CAST(CAST(m AS DATE) AS VARCHAR), CAST(block AS VARCHAR))), block) - 1 AS to_block FROM (SELECT DISTINCT parent, m, k // 3 AS block FROM k WHERE k // 3 < full_blocks), kids)
SELECT k.parent, CAST(child AS BIGINT) AS child, CAST(day_idx - k + to_block * 3 + k % 3 AS BIGINT) AS day_idx, round(value, 6) + 0.0 AS value FROM k JOIN moves v ON k.parent = v.parent AND k.m = v.m AND k.k // 3 = v.block
UNION ALL SELECT parent, CAST(child AS BIGINT), day_idx, round(value, 6) + 0.0 FROM k, kids WHERE k // 3 >= full_blocks"""))
def nu14_month_block_permutation(spark, sf_dir):
    return result(nulls.month_block_nulls(day_panel(spark, sf_dir), 3))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", blocks AS (" + block_cte("canonical", "parent", SIZES) + f") SELECT parent, CAST(n AS BIGINT) AS n, CAST(block AS BIGINT) AS block, {r('value', 'value')} FROM blocks"))
def ag12_block_means(spark, sf_dir):
    return result(blocks.block_means(canonical(spark, sf_dir), ["parent"], SIZES))


def _persistence_sql(gate: str | None = None, phase: str = "0", source: str = "canonical", keep: str = "") -> str:
    score = score_cte("(SELECT * FROM b" + keep + ")", "parent", gate) if gate else score_cte("(SELECT * FROM b" + keep + ")", "parent")
    return with_ctes(CTES, "readings daily panel centred scales canonical", ", b AS (" + block_cte(source, "parent", SIZES, phase) + "), s AS (" + score + f") SELECT parent, CAST(n AS BIGINT) AS n, {r('score', 'score')} FROM s")


@query(_persistence_sql())
def ag13_block_persistence(spark, sf_dir):
    return result(blocks.block_persistence(canonical(spark, sf_dir), ["parent"], SIZES))


@query(_persistence_sql("count(CASE WHEN next IS NOT NULL THEN value END) >= 30"))
def ag14_block_persistence_by_pairs(spark, sf_dir):
    return result(blocks.block_persistence(canonical(spark, sf_dir), ["parent"], SIZES, by_pairs=True))


@query(_persistence_sql(phase="3"))
def ag15_block_persistence_phase(spark, sf_dir):
    return result(blocks.block_persistence(canonical(spark, sf_dir), ["parent"], SIZES, phase=3))


@query(_persistence_sql(keep=" WHERE value IS NOT NULL"))
def ag16_compressed_persistence(spark, sf_dir):
    return result(blocks.block_persistence(canonical(spark, sf_dir), ["parent"], SIZES, compress=True))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", b AS (" + block_cte("canonical", "parent", SIZES) + f"""), p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY parent, n ORDER BY block DESC) = 1 THEN first_value(value) OVER (PARTITION BY parent, n ORDER BY block) ELSE lead(value) OVER (PARTITION BY parent, n ORDER BY block) END AS next FROM b)
SELECT parent, CAST(n AS BIGINT) AS n, round(CASE WHEN count(value) >= 30 AND count(CASE WHEN next IS NOT NULL THEN value END) >= 2 THEN {corr_sql('value', 'next')} END, 6) + 0.0 AS score FROM p GROUP BY parent, n"""))
def ag13_cyclic_persistence(spark, sf_dir):
    return result(blocks.block_persistence(canonical(spark, sf_dir), ["parent"], SIZES, cyclic=True))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", " + ", ".join(f"r{n} AS (SELECT parent, {n} AS n, day_idx, CASE WHEN count(*) OVER w = {n} AND count(value) OVER w >= ceil(0.8 * {n}) THEN avg(value) OVER w END AS value FROM canonical WINDOW w AS (PARTITION BY parent ORDER BY day_idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))" for n in (7, 14))
    + f", u AS (SELECT *, lead(value) OVER (PARTITION BY parent, n ORDER BY day_idx) AS next FROM (SELECT * FROM r7 UNION ALL SELECT * FROM r14)) SELECT parent, CAST(n AS BIGINT) AS n, round(CASE WHEN count(CASE WHEN next IS NOT NULL THEN value END) >= 30 THEN {corr_sql('value', 'next')} END, 6) + 0.0 AS score FROM u GROUP BY parent, n"))
def wn5_rolling_persistence(spark, sf_dir):
    return result(blocks.rolling_persistence(canonical(spark, sf_dir), ["parent"], [7, 14]))


CTES["closure"] = "SELECT parent, n, CASE WHEN count(value - ahead) >= 365 AND sqrt(avg(value * value)) > 1e-12 THEN sqrt(avg((value - ahead) * (value - ahead))) / sqrt(avg(value * value)) END AS error FROM (" + " UNION ALL ".join(f"SELECT parent, {n} AS n, value, lead(value, {n}) OVER (PARTITION BY parent ORDER BY day_idx) AS ahead FROM canonical" for n in SIZES) + ") GROUP BY 1, 2"


@query(with_ctes(CTES, "readings daily panel centred scales canonical closure", f"SELECT parent, CAST(n AS BIGINT) AS n, {r('error', 'error')} FROM closure"))
def ag17_closure_error(spark, sf_dir):
    return result(blocks.closure_error(canonical(spark, sf_dir), ["parent"], SIZES))


@query(with_ctes(CTES, "readings daily panel centred scales canonical closure", "SELECT parent, CAST(n AS BIGINT) AS winner FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY error, n) AS k FROM closure WHERE error IS NOT NULL) WHERE k = 1"))
def st2_closure_winner(spark, sf_dir):
    return result(blocks.closure_winner(blocks.closure_error(canonical(spark, sf_dir), ["parent"], SIZES), ["parent"]))


@query(with_ctes(CTES, "readings daily panel centred scales canonical closure", ", w AS (SELECT n AS winner FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY error, n) AS k FROM closure WHERE error IS NOT NULL) WHERE k = 1) SELECT CAST(winner AS BIGINT) AS winner, count(*) AS votes FROM w GROUP BY 1 ORDER BY votes DESC, winner LIMIT 1"))
def ag31_winner_mode(spark, sf_dir):
    winners = blocks.closure_winner(blocks.closure_error(canonical(spark, sf_dir), ["parent"], SIZES), ["parent"])
    return result(blocks.winner_mode(winners.withColumn("all", F.lit(1)), ["all"]).drop("all"))


@query(with_ctes(CTES, "readings daily panel centred scales canonical nulls joined blocks scores paired stats mads cells", f"SELECT parent, CAST(n AS BIGINT) AS n, eligible, {r('observed', 'observed')}, {r('null_median', 'null_median')}, {r('null_mad', 'null_mad')}, {r('local_p', 'local_p')}, {r('robust_z', 'robust_z', 4)}, {r('lower_p', 'lower_p')}, rank, issue FROM cells"))
def ag18_parent_cells(spark, sf_dir):
    return result(cells_of(spark, sf_dir).withColumn("robust_z", F.round("robust_z", 4)))


@query(with_ctes(CTES, "readings daily panel centred scales canonical nulls joined blocks scores paired stats mads cells", f"SELECT parent, CAST(n AS BIGINT) AS n, {r('observed', 'observed')}, {r('observed - null_median', 'effect')}, {r('robust_z', 'signed_z', 4)}, {r('abs(robust_z)', 'absolute_z', 4)}, {r('local_p', 'upper_p')}, {r('lower_p', 'lower_p')}, {r('least(1.0, 2 * least(local_p, lower_p))', 'two_sided_p')}, rank, {r(f'(rank - 0.5) / {CHILDREN + 1}', 'null_quantile')}, CASE WHEN observed > null_median THEN 'POSITIVE' WHEN observed < null_median THEN 'NEGATIVE' ELSE 'TIE' END AS direction FROM cells WHERE eligible"))
def ag19_signed_cells(spark, sf_dir):
    out = inference.signed_cells(cells_of(spark, sf_dir), ["parent", "n"], CHILDREN)
    return result(out.withColumn("signed_z", F.round("signed_z", 4)).withColumn("absolute_z", F.round("absolute_z", 4)))


CTES["family_cells"] = "SELECT 'baseline' AS condition, * FROM cells"
CTES |= surface_ctes("family_cells", "condition", 10)
SURFACE_CHAIN = "readings daily panel centred scales canonical nulls joined blocks scores paired stats mads cells family_cells raw_surface tested stepped surface"
SURFACE_COLUMNS = f"CAST(n AS BIGINT) AS n, parents, {r('ui', 'ui')}, {r('nss', 'nss', 4)}, positive, {r('sign_p', 'sign_p')}, {r('holm_p', 'holm_p')}, sep"


@query(with_ctes(CTES, SURFACE_CHAIN, f"SELECT condition, {SURFACE_COLUMNS} FROM surface"))
def ag20_condition_surface(spark, sf_dir):
    cells = cells_of(spark, sf_dir).withColumn("condition", F.lit("baseline"))
    return result(inference.surface(cells, ["condition"]).withColumn("nss", F.round("nss", 4)))


@query("SELECT k, n, round(" + binomial_sql("k", "n") + ", 9) + 0.0 AS p FROM (SELECT unnest(range(0, 13)) AS k, 12 AS n) UNION ALL SELECT k, n, round(" + binomial_sql("k", "n") + ", 9) + 0.0 FROM (SELECT unnest(range(0, 29)) AS k, 28 AS n)".replace("12 AS n", "12::BIGINT AS n"))
def ag21_exact_sign_test(spark, sf_dir):
    grid = spark.range(0, 13).select(F.col("id").alias("k"), F.lit(12).alias("n")).union(spark.range(0, 29).select(F.col("id").alias("k"), F.lit(28).alias("n")))
    from gneiss.functions.robust import binomial_upper

    return grid.select("k", "n", (F.round(binomial_upper(F.col("k"), F.col("n")), 9) + 0.0).alias("p"))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", f""", g AS (SELECT parent, month(day) AS season, count(*) FILTER (WHERE value > 0) AS positive, count(*) FILTER (WHERE value < 0) AS negative FROM canonical GROUP BY 1, 2)
SELECT parent, CAST(season AS BIGINT) AS season, positive, negative, {r(binomial_sql('positive', '(positive + negative)'), 'upper_p')}, {r(binomial_sql('negative', '(positive + negative)'), 'lower_p')}, {r('CASE WHEN positive + negative = 0 THEN 1.0 ELSE least(1.0, 2 * ' + binomial_sql('greatest(positive, negative)', '(positive + negative)') + ') END', 'two_sided_p')} FROM g"""))
def ag22_sign_tests(spark, sf_dir):
    rows = canonical(spark, sf_dir).withColumn("season", F.month("day"))
    return result(inference.sign_tests(rows, ["parent", "season"], F.col("value")))


@query("""WITH p AS (SELECT o_orderpriority AS key, o_orderstatus AS family, avg(CAST(o_totalprice > 250000 AS DOUBLE)) AS p FROM orders GROUP BY 1, 2), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, key) + 1) * p) AS step FROM p)
SELECT family, key, round(p, 9) + 0.0 AS p, round(max(step) OVER (PARTITION BY family ORDER BY p, key ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS holm_p FROM s""")
def wn2_holm_step_down(spark, sf_dir):
    from gneiss.functions.robust import holm

    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("key")).agg(F.avg((F.col("o_totalprice") > 250000).cast("double")).alias("p"))
    return holm(orders, ["family"], "p", "key").select("family", "key", (F.round("p", 9) + 0.0).alias("p"), (F.round("holm_p", 9) + 0.0).alias("holm_p"))


@query("""WITH c AS (SELECT l_suppkey % 12 AS parent, count(*) FILTER (WHERE l_discount <= 0.05) AS s, count(*) AS t FROM lineitem GROUP BY 1), w AS (SELECT *, s / t::DOUBLE AS p, 1.959963984540054 AS z FROM c),
v AS (SELECT *, (p + z * z / (2 * t)) / (1 + z * z / t) AS m, z * sqrt(p * (1 - p) / t + z * z / (4.0 * t * t)) / (1 + z * z / t) AS h FROM w) SELECT parent, s AS successes, t AS trials, round(p, 6) + 0.0 AS rate, round(greatest(0.0, m - h), 6) + 0.0 AS wilson_low, round(least(1.0, m + h), 6) + 0.0 AS wilson_high FROM v""")
def ag50_wilson_interval(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("parent"), (F.col("l_discount") <= 0.05).alias("flag"))
    return result(inference.rates(rows, ["parent"], "flag"))


CTES["obs14"] = "SELECT parent, score FROM scores WHERE child = 0 AND n = 14"
CTES["null14"] = "SELECT parent, child, score FROM scores WHERE child > 0 AND n = 14"
SCORES_CHAIN = "readings daily panel centred scales canonical nulls joined blocks scores obs14 null14"


def _scores14(spark, sf_dir):
    scores = blocks.block_persistence(with_nulls(canonical(spark, sf_dir), CHILDREN), ["parent", "child"], [14])
    scores = stored(scores, "scores")
    return scores.where("child = 0").select("parent", "score"), scores.where("child > 0").select("parent", "child", "score")


@query(with_ctes(CTES, SCORES_CHAIN, f""", own AS (SELECT parent, median(score) AS own FROM null14 GROUP BY 1), paired AS (SELECT o.parent, o.score - own AS d FROM obs14 o JOIN own w ON o.parent = w.parent), e AS (SELECT median(d) AS effect, count(*) AS parents FROM paired), m AS (SELECT median(abs(d - effect)) AS mad FROM paired, e),
rest AS (SELECT child, n.score - own AS d FROM null14 n JOIN own w ON n.parent = w.parent), pseudo AS (SELECT child, median(d) AS m FROM rest GROUP BY 1), tails AS (SELECT count(*) AS children, count(*) FILTER (WHERE m >= effect) AS up, count(*) FILTER (WHERE m <= effect) AS down FROM pseudo, e)
SELECT {r('effect', 'effect')}, {r('(up + 1) / (children + 1.0)', 'upper_p')}, {r('(down + 1) / (children + 1.0)', 'lower_p')}, {r('least(1.0, 2 * least((up + 1) / (children + 1.0), (down + 1) / (children + 1.0)))', 'two_sided_p')}, {r('least(1.0, least(1.0, 2 * least((up + 1) / (children + 1.0), (down + 1) / (children + 1.0))) * 4)', 'familywise_p')}, {r('effect / (1.4826 * mad)', 'standardized')}, CASE WHEN effect > 0 THEN 'UPPER' WHEN effect < 0 THEN 'LOWER' ELSE 'ZERO' END AS direction, parents, {r('1.4826 * mad / sqrt(parents)', 'uncertainty')}, children AS pseudo_effects FROM e, m, tails"""))
def ag23_bidirectional_separation(spark, sf_dir):
    return result(inference.bidirectional_separation(*_scores14(spark, sf_dir), family_size=4))


@query(with_ctes(CTES, SCORES_CHAIN, f""", draws AS (SELECT parent, replicate, {draw_sql(str(CHILDREN), "'joint'", 'replicate', 'parent')} + 1 AS child FROM obs14, (SELECT unnest(range(1, 1000)) AS replicate)), joint AS (SELECT replicate, median(score) AS j FROM draws JOIN null14 USING (parent, child) GROUP BY 1), o AS (SELECT median(score) AS a, count(*) AS parents FROM obs14), m AS (SELECT median(j) AS med FROM joint),
t AS (SELECT count(*) AS replicates, count(*) FILTER (WHERE j >= a - greatest(1e-10, abs(a) * 1e-10)) AS up, count(*) FILTER (WHERE j <= a + greatest(1e-10, abs(a) * 1e-10)) AS down, quantile_cont(j, 0.025) AS q025, quantile_cont(j, 0.975) AS q975, median(abs(j - med)) * 1.4826 AS joint_scale FROM joint, o, m)
SELECT {r('a', 'observed')}, {r('med', 'joint_median')}, {r('a - med', 'difference')}, {r('joint_scale', 'joint_scale')}, {r('q025', 'q025')}, {r('q975', 'q975')}, {r('(up + 1) / (replicates + 1.0)', 'upper_p')}, {r('(down + 1) / (replicates + 1.0)', 'lower_p')}, {r('least(1.0, 2 * least((up + 1) / (replicates + 1.0), (down + 1) / (replicates + 1.0)))', 'two_sided_p')}, parents, replicates FROM o, m, t"""))
def ag24_joint_parent_null(spark, sf_dir):
    observed, children = _scores14(spark, sf_dir)
    return result(inference.joint_null(observed, children, CHILDREN, []))


@query(with_ctes(CTES, SCORES_CHAIN, f"SELECT o.parent, {r('quantile_cont(n.score, 0.025)', 'q025')}, {r('median(n.score)', 'null_median')}, {r('quantile_cont(n.score, 0.975)', 'q975')}, {r('first(o.score) - median(n.score)', 'difference')} FROM obs14 o JOIN null14 n ON o.parent = n.parent GROUP BY 1"))
def ag26_channel_null_summary(spark, sf_dir):
    observed, children = _scores14(spark, sf_dir)
    return result(inference.channel_summary(children, observed, ["parent"]))


@query(with_ctes(CTES, SURFACE_CHAIN + " closure", f", pass AS (SELECT parent, n, coalesce(eligible AND local_p <= 0.05 AND robust_z >= 2.0, false) AS ok FROM cells), isl AS (SELECT parent, n, ok, row_number() OVER (PARTITION BY parent ORDER BY n) - row_number() OVER (PARTITION BY parent, ok ORDER BY n) AS i FROM pass), runs AS (SELECT parent, min(n) AS first, count(*) AS size FROM isl WHERE ok GROUP BY parent, i), f AS (SELECT parent, first, size FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY first) AS k FROM runs) WHERE k = 1) SELECT p.parent, CAST(f.first AS BIGINT) AS t_e, coalesce(size, 0) AS contiguous, {r('coalesce(size, 0) / 9.0', 's_e')} FROM (SELECT DISTINCT parent FROM cells) p LEFT JOIN f ON f.parent = p.parent"))
def ag33_parent_endpoints(spark, sf_dir):
    return result(endpoints.parent_endpoints(stored(cells_of(spark, sf_dir), "cells"), len(SIZES)))


LOO = surface_ctes("crossed", "omitted, condition", 9)


@query(with_ctes(CTES, "readings daily panel centred scales canonical nulls joined blocks scores paired stats mads cells", ", crossed AS (SELECT o.parent AS omitted, 'baseline' AS condition, c.* FROM cells c, (SELECT DISTINCT parent FROM cells) o WHERE c.parent <> o.parent), " + ", ".join(f"{k} AS ({v})" for k, v in LOO.items()) + f" SELECT omitted, condition, {SURFACE_COLUMNS} FROM surface"))
def ag34_leave_one_parent_out(spark, sf_dir):
    cells = stored(cells_of(spark, sf_dir).withColumn("condition", F.lit("baseline")), "cells")
    return result(inference.leave_one_out(cells, cells.select("parent"), ["condition"], least_parents=9).withColumn("nss", F.round("nss", 4)))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", left_out AS (SELECT c.parent * 10000 + y.omitted AS parent, row_number() OVER (PARTITION BY c.parent, y.omitted ORDER BY day_idx) - 1 AS day_idx, c.value FROM canonical c, (SELECT DISTINCT year(day) AS omitted FROM canonical) y WHERE year(c.day) <> y.omitted), b AS (" + block_cte("left_out", "parent", [14]) + "), s AS (" + score_cte("b", "parent") + f") SELECT parent // 10000 AS parent, CAST(parent % 10000 AS BIGINT) AS omitted, CAST(n AS BIGINT) AS n, {r('score', 'score')} FROM s"))
def ag35_leave_one_year_out(spark, sf_dir):
    from pyspark.sql import Window

    series = canonical(spark, sf_dir)
    years = series.select(F.year("day").alias("omitted")).distinct()
    crossed = series.join(years, F.year("day") != F.col("omitted"))
    again = crossed.withColumn("day_idx", F.row_number().over(Window.partitionBy("parent", "omitted").orderBy("day_idx")) - 1)
    return result(blocks.block_persistence(again, ["parent", "omitted"], [14]))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", f", j AS (SELECT a.parent AS left_parent, b.parent AS right_parent, a.value AS x, b.value AS y FROM canonical a JOIN canonical b ON a.day_idx = b.day_idx WHERE a.value IS NOT NULL AND b.value IS NOT NULL) SELECT left_parent AS left, right_parent AS right, {r(corr_sql('x', 'y'), 'r')}, count(*) AS days FROM j GROUP BY 1, 2"))
def j12_pairwise_correlation(spark, sf_dir):
    return result(blocks.pairwise_correlation(canonical(spark, sf_dir)))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", f", j AS (SELECT a.parent AS l, b.parent AS q, a.value AS x, b.value AS y FROM canonical a JOIN canonical b ON a.day_idx = b.day_idx WHERE a.value IS NOT NULL AND b.value IS NOT NULL), c AS (SELECT l, q, {corr_sql('x', 'y')} AS rho FROM j GROUP BY 1, 2), s AS (SELECT count(DISTINCT l) AS parents, avg(CASE WHEN l <> q THEN rho END) AS mean_rho, sum(rho * rho) AS squares FROM c) SELECT parents, {r('mean_rho', 'mean_rho')}, {r('parents / (1 + (parents - 1) * greatest(mean_rho, 0.0))', 'effective_count')}, {r('parents * parents / squares', 'effective_rank')} FROM s"))
def ag42_dependence(spark, sf_dir):
    return result(blocks.dependence(blocks.pairwise_correlation(canonical(spark, sf_dir))))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", " + ", ".join(f"b{p} AS (" + block_cte("canonical", "parent", [14], str(p)) + f"), s{p} AS (" + score_cte(f"b{p}", "parent") + ")" for p in (0, 4, 9)) + f", m AS (SELECT 0 AS phase, median(score) AS m FROM s0 UNION ALL SELECT 4, median(score) FROM s4 UNION ALL SELECT 9, median(score) FROM s9), o AS (SELECT count(*) AS phases, avg(CAST(m < 0 AS DOUBLE)) AS f, stddev_pop(m) AS sd FROM m) SELECT phases, {r('f', 'fraction_negative')}, {r('sd', 'phase_spread')}, CASE WHEN f = 1 THEN 'ALL_NEGATIVE' WHEN f = 0 THEN 'ALL_NONNEGATIVE' ELSE 'MIXED' END AS phase_class FROM o"))
def ag40_phase_summary(spark, sf_dir):
    series = canonical(spark, sf_dir)
    scores = reduce(DataFrame.union, (blocks.block_persistence(series, ["parent"], [14], phase=p).select("parent", F.lit(p).alias("phase"), "score") for p in (0, 4, 9)))
    return result(blocks.phase_summary(scores))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", f AS (SELECT parent, min(day_idx) AS monday FROM canonical WHERE isodow(day) = 1 GROUP BY 1), w AS (SELECT c.parent, day_idx - monday AS day_idx, value FROM canonical c JOIN f ON c.parent = f.parent WHERE day_idx >= monday), b AS (" + block_cte("w", "parent", [7]) + "), s AS (" + score_cte("b", "parent") + ")" + "".join(f", {u}s AS (SELECT *, lead(value) OVER (PARTITION BY parent ORDER BY g) AS next FROM (SELECT parent, date_trunc('{u}', day) AS g, avg(value) AS value FROM canonical GROUP BY 1, 2))" for u in ("month", "year")) + f" SELECT parent, 'week_aligned' AS alignment, {r('score', 'score')} FROM s" + "".join(f" UNION ALL SELECT parent, '{u}_local', round(CASE WHEN count(*) > 2 THEN {corr_sql('value', 'next')} END, 6) + 0.0 FROM {u}s GROUP BY 1" for u in ("month", "year"))))
def ag41_calendar_alignment(spark, sf_dir):
    return result(blocks.calendar_alignment(canonical(spark, sf_dir), ["parent"]))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", ", b AS (" + block_cte("canonical", "parent", [9]) + f"""), l AS (SELECT *, lead(value) OVER (PARTITION BY parent ORDER BY block) AS next FROM b), a AS (SELECT parent, count(value) AS blocks, var_pop(value) AS block_variance, covar_pop(next, value) FILTER (WHERE value IS NOT NULL AND next IS NOT NULL) AS lag_covariance, {corr_sql('value', 'next')} AS lag_correlation FROM l GROUP BY 1),
i AS (SELECT parent, day_idx // 9 AS block, count(*) AS days, count(value) AS seen, var_pop(value) AS v, CAST(date_trunc('month', min(day)) <> date_trunc('month', max(day)) AS BIGINT) AS crosses FROM canonical GROUP BY 1, 2), w AS (SELECT parent, avg(CASE WHEN seen > 1 THEN v END) AS within_variance, CAST(sum(crosses) AS BIGINT) AS month_crossings FROM i WHERE days = 9 GROUP BY 1),
q AS (SELECT parent, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM canonical GROUP BY 1), m AS (SELECT parent, median(value) AS centre FROM b GROUP BY 1), s AS (SELECT b.parent, block, value <= lo OR value >= hi AS extreme, value >= centre AS sign, value - centre AS c FROM b JOIN q ON b.parent = q.parent JOIN m ON b.parent = m.parent WHERE value IS NOT NULL),
t AS (SELECT parent, sign, extreme AND lead(extreme) OVER o AS touch, lag(sign) OVER o AS was, c * (lead(c) OVER o - c) < 0 AS back FROM s WINDOW o AS (PARTITION BY parent ORDER BY block)), h AS (SELECT parent, avg(CAST(touch AS DOUBLE)) AS extreme_adjacency, count(*) / count(*) FILTER (WHERE was IS NULL OR was <> sign)::DOUBLE AS mean_run_length, avg(CAST(back AS DOUBLE)) AS reversion_rate FROM t GROUP BY 1)
SELECT a.parent, blocks, {r('block_variance', 'block_variance')}, {r('lag_covariance', 'lag_covariance')}, {r('lag_correlation', 'lag_correlation')}, {r('within_variance', 'within_variance')}, month_crossings, {r('extreme_adjacency', 'extreme_adjacency')}, {r('mean_run_length', 'mean_run_length')}, {r('reversion_rate', 'reversion_rate')} FROM a JOIN w ON a.parent = w.parent JOIN h ON a.parent = h.parent WHERE blocks >= 3"""))
def ag37_series_metrics(spark, sf_dir):
    return result(blocks.series_metrics(canonical(spark, sf_dir), ["parent"], 9))


@query(with_ctes(CTES, "readings daily panel centred scales canonical", f"SELECT parent, {r('var_pop(m)', 'variance')} FROM (SELECT parent, date_trunc('month', day) AS g, avg(value) AS m FROM canonical GROUP BY 1, 2) GROUP BY 1"))
def ag39_month_mean_variance(spark, sf_dir):
    months = canonical(spark, sf_dir).groupBy("parent", F.trunc("day", "month").alias("g")).agg(F.avg("value").alias("m"))
    return result(months.groupBy("parent").agg(F.var_pop("m").alias("variance")))
