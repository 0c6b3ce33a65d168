"""Queries over spectra, eigenvalues, surrogates, simulations, and further tables derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import audit, blocks, dynamics, geometry, inference, ladder, nulls, panel, spectral, summaries
from gneiss.plans.storage import stored
from gneiss.queries import fields, ladders, panels
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

DFT = """, c AS (SELECT field, i, j, CASE WHEN seen THEN value - avg(CASE WHEN seen THEN value END) OVER (PARTITION BY field) ELSE 0.0 END AS x FROM grid), h AS (SELECT field, i, l, sum(x * cos(2 * pi() * j * l / 11)) AS re, sum(-x * sin(2 * pi() * j * l / 11)) AS im FROM c, (SELECT unnest(range(0, 11)) AS l) GROUP BY 1, 2, 3),
f AS (SELECT field, k, l, pow(sum(re * cos(2 * pi() * i * k / 50) + im * sin(2 * pi() * i * k / 50)), 2) + pow(sum(im * cos(2 * pi() * i * k / 50) - re * sin(2 * pi() * i * k / 50)), 2) AS p FROM h, (SELECT unnest(range(0, 50)) AS k) GROUP BY 1, 2, 3), o AS (SELECT field, CASE WHEN k = 0 AND l = 0 THEN 0.0 ELSE p END AS p FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY p DESC) AS place FROM o)"""


@query(with_ctes(fields.CTES, "cells grid", DFT + f" SELECT field, {r('sum(p) FILTER (WHERE place <= 28) / sum(p)', 'concentration')} FROM n GROUP BY 1"))
def ge4_spectral_concentration(spark, sf_dir):
    return result(spectral.spectral_concentration(fields.grid(spark, sf_dir), "field"))


@query()
def ge12_correlation_spectrum(spark, sf_dir):
    rows = blocks.pairwise_correlation(panels.canonical(spark, sf_dir)).withColumn("one", F.lit(1).cast("long"))
    return result(spectral.correlation_spectrum(rows, "one"))


@query()
def ge10_graph_spectrum(spark, sf_dir):
    return result(spectral.graph_spectrum(fields.edges(spark, sf_dir).withColumn("one", F.lit(1).cast("long")), "one"))


@query()
def ge22_concentration_norm(spark, sf_dir):
    cells = fields.grid(spark, sf_dir).withColumn("seen", F.pmod(F.col("i") + F.col("j"), F.lit(3)) == 0).withColumn("value", F.when(F.col("i") % 5 == 0, 1.0).otherwise(0.0))
    return result(spectral.concentration_norm(cells, "field"))


_FILLED = ", filled AS (SELECT parent, day_idx AS t, value IS NULL AS missing, coalesce(value, median(value) OVER (PARTITION BY parent)) AS x, count(*) OVER (PARTITION BY parent) AS n FROM canonical), kids AS (SELECT unnest(range(1, 4)) AS child)"
_PHASE = panels.draw_sql(str(2**40), "'phase'", "child", "parent", "k")


@query(with_ctes(panels.CTES, "readings daily panel centred scales canonical", _FILLED + f""", s AS (SELECT parent, k, first(n) AS n, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS re, sum(x * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM filled, (SELECT unnest(range(0, (SELECT max(n) // 2 + 1 FROM filled))) AS k) WHERE k <= n // 2 GROUP BY 1, 2),
a AS (SELECT parent, child, k, n, sqrt(re * re + im * im) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS size, CASE WHEN k = 0 OR 2 * k = n THEN 0.0 ELSE 2 * pi() * ({_PHASE}) / {float(2**40)} END AS phase FROM s, kids)
SELECT f.parent, CAST(child AS BIGINT) AS child, f.t AS day_idx, round(CASE WHEN NOT first(missing) THEN sum(size * cos(2 * pi() * ((k * f.t) % f.n) / f.n + phase)) / first(f.n) END, 6) + 0.0 AS value FROM filled f JOIN a ON a.parent = f.parent GROUP BY f.parent, child, f.t"""))
def nu11_phase_surrogates(spark, sf_dir):
    return result(spectral.phase_surrogates(panels.canonical(spark, sf_dir), 3))


@query(with_ctes(panels.CTES, "readings daily panel centred scales canonical", _FILLED + f""", l AS (SELECT *, lag(x) OVER (PARTITION BY parent ORDER BY t) AS b FROM filled), p AS (SELECT parent, sum(b * x) / greatest(sum(CASE WHEN b IS NOT NULL THEN b * b END), 1e-12) AS phi FROM l GROUP BY 1),
e AS (SELECT l.parent, t - 1 AS k, x - phi * b AS e FROM l JOIN p ON p.parent = l.parent WHERE b IS NOT NULL), d AS (SELECT parent, child, t, {panels.draw_sql('(n - 1)', "'ar1'", 'child', 'parent', '(t - 1)')} AS k FROM filled, kids WHERE t > 0),
g AS (SELECT d.parent, d.child, d.t, e.e AS v FROM d JOIN e ON e.parent = d.parent AND e.k = d.k UNION ALL SELECT parent, child, t, x FROM filled, kids WHERE t = 0)
SELECT f.parent, CAST(g.child AS BIGINT) AS child, f.t AS day_idx, round(CASE WHEN NOT first(missing) THEN sum(v * pow(phi, f.t - g.t)) END, 6) + 0.0 AS value FROM filled f JOIN g ON g.parent = f.parent AND g.t BETWEEN f.t - 80 AND f.t JOIN p ON p.parent = f.parent GROUP BY f.parent, g.child, f.t"""))
def nu12_ar1_surrogates(spark, sf_dir):
    """The SQL sums 80 lags: what is beyond weighs less than the sixth digit for the panels' phi."""
    return result(spectral.ar1_surrogates(panels.canonical(spark, sf_dir), 3))


@query()
def si5_escape_trials(spark, sf_dir):
    packed = ladders.omegas(spark, sf_dir).groupBy("ladder").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "omega"))), lambda x: x["omega"]).alias("omega"))
    trials = dynamics.simulate_trials(packed, 5, dynamics.Trial(window=(2, 9), centre=2, p_swap=0.02, most_escape=20, most_heal=20))
    return result(ladder.trial_summary(trials, ["ladder"]))


@query()
def si2_ladder_points(spark, sf_dir):
    """Every brand's whole ladder at every point of a 16 by 12 grid of mutation and anchoring."""
    base = ladders.ladders(spark, sf_dir)
    null = ladder.cyclic_coherence(ladder.null_ladders(base, ladders.CHILDREN), ["ladder", "child"]).groupBy("ladder").agg(F.avg("coherence").alias("null_mean"), F.stddev_pop("coherence").alias("null_deviation"))
    whole = base.groupBy("ladder").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("base")).join(null, "ladder")
    grid = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit(x / 15).alias("mutation"), F.lit(1 - y / 11).alias("anchoring")) for y in range(12) for x in range(16))))
    rows = whole.withColumn("p", grid).select("ladder", "p.*", "base", "null_mean", "null_deviation").repartition("ladder", "x", "y")
    return result(spectral.ladder_points(rows).drop("base"))


@query()
def ag48_power_by_cell(spark, sf_dir):
    cells = spark.range(0, 24).select(F.when(F.col("id") % 2 == 0, "iid").otherwise("ar1").alias("kind"), F.lit(0.6).alias("phi"), F.col("id").alias("replicate"))
    series = spectral.synthetic_series(cells, 420)
    scores = stored(blocks.block_persistence(series, ["kind", "replicate"], [6]), "power")
    return result(summaries.power(scores, ["kind", "n"], 0.2))


@query()
def ag49_simulated_power(spark, sf_dir):
    parents = spark.createDataFrame([(n, i, e, 0.1) for n in (12, 28) for i in (0.0, 0.5) for e in (0.0, 0.5)], "parents long, icc double, effect double, missing double")
    return result(spectral.simulated_power(parents.repartition(4), 400))


# Closure over null children, perturbation distances, curvature and bootstrap, more null kinds.

CLOSURE_NULLS = "SELECT parent, child, n, CASE WHEN count(value - ahead) >= 365 AND sqrt(avg(value * value)) > 1e-12 THEN sqrt(avg((value - ahead) * (value - ahead))) / sqrt(avg(value * value)) END AS error FROM (" + " UNION ALL ".join(f"SELECT parent, child, {n} AS n, value, lead(value, {n}) OVER (PARTITION BY parent, child ORDER BY day_idx) AS ahead FROM joined" for n in panels.SIZES) + ") GROUP BY 1, 2, 3"
CHAIN = "readings daily panel centred scales canonical nulls joined"


@query(with_ctes(panels.CTES, CHAIN, f", e AS ({CLOSURE_NULLS}) SELECT a.parent, CAST(a.n AS BIGINT) AS n, {r('first(b.error)', 'observed')}, {r('median(a.error)', 'null_median')}, {r('(1 + count(*) FILTER (WHERE a.error <= b.error)) / 128.0', 'local_p')} FROM e a JOIN e b ON a.parent = b.parent AND a.n = b.n AND b.child = 0 WHERE a.child > 0 GROUP BY 1, 2"))
def ag44_closure_nulls(spark, sf_dir):
    errors = blocks.closure_error(panels.with_nulls(panels.canonical(spark, sf_dir), panels.CHILDREN), ["parent", "child"], panels.SIZES)
    cells = inference.parent_cells(errors, ["parent", "n"], panels.CHILDREN, score="error")
    return result(cells.select("parent", "n", "observed", "null_median", F.col("lower_p").alias("local_p")))


@query(with_ctes(panels.CTES, CHAIN, f", e AS ({CLOSURE_NULLS}), w AS (SELECT parent, child, n FROM (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY error, n) AS k FROM e WHERE error IS NOT NULL) WHERE k = 1) SELECT CAST(n AS BIGINT) AS winner, child = 0 AS observed, count(*) AS votes FROM w GROUP BY 1, 2"))
def ag53_winner_distribution(spark, sf_dir):
    errors = blocks.closure_error(panels.with_nulls(panels.canonical(spark, sf_dir), panels.CHILDREN), ["parent", "child"], panels.SIZES)
    winners = blocks.closure_winner(errors, ["parent", "child"])
    return result(winners.groupBy("winner", (F.col("child") == 0).alias("observed")).agg(F.count(F.lit(1)).alias("votes")))


@query(with_ctes(panels.CTES, CHAIN, f", e AS ({CLOSURE_NULLS}), p AS (SELECT a.parent, CAST(a.n AS BIGINT) AS n, a.error < b.error AS better FROM e a JOIN e b ON a.parent = b.parent AND a.child = 0 AND b.child = 0 AND a.n = 14 AND b.n <> 14) SELECT CAST(x.n AS BIGINT) AS n, count(*) AS pairs, count(*) FILTER (WHERE a.error < x.error) AS better, {r(panels.binomial_sql('count(*) FILTER (WHERE a.error < x.error)', 'count(*)'), 'sign_p')} FROM e a JOIN e x ON a.parent = x.parent AND a.child = 0 AND x.child = 0 AND a.n = 14 AND x.n <> 14 GROUP BY 1").replace(", p AS (SELECT a.parent, CAST(a.n AS BIGINT) AS n, a.error < b.error AS better FROM e a JOIN e b ON a.parent = b.parent AND a.child = 0 AND b.child = 0 AND a.n = 14 AND b.n <> 14)", ""))
def j3_comparator_pairs(spark, sf_dir):
    errors = stored(blocks.closure_error(panels.canonical(spark, sf_dir), ["parent"], panels.SIZES), "errors")
    return result(summaries.comparator_pairs(errors, 14))


CONDITION_DAYS = "WITH h AS (" + panels.HOURLY + "), c AS (" + " UNION ALL ".join(
    f"SELECT {k} AS ix, parent, day_idx, median(ln(1 + x)) AS value FROM (SELECT parent, day_idx, {x} AS x FROM h) GROUP BY ALL" for k, x in enumerate(("reading", "reading * 0.95", "reading * 1.05", "CASE WHEN NOT (day_idx % 30 = 0 AND hour < 6) THEN reading END"))) + ")"


@query(CONDITION_DAYS + f" SELECT a.parent, CAST(a.ix AS BIGINT) AS left_ix, CAST(b.ix AS BIGINT) AS right_ix, {r('sqrt(avg((a.value - b.value) * (a.value - b.value)))', 'rmse')}, {r('covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value))', 'correlation')} FROM c a JOIN c b ON a.parent = b.parent AND a.day_idx = b.day_idx AND a.ix < b.ix GROUP BY 1, 2, 3")
def ag45_perturbation_distances(spark, sf_dir):
    rows = panels.hourly(spark, sf_dir)
    every = reduce(DataFrame.union, (panel.perturbed(rows, c).groupBy("parent", "day_idx").agg(F.median(F.log(1 + F.col("reading"))).alias("value")).select(F.lit(k).cast("long").alias("ix"), "parent", "day_idx", "value") for k, c in enumerate(panel.CONDITIONS[:4])))
    every = stored(every, "conditions")
    right = every.select(F.col("ix").alias("right_ix"), "parent", "day_idx", F.col("value").alias("y"))
    pairs = every.withColumnRenamed("ix", "left_ix").join(right, ["parent", "day_idx"]).where("left_ix < right_ix")
    return result(pairs.groupBy("parent", "left_ix", "right_ix").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("y"), 2))).alias("rmse"), (F.covar_pop("value", "y") / (F.stddev_pop("value") * F.stddev_pop("y"))).alias("correlation")))


@query(with_ctes(panels.CTES, CHAIN, f", b AS ({panels.block_cte('joined', 'parent, child', [9])}) SELECT parent, {r('median(v)', 'null_variance')} FROM (SELECT parent, child, var_pop(value) AS v FROM b WHERE child > 0 GROUP BY 1, 2) GROUP BY 1"))
def ag38_null_metric_medians(spark, sf_dir):
    children = nulls.month_strata_nulls(panels.canonical(spark, sf_dir), panels.CHILDREN)
    metrics = blocks.block_means(children, ["parent", "child"], [9]).groupBy("parent", "child").agg(F.var_pop("value").alias("v"))
    return result(metrics.groupBy("parent").agg(F.median("v").alias("null_variance")))


@query(with_ctes(panels.CTES, panels.SCORES_CHAIN, f", s AS (SELECT o.parent, o.score AS a, n.score AS b FROM obs14 o JOIN null14 n ON o.parent = n.parent) SELECT parent, {r('(1 + count(*) FILTER (WHERE b >= a - greatest(1e-10, abs(a) * 1e-10))) / 128.0', 'upper_p')} FROM s GROUP BY 1"))
def ag51_upper_p_with_ties(spark, sf_dir):
    from gneiss.functions.robust import tie_tolerance

    observed, children = panels._scores14(spark, sf_dir)
    joined = children.join(observed.withColumnRenamed("score", "a"), "parent")
    return result(joined.groupBy("parent").agg(((F.count_if(F.col("score") >= F.col("a") - tie_tolerance(F.col("a"))) + 1) / (panels.CHILDREN + 1)).alias("upper_p")))


@query("WITH t AS (SELECT o_orderkey % 2 = 0 AS truth, o_totalprice > 250000 AS claim, o_orderstatus AS family FROM orders) SELECT family, count(*) FILTER (WHERE truth AND claim) AS tp, count(*) FILTER (WHERE NOT truth AND claim) AS fp, round(avg(CAST(claim AS DOUBLE)) FILTER (WHERE truth), 6) + 0.0 AS power, round(avg(CAST(claim AS DOUBLE)) FILTER (WHERE NOT truth), 6) + 0.0 AS false_rate, round(avg(CAST(claim = truth AS DOUBLE)), 6) + 0.0 AS agreement FROM t GROUP BY 1")
def ag52_method_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2 == 0).alias("truth"), (F.col("o_totalprice") > 250000).alias("claim"), F.col("o_orderstatus").alias("family"))
    return result(summaries.method_metrics(rows, ["family"], "truth", "claim"))


@query("SELECT round(count(*) FILTER (WHERE l_discount > 0.08)::DOUBLE / count(*), 6) + 0.0 AS failure_fraction FROM lineitem")
def ag65_failure_fraction(spark, sf_dir):
    return result(summaries.failure_fraction(table(spark, sf_dir, "lineitem"), F.col("l_discount") > 0.08))


@query(with_ctes(ladders.CTES, "ladders", ", t AS (SELECT ladder, child, pos, value, (pos - 1) // 30 AS c, (pos - 1) % 30 AS k, count(*) OVER (PARTITION BY ladder, child) // 30 AS n FROM ladders, (SELECT unnest(range(1, 3)) AS child)), m AS (SELECT ladder, child, c, row_number() OVER (PARTITION BY ladder, child ORDER BY md5(concat_ws('|', 'chunk', CAST(child AS VARCHAR), ladder, CAST(c AS VARCHAR))), c) - 1 AS to_c FROM (SELECT DISTINCT ladder, child, c FROM t WHERE c < n)) SELECT t.ladder, CAST(t.child AS BIGINT) AS child, to_c * 30 + k AS day_idx, round(value, 6) + 0.0 AS value FROM t JOIN m ON t.ladder = m.ladder AND t.child = m.child AND t.c = m.c UNION ALL SELECT ladder, CAST(child AS BIGINT), pos - 1, round(value, 6) + 0.0 FROM t WHERE c >= n"))
def nu15_chunk_shuffle(spark, sf_dir):
    rows = ladders.ladders(spark, sf_dir).select(F.col("ladder").alias("parent"), (F.col("pos") - 1).alias("day_idx"), "value")
    return result(nulls.block_nulls(rows, 2, size=30, seed="chunk").withColumnRenamed("parent", "ladder"))


@query(with_ctes(fields.CTES, "cells grid", ", s AS (SELECT field, i, sqrt(sum(u * u + v * v)) AS size FROM grid GROUP BY 1, 2) SELECT field, i, round(size, 6) + 0.0 AS size FROM s"))
def ge14_scalarize(spark, sf_dir):
    return result(summaries.magnitudes(fields.grid(spark, sf_dir), ["field", "i"], ["u", "v"]))


@query(with_ctes(fields.CTES, "cells grid zeroed slopes", f", e AS (SELECT field, avg((dv_dj - du_di) * (dv_dj - du_di)) FILTER (WHERE seen) AS curl, avg((du_dj + dv_di) * (du_dj + dv_di)) FILTER (WHERE seen) AS div FROM slopes GROUP BY 1) SELECT {r('median(curl)', 'curl_energy')}, {r('median(div)', 'divergence_energy')} FROM e"))
def ge8_vector_frame_medians(spark, sf_dir):
    scores = geometry.vector_scores(fields.grid(spark, sf_dir), ["field"]).withColumn("one", F.lit(1))
    return result(geometry.frame_medians(scores, ["one"], ["curl_energy", "divergence_energy"]).drop("one"))


@query("WITH w AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey % 5 <> 0), a AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0), n AS (SELECT DISTINCT c_nationkey::BIGINT AS k FROM customer) SELECT coalesce(x.k, n.k) AS k, coalesce(w, false) AS in_items, coalesce(a, false) AS in_suppliers, n.k IS NOT NULL AS in_nations FROM (SELECT coalesce(w.k, a.k) AS k, w.k IS NOT NULL AS w, a.k IS NOT NULL AS a FROM w FULL JOIN a ON w.k = a.k) x FULL JOIN n ON x.k = n.k")
def j10_three_way_inventory(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).where("k % 5 <> 0")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).where("k % 7 <> 0")
    nations = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    return summaries.inventories({"items": items, "suppliers": suppliers, "nations": nations}, "k")


@query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS s FROM documents) SELECT s AS sha256, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1")
def au3_equal_digests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return audit.duplicates(docs, ["sha256"])
