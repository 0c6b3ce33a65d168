"""Predicate queries: gates, ceilings, look-ups, validation and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import audit, summaries, validation
from gneiss.queries.common import Registry, result
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql


@query("WITH a AS (SELECT user_id % 2 AS alpha, avg(CAST(value > 50 AS DOUBLE)) AS rate, median(value) AS m FROM events GROUP BY 1) SELECT x.rate < y.rate AS rate_rises, x.m > y.m AS median_falls, abs(x.m - y.m) < 5 AS medians_close FROM a x, a y WHERE x.alpha = 0 AND y.alpha = 1")
def pf9_registered_comparisons(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("alpha")).agg(F.avg((F.col("value") > 50).cast("double")).alias("rate"), F.median("value").alias("m"))
    wide = rows.groupBy().pivot("alpha", [0, 1]).agg(F.first("rate").alias("rate"), F.first("m").alias("m"))
    return wide.select((F.col("0_rate") < F.col("1_rate")).alias("rate_rises"), (F.col("0_m") > F.col("1_m")).alias("median_falls"), (F.abs(F.col("0_m") - F.col("1_m")) < 5).alias("medians_close"))


RULES = {"SIZE": "p_size > 45", "PRICE": "p_retailprice > 1900", "BRAND": "p_brand = 'Brand#11'"}


@query(" UNION ALL ".join(f"SELECT '{code}' AS code, CAST(p_partkey AS VARCHAR) AS detail FROM part WHERE {rule}" for code, rule in RULES.items()))
def pf10_protocol_issues(spark, sf_dir):
    return audit.issues(table(spark, sf_dir, "part"), {code: F.expr(rule) for code, rule in RULES.items()}, F.col("p_partkey").cast("string"))


@query("SELECT mutation, p_partkey, array_to_string(list_filter([CASE WHEN CASE WHEN mutation = 'size' THEN 50 ELSE p_size END > 45 THEN 'SIZE' END, CASE WHEN CASE WHEN mutation = 'price' THEN 5000 ELSE p_retailprice END > 1900 THEN 'PRICE' END], lambda x: x IS NOT NULL), ';') AS codes FROM part, (SELECT unnest(['none', 'size', 'price']) AS mutation)")
def pf11_mutations(spark, sf_dir):
    rules = {"SIZE": F.col("p_size") > 45, "PRICE": F.col("p_retailprice") > 1900}
    changes = {"none": {}, "size": {"p_size": F.lit(50)}, "price": {"p_retailprice": F.lit(5000.0)}}
    return validation.mutated(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), changes, rules).select("mutation", "p_partkey", "codes")


@query("SELECT c_custkey, least(c_custkey % 5, c_nationkey % 4, 2)::BIGINT AS level FROM customer")
def pf13_claim_ceiling(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", summaries.claim_ceiling(F.col("c_custkey") % 5, F.col("c_nationkey") % 4).alias("level"))


@query("SELECT s_suppkey, s_acctbal > 0 AND s_nationkey < 20 AND s_suppkey % 4 <> 0 AND length(s_name) > 3 AND s_suppkey > 0 AS applies FROM supplier")
def pf14_applicability(spark, sf_dir):
    flags = (F.col("s_acctbal") > 0, F.col("s_nationkey") < 20, F.col("s_suppkey") % 4 != 0, F.length("s_name") > 3, F.col("s_suppkey") > 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", summaries.applicable(*flags).alias("applies"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 WHEN 'purchase' THEN 1 END::BIGINT AS repeats FROM events")
def pf15_repeat_policy(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", validation.looked_up(F.col("event_type"), {"click": 3, "view": 5, "purchase": 1}).cast("long").alias("repeats"))


GRID = "SELECT CAST(l_quantity AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, CASE WHEN count(*) % 7 <> 0 THEN avg(l_tax) END AS value, count(*) % 5 <> 0 AS seen FROM lineitem GROUP BY 1, 2"


@query(f"SELECT bool_and(NOT seen OR value IS NOT NULL) AS finite_where_seen, count(*) = (max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS dense, count(*) = count(DISTINCT i * 1000 + j) AS single FROM ({GRID})")
def pf16_field_validation(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("m"))
    return validation.field_checks(cells.select("i", "j", F.when(F.col("n") % 7 != 0, F.col("m")).alias("value"), (F.col("n") % 5 != 0).alias("seen")))


@query("WITH e AS (SELECT n_nationkey % 5 AS a, n_regionkey AS b, 1.0 AS w FROM nation), s AS (SELECT a, b, sum(w) AS w FROM e GROUP BY 1, 2) SELECT NOT EXISTS (SELECT 1 FROM s x FULL JOIN s y ON x.a = y.b AND x.b = y.a WHERE coalesce(x.w, 0) <> coalesce(y.w, 0)) AS symmetric, coalesce(bool_and(a <> b), true) AS loop_free FROM s")
def pf16_graph_validation(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 5).alias("src"), F.col("n_regionkey").alias("dst")).agg(F.sum(F.lit(1.0)).alias("w"))
    return validation.graph_checks(edges)


@query("SELECT p_partkey, p_size + length(p_brand) + CASE WHEN p_size > 40 THEN -100 ELSE 0 END + CASE WHEN p_retailprice > 1500 THEN -100 ELSE 0 END AS subtotal, NOT (p_size > 40 OR p_retailprice > 1500) AND p_size BETWEEN 0 AND 50 AS eligible FROM part")
def pf20_candidate_scores(spark, sf_dir):
    out = validation.candidate_scores(table(spark, sf_dir, "part"), {"size": F.col("p_size"), "brand": F.length("p_brand")}, (0, 50), [F.col("p_size") > 40, F.col("p_retailprice") > 1500])
    return result(out.select("p_partkey", "subtotal", "eligible"))


@query("SELECT l_returnflag, count(*) AS size, count(l_tax) AS finite, count(*) - count(l_tax) AS missing, round(min(l_tax), 6) + 0.0 AS minimum, round(max(l_tax), 6) + 0.0 AS maximum, round(median(l_extendedprice), 4) + 0.0 AS median FROM lineitem GROUP BY 1")
def pf23_numeric_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("size"), F.count("l_tax").alias("finite"), (F.count(F.lit(1)) - F.count("l_tax")).alias("missing"), F.min("l_tax").alias("minimum"), F.max("l_tax").alias("maximum"), F.round(F.median("l_extendedprice"), 4).alias("median"))
    return result(rows)


@query("SELECT event_id, round(value * 0.0254, 9) + 0.0 AS metres FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def pf24_unit_conversion(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", summaries.converted(F.col("value"), 0.0254).alias("metres")).where("metres is not null")
