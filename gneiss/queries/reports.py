"""Queries over composed reports: traces of fields, closure diagnostics, adjudication, JSON documents, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import audit, blocks, geometry, inference, ladder, reports, spectral
from gneiss.plans.storage import stored
from gneiss.queries import fields, kernels, ladders, panels
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.queries.panels import draw_sql
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
CHILDREN, SIZES, REPLICATES = 15, range(2, 15), 199


def quoted(text: str) -> str:
    return text.replace("'", "''")


def modal_sql(source: str, keys: str, counts: str, out: str, penalty: str = "0.0") -> str:
    """Common tables whose last one, ``out``, has (keys, n, value): the power beyond the n strongest modes of 50 x 11 fields."""
    k = ", ".join(f"{out}_{x}" for x in "xhpo")
    x, h, p, o = k.split(", ")
    return f"""{x} AS (SELECT {keys}, i, j, value - sum(value) OVER (PARTITION BY {keys}) / 550.0 AS x FROM {source}),
{h} AS (SELECT {keys}, i, l, sum(x * cos(2 * pi() * j * l / 11)) AS re, sum(-x * sin(2 * pi() * j * l / 11)) AS im FROM {x}, (SELECT unnest(range(0, 6)) AS l) GROUP BY {keys}, i, l),
{p} AS (SELECT {keys}, k, l, pow(sum(re * cos(2 * pi() * i * k / 50) + im * sin(2 * pi() * i * k / 50)), 2) + pow(sum(im * cos(2 * pi() * i * k / 50) - re * sin(2 * pi() * i * k / 50)), 2) AS p FROM {h}, (SELECT unnest(range(0, 50)) AS k) GROUP BY {keys}, k, l),
{o} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC) AS place FROM {p}),
{out} AS (SELECT {keys}, n, coalesce(sum(p) FILTER (WHERE place > n), 0) / sum(p) + {penalty} + 2.220446049250313e-16 AS value FROM {o}, (SELECT unnest({counts}) AS n) GROUP BY {keys}, n)"""


@query(with_ctes(fields.CTES, "cells", ", " + modal_sql("cells", "field", "range(2, 15)", "t") + f" SELECT field, n, {r('value', 'residual')} FROM t"))
def ge16_modal_residual_trace(spark, sf_dir):
    return result(spectral.modal_trace(fields.grid(spark, sf_dir), "field", list(SIZES)))


@query(with_ctes(fields.CTES, "cells", ", " + modal_sql("cells", "field", "range(7, 14)", "t", "0.0015 * (n - 10) * (n - 10)") + f", m AS (SELECT field, min(value) AS least FROM t GROUP BY 1) SELECT t.field, {r('first(least)', 'minimum')}, count(*) AS tied, min(n) AS coordinate, bool_or(n = 7 OR n = 13) AS boundary, bool_or(n = 8 OR n = 12) AS next_to_boundary FROM t JOIN m ON t.field = m.field WHERE value <= least + 1e-10 GROUP BY 1"))
def ge15_modal_closure_audit(spark, sf_dir):
    traces = spectral.modal_trace(fields.grid(spark, sf_dir), "field", list(range(7, 14)), penalty=0.0015)
    return result(ladder.minimum_audit(traces, ["field"], "n", "residual"))


def _traces(spark, sf_dir):
    grid = fields.grid(spark, sf_dir).withColumn("seen", F.lit(True))
    parents = stored(spectral.modal_trace(grid, "field", list(SIZES)).select(F.col("field").alias("parent"), "n", F.col("residual").alias("value")), "traces")
    kids = geometry.permute_cells(grid, ["field"], CHILDREN, seed="modal").withColumn("seen", F.lit(True))
    children = stored(spectral.modal_trace(kids, ["field", "child"], list(SIZES)).select(F.col("field").alias("parent"), "child", "n", F.col("residual").alias("value")), "null-traces")
    return parents, children


_KIDS = f"""kids AS (SELECT t.field, t.child, t.i, t.j, s.value FROM (SELECT *, row_number() OVER (PARTITION BY field, child ORDER BY i, j) AS q FROM cells, (SELECT unnest(range(1, {CHILDREN + 1})) AS child)) t JOIN
  (SELECT *, row_number() OVER (PARTITION BY field, child ORDER BY md5(concat_ws('|', 'modal', CAST(child AS VARCHAR), CAST(field AS VARCHAR), CAST(i * 1000000 + j AS VARCHAR))), i, j) AS q FROM cells, (SELECT unnest(range(1, {CHILDREN + 1})) AS child)) s ON t.field = s.field AND t.child = s.child AND t.q = s.q)"""
_TRACES = (", " + modal_sql("cells", "field", "range(2, 15)", "t") + ", " + _KIDS + ", " + modal_sql("kids", "field, child", "range(2, 15)", "c")
           + f", draws AS (SELECT field, replicate, {draw_sql(str(CHILDREN), repr('trace'), 'replicate', 'field')} + 1 AS child FROM (SELECT DISTINCT field FROM cells), (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate)), joint AS (SELECT replicate, n, median(value) AS value FROM draws JOIN c USING (field, child) GROUP BY 1, 2), population AS (SELECT n, median(value) AS value FROM t GROUP BY 1)")


@query(with_ctes(fields.CTES, "cells", _TRACES + f", q AS (SELECT n, median(value) AS m, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM joint GROUP BY 1) SELECT q.n, {r('p.value', 'observed')}, {r('m', 'joint_median')}, {r('lo', 'q025')}, {r('hi', 'q975')} FROM q JOIN population p ON p.n = q.n"))
def ag55_modal_trace_audit(spark, sf_dir):
    parents, children = _traces(spark, sf_dir)
    return result(reports.trace_audit(parents, children, CHILDREN, replicates=REPLICATES))


@query(with_ctes(fields.CTES, "cells", ", " + modal_sql("cells", "field", "range(2, 15)", "t") + f", e AS (SELECT CAST(field AS VARCHAR) AS parent, n, value FROM t UNION ALL SELECT NULL, n, median(value) FROM t GROUP BY 2), m AS (SELECT *, min(value) OVER (PARTITION BY parent) AS least FROM e) SELECT parent, {r('first(least)', 'minimum')}, count(*) AS tied, min(n) AS coordinate, bool_or(n = 2 OR n = 14) AS boundary, bool_or(n = 3 OR n = 13) AS next_to_boundary FROM m WHERE value <= least + 1e-10 GROUP BY 1"))
def ag55_trace_minima(spark, sf_dir):
    traces = spectral.modal_trace(fields.grid(spark, sf_dir), "field", list(SIZES)).select(F.col("field").alias("parent"), "n", F.col("residual").alias("value"))
    return result(reports.trace_minima(stored(traces, "traces")))


def _bend(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT * FROM (SELECT {keys + ', ' if keys else ''}n, -(lead(ln(value)) OVER w - 2 * ln(value) + lag(ln(value)) OVER w) AS c FROM {source} WINDOW w AS ({part}ORDER BY n)) WHERE c IS NOT NULL"


@query(with_ctes(fields.CTES, "cells", _TRACES + f""", b AS ({_bend('population', '')}), o AS (SELECT max(c) AS peak, min(c) AS least FROM b), near AS (SELECT greatest(abs(peak) * 1e-12, 16 * 2.220446049250313e-16) AS near FROM o), e AS (SELECT CASE WHEN count(*) = 1 THEN min(n) END AS elbow FROM b, o, near WHERE c >= peak - near),
s AS (SELECT 1.4826 * median(abs(ln(value) - x)) AS scale FROM population, (SELECT median(ln(value)) AS x FROM population)), jp AS (SELECT replicate, max(c) AS p FROM ({_bend('joint', 'replicate')}) GROUP BY 1), jm AS (SELECT median(p) AS m FROM jp), js AS (SELECT m, 1.4826 * median(abs(p - m)) AS sd FROM jp, jm GROUP BY 1),
ids AS (SELECT field, row_number() OVER (ORDER BY field) - 1 AS k FROM (SELECT DISTINCT field FROM cells)), d AS (SELECT sample, slot, {draw_sql('(SELECT count(*) FROM ids)', repr('bootstrap'), 'sample', 'slot')} AS k FROM (SELECT unnest(range(1, 100)) AS sample), (SELECT k AS slot FROM ids)), rs AS (SELECT sample, n, median(value) AS value FROM d JOIN ids ON ids.k = d.k JOIN t ON t.field = ids.field GROUP BY 1, 2),
rb AS ({_bend('rs', 'sample')}), rp AS (SELECT *, max(c) OVER (PARTITION BY sample) AS peak FROM rb), re AS (SELECT sample, CASE WHEN count(*) = 1 THEN min(n) END AS again FROM rp, near WHERE c >= peak - near GROUP BY 1), st AS (SELECT avg(CASE WHEN again = elbow THEN 1.0 ELSE 0.0 END) AS stability FROM re, e)
SELECT CASE WHEN elbow IS NULL THEN 'REJECTED_TIED_ELBOW' ELSE 'COMPUTED_INTERIOR_ONLY' END AS status, elbow, {r('peak', 'peak')}, {r('peak / greatest(scale, 2.220446049250313e-16)', 'relative_prominence')}, {r('(peak - m) / greatest(sd, 2.220446049250313e-16)', 'null_standardized_prominence', 4)}, coalesce(elbow = 3, false) AS first_interior_pinning, coalesce(elbow = 13, false) AS last_interior_pinning, {r('CASE WHEN elbow IS NOT NULL THEN stability END', 'bootstrap_stability')} FROM o, e, s, js, st"""))
def ag57_curvature_audit(spark, sf_dir):
    parents, children = _traces(spark, sf_dir)
    joint = stored(reports.joint_traces(parents, children, CHILDREN, replicates=REPLICATES), "joint")
    out = reports.curvature_audit(parents, joint, samples=99)
    return result(out.withColumn("null_standardized_prominence", F.round("null_standardized_prominence", 4)))


@query(panels.SQL["ag24_joint_parent_null"].split("SELECT round(a, 6)")[0] + f"SELECT {r('a', 'observed')}, {r('med', 'joint_median')}, {r('q025', 'q025')}, {r('q975', 'q975')}, {r('a - med', 'difference')}, {r('(a - med) / greatest(joint_scale, 2.220446049250313e-16)', 'standardized', 4)}, {r('joint_scale', 'joint_scale')}, parents, replicates FROM o, m, t")
def ag25_joint_summary(spark, sf_dir):
    observed, children = panels._scores14(spark, sf_dir)
    out = reports.joint_summary(observed, children, panels.CHILDREN, [])
    return result(out.withColumn("standardized", F.round("standardized", 4)))


@query(with_ctes(panels.CTES, kernels.CHAIN, f""", e AS ({kernels.CLOSURE_NULLS}), cells AS (SELECT a.parent, a.n, (1 + count(*) FILTER (WHERE a.error <= b.error)) / 128.0 AS p FROM e a JOIN e b ON a.parent = b.parent AND a.n = b.n AND b.child = 0 WHERE a.child > 0 GROUP BY 1, 2),
w AS (SELECT parent, n FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY error, n) AS k FROM e WHERE error IS NOT NULL AND child = 0) WHERE k = 1), v AS (SELECT n, count(*) AS votes FROM w GROUP BY 1)
SELECT CAST(c.n AS BIGINT) AS n, coalesce(first(votes), 0) AS observed_winners, {r('median(p)', 'median_lower_p')}, count(*) FILTER (WHERE p <= 0.05) AS at_most_005, CASE WHEN coalesce(first(votes), 0) > 0 AND count(*) FILTER (WHERE p <= 0.05) > 0 THEN 'REQUIRES_NEW_HELDOUT_TEST' ELSE 'NO_CLOSURE_MODE_EVIDENCE' END AS classification FROM cells c LEFT JOIN v ON v.n = c.n GROUP BY c.n"""))
def ag46_size_diagnostic(spark, sf_dir):
    errors = stored(blocks.closure_error(panels.with_nulls(panels.canonical(spark, sf_dir), panels.CHILDREN), ["parent", "child"], panels.SIZES), "errors")
    cells = inference.parent_cells(errors, ["parent", "n"], panels.CHILDREN, score="error")
    winners = blocks.closure_winner(errors.where("child = 0"), ["parent"])
    return result(reports.size_diagnostic(cells, winners))


@query("""SELECT * FROM (VALUES ('winners_recomputed', true, 'rejected'), ('transitions_recomputed', true, 'rejected'), ('reported_transitions', false, 'rejected')) t("check", ok, status)""")
def ag66_summary_verification(spark, sf_dir):
    """Closure winners by two plans, transition counts by two plans, and reported counts that are one too many."""
    rows = stored(ladder.chi(ladders.omegas(spark, sf_dir), ["ladder"]), "chis")
    winners = ladder.closure_winner(ladder.closure_scores(rows, ["ladder"], (2, 30)), ["ladder"]).select("ladder", "winner", "winner_rms")
    again = rows.select("ladder", F.explode(F.sequence(F.lit(2), F.lit(30))).alias("n"), "chi").withColumn("rms", F.abs(F.col("chi") - ladder.TWO_PI / F.col("n")))
    again = again.groupBy("ladder").agg(F.min(F.struct("rms", "n")).alias("b")).select("ladder", F.col("b.n").cast("long").alias("winner"), F.col("b.rms").alias("winner_rms"))
    events = table(spark, sf_dir, "events").withColumn("alpha", F.col("user_id") % 4)
    counts = stored(ladder.transitions(events, ["user_id"], ["ts", "event_id"], "event_type", ["alpha"]), "transitions")
    whole = events.groupBy("user_id", "alpha").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    pairs = whole.select("alpha", F.explode(F.zip_with(F.expr("slice(s, 1, size(s) - 1)"), F.expr("slice(s, 2, size(s))"), lambda a, b: F.struct(a.alias("from_state"), b.alias("to_state")))).alias("p")).select("alpha", "p.*")
    other = pairs.groupBy("alpha", "from_state", "to_state").agg(F.count(F.lit(1)).alias("count"))
    keys = ["alpha", "from_state", "to_state"]
    return reports.verified({
        "winners_recomputed": audit.compare_tables(winners, again, ["ladder"], ["winner", "winner_rms"]),
        "transitions_recomputed": audit.compare_tables(counts, other, keys, ["count"]),
        "reported_transitions": audit.compare_tables(counts.withColumn("count", F.col("count") + 1), other, keys, ["count"])})


_STUDY = """SELECT s_suppkey AS study, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal / 1000) AS BIGINT) END AS t_e, greatest(s_acctbal / 10000, 0) AS s_e, s_nationkey % 3 <> 0 AS sep_any, s_nationkey % 2 = 0 AS specificity_passed, s_nationkey % 5 <> 0 AS residual_persists, s_suppkey % 11 = 0 AS single_parent,
CASE WHEN s_suppkey % 7 = 0 THEN 'rejected' ELSE 'verified' END AS verifier_status, CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS disagreements, CASE WHEN s_suppkey % 17 = 0 THEN 24 ELSE 25 END AS rejected_mutations, 25 AS mutations FROM supplier"""


@query(f"""WITH s AS ({_STUDY}), g AS (SELECT *, t_e IS NOT NULL AS a, s_e > 0 AS b, verifier_status = 'verified' AND disagreements = 0 AS v, rejected_mutations = mutations AS m FROM s), d AS (SELECT *, a AND b AND sep_any AS p, a AND b AND sep_any AND v AND m AND residual_persists AND NOT single_parent AS q FROM g)
SELECT study, CASE WHEN q THEN 'POSITIVE' WHEN p THEN 'PARTIAL_WITH_BLOCKERS' ELSE 'NEGATIVE' END AS outcome, CASE WHEN q THEN 'PERMITTED' ELSE 'BLOCKED' END AS derived_status, CASE WHEN q THEN 'DERIVED' ELSE 'COMPUTED' END AS claim_level, v AND m AS protocol_valid,
concat_ws(' | ', {', '.join(f"CASE WHEN NOT {c} THEN '{quoted(t)}' END" for c, t in zip(('sep_any', 'a', 'b', 'specificity_passed', 'v'), reports.BLOCKERS.values()))}) AS blockers FROM d""")
def au12_adjudication(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    studies = s.select(
        F.col("s_suppkey").alias("study"), F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 1000)).alias("t_e"), F.greatest(F.col("s_acctbal") / 10000, F.lit(0.0)).alias("s_e"), (F.col("s_nationkey") % 3 != 0).alias("sep_any"),
        (F.col("s_nationkey") % 2 == 0).alias("specificity_passed"), (F.col("s_nationkey") % 5 != 0).alias("residual_persists"), (F.col("s_suppkey") % 11 == 0).alias("single_parent"),
        F.when(F.col("s_suppkey") % 7 == 0, "rejected").otherwise("verified").alias("verifier_status"), F.when(F.col("s_suppkey") % 13 == 0, 1).otherwise(0).alias("disagreements"),
        F.when(F.col("s_suppkey") % 17 == 0, 24).otherwise(25).alias("rejected_mutations"), F.lit(25).alias("mutations"))
    return reports.adjudicated(studies).select("study", "outcome", "derived_status", "claim_level", "protocol_valid", F.array_join("blockers", " | ").alias("blockers"))


@query("""WITH l AS (SELECT p_brand AS ladder, sha256('[' || string_agg(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY p_partkey) || ']') AS values_hash FROM part GROUP BY 1), c AS (SELECT *, sha256('{"omega":"natural_log(value)","row_order":"source_order","sigma_omega":"sigma/value"}') AS canonicalization_hash FROM l),
p AS (SELECT *, 'ladder-' || substr(sha256('{"canonicalization_hash":"' || canonicalization_hash || '","domain_id":"parts-' || ladder || '","kind":"observed_parent","source_values_hash":"' || values_hash || '"}'), 1, 16) AS parent_id FROM c)
SELECT parent_id AS id, 'observed_parent' AS kind, NULL::VARCHAR AS parent, false AS is_null, ladder, values_hash, canonicalization_hash, 'natural_log(value), source row order' AS rule FROM p
UNION ALL SELECT 'control-' || substr(sha256('{"kind":"alpha_zero_control","parent":"' || parent_id || '"}'), 1, 16), 'alpha_zero_control', parent_id, true, ladder, values_hash, canonicalization_hash, 'natural_log(value), source row order' FROM p""")
def au14_registry_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ladder"), "p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    whole = parts.groupBy("ladder").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "cents"))), lambda x: x["cents"]).alias("values"))
    return reports.registered(whole, domain="parts")


def _documents(spark, sf_dir, changed: bool):
    """Orders with their items as JSON documents; the changed ones have another status or amount here and there."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("amount")).groupBy("key", "line").agg(F.sum("amount").alias("amount"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    if changed:
        items = items.where("not (key % 5 = 0 and line = 1)").withColumn("amount", F.when((F.col("key") % 3 == 0) & (F.col("line") == 2), F.col("amount") + 1).otherwise(F.col("amount")))
        orders = orders.withColumn("status", F.when(F.col("key") % 7 == 0, F.lit("?")).otherwise(F.col("status")))
    listed = items.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("line"), F.col("line").cast("string")).alias("k"), F.struct("amount").alias("v")))).alias("items"))
    rows = orders.join(listed, "key", "left").select("key", F.to_json(F.struct("status", F.struct("items").alias("content"))).alias("document"))
    return rows


_LINES = "SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS line, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


@query(f"""WITH i AS ({_LINES}), s AS (SELECT o_orderkey AS key, o_orderstatus AS status FROM orders) SELECT key, '$.status' AS path, '"' || status || '"' AS "left", '"?"' AS "right" FROM s WHERE key % 7 = 0
UNION ALL SELECT key, '$.content.items.line' || line || '.amount', CAST(amount AS VARCHAR), CAST(amount + 1 AS VARCHAR) FROM i WHERE key % 3 = 0 AND line = 2
UNION ALL SELECT key, '$.content.items.line1.amount', CAST(amount AS VARCHAR), NULL FROM i WHERE key % 5 = 0 AND line = 1""")
def j6_json_difference(spark, sf_dir):
    return reports.json_difference(_documents(spark, sf_dir, False), _documents(spark, sf_dir, True), ["key"], "document")


@query("SELECT o_orderkey AS key, CASE WHEN max(l_orderkey) IS NULL THEN 1 ELSE 4 END::BIGINT AS depth FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def pf19_json_depth(spark, sf_dir):
    return result(reports.json_depth(_documents(spark, sf_dir, False), ["key"], "document"))


@query("SELECT doc_id, row_number() OVER (ORDER BY text NULLS FIRST, doc_id) AS place FROM documents")
def st9_code_point_order(spark, sf_dir):
    """Documents in the order of their texts' code points."""
    return audit.numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), [F.col("text"), F.col("doc_id")], "place").select("doc_id", "place")
