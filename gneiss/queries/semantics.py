"""Queries over semantic audits: each brand's parts stand for a bundle's points, each condition of the panel for a family."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import blocks, ladder, semantics, typed
from gneiss.plans.storage import stored
from gneiss.queries import fields, panels
from gneiss.queries.common import Registry, with_ctes
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

#: One expression each, which both engines read: what a bundle numbered k says of itself, with faults here and there.
MANIFEST = {
    "profile": "CASE k % 4 WHEN 0 THEN 'ladder-historical-1' WHEN 1 THEN 'heldout-1' ELSE 'plain' END",
    "claim_level": "CASE k % 5 WHEN 0 THEN 'ILLUSTRATIVE' WHEN 1 THEN 'COMPUTED' WHEN 2 THEN 'DERIVED' WHEN 3 THEN 'EXTERNALLY_VALIDATED' ELSE 'UNKNOWN' END",
    "run_id": "concat('run-', k)", "kernel_id": "'kernel-1'", "specification_sha256": "CASE WHEN k % 7 = 0 THEN 'other' ELSE concat('spec-', k) END",
    "stated_points": "n + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END", "stated_failures": "lost - CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END",
    "stated_ui": "round(mean_ui + CASE WHEN k % 3 = 0 THEN 0.1 ELSE 0 END, 8)", "stated_nss": "round(mean_nss, 8)", "stated_s_e": "CASE WHEN k % 7 <> 1 THEN round(mean_s_e, 8) END", "stated_classes": "CASE WHEN k % 9 = 0 THEN 'none' ELSE class_list END",
}
SPECIFICATION = {
    "engine": "CASE k % 3 WHEN 0 THEN 'analytic' WHEN 1 THEN 'local' ELSE 'ladder' END", "width": "CASE WHEN k % 22 <> 21 THEN 10 END", "height": "CAST(ceil(n / 10.0) AS BIGINT)", "seed": "k",
    "requested_level": "CASE k % 3 WHEN 0 THEN 'COMPUTED' WHEN 1 THEN 'EXTERNALLY_VALIDATED' ELSE 'DERIVED' END", "null_count": "3", "spec_sha256": "concat('spec-', k)", "expected_run_id": "CASE WHEN k % 10 = 3 THEN 'run-x' ELSE concat('run-', k) END",
}
CLAIM = {
    "boundary_level": "CASE WHEN k % 11 = 0 THEN 'COMPUTED' ELSE " + MANIFEST["claim_level"] + " END", "independent_status": "CASE k % 4 WHEN 1 THEN 'independently_verified' WHEN 2 THEN 'forged' ELSE 'not_supplied' END", "claims_evidence": "k % 6 = 3",
}
DOCUMENTS = {
    "claim_authority": "CASE k % 3 WHEN 0 THEN 'COMPUTED' WHEN 1 THEN 'EXTERNALLY_VALIDATED' END", "ontology_version": "CASE WHEN k % 13 = 0 THEN '2' ELSE '1.0.0' END", "table_version": "CASE WHEN k % 17 <> 0 THEN '1.0.0' END",
    "conflates": "k % 8 = 5", "table_width": "CASE WHEN k % 5 = 1 THEN 11 ELSE 10 END", "table_height": "CAST(ceil(n / 10.0) AS BIGINT)",
}
POINT = {
    "index": "position + CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END", "grid_x": "position % 10", "grid_y": "CASE WHEN p_partkey % 60 = 0 THEN -1 WHEN p_partkey % 45 = 0 THEN 0 ELSE CAST(floor(position / 10) AS BIGINT) END",
    "classification": "CASE WHEN p_partkey % 70 = 0 THEN 'OTHER' WHEN p_size % 5 = 0 THEN 'BOUNDED' WHEN p_size % 5 = 1 THEN 'ESCAPED' WHEN p_size % 5 = 2 THEN 'RECOVERED' WHEN p_size % 5 = 3 THEN 'NULL_LIKE' ELSE 'UNRESOLVED' END",
    "failure_id": "CASE WHEN p_partkey % 30 = 0 THEN concat('f', p_partkey) END", "observed": "p_partkey % 35 <> 0",
    "x": "p_retailprice", "y": "CAST(p_size AS DOUBLE)", "s_e": "CASE WHEN k % 4 <> 0 OR p_partkey % 20 = 0 THEN p_size / 50.0 END", "ui": "CASE WHEN k % 4 <> 0 THEN p_size / 100.0 END", "nss": "CASE WHEN k % 4 <> 0 THEN p_retailprice / 1000 END",
    "sep": "CASE WHEN k % 4 <> 0 THEN 1.0 END", "rms": "CASE WHEN k % 4 <> 0 AND p_partkey % 97 <> 0 THEN 0.5 END",
}


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in expressions.items())


def _frame(base: DataFrame, expressions: dict[str, str], *keep: str) -> DataFrame:
    return base.select(*keep, *(F.expr(v).alias(k) for k, v in expressions.items()))


def bundles(spark, sf_dir) -> dict[str, DataFrame]:
    parts = table(spark, sf_dir, "part").withColumn("k", F.substring("p_brand", 7, 9).cast("long")).withColumn("position", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long") - 1)
    points = stored(_frame(parts, POINT, "p_partkey", F.col("p_brand").alias("bundle"), "k", "position"), "points")
    classes = points.where(F.col("classification") != "OTHER").groupBy("bundle", "classification").agg(F.count(F.lit(1)).alias("c")).groupBy("bundle").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "classification", F.col("c").cast("string")))), ";").alias("class_list"))
    base = points.groupBy("bundle", "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("p_partkey % 30 = 0 and p_partkey % 90 <> 0")).alias("lost"), *(F.avg(m).alias(f"mean_{m}") for m in semantics.MEANS)).join(classes, "bundle", "left")
    base = stored(base, "bundles")
    apart = [F.lit(x) for x in semantics.APART]
    documents = _frame(base, DOCUMENTS, "bundle").withColumn("non_equivalences", F.when(F.col("conflates"), F.array(apart[0])).otherwise(F.array(*apart))).drop("conflates")
    repeated = F.explode(F.sequence(F.lit(1), F.when(F.col("k") % 12 == 0, 2).otherwise(3)))
    return {
        "manifest": _frame(base, MANIFEST, "bundle"), "specification": _frame(base, SPECIFICATION, "bundle"), "claim": _frame(base, CLAIM, "bundle"), "documents": documents,
        "points": points.drop("k", "p_partkey"), "failures": points.where("p_partkey % 30 = 0 and p_partkey % 90 <> 0").select("bundle", "failure_id"),
        "receipts": base.where("k % 2 = 0").select("bundle", F.concat(F.lit("run-"), F.col("k").cast("string")).alias("run_id"), F.lit("verified").alias("status"), F.lit("someone").alias("verifier")),
        "nulls": base.select("bundle", repeated.alias("child")),
        "steps": base.where("k % 14 <> 0").select("bundle", F.lit(0).alias("position"), F.expr("CASE WHEN k % 5 = 2 THEN 'bad' ELSE concat('spec-', k) END").alias("step_sha256"), F.expr("CASE WHEN k % 7 = 3 THEN 'kernel-2' ELSE 'kernel-1' END").alias("step_id"), F.expr("CASE WHEN k % 8 = 3 THEN -1 ELSE k END").alias("step_seed")),
    }


_LEVEL = "CASE {0} WHEN 'ILLUSTRATIVE' THEN 0 WHEN 'COMPUTED' THEN 1 WHEN 'DERIVED' THEN 2 WHEN 'EXTERNALLY_VALIDATED' THEN 3 ELSE -1 END"
_RULES = [  # (code, test, detail) over the head h
    ("ONTOLOGY_VERSION_UNSUPPORTED", "ontology_version IS DISTINCT FROM '1.0.0'", "'ontology'"), ("TABLE_VERSION_UNSUPPORTED", "table_version IS DISTINCT FROM '1.0.0'", "'field table'"),
    ("ONTOLOGY_CONFLATION", "profile <> 'plain' AND conflates", "'required non-equivalences'"), ("ANALYTIC_EVIDENCE_FORBIDDEN", "engine = 'analytic' AND claims_evidence", "'claim boundary'"),
    ("SPECIFICATION_HASH_MISMATCH", "specification_sha256 <> spec_sha256", "'manifest'"), ("CLAIM_LEVEL_MISMATCH", "claim_level <> boundary_level", "'claim boundary and manifest'"), ("CLAIM_LEVEL_INVALID", "lv < 0", "claim_level"),
    ("CLAIM_LEVEL_EXCEEDS_REQUEST", "lv >= 0 AND lv > asked", "claim_level"), ("CLAIM_LEVEL_ENGINE_CONFLICT", "lv >= 0 AND ((engine = 'analytic' AND lv <> 0) OR (engine = 'local' AND lv > 2) OR (engine = 'ladder' AND profile LIKE '%historical%' AND lv > 1))", "engine"),
    ("PROFILE_MISSING", "engine = 'ladder' AND profile = 'plain'", "'the ladder engine requires a profile'"), ("CLAIM_LEVEL_DOMAIN_CONFLICT", "lv >= 0 AND authority >= 0 AND lv > authority", "claim_level"),
    ("VERIFIER_STATUS_INVALID", "independent_status = 'forged'", "independent_status"), ("VERIFIER_RECEIPT_MISSING", "independent_status = 'independently_verified' AND k % 2 <> 0", "'independent status without a receipt'"),
    ("EXTERNAL_RECEIPT_MISSING", "claim_level = 'EXTERNALLY_VALIDATED' AND k % 2 <> 0", "'the highest level requires a receipt'"), ("GRID_DIMENSION_INVALID", "width IS NULL OR height IS NULL", "'width and height'"),
    ("GRID_DIMENSION_MISMATCH", "width IS DISTINCT FROM table_width OR height IS DISTINCT FROM table_height", "'specification and table'"), ("GRID_POINT_COUNT_MISMATCH", "n <> width * height", "CAST(n AS VARCHAR)"),
    ("STATISTICS_POINT_COUNT", "stated_points <> n", "CAST(stated_points AS VARCHAR)"), ("STATISTICS_CLASS_COUNTS", "stated_classes IS DISTINCT FROM coalesce(class_list, '')", "'classification counts'"),
    *((f"STATISTICS_MEAN_{m.upper()}", f"all_{m} AND NOT coalesce(abs(stated_{m} - round(mean_{m}, 8)) <= 1.1e-8, false)", "'?'") for m in semantics.MEANS),
    ("FAILURE_COUNT_MISMATCH", "stated_failures <> lost", "CAST(stated_failures AS VARCHAR)"), ("NULL_REGISTRY_COUNT_MISMATCH", "k % 12 = 0", "'2'"), ("TRANSFORMATION_MISSING", "k % 14 = 0", "'no transformation'"),
    ("PROVENANCE_HASH_MISMATCH", "k % 14 <> 0 AND k % 5 = 2", "'transformation'"), ("PROVENANCE_KERNEL_MISMATCH", "k % 14 <> 0 AND k % 7 = 3", "'kernel-2'"), ("PROVENANCE_SEED_MISMATCH", "k % 14 <> 0 AND k % 8 = 3", "'-1'"), ("RUN_ID_MISMATCH", "run_id <> expected_run_id", "expected_run_id"),
]
_AT = "CAST(position AS VARCHAR)"
_POINT_RULES = [
    ("METRIC_NONFINITE", "CASE WHEN k % 4 = 0 THEN x IS NULL OR y IS NULL ELSE x IS NULL OR y IS NULL OR s_e IS NULL OR ui IS NULL OR nss IS NULL OR sep IS NULL OR rms IS NULL END", _AT),
    ("UNCOMPUTED_ENDPOINT_POPULATED", "k % 4 = 0 AND coalesce(s_e, ui, nss, sep) IS NOT NULL", _AT), ("OBSERVED_FAILURE_CONFLICT", "k % 4 = 0 AND observed AND failure_id IS NOT NULL", _AT),
    ("MISSING_CELL_NOT_PRESERVED", "k % 4 = 0 AND NOT observed AND (classification <> 'UNRESOLVED' OR failure_id IS NULL)", _AT), ("COORDINATE_INVALID", "NOT inside", _AT), ("INDEX_MISMATCH", "index <> position", _AT), ("CLASSIFICATION_INVALID", "classification = 'OTHER'", _AT),
]
AU4 = f"""WITH parts AS (SELECT *, CAST(substr(p_brand, 7) AS BIGINT) AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part), points AS (SELECT p_partkey, p_brand AS bundle, k, position, {_columns(POINT)} FROM parts),
classes AS (SELECT bundle, string_agg(classification || '=' || c, ';' ORDER BY classification) AS class_list FROM (SELECT bundle, classification, count(*) AS c FROM points WHERE classification <> 'OTHER' GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT s.*, class_list FROM (SELECT bundle, k, count(*) AS n, count(*) FILTER (WHERE p_partkey % 30 = 0 AND p_partkey % 90 <> 0) AS lost, {", ".join(f"avg({m}) AS mean_{m}, bool_and({m} IS NOT NULL) AS all_{m}" for m in semantics.MEANS)} FROM points GROUP BY 1, 2) s LEFT JOIN classes c ON c.bundle = s.bundle),
h AS (SELECT *, {_LEVEL.format('claim_level')} AS lv, {_LEVEL.format('requested_level')} AS asked, {_LEVEL.format('claim_authority')} AS authority FROM (SELECT *, {_columns(MANIFEST | SPECIFICATION | CLAIM | DOCUMENTS)} FROM base)),
p AS (SELECT points.*, coalesce(grid_x BETWEEN 0 AND width - 1 AND grid_y BETWEEN 0 AND height - 1, false) AS inside FROM points JOIN h ON h.bundle = points.bundle)
""" + " UNION ALL ".join(f"SELECT bundle, '{code}' AS code, {detail} AS detail FROM h WHERE {test}" for code, test, detail in _RULES) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT bundle, '{code}', {detail} FROM p WHERE {test}" for code, test, detail in _POINT_RULES) + """
UNION ALL SELECT bundle, 'COORDINATE_DUPLICATE', grid_x || ',' || grid_y FROM p WHERE inside GROUP BY bundle, grid_x, grid_y HAVING count(*) > 1
UNION ALL SELECT DISTINCT bundle, 'FAILURE_REFERENCE_MISSING', failure_id FROM p WHERE failure_id IS NOT NULL AND p_partkey % 90 = 0"""


@query(AU4)
def au4_core_semantics(spark, sf_dir):
    """Findings of every brand's bundle; means' stated values are left out of the details, as engines print them differently."""
    out = semantics.audit_semantics(bundles(spark, sf_dir))
    return out.select("bundle", "code", F.when(F.col("code").startswith("STATISTICS_MEAN_"), F.lit("?")).otherwise(F.col("detail")).alias("detail"))


@query("WITH f AS (" + AU4 + "), s AS (SELECT p_brand AS bundle, count(*) AS n FROM part GROUP BY 1 HAVING count(*) % 3 = 0) SELECT bundle, 'MEMBER_COUNT' AS code, count(*) AS findings FROM s GROUP BY 1 UNION ALL SELECT bundle, code, count(*) FROM f WHERE bundle NOT IN (SELECT bundle FROM s) GROUP BY 1, 2")
def au8_structural_first(spark, sf_dir):
    """Semantic findings are counted only for bundles without structural ones."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("bundle")).agg(F.count(F.lit(1)).alias("n")).where("n % 3 = 0")
    structural = counts.select("bundle", F.lit("MEMBER_COUNT").alias("code"), F.col("n").cast("string").alias("detail"))
    return semantics.clean_first(structural, semantics.audit_semantics(bundles(spark, sf_dir))).groupBy("bundle", "code").agg(F.count(F.lit(1)).alias("findings"))


@query("""WITH t AS (SELECT user_id % 5 AS bundle, user_id AS trial, CASE WHEN event_type = 'click' THEN 'escape' ELSE 'heal' END AS phase, CAST(epoch(ts) AS BIGINT) // 3600 AS t, event_id, user_id % 2 AS alpha, event_id % 4 AS winner FROM events),
u AS (SELECT bundle, trial, phase, t, alpha, max(winner) AS winner FROM t GROUP BY 1, 2, 3, 4, 5), m AS (SELECT bundle, alpha, winner AS from_n, lead(winner) OVER (PARTITION BY bundle, trial ORDER BY t) AS to_n FROM u WHERE phase = 'heal'), c AS (SELECT bundle, alpha, from_n, to_n, count(*) AS own FROM m WHERE to_n IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT bundle, 'TRANSITION_COUNT_MISMATCH' AS code, alpha || ',' || from_n || ',' || to_n AS detail FROM c WHERE (from_n + to_n) % 3 = 0""")
def au5_trajectory_findings(spark, sf_dir):
    """Transitions of the heal phase against stated counts of which every third is one too many."""
    events = table(spark, sf_dir, "events")
    traces = events.select((F.col("user_id") % 5).alias("bundle"), F.col("user_id").alias("trial"), F.when(F.col("event_type") == "click", "escape").otherwise("heal").alias("phase"), F.floor(F.unix_timestamp("ts") / 3600).alias("t"), (F.col("user_id") % 2).alias("alpha"), (F.col("event_id") % 4).alias("winner"))
    traces = stored(traces.groupBy("bundle", "trial", "phase", "t", "alpha").agg(F.max("winner").alias("winner")), "traces")
    own = ladder.transitions(traces.where("phase = 'heal'"), ["bundle", "trial"], ["t"], "winner", ["bundle", "alpha"])
    stated = own.select("bundle", "alpha", F.col("from_state").alias("from_n"), F.col("to_state").alias("to_n"), (F.col("count") + ((F.col("from_state") + F.col("to_state")) % 3 == 0).cast("long")).alias("count"))
    return semantics.trajectory_findings(traces, stated)


_CELLS = "SELECT parent % 2 AS bundle, CASE WHEN parent % 3 = 0 THEN 'baseline' ELSE 'noise' END AS condition, n, parent, eligible, local_p, robust_z, observed, null_median FROM cells"
_AUDITED = panels.surface_ctes("(" + _CELLS + ")", "bundle, condition", 2)


@query(with_ctes(panels.CTES, panels.SURFACE_CHAIN.split(" family_cells")[0] + " closure", ", " + ", ".join(f"{k} AS ({v})" for k, v in _AUDITED.items()) + """, w AS (SELECT bundle, n FROM (SELECT bundle, n, row_number() OVER (PARTITION BY bundle ORDER BY median(error), n) AS k FROM (SELECT parent % 2 AS bundle, n, error FROM closure) GROUP BY 1, 2) WHERE k = 1)
SELECT bundle, 'SURFACE_NSS_MISMATCH' AS code, condition || ':' || n AS detail FROM surface WHERE n % 4 = 2 UNION ALL SELECT bundle, 'SEP_MISMATCH', condition || ':' || n FROM surface WHERE n % 5 = 3
UNION ALL SELECT b.bundle, 'TE_MISMATCH', coalesce(CAST(min(n) FILTER (WHERE sep AND condition = 'baseline') AS VARCHAR), '') FROM surface b GROUP BY 1 HAVING min(n) FILTER (WHERE sep AND condition = 'baseline') IS DISTINCT FROM 9
UNION ALL SELECT bundle, 'WINNER_MISMATCH', CAST(n AS VARCHAR) FROM w WHERE bundle = 1"""))
def au6_heldout_findings(spark, sf_dir):
    """The surface, T_e and the closure winner worked out anew against stated ones with faults."""
    series = stored(panels.canonical(spark, sf_dir), "series")
    cells = stored(panels.cells_of(spark, sf_dir).withColumn("bundle", F.col("parent") % 2).withColumn("condition", F.when(F.col("parent") % 3 == 0, "baseline").otherwise("noise")), "cells")
    from gneiss.operators import inference

    surface = inference.surface(cells, ["bundle", "condition"], least_parents=2)
    wrong = surface.withColumn("nss", F.when(F.col("n") % 4 == 2, F.col("nss") + 1).otherwise(F.col("nss"))).withColumn("sep", F.when(F.col("n") % 5 == 3, ~F.col("sep")).otherwise(F.col("sep"))).select("bundle", "condition", "n", "ui", "nss", "holm_p", "sep")
    closure = blocks.closure_error(series, ["parent"], panels.SIZES).select((F.col("parent") % 2).alias("bundle"), "parent", "n", "error").where("error is not null")
    winners = closure.groupBy("bundle", "n").agg(F.median("error").alias("m")).groupBy("bundle").agg(F.min(F.struct("m", "n")).alias("b"))
    stated = winners.select("bundle", F.lit(9).cast("long").alias("t_e"), F.lit(0.0).alias("s_e"), F.col("b.n").cast("long").alias("w")).withColumn("winner", F.when(F.col("bundle") == 1, F.lit(-1).cast("long")).otherwise(F.col("w"))).drop("w")
    return semantics.heldout_findings(cells, wrong, stated, closure, least_parents=2)


@query(with_ctes(fields.CTES, "cells grid", f", s AS ({fields.coherence_cte('grid', 'value')}) SELECT field % 2 AS bundle, 'SCORE_MISMATCH' AS code, field || ':neighbour_coherence' AS detail FROM s WHERE field % 3 = 1 UNION ALL SELECT field % 2, 'SCORE_MISSING', field || ':spectral_concentration' FROM s UNION ALL SELECT field % 2, 'SCORE_UNFOUNDED', field || ':winding' FROM s WHERE field = 2 UNION ALL SELECT DISTINCT field % 2, 'PROJECTION_MISSING', CAST(field AS VARCHAR) FROM grid WHERE field = 3"))
def au7_geometry_findings(spark, sf_dir):
    """Stated scores of scalar fields: one kind missing, some wrong, one without a counterpart, a field without projection."""
    grid = stored(fields.grid(spark, sf_dir), "grid")
    own = stored(typed.typed_scores("scalar_field_2d", grid, ["field"]).select((F.col("field") % 2).alias("bundle"), "field", "channel", "score"), "scores")
    stated = own.where("channel = 'neighbour_coherence'").withColumn("score", F.when(F.col("field") % 3 == 1, F.col("score") + 0.5).otherwise(F.col("score")))
    stated = stated.union(own.where("field = 2 and channel = 'neighbour_coherence'").withColumn("channel", F.lit("winding")))
    rows = grid.select((F.col("field") % 2).alias("bundle"), "field", F.lit("scalar_field_2d").alias("kind"), F.when(F.col("field") != 3, F.lit("p1")).alias("projection"), "i", "j", "value", "seen")
    return semantics.geometry_findings(rows, stated, own)
