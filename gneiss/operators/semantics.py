"""Semantic audits of many bundles at once: every table has a ``bundle`` column, every finding is a row (bundle, code, detail).

Documents with one row a bundle (manifest, specification, claim, parent, ontology) are joined to one head; rules over the
head, over points and over counts are columns, so a thousand bundles cost the same plan as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import endpoints, inference

# Claim levels in their order, classes of a point, and what a profile's ontology must keep apart.
LEVELS = ("ILLUSTRATIVE", "COMPUTED", "DERIVED", "EXTERNALLY_VALIDATED")
CLASSES = ("BOUNDED", "ESCAPED", "RECOVERED", "NULL_LIKE", "UNRESOLVED")
APART = ("winner != emergence", "winner != survival")
STATUSES = ("not_supplied", "independently_verified")
METRICS = ("x", "y", "s_e", "ui", "nss", "sep", "rms")
MEANS = ("ui", "nss", "s_e")
VERSION = "1.0.0"


def findings(rows: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(bundle, code, detail) of every rule (test, detail) that holds on a row, in one pass."""
    every = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))) for code, (test, detail) in rules.items())))
    return rows.select("bundle", F.explode(every).alias("e")).select("bundle", "e.code", F.coalesce("e.detail", F.lit("")).alias("detail"))


def _level(name: Column) -> Column:
    return F.coalesce(*(F.when(name == level, F.lit(k)) for k, level in enumerate(LEVELS)), F.lit(-1))


def _finite(name: str) -> Column:
    return F.coalesce(~F.isnan(name) & (F.abs(name) < float("inf")), F.lit(False))


def document_findings(head: DataFrame) -> DataFrame:
    """Findings of the joined documents (see ``audit_semantics`` for the columns)."""
    text = F.lit
    level, asked, authority = _level(F.col("claim_level")), _level(F.col("requested_level")), _level(F.col("claim_authority"))
    profiled = F.col("profile").startswith("ladder-") | F.col("profile").startswith("heldout-")
    return findings(head, {
        "ONTOLOGY_VERSION_UNSUPPORTED": (~F.col("ontology_version").eqNullSafe(F.lit(VERSION)), text("ontology")),
        "TABLE_VERSION_UNSUPPORTED": (~F.col("table_version").eqNullSafe(F.lit(VERSION)), text("field table")),
        "ONTOLOGY_CONFLATION": (profiled & ~F.forall(F.array(*map(F.lit, APART)), lambda x: F.coalesce(F.array_contains("non_equivalences", x), F.lit(False))), text("required non-equivalences")),
        "ANALYTIC_EVIDENCE_FORBIDDEN": ((F.col("engine") == "analytic") & F.col("claims_evidence"), text("claim boundary")),
        "SPECIFICATION_HASH_MISMATCH": (~F.col("specification_sha256").eqNullSafe(F.col("spec_sha256")), text("manifest")),
        "CLAIM_LEVEL_MISMATCH": (~F.col("claim_level").eqNullSafe(F.col("boundary_level")), text("claim boundary and manifest")),
        "CLAIM_LEVEL_INVALID": (level < 0, F.col("claim_level")),
        "CLAIM_LEVEL_EXCEEDS_REQUEST": ((level >= 0) & (level > asked), F.col("claim_level")),
        "CLAIM_LEVEL_ENGINE_CONFLICT": ((level >= 0) & (((F.col("engine") == "analytic") & (level != 0)) | ((F.col("engine") == "local") & (level > 2)) | ((F.col("engine") == "ladder") & F.col("profile").contains("historical") & (level > 1))), F.col("engine")),
        "PROFILE_MISSING": ((F.col("engine") == "ladder") & ~profiled, text("the ladder engine requires a profile")),
        "CLAIM_LEVEL_DOMAIN_CONFLICT": ((level >= 0) & (authority >= 0) & (level > authority), F.col("claim_level")),
        "VERIFIER_STATUS_INVALID": (~F.coalesce(F.col("independent_status").isin(*STATUSES), F.lit(False)), F.col("independent_status")),
        "VERIFIER_RECEIPT_MISSING": ((F.col("independent_status") == "independently_verified") & ~F.col("receipt"), text("independent status without a receipt")),
        "EXTERNAL_RECEIPT_MISSING": ((F.col("claim_level") == "EXTERNALLY_VALIDATED") & ~F.col("receipt"), text("the highest level requires a receipt")),
        "GRID_DIMENSION_INVALID": (F.col("width").isNull() | F.col("height").isNull(), text("width and height")),
        "GRID_DIMENSION_MISMATCH": (~F.col("width").eqNullSafe(F.col("table_width")) | ~F.col("height").eqNullSafe(F.col("table_height")), text("specification and table")),
        "GRID_POINT_COUNT_MISMATCH": (F.col("points") != F.col("width") * F.col("height"), F.col("points")),
        "STATISTICS_POINT_COUNT": (~F.col("stated_points").eqNullSafe(F.col("points")), F.col("stated_points")),
        "STATISTICS_CLASS_COUNTS": (~F.col("stated_classes").eqNullSafe(F.col("classes")), text("classification counts")),
        **{f"STATISTICS_MEAN_{m.upper()}": (F.col(f"finite_{m}") & ~F.coalesce(F.abs(F.col(f"stated_{m}") - F.round(f"mean_{m}", 8)) <= 1.1e-8, F.lit(False)), F.col(f"stated_{m}")) for m in MEANS},
        "FAILURE_COUNT_MISMATCH": (~F.col("stated_failures").eqNullSafe(F.col("failures")), F.col("stated_failures")),
        "NULL_REGISTRY_COUNT_MISMATCH": (F.col("nulls") != F.coalesce("null_count", F.lit(0)), F.col("nulls")),
        "TRANSFORMATION_MISSING": (F.col("step_sha256").isNull() & F.col("step_id").isNull(), text("no transformation")),
        "PROVENANCE_HASH_MISMATCH": (F.col("step_id").isNotNull() & ~F.col("step_sha256").eqNullSafe(F.col("spec_sha256")), text("transformation")),
        "PROVENANCE_KERNEL_MISMATCH": (F.col("step_id").isNotNull() & ~F.col("step_id").eqNullSafe(F.col("kernel_id")), F.col("step_id")),
        "PROVENANCE_SEED_MISMATCH": (F.col("step_id").isNotNull() & ~F.col("step_seed").eqNullSafe(F.col("seed")), F.col("step_seed")),
        "RUN_ID_MISMATCH": (~F.col("run_id").eqNullSafe(F.col("expected_run_id")), F.col("expected_run_id")),
    })


def point_findings(points: DataFrame, dimensions: DataFrame, failures: DataFrame) -> DataFrame:
    """Findings of field points (bundle, position, index, grid_x, grid_y, classification, failure_id, metrics); a profile
    ``ladder-historical`` has coordinates alone, observed or with a failure."""
    rows = points.join(dimensions.select("bundle", "width", "height", "profile"), "bundle")
    historical, at = F.coalesce(F.col("profile").contains("historical"), F.lit(False)), F.col("position")
    finite = lambda names: reduce(lambda a, b: a & b, (_finite(n) for n in names))
    inside = F.col("grid_x").between(0, F.col("width") - 1) & F.col("grid_y").between(0, F.col("height") - 1)
    single = findings(rows, {
        "METRIC_NONFINITE": (~F.when(historical, finite(("x", "y"))).otherwise(finite(METRICS)), at),
        "UNCOMPUTED_ENDPOINT_POPULATED": (historical & F.coalesce("s_e", "ui", "nss", "sep").isNotNull(), at),
        "OBSERVED_FAILURE_CONFLICT": (historical & F.col("observed") & F.col("failure_id").isNotNull(), at),
        "MISSING_CELL_NOT_PRESERVED": (historical & ~F.col("observed") & (~F.col("classification").eqNullSafe(F.lit("UNRESOLVED")) | F.col("failure_id").isNull()), at),
        "COORDINATE_INVALID": (~F.coalesce(inside, F.lit(False)), at),
        "INDEX_MISMATCH": (~F.col("index").eqNullSafe(at), at),
        "CLASSIFICATION_INVALID": (~F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False)), at),
    })
    twice = rows.where(F.coalesce(inside, F.lit(False))).groupBy("bundle", "grid_x", "grid_y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = twice.select("bundle", F.lit("COORDINATE_DUPLICATE").alias("code"), F.concat_ws(",", F.col("grid_x").cast("string"), F.col("grid_y").cast("string")).alias("detail"))
    known = failures.select("bundle", "failure_id").distinct()
    lost = points.where("failure_id is not null").select("bundle", "failure_id").distinct().join(known, ["bundle", "failure_id"], "left_anti")
    return single.union(twice).union(lost.select("bundle", F.lit("FAILURE_REFERENCE_MISSING").alias("code"), F.col("failure_id").cast("string").alias("detail")))


def audit_semantics(tables: dict[str, DataFrame]) -> DataFrame:
    """All findings of the bundles in ``tables['manifest']``.

    One row a bundle: ``manifest`` (profile, claim_level, run_id, kernel_id, specification_sha256, stated_points,
    stated_failures, stated_ui, stated_nss, stated_s_e, stated_classes), ``specification`` (engine, width, height, seed,
    requested_level, null_count, spec_sha256, expected_run_id), ``claim`` (boundary_level, independent_status,
    claims_evidence), ``documents`` (claim_authority, ontology_version, non_equivalences, table_version, table_width,
    table_height). Several: ``points``, ``failures`` (failure_id), ``receipts`` (run_id, status, verifier), ``nulls``,
    ``steps`` (position, step_sha256, step_id, step_seed). An absent row of a document leaves nulls, which rules report.
    """
    head = tables["manifest"]
    for name in ("specification", "claim", "documents"):
        head = head.join(tables[name], "bundle", "left")
    points = tables["points"]
    classes = points.where(F.col("classification").isin(*CLASSES)).groupBy("bundle", "classification").agg(F.count(F.lit(1)).alias("n"))
    classes = classes.groupBy("bundle").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "classification", F.col("n").cast("string")))), ";").alias("classes"))
    stats = points.groupBy("bundle").agg(F.count(F.lit(1)).alias("points"), *(F.avg(m).alias(f"mean_{m}") for m in MEANS), *(F.bool_and(_finite(m)).alias(f"finite_{m}") for m in MEANS))
    counts = {n: tables[n].groupBy("bundle").agg(F.count(F.lit(1)).alias(n)) for n in ("failures", "nulls")}
    steps = tables["steps"].groupBy("bundle").agg(F.min(F.struct("position", "step_sha256", "step_id", "step_seed")).alias("s")).select("bundle", "s.step_sha256", "s.step_id", "s.step_seed")
    good = tables["receipts"].where("status = 'verified' and verifier <> ''").select("bundle", "run_id").distinct().withColumn("receipt", F.lit(True))
    for t in (stats, classes, *counts.values(), steps):
        head = head.join(t, "bundle", "left")
    head = head.join(good, ["bundle", "run_id"], "left").withColumn("receipt", F.coalesce("receipt", F.lit(False)))
    head = head.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("points", "failures", "nulls")} | {"classes": F.coalesce("classes", F.lit(""))} | {f"finite_{m}": F.coalesce(f"finite_{m}", F.lit(False)) for m in MEANS})
    return document_findings(head).union(point_findings(points, head, tables["failures"]))


def clean_first(structural: DataFrame, semantic: DataFrame) -> DataFrame:
    """Structural findings, and semantic ones of bundles that have none of these."""
    return structural.union(semantic.join(structural.select("bundle").distinct(), "bundle", "left_anti"))


def heldout_findings(cells: DataFrame, surface: DataFrame, stated: DataFrame, closure: DataFrame, *, least_parents: int = 10, least_passes: int = 4) -> DataFrame:
    """Findings of held-out bundles: the surface, T_e, S_e and the closure winner are worked out anew from parents' cells.

    ``cells`` (bundle, condition, n, parent, eligible, local_p, robust_z, observed, null_median), ``surface`` as stated
    (bundle, condition, n, ui, nss, holm_p, sep), ``stated`` (bundle, t_e, s_e, winner), ``closure`` (bundle, parent, n, error).
    """
    again = inference.surface(cells, ["bundle", "condition"], least_parents=least_parents).select("bundle", "condition", "n", *(F.col(c).alias(f"own_{c}") for c in ("ui", "nss", "holm_p", "sep")))
    joined = surface.join(again, ["bundle", "condition", "n"], "left")
    cell = F.concat_ws(":", "condition", F.col("n").cast("string"))
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col(f"own_{c}")) <= 1e-9, F.lit(False))
    there = F.col("own_sep").isNotNull()
    out = findings(joined, {
        "SURFACE_CELL_MISSING": (~there, cell),
        **{f"SURFACE_{c.upper()}_MISMATCH": (there & ~near(c), cell) for c in ("ui", "nss", "holm_p")},
        "SEP_MISMATCH": (there & (F.col("sep") != F.col("own_sep")), cell)})
    # Endpoints of each bundle: the region runs on from T_e while the baseline and enough conditions separate.
    own = again.withColumnRenamed("own_sep", "sep")
    born = own.where("condition = 'baseline'").groupBy("bundle").agg(F.min(F.when(F.col("sep"), F.col("n"))).alias("own_t_e"))
    lives = own.groupBy("bundle", "n").agg((F.max(F.when(F.col("condition") == "baseline", F.col("sep")).otherwise(False)) & (F.count_if((F.col("condition") != "baseline") & F.col("sep")) >= least_passes)).alias("survives"))
    runs = endpoints.contiguous_runs(lives, ["bundle"], "n", "survives")
    region = born.join(runs, "bundle").where("first <= own_t_e and own_t_e <= last").select("bundle", "own_t_e", "last")
    alive = own.join(region, "bundle").where("n >= own_t_e and n <= last").groupBy("bundle").agg(F.avg(F.col("sep").cast("double")).alias("own_s_e"))
    medians = closure.groupBy("bundle", "n").agg(F.median("error").alias("m")).groupBy("bundle").agg(F.min(F.struct("m", "n")).alias("b")).select("bundle", F.col("b.n").alias("own_winner"))
    head = stated.join(born, "bundle", "left").join(alive, "bundle", "left").join(medians, "bundle", "left").withColumn("own_s_e", F.coalesce("own_s_e", F.lit(0.0)))
    return out.union(findings(head, {
        "TE_MISMATCH": (~F.col("t_e").eqNullSafe(F.col("own_t_e")), F.col("own_t_e")),
        "SE_MISMATCH": (~F.coalesce(F.abs(F.col("s_e") - F.col("own_s_e")) <= 1e-9, F.lit(False)), F.round("own_s_e", 6)),
        "WINNER_MISMATCH": (~F.col("winner").eqNullSafe(F.col("own_winner")), F.col("own_winner"))}))


def trajectory_findings(traces: DataFrame, stated: DataFrame) -> DataFrame:
    """Findings of historical bundles' trajectories: repeated (trial, phase, t) rows, and transition counts of the heal phase
    that differ from the ``stated`` ones (bundle, alpha, from_n, to_n, count)."""
    from pyspark.sql import Window

    twice = traces.groupBy("bundle", "trial", "phase", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    twice = twice.select("bundle", F.lit("TRAJECTORY_DUPLICATE").alias("code"), F.concat_ws(",", F.col("trial").cast("string"), "phase", F.col("t").cast("string")).alias("detail"))
    ahead = F.lead("winner").over(Window.partitionBy("bundle", "trial").orderBy("t"))
    moves = traces.where("phase = 'heal'").withColumn("to_n", ahead).where("to_n is not null").groupBy("bundle", "alpha", F.col("winner").alias("from_n"), "to_n").agg(F.count(F.lit(1)).alias("own"))
    joined = moves.join(stated, ["bundle", "alpha", "from_n", "to_n"], "full_outer")
    wrong = joined.where(~F.col("own").eqNullSafe(F.col("count")))
    return twice.union(wrong.select("bundle", F.lit("TRANSITION_COUNT_MISMATCH").alias("code"), F.concat_ws(",", F.col("alpha").cast("string"), F.col("from_n").cast("string"), F.col("to_n").cast("string")).alias("detail")))


def geometry_findings(fields: DataFrame, stated: DataFrame, scores: DataFrame, *, tolerance: float = 1e-9) -> DataFrame:
    """Findings of geometry bundles: observed cells without a finite value, fields without a registered projection, stated
    scores (bundle, field, channel, score) that differ from those worked out (same columns) or have no counterpart.

    ``fields`` (bundle, field, kind, projection, i, j, value, seen).
    """
    from gneiss.operators.typed import PROJECTIONS

    cells = fields.where("seen").where(~_finite("value")).groupBy("bundle", "field").agg(F.count(F.lit(1)).alias("n"))
    out = cells.select("bundle", F.lit("OBSERVED_VALUE_NONFINITE").alias("code"), F.concat_ws(":", F.col("field").cast("string"), F.col("n").cast("string")).alias("detail"))
    kinds = fields.select("bundle", "field", "kind", "projection").distinct()
    out = out.union(findings(kinds, {"KIND_UNREGISTERED": (~F.coalesce(F.col("kind").isin(*PROJECTIONS), F.lit(False)), F.col("field")), "PROJECTION_MISSING": (F.col("projection").isNull(), F.col("field"))}))
    joined = stated.withColumn("stated", F.lit(True)).join(scores.withColumnRenamed("score", "own").withColumn("known", F.lit(True)), ["bundle", "field", "channel"], "full_outer")
    at = F.concat_ws(":", F.col("field").cast("string"), "channel")
    return out.union(findings(joined, {
        "SCORE_MISSING": (F.col("stated").isNull(), at), "SCORE_UNFOUNDED": (F.col("known").isNull(), at),
        "SCORE_MISMATCH": (F.col("stated") & F.col("known") & ~F.coalesce(F.abs(F.col("score") - F.col("own")) <= tolerance * F.greatest(F.lit(1.0), F.abs("own")), F.lit(False)), at)}))
