"""Composed reports: trace and curvature audits, diagnostics of one block size, adjudication, structural comparison of
JSON documents, registry ids, checks that stand for a verified result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.robust import robust_scale_of
from gneiss.operators import inference, ladder
from gneiss.operators.geometry import EPS
from gneiss.operators.nulls import draw

DEPTH = 32


def joint_summary(observed: DataFrame, children: DataFrame, count: int, keys: list[str], *, replicates: int = 999, seed: str = "joint") -> DataFrame:
    """The joint null of ``inference.joint_null`` without p-values: quantiles, difference and robust standardised effect."""
    rows = inference.joint_null(observed, children, count, keys, replicates=replicates, seed=seed)
    return rows.select(*keys, "observed", "joint_median", "q025", "q975", "difference", (F.col("difference") / F.greatest("joint_scale", F.lit(EPS))).alias("standardized"), "joint_scale", "parents", "replicates")


def size_diagnostic(cells: DataFrame, winners: DataFrame) -> DataFrame:
    """Per n: parents whose closure winner it is, median lower p of its cells, how many are at most 0.05, and a class.

    ``cells`` (parent, n, lower_p), ``winners`` (parent, winner). A size that no parent's winner is and whose cells are no
    better than their nulls has no closure-mode evidence; it is never an emergence endpoint.
    """
    won = winners.groupBy(F.col("winner").alias("n")).agg(F.count(F.lit(1)).alias("observed_winners"))
    out = cells.groupBy("n").agg(F.median("lower_p").alias("median_lower_p"), F.count_if(F.col("lower_p") <= 0.05).alias("at_most_005"))
    out = out.join(won, "n", "left").select("n", F.coalesce("observed_winners", F.lit(0)).alias("observed_winners"), "median_lower_p", "at_most_005")
    return out.withColumn("classification", F.when((F.col("observed_winners") > 0) & (F.col("at_most_005") > 0), "REQUIRES_NEW_HELDOUT_TEST").otherwise("NO_CLOSURE_MODE_EVIDENCE"))


def joint_traces(parents: DataFrame, children: DataFrame, count: int, *, replicates: int = 999, seed: str = "trace") -> DataFrame:
    """(replicate, n, value): medians over parents of traces that draw one null child of each parent, the same child at all
    coordinates. ``parents`` (parent, n, value), ``children`` (parent, child, n, value)."""
    replicate = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias("replicate")
    drawn = parents.select("parent").distinct().select("parent", replicate)
    drawn = drawn.withColumn("child", draw(count, seed, F.col("replicate"), F.col("parent")) + 1)
    return drawn.join(children, ["parent", "child"]).groupBy("replicate", "n").agg(F.median("value").alias("value"))


def trace_audit(parents: DataFrame, children: DataFrame, count: int, *, replicates: int = 999, seed: str = "trace") -> DataFrame:
    """(n, observed, joint_median, q025, q975): the population's trace against joint null traces, per coordinate."""
    joint = joint_traces(parents, children, count, replicates=replicates, seed=seed)
    q = joint.groupBy("n").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return parents.groupBy("n").agg(F.median("value").alias("observed")).join(q, "n").select("n", "observed", F.col("q")[1].alias("joint_median"), F.col("q")[0].alias("q025"), F.col("q")[2].alias("q975"))


def trace_minima(parents: DataFrame) -> DataFrame:
    """Minimum audits of the population's median trace (parent null) and of each parent's: (parent, minimum, tied, ...)."""
    population = parents.groupBy("n").agg(F.median("value").alias("value")).select(F.lit(None).cast(dict(parents.dtypes)["parent"]).alias("parent"), "n", "value")
    rows = population.unionByName(parents.select("parent", "n", "value")).withColumn("_known", F.col("parent").isNotNull()).withColumn("_parent", F.coalesce(F.col("parent").cast("string"), F.lit("")))
    audit = ladder.minimum_audit(rows, ["_known", "_parent"], "n", "value")
    return audit.select(F.when(F.col("_known"), F.col("_parent")).alias("parent"), *(c for c in audit.columns if not c.startswith("_")))


def _curvature(traces: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("n")
    x = F.log("value")
    return traces.select(*keys, "n", (-(F.lead(x).over(w) - 2 * x + F.lag(x).over(w))).alias("c")).where(F.col("c").isNotNull())


def _elbow(bends: DataFrame, keys: list[str], tolerance: Column | None = None) -> DataFrame:
    """Peak, number of ties with it within the tolerance, and the elbow if there is one."""
    peak = F.max("c").over(Window.partitionBy(*keys))
    marked = bends.withColumn("peak", peak)
    near = tolerance if tolerance is not None else F.greatest(F.abs("peak") * 1e-12, F.lit(EPS * 16))
    ties = F.col("c") >= F.col("peak") - near
    return marked.groupBy(*keys).agg(F.max("peak").alias("peak"), F.min("c").alias("least"), F.count_if(ties).alias("tied"), F.min(F.when(ties, F.col("n"))).alias("n")).withColumn("elbow", F.when(F.col("tied") == 1, F.col("n"))).drop("n")


def curvature_audit(parents: DataFrame, joint: DataFrame, *, samples: int = 999, seed: str = "bootstrap") -> DataFrame:
    """One row: status, elbow of the population's median trace, relative and null-standardised prominence, pinning at the
    ends, and the share of bootstrap samples of parents that select the same elbow.

    A trace without spread is REJECTED_FLAT_OR_TIED_TRACE, one with several equal peaks REJECTED_TIED_ELBOW; at least
    five positive points are needed. ``parents`` (parent, n, value), ``joint`` (replicate, n, value).
    """
    one = F.lit(1).alias("one")
    population = parents.groupBy("n").agg(F.median("value").alias("value")).select(one, "n", "value")
    scale = robust_scale_of(population.withColumn("x", F.log("value")), ["one"], "x").select("one", F.col("scale").alias("scale"))
    ends = population.groupBy("one").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("points"), F.min("value").alias("least_value"))
    observed = _elbow(_curvature(population, ["one"]), ["one"])
    peaks = _curvature(joint, ["replicate"]).groupBy("replicate").agg(F.max("c").alias("p")).select(one, "p")
    null = robust_scale_of(peaks, ["one"], "p").select("one", F.col("centre").alias("null_peak"), F.col("scale").alias("null_scale"))

    ids = parents.select("parent").distinct().withColumn("k", F.row_number().over(Window.orderBy("parent")) - 1)  # a row a parent
    size = ids.count()
    slots = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    drawn = population.sparkSession.range(1, samples + 1).withColumnRenamed("id", "sample").withColumn("slot", F.explode(slots)).withColumn("k", draw(size, seed, F.col("sample"), F.col("slot")))
    resampled = drawn.join(F.broadcast(ids), "k").join(parents, "parent").groupBy("sample", "n").agg(F.median("value").alias("value"))
    tolerance = observed.select(F.greatest(F.abs("peak") * 1e-12, F.lit(EPS * 16)).alias("near"))
    chosen = _elbow(_curvature(resampled, ["sample"]).crossJoin(F.broadcast(tolerance)), ["sample"])
    whole = observed.join(scale, "one").join(ends, "one").join(null, "one")
    stability = chosen.select(F.col("elbow").alias("again")).crossJoin(F.broadcast(observed.select("elbow"))).agg(F.avg(F.coalesce(F.col("again") == F.col("elbow"), F.lit(False)).cast("double")).alias("stability"))
    flat = (F.col("scale") <= EPS) | (F.col("peak") - F.col("least") <= EPS)
    elbow = F.when(~flat, F.col("elbow"))
    status = F.when((F.col("points") < 5) | (F.col("least_value") <= 0), "NOT_APPLICABLE").when(flat, "REJECTED_FLAT_OR_TIED_TRACE").when(F.col("elbow").isNull(), "REJECTED_TIED_ELBOW").otherwise("COMPUTED_INTERIOR_ONLY")
    return whole.crossJoin(F.broadcast(stability)).select(
        status.alias("status"), elbow.alias("elbow"), F.col("peak"), (F.col("peak") / F.greatest("scale", F.lit(EPS))).alias("relative_prominence"),
        ((F.col("peak") - F.col("null_peak")) / F.greatest("null_scale", F.lit(EPS))).alias("null_standardized_prominence"),
        F.coalesce(elbow == F.col("low") + 1, F.lit(False)).alias("first_interior_pinning"), F.coalesce(elbow == F.col("high") - 1, F.lit(False)).alias("last_interior_pinning"),
        F.when(elbow.isNotNull(), F.col("stability")).alias("bootstrap_stability"))


def verified(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, ok, status): each check is a table of what it found wrong, and holds if that is empty; the status is
    ``verified`` on all rows if all hold, else ``rejected``."""
    rows = reduce(DataFrame.union, (t.agg((F.count(F.lit(1)) == 0).alias("ok")).select(F.lit(name).alias("check"), "ok") for name, t in checks.items()))
    whole = rows.agg(F.bool_and("ok").alias("all"))
    return rows.crossJoin(F.broadcast(whole)).select("check", "ok", F.when(F.col("all"), "verified").otherwise("rejected").alias("status"))


#: What blocks a derived claim, in this order: a column of the endpoints that must hold, and the reason if it doesn't.
BLOCKERS = {
    "sep_any": "No size of the primary grid separates.",
    "t_e_observed": "The emergence size is not observed and isn't filled in from the closure winner.",
    "s_e_positive": "The contiguous survival is zero as no surviving region begins at the emergence size.",
    "specificity_passed": "The specificity gate failed.",
    "verified": "The independent verification disagrees.",
}


def adjudicated(studies: DataFrame) -> DataFrame:
    """Endpoints with outcome, status, claim level and blockers.

    ``studies`` has t_e (null: not observed), s_e, sep_any, specificity_passed, residual_persists, single_parent,
    verifier_status, disagreements, rejected_mutations, mutations. A study is positive if a size separates, emergence is
    observed and survival is positive; a derived claim needs verification, all mutations rejected, a residual that
    persists and no dependence on a single parent as well, else a positive study is partial.
    """
    gates = {"t_e_observed": F.col("t_e").isNotNull(), "s_e_positive": F.coalesce(F.col("s_e") > 0, F.lit(False)), "sep_any": F.coalesce("sep_any", F.lit(False)),
             "specificity_passed": F.coalesce("specificity_passed", F.lit(False)),
             "verified": F.coalesce((F.col("verifier_status") == "verified") & (F.col("disagreements") == 0), F.lit(False)),
             "mutations_passed": F.coalesce((F.col("rejected_mutations") == F.col("mutations")) & (F.col("mutations") > 0), F.lit(False))}
    rows = studies.select(*(c for c in studies.columns if c not in gates), *(g.alias(n) for n, g in gates.items()))
    positive = F.col("t_e_observed") & F.col("s_e_positive") & F.col("sep_any")
    derived = positive & F.col("verified") & F.col("mutations_passed") & F.coalesce("residual_persists", F.lit(False)) & ~F.coalesce("single_parent", F.lit(True))
    blockers = F.array_compact(F.array(*(F.when(~F.col(gate), F.lit(text)) for gate, text in BLOCKERS.items())))
    return rows.select("*", F.when(derived, "POSITIVE").when(positive, "PARTIAL_WITH_BLOCKERS").otherwise("NEGATIVE").alias("outcome"), F.when(derived, "PERMITTED").otherwise("BLOCKED").alias("derived_status"),
                       F.when(derived, "DERIVED").otherwise("COMPUTED").alias("claim_level"), (F.col("verified") & F.col("mutations_passed")).alias("protocol_valid"), blockers.alias("blockers"))


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON object (sorted names, no spaces) of the given columns."""
    return F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def registry_id(prefix: str, fields: dict[str, Column]) -> Column:
    """``prefix-`` and 16 hex digits of the canonical hash."""
    return F.concat(F.lit(prefix + "-"), F.substring(canonical_hash(fields), 1, 16))


def registered(ladders: DataFrame, *, domain: str, rule: str = "natural_log(value), source row order") -> DataFrame:
    """Registry rows of observed ladders (ladder, values) and of one control each: id, kind, parent id, hashes."""
    values = F.sha2(F.to_json("values"), 256)
    canonicalization = canonical_hash({"omega": F.lit("natural_log(value)"), "row_order": F.lit("source_order"), "sigma_omega": F.lit("sigma/value")})
    rows = ladders.select("ladder", values.alias("values_hash"), canonicalization.alias("canonicalization_hash"))
    parent = registry_id("ladder", {"domain_id": F.concat(F.lit(domain + "-"), F.col("ladder")), "kind": F.lit("observed_parent"), "source_values_hash": F.col("values_hash"), "canonicalization_hash": F.col("canonicalization_hash")})
    rows = rows.withColumn("parent_id", parent)
    control = registry_id("control", {"parent": F.col("parent_id"), "kind": F.lit("alpha_zero_control")})
    either = F.array(
        F.struct(F.col("parent_id").alias("id"), F.lit("observed_parent").alias("kind"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("is_null")),
        F.struct(control.alias("id"), F.lit("alpha_zero_control").alias("kind"), F.col("parent_id").alias("parent"), F.lit(True).alias("is_null")))
    return rows.select("ladder", "values_hash", "canonicalization_hash", F.lit(rule).alias("rule"), F.explode(either).alias("e")).select("e.*", "ladder", "values_hash", "canonicalization_hash", "rule")


def json_nodes(rows: DataFrame, keys: list[str], column: str, *, deepest: int = DEPTH) -> DataFrame:
    """(keys, path, depth, value, leaf) of every node of JSON documents: paths are ``$.a[0].b``, values canonical JSON.

    Documents that don't parse have one row with a null path. A level a round, each a generator over its containers;
    documents deeper than ``deepest`` are an error.
    """
    spark = rows.sparkSession
    parsed = rows.select(*keys, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(F.col(column)).alias("v"))
    level, out = parsed.where("v is not null"), [parsed.where("v is null").select(*keys, F.lit(None).cast("string").alias("path"), "depth", F.lit(None).cast("string").alias("value"), F.lit(True).alias("leaf"))]
    for _ in range(deepest + 2):
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
        out.append(level.select(*keys, "path", "depth", F.to_json("v").alias("value"), ~inner))
        containers = level.where(inner)
        if containers.isEmpty():
            return reduce(DataFrame.union, out)
        items = containers.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_name"), F.col("value").alias("_item")))
        step = F.when(F.col("_name").isNotNull(), F.concat(F.lit("."), F.col("_name"))).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        level = items.select(*keys, F.concat("path", step).alias("path"), (F.col("depth") + 1).alias("depth"), F.col("_item").alias("v"))
    raise ValueError(f"documents are deeper than {deepest}")


def json_depth(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, depth): the deepest node of each document; null if it doesn't parse, as documents with NaN or Infinity do."""
    return json_nodes(rows, keys, column).groupBy(*keys).agg(F.max(F.when(F.col("path").isNotNull(), F.col("depth"))).alias("depth"))


def json_difference(left: DataFrame, right: DataFrame, keys: list[str], column: str, *, tolerance: float = 1e-12) -> DataFrame:
    """(keys, path, left, right): leaves that one side lacks or that differ, numbers by more than the tolerance."""
    a = json_nodes(left, keys, column).where("leaf").select(*keys, "path", F.col("value").alias("left"))
    b = json_nodes(right, keys, column).where("leaf").select(*keys, "path", F.col("value").alias("right"))
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    same = F.col("left").eqNullSafe(F.col("right")) | F.coalesce(F.abs(number("left") - number("right")) <= tolerance, F.lit(False))
    return a.join(b, [*keys, "path"], "full_outer").where(~same)
