"""Ladder and trajectory queries: brands' retail prices as ladders, users' events as trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import endpoints, inference, ladder, nulls, summaries
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.queries.panels import draw_sql
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

CHILDREN = 5
CTES = {
    "ladders": "SELECT p_brand AS ladder, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_retailprice AS value FROM part",
    "circle": """SELECT ladder, pos, value, coalesce(lag(value) OVER w, last_value(value) OVER f) AS l, coalesce(lead(value) OVER w, first_value(value) OVER f) AS r FROM ladders
      WINDOW w AS (PARTITION BY ladder ORDER BY pos), f AS (PARTITION BY ladder ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "omegas": "SELECT ladder, pos, value, ln(value) AS omega, 0.01 * value / value AS sigma_omega FROM ladders WHERE value > 0",
    "chis": "SELECT ladder, sum(omega / pos) AS chi FROM omegas GROUP BY 1",
    "closures": "SELECT ladder, n, abs(chi - 2 * pi() / n) AS rms FROM chis, (SELECT unnest(range(2, 31)) AS n)",
    "top": "SELECT *, row_number() OVER (PARTITION BY ladder ORDER BY rms, n) AS place FROM closures",
    "winners": "SELECT ladder, max(n) FILTER (WHERE place = 1) AS winner, max(rms) FILTER (WHERE place = 1) AS winner_rms, max(n) FILTER (WHERE place = 2) AS runner, max(rms) FILTER (WHERE place = 2) AS runner_rms FROM top WHERE place <= 2 GROUP BY 1",
    "null_ladders": f"""SELECT t.ladder, t.child, t.pos, s.value FROM (SELECT ladder, child, pos, value FROM ladders, (SELECT unnest(range(1, {CHILDREN + 1})) AS child)) t JOIN
      (SELECT ladder, child, value, row_number() OVER (PARTITION BY ladder, child ORDER BY md5(concat_ws('|', 'ladder', CAST(child AS VARCHAR), ladder, CAST(pos AS VARCHAR))), pos) AS k FROM ladders, (SELECT unnest(range(1, {CHILDREN + 1})) AS child)) s
      ON t.ladder = s.ladder AND t.child = s.child AND t.pos = s.k""",
}
COHERENCE = "CASE WHEN count(value) < 2 THEN 0.0 WHEN max(value) = min(value) THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - avg(abs(r - value)) / (1.25 * (max(value) - min(value))))) END"


def ladders(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("ladder"), place.alias("pos"), F.col("p_retailprice").alias("value"))


def omegas(spark, sf_dir):
    return ladder.with_sigma(ladders(spark, sf_dir), 0.01 * F.col("value"))


@query(with_ctes(CTES, "ladders circle", f"SELECT ladder, pos, {r('l', 'left')}, {r('r', 'right')} FROM circle"))
def wn6_circular_neighbours(spark, sf_dir):
    return result(ladder.neighbours(ladders(spark, sf_dir), ["ladder"]).drop("value"))


@query(with_ctes(CTES, "ladders circle", f"SELECT ladder, count(value) AS n, {r(COHERENCE, 'coherence')} FROM circle GROUP BY 1"))
def ag4_cyclic_coherence(spark, sf_dir):
    return result(ladder.cyclic_coherence(ladders(spark, sf_dir), ["ladder"]))


@query(with_ctes(CTES, "ladders null_ladders", f"SELECT ladder, CAST(child AS BIGINT) AS child, pos, {r('value', 'value')} FROM null_ladders"))
def nu1_ladder_permutation(spark, sf_dir):
    return result(ladder.null_ladders(ladders(spark, sf_dir), CHILDREN))


@query(with_ctes(CTES, "ladders null_ladders", f", c AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY ladder, child ORDER BY pos), first_value(value) OVER (PARTITION BY ladder, child ORDER BY pos)) AS r FROM null_ladders) SELECT ladder, CAST(child AS BIGINT) AS child, count(value) AS n, {r(COHERENCE, 'coherence')} FROM c GROUP BY 1, 2"))
def nu2_null_registry(spark, sf_dir):
    return result(ladder.cyclic_coherence(ladder.null_ladders(ladders(spark, sf_dir), CHILDREN), ["ladder", "child"]))


@query(with_ctes(CTES, "ladders null_ladders", f"SELECT n.ladder, CAST(n.child AS BIGINT) AS child, {r('exp(-sqrt(avg((n.value - l.value) * (n.value - l.value))) / greatest(stddev_pop(l.value), 1e-9))', 'similarity')} FROM null_ladders n JOIN ladders l ON n.ladder = l.ladder AND n.pos = l.pos GROUP BY 1, 2"))
def ag5_similarity(spark, sf_dir):
    base = ladders(spark, sf_dir)
    return result(ladder.similarity(ladder.null_ladders(base, CHILDREN), base, ["ladder", "child"], "ladder"))


@query(with_ctes(CTES, "ladders", f""", c AS (SELECT *, count(*) OVER (PARTITION BY ladder) AS n FROM ladders), w AS (SELECT ladder, k, first(n) AS n, round(sqrt(pow(sum(value * cos(-2 * pi() * k * (pos - 1) / n)), 2) + pow(sum(value * sin(-2 * pi() * k * (pos - 1) / n)), 2)), 9) AS amplitude FROM c, (SELECT unnest(range(1, 13)) AS k) WHERE k <= n // 2 GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ladder ORDER BY amplitude DESC, k DESC) AS place FROM w WHERE n >= 4) WHERE place = 1) SELECT l.ladder, k AS winner, round(amplitude, 5) + 0.0 AS amplitude FROM (SELECT DISTINCT ladder FROM ladders) l LEFT JOIN b ON l.ladder = b.ladder"""))
def ag6_harmonic_winner(spark, sf_dir):
    return result(ladder.harmonic_winner(ladders(spark, sf_dir), ["ladder"]).withColumn("amplitude", F.round("amplitude", 5)))


@query(with_ctes(CTES, "ladders omegas", f"SELECT ladder, pos, {r('omega', 'omega')}, {r('sigma_omega', 'sigma_omega')} FROM omegas"))
def pf_omega_and_sigma(spark, sf_dir):
    return result(omegas(spark, sf_dir).select("ladder", "pos", "omega", "sigma_omega"))


@query(with_ctes(CTES, "ladders omegas chis", f"SELECT ladder, {r('chi', 'chi')} FROM chis"))
def ag7_chi(spark, sf_dir):
    return result(ladder.chi(omegas(spark, sf_dir), ["ladder"]))


@query(with_ctes(CTES, "ladders omegas chis closures top winners", f"SELECT ladder, winner, {r('winner_rms', 'winner_rms')}, runner, {r('runner_rms', 'runner_rms')}, {r('runner_rms - winner_rms', 'margin')} FROM winners"))
def ag8_closure_score(spark, sf_dir):
    scores = ladder.closure_scores(ladder.chi(omegas(spark, sf_dir), ["ladder"]), ["ladder"], (2, 30))
    return result(ladder.closure_winner(scores, ["ladder"]))


@query(with_ctes(CTES, "ladders omegas chis closures top", f"SELECT ladder, n AS \"N\", {r('rms', 'rms')}, place FROM top WHERE place <= 2"))
def st1_top_two(spark, sf_dir):
    from pyspark.sql import Window

    scores = ladder.closure_scores(ladder.chi(omegas(spark, sf_dir), ["ladder"]), ["ladder"], (2, 30))
    place = F.row_number().over(Window.partitionBy("ladder").orderBy("rms", "N"))
    return result(scores.withColumn("place", place).where("place <= 2"))


@query(with_ctes(CTES, "ladders omegas chis closures top winners", "SELECT ladder, winner, winner = 2 AND runner_rms - winner_rms >= 0.05 AS closed FROM winners"))
def pf7_closed(spark, sf_dir):
    scores = ladder.closure_scores(ladder.chi(omegas(spark, sf_dir), ["ladder"]), ["ladder"], (2, 30))
    return result(ladder.closed(ladder.closure_winner(scores, ["ladder"]), 2, 0.05).select("ladder", "winner", "closed"))


@query(with_ctes(CTES, "ladders null_ladders", f", o AS (SELECT ladder, child, sum(ln(value) / pos) AS chi FROM null_ladders GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY ladder, child ORDER BY abs(chi - 2 * pi() / n), n) AS place FROM o, (SELECT unnest(range(2, 31)) AS n)) SELECT ladder, CAST(child AS BIGINT) AS child, {r('chi', 'chi')}, n AS winner FROM s WHERE place = 1"))
def si7_permutation_controls(spark, sf_dir):
    children = ladder.null_ladders(ladders(spark, sf_dir), CHILDREN).withColumn("omega", F.log("value"))
    chis = ladder.chi(children, ["ladder", "child"])
    winners = ladder.closure_winner(ladder.closure_scores(chis, ["ladder", "child"], (2, 30)), ["ladder", "child"])
    return result(chis.join(winners.select("ladder", "child", "winner"), ["ladder", "child"]))


@query(with_ctes(CTES, "ladders null_ladders", f", c AS (SELECT *, coalesce(lead(value) OVER w, first_value(value) OVER f) AS r, coalesce(lag(value) OVER w, last_value(value) OVER f) AS l FROM null_ladders WINDOW w AS (PARTITION BY ladder, child ORDER BY pos), f AS (PARTITION BY ladder, child ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT c.ladder, CAST(child AS BIGINT) AS child, c.pos, round(0.58 * c.value + 0.42 * (0.7 * (l + 2 * c.value + r) / 4 + 0.3 * p.value), 6) + 0.0 AS value FROM c JOIN ladders p ON c.ladder = p.ladder AND c.pos = p.pos"))
def pe2_relaxation_step(spark, sf_dir):
    base = ladders(spark, sf_dir)
    return result(ladder.relax(ladder.null_ladders(base, CHILDREN), base, ["ladder", "child"], "ladder", 0.3))


@query(with_ctes(CTES, "ladders null_ladders", "SELECT n.ladder, CAST(child AS BIGINT) AS child, n.pos, round(0.98 * n.value + 0.02 * l.value, 6) + 0.0 AS value FROM null_ladders n JOIN ladders l ON n.ladder = l.ladder AND n.pos = l.pos"))
def pe6_anchor(spark, sf_dir):
    base = ladders(spark, sf_dir)
    return result(ladder.anchor(ladder.null_ladders(base, CHILDREN), base, "ladder", 0.02).select("ladder", "child", "pos", "value"))


def _uniform_sql(tag: str) -> str:
    return f"(({draw_sql(str(2**40), repr(tag), repr('noise'), 'ladder', 'pos')}) + 0.5) / {float(2**40)}"


@query(with_ctes(CTES, "ladders omegas", f"SELECT ladder, pos, round(omega + 0.5 * sigma_omega * sqrt(-2 * ln({_uniform_sql('u')})) * cos(2 * pi() * {_uniform_sql('v')}), 6) + 0.0 AS omega FROM omegas"))
def pe5_value_noise(spark, sf_dir):
    return result(ladder.value_noise(omegas(spark, sf_dir), 0.5).select("ladder", "pos", "omega"))


EVENT_STATES = "SELECT user_id, event_id, ts, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events"


@query(f"SELECT user_id, count(*) FILTER (WHERE event_type <> next) AS flips, count(*) AS steps FROM ({EVENT_STATES}) GROUP BY 1")
def wn7_flips(spark, sf_dir):
    return result(ladder.flips(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type"))


@query(f"SELECT user_id % 4 AS alpha, event_type AS from_state, next AS to_state, count(*) AS count FROM ({EVENT_STATES}) WHERE next IS NOT NULL GROUP BY 1, 2, 3")
def ag29_transitions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("alpha", F.col("user_id") % 4)
    return result(ladder.transitions(events, ["user_id"], ["ts", "event_id"], "event_type", ["alpha"]))


@query("SELECT user_id, event_type AS phase, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def wn16_last_of_phase(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("t", F.struct("ts", "event_id")).withColumnRenamed("event_type", "phase")
    return ladder.last_of_phase(events, ["user_id"], "phase", "t", ["value", "ts"])


TRIALS = f"""SELECT user_id, user_id % 4 AS alpha, bool_or(event_type = 'click') AS escaped, bool_or(event_type = 'purchase') AS returned,
  CAST(min(k) FILTER (WHERE event_type = 'click') AS DOUBLE) AS escape_steps, CAST(min(k) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS return_steps, CAST(count(*) FILTER (WHERE event_type <> next) AS DOUBLE) AS flips
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({EVENT_STATES})) GROUP BY 1, 2"""


def trials(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(order)).withColumn("k", F.row_number().over(order))
    step = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("k"))).cast("double")
    return rows.groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "click").alias("escaped"), F.bool_or(F.col("event_type") == "purchase").alias("returned"), step("click").alias("escape_steps"), step("purchase").alias("return_steps"),
        F.count_if(F.col("event_type") != F.col("next")).cast("double").alias("flips")).withColumn("alpha", F.col("user_id") % 4)


SUMMARY = f"count(*) AS trials, count(*) FILTER (WHERE escaped) AS escaped_count, count(*) FILTER (WHERE escaped AND returned) AS returned_count, {r('avg(CAST(escaped AS DOUBLE))', 'escape_rate')}, {r('avg(CASE WHEN escaped THEN CAST(returned AS DOUBLE) END)', 'return_rate')}, {r('avg(CASE WHEN escaped THEN escape_steps END)', 'mean_escape_steps')}, {r('avg(CASE WHEN escaped AND returned THEN return_steps END)', 'mean_return_steps')}, {r('avg(flips)', 'mean_flips')}, {r('quantile_cont(flips, 0.9)', 'p90_flips')}"


@query(f"SELECT alpha, {SUMMARY} FROM ({TRIALS}) GROUP BY 1")
def ag27_trial_summary(spark, sf_dir):
    return result(ladder.trial_summary(trials(spark, sf_dir), ["alpha"]))


@query(f"SELECT user_id % 3 AS p_swap, {SUMMARY} FROM ({TRIALS}) GROUP BY 1")
def ag28_operating_envelope(spark, sf_dir):
    return result(ladder.trial_summary(trials(spark, sf_dir).withColumn("p_swap", F.col("user_id") % 3), ["p_swap"]))


@query("SELECT user_id % 7 AS g, coalesce(quantile_cont(value, 0.9), 'inf'::DOUBLE) AS p90 FROM events GROUP BY 1")
def ag30_p90(spark, sf_dir):
    return summaries.p90(table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 7), ["g"], "value")


TRACE = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value > 80 AS separated, value / 100 AS similarity FROM events"


@query(f"WITH t AS ({TRACE}), b AS (SELECT user_id, min(step) FILTER (WHERE separated) AS t_e, min(step) FILTER (WHERE similarity >= 0.5) AS back, arg_min(similarity, step) AS start FROM t GROUP BY 1), a AS (SELECT t.user_id, avg(CAST(separated AS DOUBLE)) AS survival FROM t JOIN b ON t.user_id = b.user_id WHERE step >= t_e GROUP BY 1) SELECT b.user_id, t_e, {r('coalesce(survival, 0.0)', 'survival')}, start < 0.5 AS escaped, CASE WHEN start < 0.5 THEN back END AS recovery_step FROM b LEFT JOIN a ON a.user_id = b.user_id")
def wn8_trace_endpoints(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    trace = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("step"), (F.col("value") > 80).alias("separated"), (F.col("value") / 100).alias("similarity"))
    return result(endpoints.trace_endpoints(trace, ["user_id"], similar=0.5))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'RECOVERED' WHEN value > 90 THEN 'ESCAPED' WHEN value > 40 THEN 'BOUNDED' WHEN value > 5 THEN 'NULL_LIKE' ELSE 'UNRESOLVED' END AS classification FROM events")
def pf4_point_classification(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").alias("recovered"), (F.col("value") > 90).alias("escaped"), (F.col("value") > 40).alias("bounded"), (F.col("value") > 5).alias("null_like"))
    return endpoints.classify(points).select("event_id", "classification")


@query(f"WITH f AS (SELECT user_id % 10 AS k, CAST(ts AS DATE) AS d, count(*) > 2 AS flag FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) - row_number() OVER (PARTITION BY k, flag ORDER BY d) AS i FROM f) SELECT k, min(d) AS first, max(d) AS last, count(*) AS size FROM i WHERE flag GROUP BY k, i")
def wn11_contiguous_runs(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("k"), F.to_date("ts").alias("d")).agg((F.count(F.lit(1)) > 2).alias("flag"))
    return endpoints.contiguous_runs(days, ["k"], "d", "flag")


@query(with_ctes(CTES, "ladders omegas chis closures", ", m AS (SELECT ladder, min(rms) AS least FROM closures GROUP BY 1) SELECT c.ladder, round(first(least), 6) + 0.0 AS minimum, count(*) AS tied, min(n) AS coordinate, bool_or(n = 2 OR n = 30) AS boundary, bool_or(n = 3 OR n = 29) AS next_to_boundary FROM closures c JOIN m ON c.ladder = m.ladder WHERE rms <= least + 1e-10 GROUP BY 1"))
def ag54_minimum_audit(spark, sf_dir):
    scores = ladder.closure_scores(ladder.chi(omegas(spark, sf_dir), ["ladder"]), ["ladder"], (2, 30))
    return result(ladder.minimum_audit(scores, ["ladder"], "N", "rms"))


CURVATURE = ", b AS (SELECT ladder, n, -(lead(ln(rms)) OVER w - 2 * ln(rms) + lag(ln(rms)) OVER w) AS c FROM closures WINDOW w AS (PARTITION BY ladder ORDER BY n)), k AS (SELECT *, row_number() OVER (PARTITION BY ladder ORDER BY c DESC, n) AS rank FROM b WHERE c IS NOT NULL) "


@query(with_ctes(CTES, "ladders omegas chis closures", CURVATURE + f'SELECT ladder, n AS "N", {r("c", "curvature")}, rank FROM k'))
def wn13_relative_curvature(spark, sf_dir):
    scores = ladder.closure_scores(ladder.chi(omegas(spark, sf_dir), ["ladder"]), ["ladder"], (2, 30))
    return result(ladder.relative_curvature(scores, ["ladder"], "N", "rms"))


@query(with_ctes(CTES, "ladders omegas chis closures", CURVATURE + f'SELECT ladder, n AS "N", {r("c", "curvature")}, rank FROM k WHERE rank <= 3'))
def st4_curvature_candidates(spark, sf_dir):
    scores = ladder.closure_scores(ladder.chi(omegas(spark, sf_dir), ["ladder"]), ["ladder"], (2, 30))
    return result(ladder.relative_curvature(scores, ["ladder"], "N", "rms").where("rank <= 3"))


@query("WITH p AS (SELECT p_brand, p_size AS effect, avg(CAST(p_retailprice > 1100 AS DOUBLE)) AS power FROM part GROUP BY 1, 2) SELECT p_brand, CAST(min(effect) FILTER (WHERE power >= 0.8) AS BIGINT) AS minimum_effect FROM p GROUP BY 1")
def ag47_minimum_detectable(spark, sf_dir):
    power = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("effect")).agg(F.avg((F.col("p_retailprice") > 1100).cast("double")).alias("power"))
    return result(inference.minimum_detectable(power, ["p_brand"], "effect"))


@query(with_ctes(CTES, "ladders", f", d AS (SELECT ladder, replicate, pos, {draw_sql('(count(*) OVER (PARTITION BY ladder, replicate))', repr('resample'), 'replicate', 'ladder', 'pos')} AS k FROM ladders, (SELECT unnest(range(1, 4)) AS replicate)) SELECT d.ladder, replicate, d.pos, round(l.value, 6) + 0.0 AS value FROM d JOIN ladders l ON d.ladder = l.ladder AND l.pos = d.k + 1"))
def nu19_bootstrap_resample(spark, sf_dir):
    return result(nulls.resample(ladders(spark, sf_dir), ["ladder"], "pos", 3))


@query(f"""WITH g AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS i, CAST(n_nationkey AS BIGINT) AS j FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5 WHERE s_nationkey < n_nationkey), e AS (SELECT count(*) AS m FROM g), d AS (SELECT k, {draw_sql('300', "'rewire'", 'k')} AS pair FROM (SELECT unnest(range(0, 4 * (SELECT m FROM e) + 64)) AS k)),
f AS (SELECT pair, min(k) AS k FROM d GROUP BY 1), c AS (SELECT pair FROM f ORDER BY k LIMIT (SELECT m FROM e)), p AS (SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, row_number() OVER (ORDER BY a.n_nationkey, b.n_nationkey) - 1 AS pair FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) SELECT i, j FROM p JOIN c ON p.pair = c.pair""")
def nu16_rewired_graph(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    edges = supplier.join(nation, F.col("n_regionkey") == F.col("s_nationkey") % 5).where("s_nationkey < n_nationkey").select("s_nationkey", "n_nationkey").distinct()
    return result(nulls.rewired(edges, nation.select(F.col("n_nationkey").cast("long").alias("node"))).drop("place"))


@query("SELECT user_id % 20 AS k, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds, count(DISTINCT event_type) = 1 AS single FROM events GROUP BY 1")
def so8_single_digest(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("k")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"), (F.count_distinct("event_type") == 1).alias("single"))
