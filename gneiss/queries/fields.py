"""Field queries: line items binned by quantity and discount as a grid, nations' trade as a graph, embeddings as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import geometry
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

CTES = {
    "cells": "SELECT l_suppkey % 4 AS field, CAST(l_quantity AS BIGINT) - 1 AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, avg(ln(1 + l_extendedprice)) AS value, avg(sqrt(l_tax + 0.01)) * 10 - 2.2 AS v, avg(ln(l_extendedprice / l_quantity)) - 7.2 AS u FROM lineitem GROUP BY 1, 2, 3",
    "grid": "SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'mask', CAST(field AS VARCHAR), CAST(i AS VARCHAR), CAST(j AS VARCHAR))), 1, 4) AS BIGINT) % 10 <> 0 AS seen FROM cells",
    "centred": "SELECT field, i, j, seen, CASE WHEN seen THEN value - avg(CASE WHEN seen THEN value END) OVER (PARTITION BY field) END AS c FROM grid",
    "zeroed": "SELECT field, i, j, seen, CASE WHEN seen THEN u ELSE 0.0 END AS u, CASE WHEN seen THEN v ELSE 0.0 END AS v FROM grid",
    "slopes": "SELECT field, i, j, seen, " + ", ".join(
        f"CASE WHEN lag({c}) OVER w{a} IS NULL THEN lead({c}) OVER w{a} - {c} WHEN lead({c}) OVER w{a} IS NULL THEN {c} - lag({c}) OVER w{a} ELSE (lead({c}) OVER w{a} - lag({c}) OVER w{a}) / 2 END AS d{c}_d{a}" for c in "uv" for a in "ij")
    + " FROM zeroed WINDOW wi AS (PARTITION BY field, j ORDER BY i), wj AS (PARTITION BY field, i ORDER BY j)",
    "edges": "SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, sum(l_extendedprice * (1 - l_discount)) / 1000000 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2",
    "points": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS DOUBLE) AS value FROM embeddings",
}


def coherence_cte(source: str, value: str) -> str:
    """Common tables' text for the coherence of one column of ``source``."""
    return f"""SELECT field, CASE WHEN avg(c * c) > 2.220446049250313e-16 AND count(p) + count(q) > 0 THEN (coalesce(sum(p), 0) + coalesce(sum(q), 0)) / (count(p) + count(q)) / avg(c * c) ELSE 0.0 END AS coherence FROM (
      SELECT field, c, CASE WHEN lead(j) OVER a = j + 1 THEN c * lead(c) OVER a END AS p, CASE WHEN lead(i) OVER d = i + 1 THEN c * lead(c) OVER d END AS q FROM
        (SELECT field, i, j, CASE WHEN seen THEN {value} - avg(CASE WHEN seen THEN {value} END) OVER (PARTITION BY field) END AS c FROM {source}) WINDOW a AS (PARTITION BY field, i ORDER BY j), d AS (PARTITION BY field, j ORDER BY i)) GROUP BY 1"""


def grid(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    cells = items.groupBy((F.col("l_suppkey") % 4).alias("field"), (F.col("l_quantity").cast("long") - 1).alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j")).agg(
        F.avg(F.log(1 + F.col("l_extendedprice"))).alias("value"), (F.avg(F.sqrt(F.col("l_tax") + 0.01)) * 10 - 2.2).alias("v"), (F.avg(F.log(F.col("l_extendedprice") / F.col("l_quantity"))) - 7.2).alias("u"))
    from gneiss.operators.nulls import hashed

    mask = F.conv(F.substring(hashed("mask", F.col("field"), F.col("i"), F.col("j")), 1, 4), 16, 10).cast("long") % 10 != 0
    return cells.withColumn("seen", mask)


def edges(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier")}
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey <> c_nationkey")
    return joined.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000000).alias("w"))


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("double").alias("value"))


@query(with_ctes(CTES, "cells grid", f", s AS ({coherence_cte('grid', 'value')}) SELECT field, {r('coherence', 'coherence')} FROM s"))
def ge3_neighbour_coherence(spark, sf_dir):
    return result(geometry.neighbour_coherence(grid(spark, sf_dir), ["field"]))


VECTOR = f"""SELECT cu.field, {r('cu.coherence', 'u_coherence')}, {r('cv.coherence', 'v_coherence')}, {r('mean_curl', 'mean_curl')}, {r('curl_energy', 'curl_energy', 4)}, {r('mean_curl * mean_curl / greatest(curl_energy, 2.220446049250313e-16)', 'curl_coherence')}, {r('divergence_energy', 'divergence_energy', 4)} FROM cu JOIN cv ON cu.field = cv.field JOIN
  (SELECT field, avg(dv_dj - du_di) FILTER (WHERE seen) AS mean_curl, avg((dv_dj - du_di) * (dv_dj - du_di)) FILTER (WHERE seen) AS curl_energy, avg((du_dj + dv_di) * (du_dj + dv_di)) FILTER (WHERE seen) AS divergence_energy FROM slopes GROUP BY 1) s ON s.field = cu.field"""


@query(with_ctes(CTES, "cells grid zeroed slopes", f", cu AS ({coherence_cte('zeroed', 'u')}), cv AS ({coherence_cte('zeroed', 'v')}) " + VECTOR))
def ge2_vector_scores(spark, sf_dir):
    out = geometry.vector_scores(grid(spark, sf_dir), ["field"])
    return result(out.withColumn("curl_energy", F.round("curl_energy", 4)).withColumn("divergence_energy", F.round("divergence_energy", 4)))


TURNED = "SELECT field, j AS i, max(i) OVER (PARTITION BY field) - i AS j, -v AS u, u AS v, seen FROM grid"
MIRRORED = "SELECT field, max(i) OVER (PARTITION BY field) - i AS i, j, u, -v AS v, seen FROM grid"


@query(with_ctes(CTES, "cells grid", f", t AS ({TURNED}) SELECT field, i, j, {r('u', 'u')}, {r('v', 'v')}, seen FROM t"))
def pe8_rotate_90(spark, sf_dir):
    return result(geometry.rotate_90(grid(spark, sf_dir), ["field"]))


@query(with_ctes(CTES, "cells grid", f", t AS ({MIRRORED}) SELECT field, i, j, {r('u', 'u')}, {r('v', 'v')}, seen FROM t"))
def pe9_reflect_y(spark, sf_dir):
    return result(geometry.reflect_y(grid(spark, sf_dir), ["field"]))


def _vector_of(name: str) -> str:
    turned = {"zeroed": CTES["zeroed"].replace("FROM grid", f"FROM {name}"), "slopes": CTES["slopes"]}
    return ", ".join(f"{k} AS ({v})" for k, v in turned.items()) + f", cu AS ({coherence_cte('zeroed', 'u')}), cv AS ({coherence_cte('zeroed', 'v')}) "


@query(with_ctes(CTES, "cells grid", f", t AS ({TURNED}), {_vector_of('t')}" + VECTOR))
def pe13_rotation_audit(spark, sf_dir):
    """Scores after a quarter turn, for comparison with the unturned field's: u and v coherence change places."""
    out = geometry.vector_scores(geometry.rotate_90(grid(spark, sf_dir), ["field"]), ["field"])
    return result(out.withColumn("curl_energy", F.round("curl_energy", 4)).withColumn("divergence_energy", F.round("divergence_energy", 4)))


@query(with_ctes(CTES, "cells grid", f", a AS ({coherence_cte('grid', 'value')}), b AS ({coherence_cte('grid', 'u')}), c AS ({coherence_cte('grid', 'v')}) SELECT a.field, {r('a.coherence', 'value_coherence')}, {r('b.coherence', 'u_coherence')}, {r('c.coherence', 'v_coherence')}, x, y, z FROM a JOIN b ON a.field = b.field JOIN c ON a.field = c.field JOIN (SELECT field, {r('corr(value, u)', 'x')}, {r('corr(value, v)', 'y')}, {r('corr(u, v)', 'z')} FROM grid WHERE seen GROUP BY 1) k ON k.field = a.field")
       .replace(" x, y, z FROM", " x AS value_u_correlation, y AS value_v_correlation, z AS u_v_correlation FROM"))
def ge9_component_scores(spark, sf_dir):
    return result(geometry.component_scores(grid(spark, sf_dir), ["field"], ["value", "u", "v"]))


@query(with_ctes(CTES, "cells grid", f", a AS ({coherence_cte('grid', 'value')}) SELECT {r('median(coherence)', 'coherence')} FROM a"))
def ge7_frame_medians(spark, sf_dir):
    frames = geometry.neighbour_coherence(grid(spark, sf_dir), ["field"]).withColumn("all", F.lit(1))
    return result(geometry.frame_medians(frames, ["all"], ["coherence"]).drop("all"))


@query(with_ctes(CTES, "cells grid", f", m AS (SELECT field, i, avg(value) AS m FROM grid GROUP BY 1, 2), l AS (SELECT *, lag(m) OVER (PARTITION BY field ORDER BY i) AS b FROM m) SELECT field, {r('CASE WHEN count(*) > 2 AND stddev_pop(m) > 2.220446049250313e-16 THEN corr(b, CASE WHEN b IS NOT NULL THEN m END) ELSE 0.0 END', 'lag1')} FROM l GROUP BY 1"))
def wn19_lag_one(spark, sf_dir):
    frames = grid(spark, sf_dir).groupBy("field", "i").agg(F.avg("value").alias("m"))
    return result(geometry.lag_one(frames, ["field"], "i", "m"))


def _down(source: str, f: int) -> str:
    return f"SELECT field, i // {f} AS i, j // {f} AS j, coalesce(avg(value) FILTER (WHERE seen), 0.0) AS value, bool_or(seen) AS seen FROM (SELECT *, (max(i) OVER (PARTITION BY field) + 1) // {f} * {f} AS h, (max(j) OVER (PARTITION BY field) + 1) // {f} * {f} AS w FROM {source}) WHERE i < h AND j < w GROUP BY ALL"


@query(with_ctes(CTES, "cells grid", f", d AS ({_down('grid', 2)}) SELECT field, i, j, {r('value', 'value')}, seen FROM d"))
def ag60_downsample(spark, sf_dir):
    return result(geometry.downsample(grid(spark, sf_dir), ["field"], 2))


@query(with_ctes(CTES, "cells grid", f", d AS ({_down('grid', 2)}), e AS ({_down('d', 2)}) SELECT 2 AS ell, field, i, j, {r('value', 'value')}, seen FROM d UNION ALL SELECT 4, field, i, j, round(value, 6) + 0.0, seen FROM e").replace("SELECT 2 AS ell", "SELECT 2::BIGINT AS ell"))
def pe12_scale_views(spark, sf_dir):
    half = geometry.downsample(grid(spark, sf_dir), ["field"], 2)
    quarter = geometry.downsample(half, ["field"], 2)
    return result(half.select(F.lit(2).alias("ell"), "*").union(quarter.select(F.lit(4).alias("ell"), "*")))


@query("SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS i, CAST(floor(l_quantity * 100 / 500) AS BIGINT) AS j, count(*) AS n, round(median(l_tax), 6) + 0.0 AS tax, round(median(l_discount), 6) + 0.0 AS discount FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 8".replace("l_quantity * 100 / 500", "l_quantity * 1000 / 5000"))
def ag58_cell_binning(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 1000).alias("y"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return result(geometry.bin_points(rows, 5000, ["tax", "discount"]))


@query("WITH s AS (SELECT CAST(l_quantity AS BIGINT) AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, year(l_shipdate) AS t, avg(l_tax) AS value FROM lineitem GROUP BY 1, 2, 3) SELECT i, j, round(avg(value), 6) + 0.0 AS value, count(DISTINCT t) FILTER (WHERE value IS NOT NULL) = (SELECT count(DISTINCT t) FROM s) AS seen FROM s GROUP BY 1, 2")
def ag59_mean_field(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j"), F.year("l_shipdate").alias("t")).agg(F.avg("l_tax").alias("value"))
    return result(geometry.mean_field(rows))


@query(with_ctes(CTES, "cells grid", f"SELECT field, {r('median(abs(v) / greatest(abs(u), 1e-9))', 'ratio')} FROM grid WHERE seen GROUP BY 1"))
def ag61_cross_stream_ratio(spark, sf_dir):
    return result(geometry.cross_stream_ratio(grid(spark, sf_dir), ["field"]))


@query(with_ctes(CTES, "cells grid", f", d AS (SELECT field, value, value - avg(value) OVER (PARTITION BY field, i) - avg(value) OVER (PARTITION BY field, j) + avg(value) OVER (PARTITION BY field) AS rest FROM grid) SELECT field, {r('avg(rest * rest) / greatest(var_pop(value), 2.220446049250313e-16)', 'residual_ratio')} FROM d GROUP BY 1"))
def ag62_additive_residual(spark, sf_dir):
    return result(geometry.additive_residual(grid(spark, sf_dir), ["field"]))


@query(with_ctes(CTES, "cells grid", ", k AS (SELECT field, i, j, seen, row_number() OVER (PARTITION BY field, seen ORDER BY md5(concat_ws('|', 'dropout', CAST(field AS VARCHAR), CAST(i AS VARCHAR), CAST(j AS VARCHAR))), i, j) AS k, count(*) OVER (PARTITION BY field, seen) AS n FROM grid) SELECT field, i, j, seen AND NOT (k <= greatest(1, ceil(0.05 * n))) AS seen FROM k"))
def pe10_mask_dropout(spark, sf_dir):
    return result(geometry.drop_out(grid(spark, sf_dir), ["field"], 0.05).select("field", "i", "j", "seen"))


def _cells_null(values: str, seed: str) -> str:
    rank = f"row_number() OVER (PARTITION BY field, child ORDER BY md5(concat_ws('|', '{seed}', CAST(child AS VARCHAR), CAST(field AS VARCHAR), CAST(i * 1000000 + j AS VARCHAR))), i, j)"
    return f"SELECT t.field, CAST(t.child AS BIGINT) AS child, t.i, t.j, {values} FROM (SELECT *, row_number() OVER (PARTITION BY field, child ORDER BY i, j) AS k FROM grid, (SELECT unnest(range(1, 4)) AS child) WHERE seen) t JOIN (SELECT *, {rank} AS k FROM grid, (SELECT unnest(range(1, 4)) AS child) WHERE seen) s ON t.field = s.field AND t.child = s.child AND t.k = s.k"


@query(with_ctes(CTES, "cells grid", _cells_null(r("s.value", "value"), "cells")))
def nu6_masked_cell_permutation(spark, sf_dir):
    return result(geometry.permute_cells(grid(spark, sf_dir), ["field"], 3))


@query(with_ctes(CTES, "cells grid", _cells_null(r("s.u", "u") + ", " + r("s.v", "v"), "whole")))
def nu5_vector_permutation(spark, sf_dir):
    vectors = grid(spark, sf_dir).withColumn("value", F.struct("u", "v"))
    return result(geometry.permute_cells(vectors, ["field"], 3, seed="whole").select("field", "child", "i", "j", "value.u", "value.v"))


@query(with_ctes(CTES, "cells", ", " + "s AS (SELECT field, i, j, (value + " + " + ".join(f"coalesce({f}(value) OVER w{a}, {e}_value(value) OVER f{a})" for a in "ij" for f, e in (("lag", "last"), ("lead", "first"))) + ") / 5 AS value FROM cells WINDOW " + ", ".join(f"w{a} AS (PARTITION BY field, {b} ORDER BY {a}), f{a} AS (PARTITION BY field, {b} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" for a, b in (("i", "j"), ("j", "i"))) + f") SELECT field, i, j, {r('value', 'value')} FROM s"))
def pe16_smoothing(spark, sf_dir):
    return result(geometry.smooth(grid(spark, sf_dir), ["field"]))


DIRECTIONS = [(0, 1), (1, 0), (1, 1), (1, -1)]


def _line_sql(dy: int, dx: int) -> str:
    line = f"SELECT a.field, a.i, a.j, count(*) AS n, avg(CAST(b.seen AS DOUBLE)) AS m FROM grid a JOIN grid b ON a.field = b.field AND b.i >= a.i AND b.i - a.i = {dy} * k.k AND b.j - a.j = {dx} * k.k"
    return f"SELECT field, '{dy},{dx}' AS direction, coalesce(max(m) FILTER (WHERE n >= 4), 0.0) AS occupancy FROM (SELECT a.field, a.i, a.j, count(*) AS n, avg(CAST(b.seen AS DOUBLE)) AS m FROM grid a, (SELECT unnest(range(0, 50)) AS k) k, grid b WHERE a.field = b.field AND b.i = a.i + {dy} * k.k AND b.j = a.j + {dx} * k.k GROUP BY 1, 2, 3) GROUP BY 1" if line else ""


@query(with_ctes(CTES, "cells grid", ", l AS (" + " UNION ALL ".join(_line_sql(*d) for d in DIRECTIONS) + f") SELECT field, direction, {r('occupancy', 'occupancy')}, occupancy >= 0.75 AS channel FROM l"))
def ge20_line_porosity(spark, sf_dir):
    return result(geometry.line_porosity(grid(spark, sf_dir), ["field"], DIRECTIONS))


@query(with_ctes(CTES, "cells grid", f", s AS (SELECT a.field, radius, a.i, a.j, avg(CAST(b.seen AS DOUBLE)) AS share FROM grid a, grid b, (SELECT unnest([1, 2]) AS radius) WHERE a.field = b.field AND (a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) <= radius * radius GROUP BY 1, 2, 3, 4) SELECT field, CAST(radius AS BIGINT) AS radius, {r('max(share)', 'maximum_occupancy')}, {r('1 - median(share)', 'median_missing')}, {r('1 - max(share)', 'minimum_missing')} FROM s GROUP BY 1, 2"))
def ge21_ball_porosity(spark, sf_dir):
    return result(geometry.ball_porosity(grid(spark, sf_dir), ["field"], [1, 2]))


@query(with_ctes(CTES, "edges", f", x AS (SELECT sum(least(abs(a.w), abs(b.w))) AS mutual FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src), y AS (SELECT sum(a.w * b.w * c.w) AS t FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src), z AS (SELECT sum(abs(w)) AS total FROM edges) SELECT {r('total', 'total', 4)}, {r('mutual / total', 'reciprocity')}, {r('t', 'three_cycles', 2)}, {r('t / pow(total, 3)', 'normalized_three_cycles', 9)} FROM x, y, z"))
def ge10_graph_scores(spark, sf_dir):
    out = geometry.graph_scores(edges(spark, sf_dir))
    return out.select((F.round("total", 4) + 0.0).alias("total"), (F.round("reciprocity", 6) + 0.0).alias("reciprocity"), (F.round("three_cycles", 2) + 0.0).alias("three_cycles"), (F.round("normalized_three_cycles", 9) + 0.0).alias("normalized_three_cycles"))


@query(with_ctes(CTES, "edges", f", u AS (SELECT DISTINCT least(src, dst) AS i, greatest(src, dst) AS j FROM edges WHERE w > (SELECT median(w) FROM edges)), t AS (SELECT count(*) AS triangles FROM u a JOIN u b ON a.j = b.i JOIN u c ON c.i = a.i AND c.j = b.j), d AS (SELECT n, count(*) AS d FROM (SELECT i AS n FROM u UNION ALL SELECT j FROM u) GROUP BY 1), w AS (SELECT sum(d * (d - 1) / 2) AS wedges FROM d) SELECT triangles, {r('wedges', 'wedges')}, {r('3 * triangles / wedges', 'transitivity')} FROM t, w"))
def ge1_triangles(spark, sf_dir):
    e = edges(spark, sf_dir)
    middle = e.agg(F.median("w").alias("m"))
    pairs = e.crossJoin(F.broadcast(middle)).where("w > m").select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    return result(geometry.triangles(pairs))


NEAREST = "SELECT id, other, d FROM (SELECT a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS k FROM points a JOIN points b ON a.id <> b.id) WHERE k = 1"


@query(with_ctes(CTES, "points", f", n AS ({NEAREST}) SELECT id, other, round(d, 6) + 0.0 AS distance FROM n"))
def j15_nearest_point(spark, sf_dir):
    return result(geometry.all_nearest_points(points(spark, sf_dir)).where("other is not null"))


@query(with_ctes(CTES, "points", f", n AS ({NEAREST}), s AS (SELECT var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c, avg(value) AS m, var_pop(value) AS s FROM points), l AS (SELECT avg((p.value - m) * (q.value - m)) AS product FROM n JOIN points p ON n.id = p.id JOIN points q ON n.other = q.id, s) SELECT {r('sqrt(((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)) / ((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c)))', 'anisotropy')}, {r('product / s', 'neighbour_coherence')} FROM s, l"))
def ge11_point_scores(spark, sf_dir):
    p = points(spark, sf_dir)
    return result(geometry.point_scores(p, geometry.all_nearest_points(p)))


@query(with_ctes(CTES, "points", f""", p AS (SELECT CAST(value AS BIGINT) AS path, id AS pos, x, y FROM points), c AS (SELECT *, x - avg(x) OVER (PARTITION BY path) AS cx, y - avg(y) OVER (PARTITION BY path) AS cy FROM p), a AS (SELECT *, atan2(cy, cx) AS angle FROM c),
s AS (SELECT path, cx, cy, angle, coalesce(lead(angle) OVER w, first_value(angle) OVER w) - angle + pi() AS raw, sqrt(pow(coalesce(lead(x) OVER w, first_value(x) OVER w) - x, 2) + pow(coalesce(lead(y) OVER w, first_value(y) OVER w) - y, 2)) AS step FROM a WINDOW w AS (PARTITION BY path ORDER BY pos)), g AS (SELECT path, count(*) AS n, sum(raw - 2 * pi() * floor(raw / (2 * pi())) - pi()) / (2 * pi()) AS winding, sum(step) AS length, median(sqrt(cx * cx + cy * cy)) AS radius FROM s GROUP BY 1)
SELECT path, {r('winding', 'winding')}, {r('length', 'length')}, {r('least(1.0, 2 * pi() * radius / length)', 'efficiency')}, {r('least(1.0, abs(winding)) * least(1.0, 2 * pi() * radius / length)', 'coherence')} FROM g WHERE n >= 4"""))
def ge19_winding(spark, sf_dir):
    paths = points(spark, sf_dir).select(F.col("value").cast("long").alias("path"), F.col("id").alias("pos"), "x", "y")
    return result(geometry.winding(paths, ["path"]))


@query("WITH p AS (SELECT p_brand AS path, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part) SELECT path, pos, p_partkey AS node FROM p")
def ge17_path_extraction(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("node")
    nodes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("node"))
    links = nodes.withColumn("b", F.lead("node").over(order)).where("b is not null").select("path", F.col("node").alias("a"), "b")
    return result(geometry.path_order(links))


@query("SELECT x, y, y * 40 + x AS index, round(-1.35 + 2.7 * x / 39, 9) + 0.0 AS re, round(1.05 - 2.1 * y / 27, 9) + 0.0 AS im FROM (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(0, 28)) AS y)")
def pf3_grid_generation(spark, sf_dir):
    from gneiss.operators.dynamics import grid_points

    return grid_points(spark, 40, 28, (-1.35, 1.35), (-1.05, 1.05)).select("x", "y", "index", (F.round("re", 9) + 0.0).alias("re"), (F.round("im", 9) + 0.0).alias("im"))


@query("""WITH RECURSIVE g AS (SELECT x, y, -1.35 + 2.7 * x / 39 AS cr, 1.05 - 2.1 * y / 27 AS ci FROM (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(0, 28)) AS y)),
o AS (SELECT x, y, cr, ci, 0 AS step, 0.0::DOUBLE AS zr, 0.0::DOUBLE AS zi FROM g UNION ALL SELECT x, y, cr, ci, step + 1, zr * zr - zi * zi + cr, 2 * zr * zi + ci FROM o WHERE step < 24 AND zr * zr + zi * zi <= 4)
SELECT x, y, max(zr * zr + zi * zi) > 4 AS escaped, CAST(max(step) AS BIGINT) AS steps FROM o GROUP BY 1, 2""")
def si1_escape_time(spark, sf_dir):
    from gneiss.operators.dynamics import escape_time, grid_points

    return escape_time(grid_points(spark, 40, 28, (-1.35, 1.35), (-1.05, 1.05)), most=24).select("x", "y", "escaped", "steps")
