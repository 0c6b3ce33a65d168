"""Queries over volumes, kinds of geometry, their nulls and checks: line items binned by supplier group as volumes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import typed
from gneiss.operators.nulls import hashed
from gneiss.queries import fields, kernels
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.queries.panels import draw_sql
from gneiss.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql

CTES = fields.CTES | {
    "vol": """SELECT l_suppkey % 2 AS volume, (l_suppkey // 2) % 5 AS k, CAST(l_quantity AS BIGINT) - 1 AS i, CAST(round(l_discount * 100) AS BIGINT) AS j, avg(ln(1 + l_extendedprice)) AS value,
      avg(ln(l_extendedprice / l_quantity)) - 7.2 AS u, avg(sqrt(l_tax + 0.01)) * 10 - 2.2 AS v, avg(l_tax) * 10 - 0.4 AS w FROM lineitem GROUP BY 1, 2, 3, 4""",
    "volume": "SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'mask', CAST(volume AS VARCHAR), CAST(k AS VARCHAR), CAST(i AS VARCHAR), CAST(j AS VARCHAR))), 1, 4) AS BIGINT) % 10 <> 0 AS seen FROM vol",
    "slices": "SELECT volume * 100 + k AS field, i, j, value, seen FROM volume",
}
CTES |= {f"{c}_slices": f"SELECT volume * 100 + k AS field, i, j, CASE WHEN seen THEN {c} ELSE 0.0 END AS {c}, seen FROM volume" for c in "uvw"}
CTES["zero3"] = "SELECT volume, k, i, j, seen, " + ", ".join(f"CASE WHEN seen THEN {c} ELSE 0.0 END AS {c}" for c in "uvw") + " FROM volume"
CTES["slopes3"] = "SELECT volume, seen, " + ", ".join(
    f"CASE WHEN lag({c}) OVER w{a} IS NULL AND lead({c}) OVER w{a} IS NULL THEN 0.0 WHEN lag({c}) OVER w{a} IS NULL THEN lead({c}) OVER w{a} - {c} WHEN lead({c}) OVER w{a} IS NULL THEN {c} - lag({c}) OVER w{a} ELSE (lead({c}) OVER w{a} - lag({c}) OVER w{a}) / 2 END AS d{c}_d{a}"
    for c in "uvw" for a in "kij") + " FROM zero3 WINDOW wk AS (PARTITION BY volume, i, j ORDER BY k), wi AS (PARTITION BY volume, k, j ORDER BY i), wj AS (PARTITION BY volume, k, i ORDER BY j)"
CONCENTRATION = "conc AS (SELECT field, sum(p) FILTER (WHERE place <= 28) / sum(p) AS concentration FROM n GROUP BY 1)"


def volume(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    cells = items.groupBy((F.col("l_suppkey") % 2).alias("volume"), F.floor(F.col("l_suppkey") / 2 % 5).alias("k"), (F.col("l_quantity").cast("long") - 1).alias("i"), F.round(F.col("l_discount") * 100).cast("long").alias("j")).agg(
        F.avg(F.log(1 + F.col("l_extendedprice"))).alias("value"), (F.avg(F.log(F.col("l_extendedprice") / F.col("l_quantity"))) - 7.2).alias("u"), (F.avg(F.sqrt(F.col("l_tax") + 0.01)) * 10 - 2.2).alias("v"), (F.avg("l_tax") * 10 - 0.4).alias("w"))
    mask = F.conv(F.substring(hashed("mask", F.col("volume"), F.col("k"), F.col("i"), F.col("j")), 1, 4), 16, 10).cast("long") % 10 != 0
    return cells.withColumn("seen", mask)


@query(with_ctes(CTES, "vol volume slices", f", s AS ({fields.coherence_cte('slices', 'value')})" + kernels.DFT.replace("FROM grid", "FROM slices") + f""", {CONCENTRATION},
m AS (SELECT volume, k, avg(value) FILTER (WHERE seen) AS m FROM volume GROUP BY 1, 2), l AS (SELECT *, lag(m) OVER (PARTITION BY volume ORDER BY k) AS b FROM m), g AS (SELECT volume, CASE WHEN count(*) > 2 AND stddev_pop(m) > 2.220446049250313e-16 THEN corr(b, CASE WHEN b IS NOT NULL THEN m END) ELSE 0.0 END AS lag1 FROM l GROUP BY 1)
SELECT g.volume, {r('median(s.coherence)', 'median_slice_neighbour_coherence')}, {r('median(conc.concentration)', 'median_slice_spectral_concentration')}, {r('first(g.lag1)', 'lag1_slice_mean')} FROM s JOIN conc ON s.field = conc.field JOIN g ON g.volume = s.field // 100 GROUP BY 1"""))
def ge5_volume_scores(spark, sf_dir):
    return result(typed.volume_scores(volume(spark, sf_dir), ["volume"]))


@query(with_ctes(CTES, "vol volume u_slices v_slices w_slices zero3 slopes3", ", " + ", ".join(f"c{c} AS ({fields.coherence_cte(f'{c}_slices', c)})" for c in "uvw") + f""",
q AS (SELECT volume, CASE WHEN seen THEN dw_di - dv_dk END AS cx, CASE WHEN seen THEN du_dk - dw_dj END AS cy, CASE WHEN seen THEN dv_dj - du_di END AS cz, CASE WHEN seen THEN du_dj + dv_di + dw_dk END AS div FROM slopes3),
e AS (SELECT volume, avg(cx * cx + cy * cy + cz * cz) AS energy, pow(avg(cx), 2) + pow(avg(cy), 2) + pow(avg(cz), 2) AS mean, avg(div * div) AS div FROM q GROUP BY 1), """ + ", ".join(f"m{c} AS (SELECT field // 100 AS volume, median(coherence) AS m FROM c{c} GROUP BY 1)" for c in "uvw") + f"""
SELECT e.volume, {r('energy', 'curl_energy_3d')}, {r('mean / greatest(energy, 2.220446049250313e-16)', 'curl_coherence_3d')}, {r('div', 'divergence_energy_3d')}, {r('mu.m', 'u_volume_neighbour_coherence')}, {r('mv.m', 'v_volume_neighbour_coherence')}, {r('mw.m', 'w_volume_neighbour_coherence')} FROM e JOIN mu ON mu.volume = e.volume JOIN mv ON mv.volume = e.volume JOIN mw ON mw.volume = e.volume"""))
def ge6_vector_volume_scores(spark, sf_dir):
    return result(typed.vector_volume_scores(volume(spark, sf_dir), ["volume"]))


_CHANNELS = (f", sc AS ({fields.coherence_cte('grid', 'value')}), cu AS ({fields.coherence_cte('zeroed', 'u')}), cv AS ({fields.coherence_cte('zeroed', 'v')}), gu AS ({fields.coherence_cte('grid', 'u')}), gv AS ({fields.coherence_cte('grid', 'v')})" + kernels.DFT + f""", {CONCENTRATION},
e AS (SELECT field, avg(dv_dj - du_di) FILTER (WHERE seen) AS mean_curl, avg((dv_dj - du_di) * (dv_dj - du_di)) FILTER (WHERE seen) AS curl_energy, avg((du_dj + dv_di) * (du_dj + dv_di)) FILTER (WHERE seen) AS divergence_energy FROM slopes GROUP BY 1),
k AS (SELECT field, corr(value, u) AS x, corr(value, v) AS y, corr(u, v) AS z FROM grid WHERE seen GROUP BY 1),
channels AS (""" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, field, '{channel}' AS channel, {score} AS score FROM {source}" for kind, channel, score, source in (
    ("scalar_field_2d", "neighbour_coherence", "coherence", "sc"), ("scalar_field_2d", "spectral_concentration", "concentration", "conc"), ("vector_field_2d", "u_coherence", "coherence", "cu"), ("vector_field_2d", "v_coherence", "coherence", "cv"),
    ("vector_field_2d", "mean_curl", "mean_curl", "e"), ("vector_field_2d", "curl_energy", "curl_energy", "e"), ("vector_field_2d", "curl_coherence", "mean_curl * mean_curl / greatest(curl_energy, 2.220446049250313e-16)", "e"), ("vector_field_2d", "divergence_energy", "divergence_energy", "e"),
    ("multicomponent_single_system", "value_coherence", "coherence", "sc"), ("multicomponent_single_system", "u_coherence", "coherence", "gu"), ("multicomponent_single_system", "v_coherence", "coherence", "gv"),
    ("multicomponent_single_system", "value_u_correlation", "x", "k"), ("multicomponent_single_system", "value_v_correlation", "y", "k"), ("multicomponent_single_system", "u_v_correlation", "z", "k"))) + ")")
KINDS = ("scalar_field_2d", "vector_field_2d", "multicomponent_single_system")


def _typed(spark, sf_dir):
    grid = fields.grid(spark, sf_dir)
    return reduce(DataFrame.union, (typed.typed_scores(kind, grid, ["field"]).select(F.lit(kind).alias("kind"), "field", "channel", "score") for kind in KINDS))


@query(with_ctes(CTES, "cells grid zeroed slopes", _CHANNELS + f" SELECT kind, field, channel, {r('score', 'score', 4)} FROM channels"))
def ge13_typed_scores(spark, sf_dir):
    return _typed(spark, sf_dir).withColumn("score", F.round("score", 4) + F.lit(0.0))


@query(with_ctes(CTES, "cells grid zeroed slopes", _CHANNELS + f" SELECT field, {r('abs(score)', 'score', 4)} FROM channels WHERE channel = 'curl_energy'"))
def ge24_channel_projection(spark, sf_dir):
    return typed.projected(_typed(spark, sf_dir).drop("kind"), ["field"], "curl_energy").withColumn("score", F.round("score", 4) + F.lit(0.0))


@query(f"""WITH p AS (SELECT p_brand AS path, ln(p_retailprice) AS omega, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part), c AS (SELECT path, sum(omega / pos) AS chi, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT path, m, abs(chi - 2 * pi() / m) AS rms, row_number() OVER (PARTITION BY path ORDER BY abs(chi - 2 * pi() / m), m) AS place FROM c, (SELECT unnest(range(7, 14)) AS m) WHERE n > 1)
SELECT a.path, a.m AS winner, {r('a.rms', 'winner_rms')}, b.m AS runner, {r('b.rms', 'runner_rms')}, {r('b.rms - a.rms', 'margin')} FROM s a JOIN s b ON a.path = b.path AND a.place = 1 AND b.place = 2""")
def ge18_path_closure(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("node")
    nodes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("node"), F.log("p_retailprice").alias("omega"))
    links = nodes.withColumn("b", F.lead("node").over(order)).where("b is not null").select("path", F.col("node").alias("a"), "b")
    return result(typed.path_closure(links, nodes))


_HALF = draw_sql(str(1 << 20), "'support'", "i", "j") + f" / {float(1 << 20)} > 0.4"


@query(with_ctes(CTES, "cells", f""", g AS (SELECT DISTINCT i, j FROM cells), m AS (SELECT i, j, abs(i - 24.5) < 1 OR (i + j) % 7 = 0 AS ball_porous_line_containing, (j + 2 * i) % 5 = 0 AND ((2 * j - i) % 7 + 7) % 7 <> 0 AS line_porous, abs(j - 24.5) < 1 OR abs(i - 24.5) < 1 AS orthogonal_line_counterexample,
  ((j - 3 * i) % 11 + 11) % 11 = 0 AS directionally_hidden_channel, CAST(floor(sqrt(pow(j - 24.5, 2) + pow(i - 24.5, 2))) AS BIGINT) % 4 = 0 AS isotropic_porous, j % 6 = 0 OR (i % 9 = 0 AND {_HALF}) AS anisotropic_porous FROM g)
SELECT support, i, j, seen FROM (UNPIVOT m ON ball_porous_line_containing, line_porous, orthogonal_line_counterexample, directionally_hidden_channel, isotropic_porous, anisotropic_porous INTO NAME support VALUE seen)"""))
def ge23_support_masks(spark, sf_dir):
    return typed.support_masks(fields.grid(spark, sf_dir).select("i", "j").distinct(), 50)


def _moved(source: str, keys: str, values: str, seed: str, children: int, where: str = "WHERE seen") -> str:
    marks = "".join(f", CAST({k.strip()} AS VARCHAR)" for k in keys.split(","))
    on = " AND ".join(f"t.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {named}, t.child, t.i, t.j, {values} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, child ORDER BY i, j) AS q FROM {source}, (SELECT unnest(range(1, {children + 1})) AS child) {where}) t JOIN
      (SELECT *, row_number() OVER (PARTITION BY {keys}, child ORDER BY md5(concat_ws('|', '{seed}', CAST(child AS VARCHAR){marks}, CAST(i * 1000000 + j AS VARCHAR))), i, j) AS q FROM {source}, (SELECT unnest(range(1, {children + 1})) AS child) {where}) s ON {on} AND t.child = s.child AND t.q = s.q"""


def _order(source: str, keys: str, item: str, seed: str, children: int) -> str:
    """Where each item goes: (keys, child, to_item, from_item)."""
    part = f"{keys}, child" if keys else "child"
    marks = "".join(f", CAST({k.strip()} AS VARCHAR)" for k in keys.split(",") if keys)
    on = " AND ".join([f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(",") if keys] + ["a.child = b.child", "a.q = b.q"])
    base = f"(SELECT DISTINCT {keys + ', ' if keys else ''}{item} FROM {source}), (SELECT unnest(range(1, {children + 1})) AS child)"
    return f"""SELECT a.*, b.{item} AS from_item FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {item}) AS q FROM {base}) a JOIN
      (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY md5(concat_ws('|', '{seed}', CAST(child AS VARCHAR){marks}, CAST({item} AS VARCHAR))), {item}) AS q FROM {base}) b ON {on}"""


@query(with_ctes(CTES, "vol volume", f", m AS ({_moved('volume', 'volume, k', 's.value AS value', 'typed', 2)}), o AS ({_order('volume', 'volume', 'k', 'typed|order', 2)}) SELECT m.volume, CAST(m.child AS BIGINT) AS child, o.k AS k, m.i, m.j, round(value, 6) + 0.0 AS value FROM m JOIN o ON m.volume = o.volume AND m.child = o.child AND m.k = o.from_item"))
def nu7_frame_and_cell_null(spark, sf_dir):
    """The null of a sequence of frames through the dispatch by kind."""
    return result(typed.typed_null("spatiotemporal_scalar", volume(spark, sf_dir), ["volume"], 2))


@query(with_ctes(CTES, "edges", f", ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), o AS ({_order('ends', '', 'node', 'typed', 3)}) SELECT CAST(a.child AS BIGINT) AS child, a.from_item AS \"left\", b.from_item AS \"right\", round(w, 4) + 0.0 AS w FROM edges e JOIN o a ON e.src = a.node JOIN o b ON e.dst = b.node AND a.child = b.child"))
def nu7_relabelled_null(spark, sf_dir):
    """The null of a matrix through the dispatch by kind: rows and columns change names alike."""
    rows = fields.edges(spark, sf_dir).withColumnsRenamed({"src": "left", "dst": "right"})
    return typed.typed_null("correlation", rows, [], 3).select("child", "left", "right", (F.round("w", 4) + 0.0).alias("w"))


def _normal_sql(*parts: str) -> str:
    u, v = (f"({draw_sql(str(2**40), tag, *parts)} + 0.5) / {float(2**40)}" for tag in ("'u'", "'v'"))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


@query(with_ctes(CTES, "cells grid", f""", spread AS (SELECT *, greatest(stddev_pop(value) OVER (PARTITION BY field), 1.0) AS sd FROM grid), parents AS (SELECT field, parent, i, j, value + 0.04 * sd * {_normal_sql("'parent'", 'field', 'parent', 'i', 'j')} AS value, seen FROM spread, (SELECT unnest(range(1, 13)) AS parent)),
kids AS ({_moved('parents', 'field, parent', 's.value AS value', 'cells', 127)}), every AS (SELECT field, parent, 0 AS child, i, j, value FROM parents WHERE seen UNION ALL SELECT field, parent, child, i, j, value FROM kids)
SELECT field, CAST(parent AS BIGINT) AS parent, CAST(child AS BIGINT) AS child, count(*) AS cells, {r('avg(value * (i + 1) / (j + 1))', 'moment')} FROM every GROUP BY 1, 2, 3"""))
def nu18_parent_ensembles(spark, sf_dir):
    """Twelve jittered parents of each field and 127 null children of each, as a moment that depends on the places."""
    every = typed.parent_ensembles(fields.grid(spark, sf_dir), ["field"], 12, 127)
    return result(every.groupBy("field", "parent", "child").agg(F.count(F.lit(1)).alias("cells"), F.avg(F.col("value") * (F.col("i") + 1) / (F.col("j") + 1)).alias("moment")))


@query(with_ctes(CTES, "cells grid", ", n AS (SELECT *, sqrt(avg(CASE WHEN seen THEN u * u END) OVER (PARTITION BY field)) AS ru, sqrt(avg(CASE WHEN seen THEN v * v END) OVER (PARTITION BY field)) AS rv FROM grid) SELECT field, i, j, " + ", ".join(
    f"round({c} + 0.01 * r{c} * " + _normal_sql("'component'", f"'{c}'", "field", "i", "j") + f", 6) + 0.0 AS {c}" for c in "uv") + " FROM n"))
def pe11_component_noise(spark, sf_dir):
    return result(typed.component_noise(fields.grid(spark, sf_dir), ["field"], ["u", "v"]).select("field", "i", "j", "u", "v"))


_TURNED = "SELECT field, j AS i, max(i) OVER (PARTITION BY field) - i AS j, value, seen FROM grid"


@query(with_ctes(CTES, "cells grid", f", t AS ({_TURNED}), a AS ({fields.coherence_cte('grid', 'value')}), b AS ({fields.coherence_cte('t', 'value')}) SELECT a.field, 'neighbour_coherence' AS channel, {r('a.coherence', 'score')}, {r('b.coherence', 'turned')}, CASE WHEN abs(abs(a.coherence) - abs(b.coherence)) <= 1e-9 * greatest(1.0, abs(a.coherence)) THEN 'PASS' ELSE 'DISAGREEMENT' END AS status FROM a JOIN b ON a.field = b.field"))
def pe14_representation_check(spark, sf_dir):
    """Neighbour coherence of scalar fields before and after a quarter turn."""
    return result(typed.representation_check("scalar_field_2d", fields.grid(spark, sf_dir), ["field"]).where("channel = 'neighbour_coherence'"))


@query()
def ag63_fragility(spark, sf_dir):
    return result(typed.fragility(fields.grid(spark, sf_dir), ["field"]))
