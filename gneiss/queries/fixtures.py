"""Queries over registered synthetic geometries, which read no table, and benchmarks of ladders, which do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import fixtures
from gneiss.plans.storage import stored
from gneiss.queries import ladders
from gneiss.queries.common import Registry, r, result, with_ctes
from gneiss.queries.typed import _normal_sql

REGISTRY = Registry()
query = REGISTRY.add
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
PARENTS, CHILDREN = 20, 31
_LAST = fixtures.SIZE - 1


def _family_sql(name: str) -> str:
    family = fixtures.FAMILIES[name]
    d = family.depth
    z = f"2.0 * k / {d - 1} - 1.0" if d > 1 else "0.0"
    noise = "".join(f", {_normal_sql(repr(name), repr(c), 'parent', 'k', 'i', 'j')} AS n_{c}" for c in family.fields)
    grid = f"SELECT *, 2.0 * j / {_LAST} - 1.0 AS x, 2.0 * i / {_LAST} - 1.0 AS y, {z} AS z, k / {max(1, d - 1)}::DOUBLE AS t FROM (SELECT unnest(range(0, {PARENTS})) AS parent), (SELECT unnest(range(0, {d})) AS k), (SELECT unnest(range(0, {fixtures.SIZE})) AS i), (SELECT unnest(range(0, {fixtures.SIZE})) AS j)"
    rows = f"SELECT *, {_normal_sql(repr(name), repr('parent'), 'parent')} AS m{noise} FROM ({grid})"
    return " UNION ALL ".join(f"SELECT '{name}' AS family, parent, '{c}' AS component, count(*) FILTER (WHERE {family.seen}) AS seen, {r(f'avg(({e}) * (i + 1) / (j + k + 1))', 'moment')} FROM ({rows}) GROUP BY parent" for c, e in family.fields.items())


@query(" UNION ALL ".join(_family_sql(name) for name in fixtures.FAMILIES))
def si10_field_families(spark, sf_dir):
    """All registered families of fields with all parents, as a moment of each component that depends on the places."""
    parts = []
    for name, family in fixtures.FAMILIES.items():
        rows = fixtures.field_family(spark, name, PARENTS).unpivot(["parent", "k", "i", "j", "seen"], list(family.fields), "component", "value")
        parts.append(rows.groupBy("parent", "component").agg(F.count_if("seen").alias("seen"), F.avg(F.col("value") * (F.col("i") + 1) / (F.col("j") + F.col("k") + 1)).alias("moment")).select(F.lit(name).alias("family"), "parent", "component", "seen", "moment"))
    return result(reduce(DataFrame.union, parts))


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS fixture, '{c}' AS component, i, j, {r(f'CAST({e} AS DOUBLE)', 'value')} FROM (SELECT i, j, 2.0 * j / {_LAST} - 1.0 AS x, 2.0 * i / {_LAST} - 1.0 AS y FROM (SELECT unnest(range(0, {fixtures.SIZE})) AS i), (SELECT unnest(range(0, {fixtures.SIZE})) AS j))"
    for name, components in fixtures.FIXTURES.items() for c, e in components.items()))
def si9_field_fixtures(spark, sf_dir):
    parts = [fixtures.fixture(spark, name).unpivot(["i", "j"], list(components), "component", "value").select(F.lit(name).alias("fixture"), "component", "i", "j", "value") for name, components in fixtures.FIXTURES.items()]
    return result(reduce(DataFrame.union, parts))


@query()
def si11_suite(spark, sf_dir):
    """Every family of fields: 20 parents, 31 null children of each, detections and their rates."""
    return result(fixtures.suite_summary(stored(fixtures.suite(spark, list(fixtures.FAMILIES), PARENTS, CHILDREN), "suite")))


_WINNER = "SELECT {k}, n AS winner FROM (SELECT {k}, n, row_number() OVER (PARTITION BY {k} ORDER BY abs(chi - 2 * pi() / n), n) AS place FROM {source}, (SELECT unnest(range(2, 31)) AS n)) WHERE place = 1"


@query(with_ctes(ladders.CTES, "ladders omegas", f""", kids AS (SELECT unnest(range(1, 65)) AS child),
p AS (SELECT t.ladder, t.child, t.pos, s.omega FROM (SELECT ladder, child, pos, row_number() OVER (PARTITION BY ladder, child ORDER BY pos) AS k FROM omegas, kids) t JOIN (SELECT ladder, child, omega, row_number() OVER (PARTITION BY ladder, child ORDER BY md5(concat_ws('|', 'benchmark', CAST(child AS VARCHAR), ladder, CAST(pos AS VARCHAR))), pos) AS k FROM omegas, kids) s ON t.ladder = s.ladder AND t.child = s.child AND t.k = s.k),
q AS (SELECT ladder, child, pos, omega + 0.5 * sigma_omega * {_normal_sql("'benchmark'", 'child', 'ladder', 'pos')} AS omega FROM omegas, kids),
c AS (SELECT ladder, sum(omega / pos) AS chi FROM omegas GROUP BY 1), cp AS (SELECT ladder, child, sum(omega / pos) AS chi FROM p GROUP BY 1, 2), cq AS (SELECT ladder, child, sum(omega / pos) AS chi FROM q GROUP BY 1, 2),
w AS ({_WINNER.format(k='ladder', source='c')}), wp AS ({_WINNER.format(k='ladder, child', source='cp')}), wq AS ({_WINNER.format(k='ladder, child', source='cq')})
SELECT w.ladder, w.winner, (SELECT round(avg(CAST(wp.winner = w.winner AS DOUBLE)), 6) + 0.0 FROM wp WHERE wp.ladder = w.ladder) AS permuted_share, (SELECT round(avg(CAST(wq.winner = w.winner AS DOUBLE)), 6) + 0.0 FROM wq WHERE wq.ladder = w.ladder) AS noisy_share FROM w"""))
def si13_order_benchmark(spark, sf_dir):
    return result(fixtures.order_benchmark(ladders.omegas(spark, sf_dir), (2, 30)))


@query()
def si14_threshold_calibration(spark, sf_dir):
    """Surfaces of the negative and the positive calibration series at the registered size."""
    return result(fixtures.calibrated(spark, positive=False).union(fixtures.calibrated(spark, positive=True)))
