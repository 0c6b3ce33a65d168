"""Operators against hand-made cases, and a sample of the queries against DuckDB."""

import io
import math
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from gneiss import queries as core
from gneiss.functions.robust import binomial_upper, holm
from gneiss.operators import audit, blocks, dynamics, endpoints, geometry, ladder, nulls, panel
from gneiss.sources.documents import bundle_bytes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for t in compare.TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["ag12_block_means", "ag20_condition_surface", "ag24_joint_parent_null", "ag37_series_metrics", "ag8_closure_score", "ge2_vector_scores", "ge20_line_porosity", "j9_manifest_audit", "nu10_stationary_bootstrap", "si1_escape_time"])
def test_query_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    found = duck.sql(core.oracle_sql()[name])
    assert compare.digest(df.columns, [tuple(x) for x in df.collect()]) == compare.digest(found.columns, found.fetchall())


def test_every_query_has_sql_or_a_reason():
    without = set(core.queries()) - set(core.oracle_sql())
    assert without <= core.ROWS_ONLY


def test_exact_sign_test(spark):
    rows = spark.range(0, 13).select("id", binomial_upper(F.col("id"), F.lit(12)).alias("p")).collect()
    for row in rows:
        assert row.p == pytest.approx(sum(math.comb(12, k) for k in range(row.id, 13)) / 4096, abs=1e-15)


def test_holm_keeps_nulls_and_order(spark):
    rows = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03), (1, "d", None)], "f int, k string, p double")
    got = {r.k: r.holm_p for r in holm(rows, ["f"], "p", "k").collect()}
    assert got == {"a": pytest.approx(0.03), "c": pytest.approx(0.06), "b": pytest.approx(0.06), "d": None}


def test_nulls_keep_month_multisets(spark):
    days = spark.sql("select 1L parent, id day_idx, date_add(date'2020-01-01', cast(id as int)) day, cast(id as double) value from range(90)")
    children = nulls.month_strata_nulls(days, 3)
    for child in (1, 2, 3):
        rows = children.where(F.col("child") == child).join(days.select("day_idx", "day"), "day_idx").groupBy(F.month("day")).agg(F.sum("value").alias("s"), F.count_distinct("value").alias("n")).collect()
        want = days.groupBy(F.month("day")).agg(F.sum("value").alias("s"), F.count_distinct("value").alias("n")).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, want))


def test_closure_prefers_the_period(spark):
    series = spark.sql("select 1 k, id day_idx, cast(id % 9 as double) value from range(1800)")
    errors = blocks.closure_error(series, ["k"], [7, 8, 9, 10])
    assert blocks.closure_winner(errors, ["k"]).first().winner == 9


def test_short_series_have_no_persistence(spark):
    series = spark.sql("select 1 k, id day_idx, cast(id as double) value from range(60)")
    assert blocks.block_persistence(series, ["k"], [7]).first().score is None


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "parent long, day date, reading double")
    assert panel.canonical(panel.densify(panel.daily_log_medians(empty))).count() == 0


def test_rotation_keeps_curl(spark):
    rows = [(1, i, j, float(-(i - 3)), float(j - 3), True) for i in range(7) for j in range(7)]
    field = spark.createDataFrame(rows, "field int, i long, j long, u double, v double, seen boolean")
    before, after = geometry.vector_scores(field, ["field"]).first(), geometry.vector_scores(geometry.rotate_90(field, ["field"]), ["field"]).first()
    assert before.curl_energy == pytest.approx(after.curl_energy) == pytest.approx(4.0)
    assert before.divergence_energy == pytest.approx(after.divergence_energy, abs=1e-12)


def test_downsample_ignores_hidden_cells(spark):
    rows = [(1, k // 4, k % 4, float(k), k != 0) for k in range(16)]
    field = spark.createDataFrame(rows, "field int, i long, j long, value double, seen boolean")
    got = {(r.i, r.j): r.value for r in geometry.downsample(field, ["field"], 2).collect()}
    assert got[(0, 0)] == pytest.approx(10 / 3) and got[(1, 1)] == pytest.approx(12.5)


def test_winding_of_a_ring(spark):
    ring = [(1, k, math.cos(2 * math.pi * k / 32), math.sin(2 * math.pi * k / 32)) for k in range(32)] + [(2, k, math.cos(2 * math.pi * k / 32), -math.sin(2 * math.pi * k / 32)) for k in range(32)]
    got = {r.path: r.winding for r in geometry.winding(spark.createDataFrame(ring, "path int, pos int, x double, y double"), ["path"]).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(-1.0)}


def test_path_order_rejects_branches(spark):
    edges = spark.createDataFrame([(1, 3, 1), (1, 1, 2), (2, 1, 2), (2, 2, 3), (2, 2, 4)], "path int, a long, b long")
    assert [(r.path, r.pos, r.node) for r in geometry.path_order(edges).orderBy("path", "pos").collect()] == [(1, 0, 2), (1, 1, 1), (1, 2, 3)]


def test_contiguous_runs(spark):
    rows = spark.createDataFrame([(1, n, n in (7, 8, 11)) for n in range(6, 13)], "k int, n int, ok boolean")
    assert sorted((r.first, r.last, r["size"]) for r in endpoints.contiguous_runs(rows, ["k"], "n", "ok").collect()) == [(7, 8, 2), (11, 11, 1)]


def test_escape_time_of_known_points(spark):
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (-1.0, 0.0)], "re double, im double")
    assert [(r.escaped, r.steps) for r in dynamics.escape_time(points, most=20).collect()] == [(False, 20), (True, 2), (False, 20)]


def test_harmonic_ties_go_to_the_higher(spark):
    rows = spark.createDataFrame([("a", k + 1, 1.0 if k == 0 else 0.0) for k in range(8)], "ladder string, pos int, value double")
    assert ladder.harmonic_winner(rows, ["ladder"]).first().winner == 4


def test_trials_are_repeatable(spark):
    ladders = spark.createDataFrame([("a", [1.0 + 0.1 * k for k in range(14)])], "ladder string, omega array<double>")
    settings = dynamics.Trial(centre=2, window=(2, 9), p_swap=0.2)
    first = sorted(dynamics.simulate_trials(ladders, 6, settings).collect())
    assert first == sorted(dynamics.simulate_trials(ladders.repartition(3), 6, settings).collect()) and len(first) == 6


def test_preflight_codes(spark):
    rows = spark.createDataFrame([("a/../b", 1, 1), ("ok", 10, 1), ("ok", 10, 1), ("big", 1000, 1), ("C:x", 1, 1)], "path string, bytes long, packed long")
    codes = {(r.code, r.detail) for r in audit.preflight(rows, {"files": 4, "member": 500, "total": 100, "ratio": 200}).collect()}
    assert codes == {("PATH_UNSAFE", "a/../b"), ("PATH_UNSAFE", "C:x"), ("MEMBER_DUPLICATE", "ok"), ("MEMBER_TOO_LARGE", "big"), ("RATIO_TOO_HIGH", "big"), ("TOO_MANY_FILES", ""), ("TOTAL_TOO_LARGE", "")}


def test_bundles_are_repeatable_bytes():
    one = bundle_bytes({"b": b"2", "a": b"1"})
    assert one == bundle_bytes({"a": b"1", "b": b"2"})
    assert zipfile.ZipFile(io.BytesIO(one)).namelist() == ["a", "b", "manifest.json"]


def test_block_means_of_gaps_and_missing_values(spark):
    """Rows that lack days, null values and a phase, against a plain loop."""
    import random

    rng = random.Random(8)
    rows = [(p, d, None if rng.random() < 0.1 else rng.uniform(-5, 5)) for p in (1, 2) for d in range(120) if rng.random() < 0.97]
    days = spark.createDataFrame(rows, "parent long, day_idx long, value double")
    for phase in (0, 4):
        got = {(r.parent, r.n, r.block): r.value for r in blocks.block_means(days, ["parent"], [1, 5, 7], phase=phase).collect()}
        want = {}
        for p in (1, 2):
            values = {d: v for q, d, v in rows if q == p and d >= phase}
            for n in (1, 5, 7):
                for b in range(120 // n):
                    span = [phase + b * n + k for k in range(n)]
                    if all(d in values for d in span):
                        seen = [values[d] for d in span if values[d] is not None]
                        want[p, n, b] = sum(seen) / len(seen) if len(seen) >= math.ceil(0.8 * n) else None
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
