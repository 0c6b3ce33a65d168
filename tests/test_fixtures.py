"""Registered synthetic geometries against what they are meant to be."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import fixtures, geometry, ladder, nulls, rasters, spectral, typed


def test_suites_find_what_is_there(spark):
    rows = fixtures.suite(spark, ["N01", "P01", "P03", "A04"], parents=3, children=19)
    got = {}
    for r in rows.collect():
        got.setdefault(r.family, []).append(r)
    assert all(len(x) == 3 for x in got.values())
    assert all(r.detected and r.upper_p == pytest.approx(0.05) for f in ("P01", "P03", "A04") for r in got[f]) and not all(r.detected for r in got["N01"])
    assert all(r.status == "PASS" for x in got.values() for r in x)
    summary = {r.family: r for r in fixtures.suite_summary(rows).collect()}
    assert summary["P01"].successes == 3 and summary["P01"].disagreements == 0 and summary["P01"].wilson_high == pytest.approx(1.0)


def test_families_have_their_shapes(spark):
    for name, family in fixtures.FAMILIES.items():
        rows = fixtures.field_family(spark, name, 1)
        assert rows.count() == family.depth * fixtures.SIZE**2 and rows.dropna().count() == rows.count(), name
    masked = fixtures.field_family(spark, "N11", 1).where("seen")
    assert masked.count() == (fixtures.SIZE - 6) ** 2


def test_graphs_points_and_correlations(spark):
    def matrix(name):
        rows = fixtures.OTHERS[name](spark, 2).where("parent = 1").collect()
        out = np.zeros((fixtures.NODES, fixtures.NODES))
        for r in rows:
            out[r.src, r.dst] = r.w
        return out

    acyclic, cycle, community, random_ = (matrix(n) for n in ("directed_acyclic", "directed_cycle", "weighted_community", "weighted_random"))
    assert np.trace(np.linalg.matrix_power(acyclic, 3)) == 0 and (np.tril(acyclic) == 0).all() and acyclic.any()
    assert (cycle > 0).sum() == 2 * fixtures.NODES and np.allclose(community, community.T) and np.allclose(random_, random_.T)
    assert community[0, 1] > 0.7 > 0.3 > community[0, 11] and 0 < (random_ > 0).mean() < 0.5
    ring = fixtures.ring_coherence(fixtures.OTHERS["ordered_ring"](spark, 3), ["parent"]).collect()
    disk = fixtures.ring_coherence(fixtures.OTHERS["unordered_disk"](spark, 3), ["parent"]).collect()
    assert len(ring) == len(disk) == 3 and min(r.score for r in ring) > 0.9 > 0.5 > max(r.score for r in disk)
    for factor in (False, True):
        rows = fixtures.correlation_family(spark, 2, factor=factor)
        r = np.array([x.r for x in rows.where("parent = 0").orderBy("left", "right").collect()]).reshape(fixtures.SERIES, -1)
        off = r[~np.eye(fixtures.SERIES, dtype=bool)]
        assert np.allclose(np.diag(r), 1) and (off.mean() > 0.7 if factor else abs(off.mean()) < 0.1)
    points = fixtures.OTHERS["irregular_gradient"](spark, 1).select(F.col("pos").alias("id"), "x", "y", "value")
    assert geometry.point_scores(points, geometry.all_nearest_points(points, cell=0.2)).first().neighbour_coherence > 0.6


def test_phases_change_and_amplitudes_stay(spark):
    rows = fixtures.phase_randomized(spark, 2).collect()
    fields = np.zeros((2, fixtures.SIZE, fixtures.SIZE))
    for r in rows:
        fields[r.parent, r.i, r.j] = r.value
    y, x = np.mgrid[-1.0 : 1.0 : complex(fixtures.SIZE), -1.0 : 1.0 : complex(fixtures.SIZE)]
    base = np.sin(4 * np.pi * x) + 0.7 * np.cos(3 * np.pi * y)
    inner = np.s_[1:, 1 : fixtures.SIZE // 2]  # the other frequencies' phases are bound to be real
    assert np.allclose(np.abs(np.fft.rfft2(fields[0]))[inner], np.abs(np.fft.rfft2(base))[inner], atol=1e-6)
    assert not np.allclose(fields[0], fields[1]) and not np.allclose(fields[0], base)


def test_fixtures_without_noise(spark):
    ring = {(r.i, r.j): r.value for r in fixtures.fixture(spark, "checkerboard").collect()}
    assert ring[0, 0] == 1.0 and ring[0, 1] == -1.0 and len(ring) == fixtures.SIZE**2
    grid = fixtures.fixture(spark, "anisotropic_wave").withColumn("seen", F.lit(True)).withColumn("field", F.lit(1))
    turned = fixtures.fixture(spark, "rotated_wave").withColumn("seen", F.lit(True)).withColumn("field", F.lit(1))
    a, b = (typed.scalar_scores(g, ["field"]).first() for g in (grid, turned))
    assert a.neighbour_coherence == pytest.approx(b.neighbour_coherence) and a.spectral_concentration == pytest.approx(b.spectral_concentration)


def test_calibration_separates_the_positive_series_alone(spark):
    months = fixtures.calibration_series(spark, 2, 120, positive=True).groupBy("parent", F.trunc("day", "month")).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and r.s == pytest.approx(1) for r in months)
    for positive in (False, True):
        surface = fixtures.calibrated(spark, positive=positive, parents=10, days=730, children=39, sizes=(6, 7)).collect()
        assert any(r.sep for r in surface) == positive


def test_rasters_beyond_a_task_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(spectral, "CELLS", 10)
    with pytest.raises(ValueError, match="downsample"):
        spectral._checked(11)


def test_copies_of_ladders_in_arrays_and_by_windows(spark, monkeypatch):
    rows = [(name, pos, random.Random(f"{name}{pos}").uniform(-2, 2), 0.5 * (pos % 4)) for name, n in (("a", 40), ("b ü", 1), ("c", 300)) for pos in range(2, 3 * n, 3 if n > 1 else 1)]
    ladders = spark.createDataFrame([*rows, ("c", 1, None, 0.1), (None, 1, 1.0, 1.0)], "ladder string, pos long, omega double, sigma double")
    known, found = ladders.where("ladder is not null"), {}
    want = {"p": ladder.chi(nulls.permuted_within(known, ["ladder"], "pos", [F.lit(0)], 11, seed="s", value="omega"), ["ladder", "child"]),
            "n": ladder.chi(nulls.with_children(known, 11).withColumn("omega", F.col("omega") + F.col("sigma") * ladder.hash_normal("s", F.col("child"), F.col("ladder"), F.col("pos"))), ["ladder", "child"])}
    got = {"p": fixtures._copied_chis(known, 11, fixtures._permuted, "s"), "n": fixtures._copied_chis(known, 11, fixtures._noisy, "s")}
    for kind in want:
        found[kind] = {(r.ladder, r.child): r.chi for r in got[kind].collect()}
        expected = {(r.ladder, r.child): r.chi for r in want[kind].collect()}
        assert len(expected) == 33 and found[kind] == pytest.approx(expected, abs=1e-9)
    both = [fixtures.order_benchmark(ladders.withColumnRenamed("sigma", "sigma_omega"), (2, 30), permutations=9, noise=5).collect()]
    monkeypatch.setattr(fixtures, "ARRAY_LADDER", 50)
    both.append(fixtures.order_benchmark(ladders.withColumnRenamed("sigma", "sigma_omega"), (2, 30), permutations=9, noise=5).collect())
    assert sorted(both[0]) == sorted(both[1]) and len(both[0]) == 3


def test_single_channels_equal_all_scores(spark):
    seen = set()
    for name, family in fixtures.FAMILIES.items():
        if (family.kind, family.channel) in seen:
            continue
        seen.add((family.kind, family.channel))
        rows = fixtures.field_family(spark, name, 2)
        rows = (rows if family.depth > 1 else rows.drop("k")).withColumn("seen", F.expr("seen and (i + 2 * j) % 11 <> 3"))
        assert (family.kind, family.channel) in typed.CHANNELS
        one = {r.parent: r.score for r in typed.channel_score(family.kind, rows, ["parent"], family.channel).collect()}
        every = {r.parent: r.score for r in typed.projected(typed.typed_scores(family.kind, rows, ["parent"]), ["parent"], family.channel).collect()}
        assert len(one) == 2 and one == pytest.approx(every, abs=1e-12), name


def test_suites_exchange_cells_once_for_all_families(spark, monkeypatch):
    plans, stored = [], fixtures.stored
    monkeypatch.setattr(fixtures, "stored", lambda df, name: (plans.append(df), stored(df, name))[1])
    rows = fixtures.suite(spark, list(fixtures.FAMILIES), 1, 1)
    text = "".join(df._jdf.queryExecution().executedPlan().toString() for df in [*plans, rows])
    assert text.count("Exchange ") <= 4 and "Join" not in text  # all families at once filled a driver of 1 GB


def test_fields_in_arrays_equal_rows(spark):
    seen = set()
    for name, family in fixtures.FAMILIES.items():
        kind = (family.kind, family.channel, family.seen)
        if kind in seen:
            continue
        seen.add(kind)
        rows = fixtures.field_family(spark, name, 2)
        rows = rows if family.depth > 1 else rows.drop("k")
        parts = [typed.typed_null(family.kind, rows, ["parent"], 9, seed=name).withColumn("seen", F.lit(True)), rows.withColumn("child", F.lit(0).cast("long"))]
        if family.kind in typed.TURNS:
            parts.append(typed.TURNS[family.kind](rows, ["parent"]).select(*rows.columns).withColumn("child", F.lit(-1).cast("long")))
        every = parts[0].unionByName(parts[1]) if len(parts) < 3 else parts[0].unionByName(parts[1]).unionByName(parts[2])
        want = {(r.parent, r.child): r.score for r in typed.channel_score(family.kind, every, ["parent", "child"], family.channel).collect()}
        got = {(r.parent, r.child): r.score for r in fixtures._suite_scores(spark, [name], 2, 9).collect()}  # more children than a task makes
        assert len(got) == 2 * (10 + (family.kind in typed.TURNS)) and got == pytest.approx(want, abs=1e-12), name
        assert len({round(x, 9) for x in got.values()}) > 10, name
    assert {k[:2] for k in seen} == set(rasters.CHANNELS) == set(typed.CHANNELS)


def test_masked_fields_that_arrays_do_not_cover_are_an_error():
    seen = np.ones((1, 4, 4), bool)
    seen[0, 0, 0] = False
    with pytest.raises(ValueError, match="unobserved"):
        rasters.Field("vector_field_2d", "curl_energy", ("u", "v"), np.zeros((2, 1, 4, 4)), seen, 0, "s")
    with pytest.raises(ValueError, match="masked"):
        rasters.Field("scalar_field_2d", "spectral_concentration", ("value",), np.zeros((1, 1, 4, 4)), seen, 0, "s").score(np.zeros((1, 1, 4, 4)))
    with pytest.raises(ValueError, match="registered"):
        rasters.Field("scalar_field_2d", "no_such", ("value",), np.zeros((1, 1, 4, 4)), seen, 0, "s")
    half = rasters.Field("scalar_field_2d", "neighbour_coherence", ("value",), np.zeros((1, 1, 4, 4)), np.zeros((1, 4, 4), bool), 0, "s")
    assert half.score(half.child(1)) == 0.0
