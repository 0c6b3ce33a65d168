"""Typed geometries, graphs, paths and ladders against plain loops and NumPy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import audit, geometry, ladder, nulls, reports, spectral, typed


def coherence(values, mask):
    centred = values - values[mask].mean()
    variance = (centred[mask] ** 2).mean()
    products = [*(centred[:, :-1] * centred[:, 1:])[mask[:, :-1] & mask[:, 1:]], *(centred[:-1] * centred[1:])[mask[:-1] & mask[1:]]]
    return float(np.mean(products) / variance) if products and variance > 1e-15 else 0.0


def concentration(values, mask):
    centred = np.where(mask, values - values[mask].mean(), 0.0)
    power = np.abs(np.fft.fft2(centred)) ** 2
    power.flat[0] = 0
    ordered = np.sort(power.ravel())
    return float(ordered[-max(1, int(np.ceil(0.05 * power.size))):].sum() / ordered.sum())


def rows_of(arrays, mask):
    return [(int(k), int(i), int(j), *(float(a[k, i, j]) for a in arrays), bool(mask[k, i, j])) for k, i, j in np.ndindex(mask.shape)]


def test_volumes_equal_numpy(spark):
    rng = np.random.default_rng(4)
    u, v, w = rng.normal(size=(3, 4, 6, 5))
    mask = rng.random((4, 6, 5)) > 0.15
    frame = spark.createDataFrame(rows_of([u, v, w, u], mask), "k long, i long, j long, u double, v double, w double, value double, seen boolean").withColumn("volume", F.lit(1))
    got = typed.volume_scores(frame, ["volume"]).first()
    means = np.array([u[k][mask[k]].mean() for k in range(4)])
    assert got.median_slice_neighbour_coherence == pytest.approx(np.median([coherence(u[k], mask[k]) for k in range(4)]))
    assert got.median_slice_spectral_concentration == pytest.approx(np.median([concentration(u[k], mask[k]) for k in range(4)]))
    assert got.lag1_slice_mean == pytest.approx(np.corrcoef(means[:-1], means[1:])[0, 1])
    zero = [np.where(mask, x, 0.0) for x in (u, v, w)]
    (uk, ui, uj), (vk, vi, vj), (wk, wi, wj) = (np.gradient(x) for x in zero)
    curl = np.stack([wi - vk, uk - wj, vj - ui])[:, mask]
    got = typed.vector_volume_scores(frame, ["volume"]).first()
    assert got.curl_energy_3d == pytest.approx((curl**2).sum(0).mean()) and got.divergence_energy_3d == pytest.approx(((uj + vi + wk)[mask] ** 2).mean())
    assert got.curl_coherence_3d == pytest.approx((curl.mean(1) ** 2).sum() / (curl**2).sum(0).mean())
    assert got.w_volume_neighbour_coherence == pytest.approx(np.median([coherence(zero[2][k], mask[k]) for k in range(4)]))


def test_fragility_equals_numpy(spark):
    rng = np.random.default_rng(6)
    field = np.cumsum(rng.normal(size=(8, 10)), axis=1)
    grid = spark.createDataFrame([(1, int(i), int(j), float(field[i, j]), True) for i, j in np.ndindex(field.shape)], "field long, i long, j long, value double, seen boolean")
    variants = {}
    for r in typed.field_variants(grid, ["field"]).collect():
        variants.setdefault(r.variant, {})[(r.i, r.j)] = r.value
    arrays = {}
    for name, cells in variants.items():
        array = np.full((1 + max(i for i, _ in cells), 1 + max(j for _, j in cells)), np.nan)
        for at, x in cells.items():
            array[at] = x
        arrays[name] = array
    assert all(np.isfinite(a).all() for a in arrays.values()) and arrays["baseline"].tolist() == field.tolist()
    assert sorted(arrays["coordinate_or_edge_shuffle"].ravel()) == sorted(field.ravel()) and np.array_equal(arrays["orientation_rotation"], np.rot90(field, -1))
    assert np.array_equal(arrays["resolution_reduction"], field[::2, ::2].repeat(2, 0).repeat(2, 1)[:8, :10]) and (arrays["mask_dropout"] != field).sum() == 8
    scores = lambda a: (coherence(a, np.ones(a.shape, bool)), concentration(a, np.ones(a.shape, bool)))
    base = scores(field)
    want = {n: np.median([abs(x - b) / max(abs(b), 0.05) for x, b in zip(scores(a), base)]) for n, a in arrays.items() if n != "baseline"}
    got = {r.variant: r for r in typed.fragility(grid, ["field"]).collect()}
    assert {n: got[n].distance for n in got} == pytest.approx(want)
    assert got["mask_dropout"].supported == (want["coordinate_or_edge_shuffle"] > max(want["measurement_noise"], want["orientation_rotation"]))


def small(spark):
    cells = [(f, k, i, j, float(f * 7 + k * 5 + i * 3 + j), float(i), float(j), (i + j + k) % 4 != 0) for f in range(2) for k in range(3) for i in range(4) for j in range(3)]
    volume = spark.createDataFrame(cells, "field long, k long, i long, j long, value double, u double, v double, seen boolean").withColumn("w", F.col("u") - F.col("v"))
    edges = spark.createDataFrame([(a, b, float(a * 10 + b)) for a in range(6) for b in range(6) if a < b and (a + b) % 3], "src long, dst long, w double")
    points = spark.createDataFrame([(k, float(k % 5), float(k * k % 7), float(k)) for k in range(20)], "id long, x double, y double, value double")
    return {"scalar_field_2d": (volume.where("k = 0"), ["field"]), "vector_field_2d": (volume.where("k = 0"), ["field"]), "scalar_volume_3d": (volume, ["field"]), "vector_volume_3d": (volume, ["field"]),
            "spatiotemporal_scalar": (volume, ["field"]), "spatiotemporal_vector": (volume, ["field"]), "multicomponent_single_system": (volume.where("k = 0"), ["field"]), "coupled_multi_system": (volume.where("k = 0"), ["field"]),
            "weighted_graph": (edges, []), "directed_graph": (edges.union(edges.selectExpr("dst", "src", "w + 1")), []), "irregular_point_field": (points, []), "manifold_point_cloud": (points, []),
            "correlation": (spark.createDataFrame([(a, b, 1.0 if a == b else 0.1 * (a + b)) for a in range(4) for b in range(4)], "left long, right long, r double"), [])}


def test_every_kind_has_scores_nulls_and_checks(spark):
    geometries = small(spark)
    assert set(geometries) == set(typed.PROJECTIONS) == set(typed.NULLS)
    for kind, (rows, keys) in geometries.items():
        scores = typed.typed_scores(kind, rows, keys).collect()
        assert scores and all(r.score is not None for r in scores), kind
        children = typed.typed_null(kind, rows, keys, 2)
        assert {r.child for r in children.select("child").distinct().collect()} == {1, 2}, kind
        value = next(c for c in ("w", "r", "value", "u") if c in children.columns)
        seen = rows.where("seen") if "seen" in rows.columns else rows
        for child in (1, 2):
            assert sorted(r[0] for r in children.where(F.col("child") == child).select(value).collect()) == sorted(r[0] for r in seen.select(value).collect()), kind
        checked = typed.representation_check(kind, rows, keys).collect()
        if kind not in ("vector_field_2d", "multicomponent_single_system", "coupled_multi_system") and kind in typed.TURNS:
            assert all(r.status == "PASS" for r in checked), (kind, checked)
        if kind not in typed.TURNS:
            assert {r.status for r in checked} == {"NOT_APPLICABLE"}
    for call in (typed.typed_scores, lambda k, r, keys: typed.typed_null(k, r, keys, 1)):
        with pytest.raises(ValueError, match="registered"):
            call("sphere", geometries["scalar_field_2d"][0], ["field"])


def test_paths_of_any_length_and_circles(spark):
    long = list(range(300))
    random.Random(1).shuffle(long)
    links = [(1, a, b) for a, b in zip(long, long[1:])] + [(2, 5, 6)] + [(3, 1, 2), (3, 2, 3), (3, 3, 1)] + [(4, 1, 2), (4, 2, 3), (4, 7, 8), (4, 8, 9), (4, 9, 7)]
    got = {}
    for r in geometry.path_order(spark.createDataFrame(links, "path long, a long, b long")).collect():
        got.setdefault(r.path, {})[r.pos] = r.node
    want = long if long[0] < long[-1] else long[::-1]
    assert got == {1: dict(enumerate(want)), 2: {0: 5, 1: 6}, 4: {0: 1, 1: 2, 2: 3}}


def test_cycles_and_triangles_equal_plain_loops(spark):
    rng = random.Random(7)
    edges = [(a, b, rng.uniform(-1, 1)) for a in range(9) for b in range(9) if rng.random() < 0.5] + [(0, k, 0.5) for k in range(9)]
    matrix = np.zeros((9, 9))
    for a, b, w in edges:
        matrix[a, b] += w
    got = geometry.graph_scores(spark.createDataFrame(edges, "src long, dst long, w double")).first()
    assert got.three_cycles == pytest.approx(np.trace(matrix @ matrix @ matrix))
    pairs = sorted({(min(a, b), max(a, b)) for a, b, _ in edges if a != b})
    count = sum((a, b) in pairs and (b, c) in pairs and (a, c) in pairs for a, b, c in itertools.combinations(range(9), 3))
    assert geometry.triangles(spark.createDataFrame(pairs, "i long, j long")).first().triangles == count


@pytest.mark.parametrize("m", [0, 3, 20, 44, 45])
def test_rewired_graphs_of_any_density(spark, m):
    nodes = spark.range(10).select((F.col("id") * 3).alias("node"))
    edges = spark.range(m).select("id")
    got = [(r.i, r.j) for r in nulls.rewired(edges, nodes).collect()]
    assert len(got) == len(set(got)) == m and all(a < b and a % 3 == b % 3 == 0 and b <= 27 for a, b in got)


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x")).repartition(7)
    got = audit.numbered(rows, [F.col("x")], "place", first=0).collect()
    assert len(got) == 5000 and all(r.place == r.x for r in got)
    assert audit.numbered(rows.limit(0), [F.col("x")]).count() == 0


def test_nearest_points_however_far(spark):
    rng = random.Random(3)
    points = [(k, rng.uniform(0, 1), rng.uniform(0, 1)) for k in range(60)] + [(100, 500.0, 500.0), (101, -2000.0, 3.0)]
    got = {r.id: r.other for r in geometry.all_nearest_points(spark.createDataFrame(points, "id long, x double, y double"), cell=0.1).collect()}
    want = {k: min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 * 1e9 // 1 * 1e3 + o / 1e3 for o, a, b in points if o != k) for k, x, y in points}
    assert all(got[k] == min((o for o, _, _ in points if o != k), key=lambda o: ((points_at(points, k)[0] - points_at(points, o)[0]) ** 2 + (points_at(points, k)[1] - points_at(points, o)[1]) ** 2, o)) for k in want)
    assert geometry.all_nearest_points(spark.createDataFrame(points[:1], "id long, x double, y double"), cell=0.1).first().other is None


def points_at(points, k):
    return next((x, y) for o, x, y in points if o == k)


@pytest.mark.parametrize("size", [3, 64])
def test_nearest_points_of_clusters_copies_and_odd_values(spark, size):
    rng, inf, nan = random.Random(5), float("inf"), float("nan")
    places = [(rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for _ in range(150)] + [(rng.uniform(-9, 9), rng.choice([-1.0, 0.0, 2.0])) for _ in range(80)] + [(float(a), float(b)) for a in range(6) for b in range(6)]
    places += [(1e30, -3.0), (2e30, -3.0), (None, 1.0), (2.0, None), (nan, 0.0), (inf, 1.0), (inf, 2.0), (-inf, inf), (0.5, -inf)] + [(0.25, -0.0)] * 40 + [(0.25, 0.0)] * 9
    rng.shuffle(places)
    points = [(k * 3 + 1, *p) for k, p in enumerate(places)]

    def key(a, b):
        if None in (*a[1:], *b[1:]):
            return 2, 0.0, b[0]
        d = math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
        return (1, 0.0, b[0]) if math.isnan(d) else (0, d, b[0])

    got = {r.id: r for r in geometry.all_nearest_points(spark.createDataFrame([*points, (None, 0.0, 0.0)], "id long, x double, y double"), size=size).collect()}
    assert len(got) == len(points)
    for p in points:
        odd, distance, other = min(key(p, q) for q in points if q is not p)
        assert got[p[0]].other == other
        assert got[p[0]].distance is None if odd == 2 else math.isnan(got[p[0]].distance) if odd else got[p[0]].distance == distance
    two = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5)], "id long, x double, y double")
    assert {(r.id, r.other, r.distance) for r in geometry.all_nearest_points(two).collect()} == {(1, 2, 0.0), (2, 1, 0.0)}
    assert geometry.all_nearest_points(two.limit(0)).count() == 0


def test_ladder_points_equal_a_plain_loop(spark):
    rng = random.Random(5)
    ladders = [[rng.uniform(1, 9) for _ in range(n)] for n in (1, 4, 9, 20)]
    rows = [(n, x, y, x / 3, y / 2, base, 0.3, 0.1) for n, base in enumerate(ladders) for x in range(4) for y in range(3)] + [(9, 0, 0, 0.5, 0.5, [], 0.3, 0.1), (10, 0, 0, 0.5, 0.5, [1.0, 2.0], None, None)]
    frame = spark.createDataFrame(rows, "n long, x long, y long, mutation double, anchoring double, base array<double>, null_mean double, null_deviation double")
    got = {(r.n, r.x, r.y): r for r in spectral.ladder_points(frame).collect()}
    assert (got[9, 0, 0].classification, got[9, 0, 0].failure) == ("UNRESOLVED", "EMPTY_LADDER") and got[10, 0, 0].failure == "NO_NULL_COHERENCE"
    for n, x, y, mutation, anchoring, base, mean, deviation in rows[:48]:
        parent = np.array(base)
        near = lambda v: float(np.exp(-np.sqrt(((v - parent) ** 2).mean()) / max(parent.std(), 1e-9)))
        stream, v = random.Random(1407 + x * 73_856_093 + y * 19_349_663), parent.copy()
        for _ in range(round(mutation * len(v) * 1.5)):
            a, b = stream.randrange(len(v)), stream.randrange(len(v))
            v[a], v[b] = v[b], v[a]
        escaped, flags, back = near(v) < 0.6, [], None
        for step in range(13):
            spread = v.max() - v.min()
            c = 0.0 if len(v) < 2 else 1.0 if spread == 0 else min(1.0, max(0.0, 1 - np.abs(np.roll(v, -1) - v).mean() / (1.25 * spread)))
            flags.append(c - mean >= 0.08 and (c - mean) / deviation >= 1)
            if escaped and back is None and near(v) >= 0.78:
                back = step
            last = near(v)
            v = 0.58 * v + 0.42 * ((1 - anchoring) * (np.roll(v, 1) + 2 * v + np.roll(v, -1)) / 4 + anchoring * parent)
        r = got[n, x, y]
        assert r.recovery_step == back and r.t_e == (flags.index(True) if True in flags else None)
        assert r.coherence == pytest.approx(c, abs=1e-8) and r.similarity == pytest.approx(last, abs=1e-8)
        assert (r.classification == "RECOVERED") == (escaped and back is not None)


def test_traces_that_are_flat_or_tied(spark):
    parents = spark.createDataFrame([(p, n, 1.0) for p in range(3) for n in range(2, 9)], "parent long, n long, value double")
    joint = spark.createDataFrame([(k, n, 1.0 + 0.1 * ((n * k) % 3)) for k in range(1, 6) for n in range(2, 9)], "replicate long, n long, value double")
    assert reports.curvature_audit(parents, joint, samples=5).first().status == "REJECTED_FLAT_OR_TIED_TRACE"
    two = parents.withColumn("value", F.when(F.col("n").isin(4, 6), 8.0).when(F.col("n") == 5, 2.0).otherwise(F.col("n") % 2 + 1.0))
    got = reports.curvature_audit(two, joint, samples=5).first()
    assert got.status == "REJECTED_TIED_ELBOW" and got.elbow is None and got.bootstrap_stability is None
    one = parents.withColumn("value", F.when(F.col("n") == 5, 3.0).otherwise(F.col("n") / 100 + 1))
    got = reports.curvature_audit(one, joint, samples=5).first()
    assert (got.status, got.elbow, got.bootstrap_stability) == ("COMPUTED_INTERIOR_ONLY", 5, 1.0)


def test_array_ladders_equal_rows(spark):
    rng = random.Random(2)
    rows = [(k, p, rng.uniform(0, 5)) for k, n in ((1, 1), (2, 2), (3, 7)) for p in range(1, n + 1)]
    frame = spark.createDataFrame(rows, "ladder long, pos long, value double")
    arrays = frame.groupBy("ladder").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
    a = {r.ladder: r.c for r in arrays.select("ladder", ladder.array_coherence(F.col("v")).alias("c")).collect()}
    assert a == pytest.approx({r.ladder: r.coherence for r in ladder.cyclic_coherence(frame, ["ladder"]).collect()})
