"""Typed geometries: volumes, projection scores by kind, null geometries by kind, and checks under turns and noise.

Rows are those of ``geometry``: grids (keys, i, j, value or components, seen), volumes with a depth or time column ``k``,
graphs (src, dst, w), points (id, x, y, value), correlations (left, right, r).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import geometry, ladder, nulls, spectral
from gneiss.operators.geometry import EPS

TOLERANCE = 1e-9
#: Added to the seed's parts for each variant of ``fragility``.
NOISE, DROPPED = 0.05, 0.1


def scalar_scores(grid: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``neighbour_coherence`` and ``spectral_concentration`` of a 2-D scalar field."""
    rows = grid.withColumn("value", F.col(value))
    near = geometry.neighbour_coherence(rows, keys).withColumnRenamed("coherence", "neighbour_coherence")
    return near.join(spectral.spectral_concentration(rows, keys).withColumnRenamed("concentration", "spectral_concentration"), keys)


def volume_scores(volume: DataFrame, keys: list[str], depth: str = "k", *, prefix: str = "slice") -> DataFrame:
    """Medians over slices of both scalar scores, and the lag-1 correlation of the slices' observed means along the depth."""
    names = {"neighbour_coherence": f"median_{prefix}_neighbour_coherence", "spectral_concentration": f"median_{prefix}_spectral_concentration"}
    slices = geometry.frame_medians(scalar_scores(volume, [*keys, depth]), keys, list(names)).withColumnsRenamed(names)
    means = volume.groupBy(*keys, depth).agg(F.avg(F.when(F.col("seen"), F.col("value"))).alias("m"))
    return slices.join(geometry.lag_one(means, keys, depth, "m").withColumnRenamed("lag1", f"lag1_{prefix}_mean"), keys)


def _slope(keys: list[str], value: str, axis: str) -> Column:
    """Central difference along one of the three axes, one-sided at the ends."""
    w = Window.partitionBy(*keys, *(a for a in ("k", "i", "j") if a != axis)).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def _zeroed_volume(volume: DataFrame, keys: list[str]) -> DataFrame:
    return volume.select(*keys, "k", "i", "j", "seen", *(F.when(F.col("seen"), F.col(c)).otherwise(0.0).alias(c) for c in "uvw"))


def volume_curl_scores(volume: DataFrame, keys: list[str]) -> DataFrame:
    """Curl energy, curl coherence and divergence energy of a 3-D vector field (u along j, v along i, w along k) over observed
    cells; unobserved cells count as zero in differences."""
    d = _zeroed_volume(volume, keys)
    for axis in "kij":  # one exchange an axis
        d = d.select("*", *(_slope(keys, c, axis).alias(f"d{c}_d{axis}") for c in "uvw"))
    seen = lambda x: F.when(F.col("seen"), x)
    d = d.select(*keys, seen(F.col("dw_di") - F.col("dv_dk")).alias("cx"), seen(F.col("du_dk") - F.col("dw_dj")).alias("cy"), seen(F.col("dv_dj") - F.col("du_di")).alias("cz"),
                 seen(F.col("du_dj") + F.col("dv_di") + F.col("dw_dk")).alias("div"))
    square = lambda c: F.col(c) * F.col(c)
    energy = F.avg(square("cx") + square("cy") + square("cz"))
    mean = F.pow(F.avg("cx"), F.lit(2)) + F.pow(F.avg("cy"), F.lit(2)) + F.pow(F.avg("cz"), F.lit(2))
    return d.groupBy(*keys).agg(energy.alias("curl_energy_3d"), (mean / F.greatest(energy, F.lit(EPS))).alias("curl_coherence_3d"), F.avg(square("div")).alias("divergence_energy_3d"))


def vector_volume_scores(volume: DataFrame, keys: list[str]) -> DataFrame:
    """``volume_curl_scores`` of a 3-D vector field and the median slice coherence of each component."""
    zero, out = _zeroed_volume(volume, keys), volume_curl_scores(volume, keys)
    for c in "uvw":
        one = geometry.neighbour_coherence(zero, [*keys, "k"], c)
        out = out.join(one.groupBy(*keys).agg(F.median("coherence").alias(f"{c}_volume_neighbour_coherence")), keys)
    return out


def _frames(score: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(grid: DataFrame, keys: list[str]) -> DataFrame:
        scores = score(grid, [*keys, "k"])
        names = [c for c in scores.columns if c not in (*keys, "k")]
        return geometry.frame_medians(scores, keys, names).withColumnsRenamed({c: f"median_{c}" for c in names})

    return run


def _graph(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of one graph; its spectrum is that of a matrix one task can hold."""
    whole = spectral.graph_spectrum(edges.withColumn("_one", F.lit(1).cast("long")), "_one").drop("_one")
    return geometry.graph_scores(edges).crossJoin(F.broadcast(whole))


def _components(names: tuple[str, ...]) -> Callable[..., DataFrame]:
    return lambda grid, keys: geometry.component_scores(grid, keys, list(names))


#: The scores of each kind of geometry: a function of (rows, keys).
PROJECTIONS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "scalar_field_2d": scalar_scores,
    "vector_field_2d": geometry.vector_scores,
    "scalar_volume_3d": volume_scores,
    "vector_volume_3d": vector_volume_scores,
    "spatiotemporal_scalar": lambda grid, keys: volume_scores(grid, keys, prefix="frame"),
    "spatiotemporal_vector": _frames(geometry.vector_scores),
    "multicomponent_single_system": _components(("value", "u", "v")),
    "coupled_multi_system": _components(("u", "v")),
    "weighted_graph": _graph,
    "directed_graph": _graph,
    "irregular_point_field": lambda points, keys: geometry.point_scores(points, geometry.all_nearest_points(points)),
    "manifold_point_cloud": lambda points, keys: geometry.point_scores(points, geometry.all_nearest_points(points)),
    "correlation": lambda rows, keys: spectral.correlation_spectrum(rows.withColumn("_one", F.lit(1).cast("long")), "_one").drop("_one"),
}


def typed_scores(kind: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, score) of a geometry of any registered kind; another kind is an error."""
    if kind not in PROJECTIONS:
        raise ValueError(f"no projection is registered for {kind}")
    scores = PROJECTIONS[kind](rows, keys)
    channels = [c for c in scores.columns if c not in keys]
    return scores.select(*keys, *(F.col(c).cast("double").alias(c) for c in channels)).unpivot(keys, channels, "channel", "score")


def projected(scores: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """(keys, score): the absolute score of one channel of ``typed_scores``."""
    return scores.where(F.col("channel") == channel).select(*keys, F.abs("score").alias("score"))


def _median_slices(grid: DataFrame, keys: list[str]) -> DataFrame:
    return geometry.frame_medians(geometry.neighbour_coherence(grid, [*keys, "k"]), keys, ["coherence"])


def _lag_of_means(grid: DataFrame, keys: list[str]) -> DataFrame:
    means = grid.groupBy(*keys, "k").agg(F.avg(F.when(F.col("seen"), F.col("value"))).alias("m"))
    return geometry.lag_one(means, keys, "k", "m")


#: Single channels that can be had without their kind's other scores: a function of (rows, keys) and its column.
CHANNELS: dict[tuple[str, str], tuple[Callable[[DataFrame, list[str]], DataFrame], str]] = {
    ("scalar_field_2d", "neighbour_coherence"): (geometry.neighbour_coherence, "coherence"),
    ("scalar_field_2d", "spectral_concentration"): (spectral.spectral_concentration, "concentration"),
    ("scalar_volume_3d", "median_slice_neighbour_coherence"): (_median_slices, "coherence"),
    ("spatiotemporal_scalar", "lag1_frame_mean"): (_lag_of_means, "lag1"),
    ("vector_field_2d", "curl_energy"): (geometry.curl_scores, "curl_energy"),
    ("vector_field_2d", "curl_coherence"): (geometry.curl_scores, "curl_coherence"),
    ("vector_volume_3d", "curl_coherence_3d"): (volume_curl_scores, "curl_coherence_3d"),
    ("spatiotemporal_vector", "median_curl_coherence"): (_frames(geometry.curl_scores), "median_curl_coherence"),
    ("coupled_multi_system", "u_v_correlation"): (lambda grid, keys: grid.where("seen").groupBy(*keys).agg(F.corr("u", "v").alias("r")), "r"),
}


def channel_score(kind: str, rows: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """``projected`` of ``typed_scores`` for one channel, without the others where ``CHANNELS`` has it."""
    if (kind, channel) not in CHANNELS:
        return projected(typed_scores(kind, rows, keys), keys, channel)
    function, column = CHANNELS[kind, channel]
    return function(rows, keys).select(*keys, F.abs(F.col(column).cast("double")).alias("score"))


#: The null geometry of each kind: a function of (rows, keys, children, seed) that adds ``child``.
NULLS: dict[str, Callable[[DataFrame, list[str], int, str], DataFrame]] = {
    "scalar_field_2d": lambda g, keys, n, seed: geometry.permute_cells(g, keys, n, seed=seed),
    "scalar_volume_3d": lambda g, keys, n, seed: _whole_cells(g.withColumn("value", F.struct("value")), keys, n, seed),
    "vector_field_2d": lambda g, keys, n, seed: geometry.permute_cells(g.withColumn("value", F.struct("u", "v")), keys, n, seed=seed).select(*keys, "child", "i", "j", "value.*"),
    "vector_volume_3d": lambda g, keys, n, seed: _whole_cells(g.withColumn("value", F.struct("u", "v", "w")), keys, n, seed),
    "spatiotemporal_scalar": lambda g, keys, n, seed: nulls.frames_and_cells(g, keys, "k", n, seed=seed),
    "spatiotemporal_vector": lambda g, keys, n, seed: nulls.frames_and_cells(g.withColumn("value", F.struct("u", "v")), keys, "k", n, seed=seed).select(*keys, "child", "k", "i", "j", "value.*"),
    "multicomponent_single_system": lambda g, keys, n, seed: _each_component(g, keys, ["value", "u", "v"], n, seed),
    "coupled_multi_system": lambda g, keys, n, seed: _each_component(g, keys, ["u", "v"], n, seed),
    "weighted_graph": lambda e, keys, n, seed: nulls.shuffled_weights(e, _ends(e), n, directed=False, seed=seed),
    "directed_graph": lambda e, keys, n, seed: nulls.shuffled_weights(e, _ends(e), n, directed=True, seed=seed),
    "irregular_point_field": lambda p, keys, n, seed: nulls.permuted_within(p, keys, "id", [F.lit(0)], n, seed=seed).join(p.select(*keys, "id", "x", "y"), [*keys, "id"]),
    "manifold_point_cloud": lambda p, keys, n, seed: nulls.permuted_within(p.withColumn("at", F.struct("x", "y")), keys, "id", [F.lit(0)], n, seed=seed, value="at")
        .select(*keys, "child", "id", "at.*").join(p.select(*keys, "id", "value"), [*keys, "id"]),
    "correlation": lambda c, keys, n, seed: nulls.relabelled(c, ("left", "right"), n, seed=seed),
}


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _whole_cells(volume: DataFrame, keys: list[str], children: int, seed: str) -> DataFrame:
    """Observed values of a volume change cells, whole vectors at a time."""
    rows = volume.where("seen").withColumn("cell", (F.col("k") * 1_000_000 + F.col("i")) * 1_000_000 + F.col("j"))
    moved = nulls.permuted_within(rows, keys, "cell", [F.lit(0)], children, seed=seed)
    return moved.select(*keys, "child", F.floor(F.col("cell") / 10**12).alias("k"), (F.floor(F.col("cell") / 10**6) % 10**6).alias("i"), (F.col("cell") % 10**6).alias("j"), "value.*")


def _each_component(grid: DataFrame, keys: list[str], components: list[str], children: int, seed: str) -> DataFrame:
    """Each component changes cells by itself."""
    parts = [geometry.permute_cells(grid, keys, children, seed=f"{seed}|{c}", value=c) for c in components]
    return reduce(lambda a, b: a.join(b, [*keys, "child", "i", "j"]), parts)


def typed_null(kind: str, rows: DataFrame, keys: list[str], children: int, *, seed: str = "typed") -> DataFrame:
    """Null children of a geometry of any registered kind; another kind is an error."""
    if kind not in NULLS:
        raise ValueError(f"no null is registered for {kind}")
    return NULLS[kind](rows, keys, children, seed)


def jittered_parents(grid: DataFrame, keys: list[str], parents: int, *, share: float = 0.04, seed: str = "parent") -> DataFrame:
    """(keys, parent, i, j, value, seen): copies of a field with normal noise of ``share`` times its deviation, or of
    ``share`` where that is under 1."""
    spread = F.greatest(F.stddev_pop("value").over(Window.partitionBy(*keys)), F.lit(1.0))
    rows = grid.withColumn("_s", spread).withColumn("parent", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(parents).cast("long"))))
    noise = ladder.hash_normal(seed, *(F.col(k) for k in keys), F.col("parent"), F.col("i"), F.col("j"))
    return rows.select(*keys, "parent", "i", "j", (F.col("value") + share * F.col("_s") * noise).alias("value"), "seen")


def parent_ensembles(grid: DataFrame, keys: list[str], parents: int, children: int, *, seed: str = "parent") -> DataFrame:
    """(keys, parent, child, i, j, value): jittered parents (child 0) and the null children of each."""
    made = jittered_parents(grid, keys, parents, seed=seed).where("seen")
    kids = geometry.permute_cells(made, [*keys, "parent"], children)
    return made.select(*keys, "parent", F.lit(0).cast("long").alias("child"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value").union(kids.select(*keys, "parent", "child", "i", "j", "value"))


def component_noise(grid: DataFrame, keys: list[str], components: list[str], *, share: float = 0.01, seed: str = "component") -> DataFrame:
    """Normal noise of ``share`` times a component's root mean square over observed cells."""
    w = Window.partitionBy(*keys)
    rms = lambda c: F.sqrt(F.avg(F.when(F.col("seen"), F.col(c) * F.col(c))).over(w))
    noisy = {c: F.col(c) + share * rms(c) * ladder.hash_normal(seed, c, *(F.col(k) for k in keys), F.col("i"), F.col("j")) for c in components}
    return grid.select(*(noisy.get(c, F.col(c)).alias(c) for c in grid.columns))


def turned_scalar(grid: DataFrame, keys: list[str]) -> DataFrame:
    """A quarter turn of cells: (i, j) to (j, H - 1 - i)."""
    high = F.max("i").over(Window.partitionBy(*keys))
    return grid.withColumn("_h", high).withColumn("_i", F.col("j")).withColumn("j", F.col("_h") - F.col("i")).withColumn("i", F.col("_i")).drop("_h", "_i")


#: What must leave a kind's scores as they are: a function of (rows, keys).
TURNS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "scalar_field_2d": turned_scalar,
    "scalar_volume_3d": lambda g, keys: turned_scalar(g, [*keys, "k"]),
    "spatiotemporal_scalar": lambda g, keys: turned_scalar(g, [*keys, "k"]),
    "vector_field_2d": geometry.rotate_90,
    "weighted_graph": lambda e, keys: e.withColumn("src", -F.col("src")).withColumn("dst", -F.col("dst")),
    "directed_graph": lambda e, keys: e.withColumn("src", -F.col("src")).withColumn("dst", -F.col("dst")),
    "correlation": lambda c, keys: c.withColumn("left", -F.col("left")).withColumn("right", -F.col("right")),
    "irregular_point_field": lambda p, keys: p.withColumn("_x", -F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("_x")).drop("_x"),
    "manifold_point_cloud": lambda p, keys: p.withColumn("_x", -F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("_x")).drop("_x"),
    "multicomponent_single_system": turned_scalar,
    "coupled_multi_system": turned_scalar,
}


def representation_check(kind: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, score, turned, status): whether each score survives the kind's turn, relabelling or rigid motion
    within 1e-9 times max(1, |score|); kinds without a registered one are NOT_APPLICABLE."""
    scores = typed_scores(kind, rows, keys)
    if kind not in TURNS:
        return scores.select(*keys, "channel", "score", F.lit(None).cast("double").alias("turned"), F.lit("NOT_APPLICABLE").alias("status"))
    after = typed_scores(kind, TURNS[kind](rows, keys), keys).withColumnRenamed("score", "turned")
    same = F.abs(F.abs("turned") - F.abs("score")) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs("score"))
    return scores.join(after, [*keys, "channel"]).select(*keys, "channel", "score", "turned", F.when(same, "PASS").otherwise("DISAGREEMENT").alias("status"))


def field_variants(grid: DataFrame, keys: list[str], *, seed: str = "fragile") -> DataFrame:
    """(variant, keys, i, j, value, seen) of a scalar field without missing cells: its baseline, noise of 0.05 times
    max(deviation, 1), cells shuffled, a quarter turn, a tenth of the cells at the mean, every second cell doubled."""
    whole = Window.partitionBy(*keys)
    marks = [F.col(k) for k in keys]
    cells = grid.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value", F.lit(True).alias("seen"))
    noisy = cells.withColumn("value", F.col("value") + NOISE * F.greatest(F.stddev_pop("value").over(whole), F.lit(1.0)) * ladder.hash_normal(seed, "noise", *marks, F.col("i"), F.col("j")))
    shuffled = geometry.permute_cells(cells, keys, 1, seed=seed).select(*keys, "i", "j", "value", F.lit(True).alias("seen"))
    place = F.row_number().over(whole.orderBy(nulls.hashed(seed, "drop", *marks, F.col("i"), F.col("j")), "i", "j"))
    dropped = cells.withColumn("_k", place).withColumn("_n", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) * DROPPED))).withColumn("_m", F.avg("value").over(whole))
    dropped = dropped.withColumn("value", F.when(F.col("_k") <= F.col("_n"), F.col("_m")).otherwise(F.col("value"))).drop("_k", "_n", "_m")
    corners = cells.where("i % 2 = 0 and j % 2 = 0").select(*keys, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("_v"))
    coarse = cells.withColumn("_i", F.col("i") - F.col("i") % 2).withColumn("_j", F.col("j") - F.col("j") % 2).join(corners, [*keys, "_i", "_j"]).select(*keys, "i", "j", F.col("_v").alias("value"), "seen")
    parts = {"baseline": cells, "measurement_noise": noisy, "coordinate_or_edge_shuffle": shuffled, "orientation_rotation": turned_scalar(cells, keys), "mask_dropout": dropped, "resolution_reduction": coarse}
    return reduce(DataFrame.union, (v.select(F.lit(name).alias("variant"), *keys, F.col("i").cast("long"), F.col("j").cast("long"), "value", "seen") for name, v in parts.items()))


def fragility(grid: DataFrame, keys: list[str], *, seed: str = "fragile") -> DataFrame:
    """Per key and variant the median over channels of |change| / max(|baseline|, 0.05), and whether shuffling moves the
    scores more than noise and turning do."""
    scores = scalar_scores(field_variants(grid, keys, seed=seed), ["variant", *keys])
    long = scores.unpivot(["variant", *keys], ["neighbour_coherence", "spectral_concentration"], "channel", "score")
    base = long.where("variant = 'baseline'").select(*keys, "channel", F.col("score").alias("base"))
    moved = long.where("variant <> 'baseline'").join(base, [*keys, "channel"]).groupBy("variant", *keys).agg(F.median(F.abs(F.col("score") - F.col("base")) / F.greatest(F.abs("base"), F.lit(0.05))).alias("distance"))
    at = lambda name: F.max(F.when(F.col("variant") == name, F.col("distance"))).over(Window.partitionBy(*keys))
    shuffle = at("coordinate_or_edge_shuffle")
    return moved.withColumn("supported", (shuffle > at("measurement_noise")) & (shuffle > at("orientation_rotation")))


def support_masks(grid: DataFrame, size: int, *, seed: str = "support") -> DataFrame:
    """(support, i, j, seen): six registered sets of cells of a size x size grid of rows (i, j)."""
    i, j, centre = F.col("i"), F.col("j"), (size - 1) / 2
    off = lambda c: F.abs(c - centre) < 1
    radius = F.floor(F.sqrt(F.pow(j - centre, 2) + F.pow(i - centre, 2)))
    half = nulls.draw(1 << 20, seed, i, j) / float(1 << 20) > 0.4
    masks = {  # fixed values: the sets' definitions
        "ball_porous_line_containing": off(i) | ((i + j) % 7 == 0),
        "line_porous": ((j + 2 * i) % 5 == 0) & (F.pmod(2 * j - i, F.lit(7)) != 0),
        "orthogonal_line_counterexample": off(i) | off(j),
        "directionally_hidden_channel": F.pmod(j - 3 * i, F.lit(11)) == 0,
        "isotropic_porous": radius % 4 == 0,
        "anisotropic_porous": (j % 6 == 0) | ((i % 9 == 0) & half),
    }
    every = F.array(*(F.struct(F.lit(name).alias("support"), mask.alias("seen")) for name, mask in masks.items()))
    return grid.select("i", "j", F.explode(every).alias("m")).select("m.support", "i", "j", "m.seen")


def path_closure(links: DataFrame, values: DataFrame, window: tuple[int, int] = (7, 13)) -> DataFrame:
    """Closure winner of the values along path graphs: ``links`` (path, a, b), ``values`` (path, node, omega). Only
    simple paths have a row."""
    order = geometry.path_order(links)
    rows = order.join(values, ["path", "node"]).withColumn("pos", F.col("pos") + 1)
    return ladder.closure_winner(ladder.closure_scores(ladder.chi(rows, ["path"]), ["path"], window), ["path"])
