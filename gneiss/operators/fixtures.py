"""Registered synthetic geometries: fields by formula over a grid, points, graphs and correlations, with seeded noise.

Every number comes from the family's name, its parent, its cell and a hash, so any engine repeats it and families of any
number of parents are made where they are used. A suite scores parents against their null children.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.robust import tie_tolerance
from gneiss.operators import geometry, inference, ladder, nulls, rasters, spectral, typed
from gneiss.plans.storage import arrow_rows, stored

SIZE, NODES, POINTS, SAMPLES, SERIES = 24, 12, 96, 256, 8
PI = math.pi


@dataclass(frozen=True)
class Family:
    """A kind of geometry, the channel that its target shows in, whether it is there, and the fields' formulas: SQL
    expressions over x, y, z in [-1, 1], t in [0, 1], whole i, j, k, and noise ``n_NAME`` (cell) and ``m`` (parent)."""

    kind: str
    channel: str
    truth: str
    fields: dict[str, str]
    depth: int = 1
    seen: str = "true"


_INNER = f"i BETWEEN 3 AND {SIZE - 4} AND j BETWEEN 3 AND {SIZE - 4}"
_R2 = "(x * x + y * y)"
# The registered families of fields.
FAMILIES: dict[str, Family] = {
    "N01": Family("scalar_field_2d", "neighbour_coherence", "ABSENT", {"value": "n_value"}),
    "N02": Family("vector_field_2d", "curl_energy", "ABSENT", {"u": "n_u", "v": "n_v"}),
    "N03": Family("scalar_volume_3d", "median_slice_neighbour_coherence", "ABSENT", {"value": "n_value"}, 6),
    "N04": Family("spatiotemporal_scalar", "lag1_frame_mean", "ABSENT", {"value": "n_value"}, 8),
    "N10": Family("coupled_multi_system", "u_v_correlation", "ABSENT", {"u": "n_u", "v": "n_v"}),
    "N11": Family("scalar_field_2d", "neighbour_coherence", "ABSENT", {"value": "n_value"}, seen=_INNER),
    "N13": Family("vector_field_2d", "curl_energy", "ABSENT", {"u": "x + 0.03 * n_u", "v": "y + 0.03 * n_v"}),
    "P01": Family("scalar_field_2d", "neighbour_coherence", "PRESENT", {"value": "x + 0.6 * y + 0.06 * n_value"}),
    "P02": Family("scalar_field_2d", "spectral_concentration", "PRESENT", {"value": f"sin(3.0 * {PI} * x + 0.03 * m) + 0.7 * cos(2.0 * {PI} * y)"}),
    "P03": Family("vector_field_2d", "curl_coherence", "PRESENT", {"u": "-y + 0.03 * n_u", "v": "x + 0.03 * n_v"}),
    "P04": Family("vector_field_2d", "curl_coherence", "PRESENT", {"u": "y + 0.03 * n_u", "v": "0.03 * n_v"}),
    "P05": Family("scalar_volume_3d", "median_slice_neighbour_coherence", "PRESENT", {"value": f"sin(2.0 * {PI} * x) + 0.4 * z + 0.05 * n_value"}, 6),
    "P06": Family("vector_volume_3d", "curl_coherence_3d", "PRESENT", {"u": "-y + 0.02 * n_u", "v": "x + 0.02 * n_v", "w": "0.2 * z + 0.02 * n_w"}, 6),
    "P07": Family("spatiotemporal_scalar", "lag1_frame_mean", "PRESENT", {"value": f"(0.2 + t) * exp(-4.0 * {_R2}) + 0.015 * n_value"}, 8),
    "P08": Family("spatiotemporal_vector", "median_curl_coherence", "PRESENT", {"u": "-(1.0 + t) * y + 0.02 * n_u", "v": "(1.0 + t) * x + 0.02 * n_v"}, 8),
    "A02": Family("coupled_multi_system", "u_v_correlation", "DECOY", {"u": "sin(3.0 * x) + 0.08 * n_u", "v": "0.9 * (sin(3.0 * x) + 0.08 * n_u) + 0.08 * n_v"}),
    "A03": Family("scalar_field_2d", "neighbour_coherence", "DECOY", {"value": "2.0 * x + 0.2 * y + 0.06 * n_value"}, seen=_INNER),
    "A04": Family("scalar_field_2d", "spectral_concentration", "DECOY", {"value": "(i + j) % 2 * 2.0 - 1.0 + 0.03 * n_value"}),
    "A05": Family("scalar_field_2d", "neighbour_coherence", "DECOY", {"value": f"exp(-3.0 * {_R2}) + 0.02 * n_value"}),
    "A06": Family("scalar_field_2d", "spectral_concentration", "DECOY", {"value": f"CASE WHEN i = 0 OR i = {SIZE - 1} THEN sin(3.0 * {PI} * (x + 1.0)) ELSE 0.0 END + CASE WHEN j = 0 OR j = {SIZE - 1} THEN cos(3.0 * {PI} * (y + 1.0)) ELSE 0.0 END + 0.01 * n_value"}),
}
# Single fields without noise, over the same grid.
FIXTURES: dict[str, dict[str, str]] = {
    "isotropic_wave": {"value": f"cos(8.0 * {PI} * sqrt{_R2}) * exp(-0.7 * sqrt{_R2})"},
    "anisotropic_wave": {"value": f"sin(7.0 * {PI} * x + 2.0 * {PI} * y)"},
    "vortex_shedding": {"u": f"sin(4.0 * {PI} * x) * cos(2.0 * {PI} * y)", "v": f"-cos(4.0 * {PI} * x) * sin(2.0 * {PI} * y)"},
    "wave_equation": {"value": f"sin(5.0 * {PI} * x) * cos(5.0 * {PI} * y)"},
    "coupled_phases": {"u": f"sin(4.0 * {PI} * x) * cos(2.0 * {PI} * y)", "v": f"cos(4.0 * {PI} * x + 0.7)"},
    "bursts": {"value": "exp(-35.0 * (pow(x + 0.5, 2) + pow(y + 0.2, 2))) + 0.8 * exp(-35.0 * (pow(x - 0.1, 2) + pow(y - 0.4, 2))) + 1.2 * exp(-35.0 * (pow(x - 0.55, 2) + pow(y + 0.45, 2)))"},
    "ring": {"value": f"exp(-80.0 * pow(sqrt{_R2} - 0.55, 2))"},
    "diffusion_kernel": {"value": "exp(-10.0 * (pow(x + 0.25, 2) + pow(y - 0.1, 2)))"},
    "checkerboard": {"value": "1.0 - (i + j) % 2 * 2.0"},
    "rotated_wave": {"value": f"sin(7.0 * {PI} * y - 2.0 * {PI} * x)"},
}


def _cells(spark: SparkSession, depth: int, parents: int) -> DataFrame:
    """(parent, k, i, j, x, y, z, t) of grids of SIZE x SIZE cells."""
    area = SIZE * SIZE
    rows = spark.range(parents * depth * area).select(F.floor(F.col("id") / (depth * area)).alias("parent"), F.floor(F.col("id") / area % depth).alias("k"), F.floor(F.col("id") / SIZE % SIZE).alias("i"), (F.col("id") % SIZE).alias("j"))
    scale = lambda c, n: (2.0 * F.col(c) / (n - 1) - 1.0) if n > 1 else F.lit(0.0)
    return rows.select("*", scale("j", SIZE).alias("x"), scale("i", SIZE).alias("y"), scale("k", depth).alias("z"), (F.col("k") / max(1, depth - 1)).alias("t"))


def field_family(spark: SparkSession, name: str, parents: int) -> DataFrame:
    """(parent, k, i, j, components, seen) of a registered family of fields."""
    family = FAMILIES[name]
    rows = _cells(spark, family.depth, parents).withColumn("m", ladder.hash_normal(name, "parent", F.col("parent")))
    for c in family.fields:
        rows = rows.withColumn(f"n_{c}", ladder.hash_normal(name, c, F.col("parent"), F.col("k"), F.col("i"), F.col("j")))
    return rows.select("parent", "k", "i", "j", *(F.expr(e).cast("double").alias(c) for c, e in family.fields.items()), F.expr(family.seen).alias("seen"))


def fixture(spark: SparkSession, name: str) -> DataFrame:
    """(i, j, components) of a registered field without noise."""
    return _cells(spark, 1, 1).select("i", "j", *(F.expr(e).cast("double").alias(c) for c, e in FIXTURES[name].items()))


def phase_randomized(spark: SparkSession, parents: int) -> DataFrame:
    """(parent, i, j, value, seen): a two-wave field whose Fourier amplitudes stay and whose phases are drawn anew for each
    parent. One field is one task's raster."""
    import numpy as np
    import pandas as pd

    base = _cells(spark, 1, parents).select("parent", "i", "j", (F.sin(4 * PI * F.col("x")) + 0.7 * F.cos(3 * PI * F.col("y"))).alias("value"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["i", "j"])
        spectrum = np.fft.rfft2(rows["value"].to_numpy().reshape(SIZE, SIZE))
        phases = spectral.generator("phase", rows["parent"].iloc[0]).uniform(-np.pi, np.pi, spectrum.shape)
        return rows.assign(value=np.fft.irfft2(np.abs(spectrum) * np.exp(1j * phases), s=(SIZE, SIZE)).ravel(), seen=True)

    return base.groupBy("parent").applyInPandas(run, "parent long, i long, j long, value double, seen boolean")


def _uniform(*parts: Column | str) -> Column:
    return (nulls.draw(2**40, *parts) + 0.5) / float(2**40)


def graph_family(spark: SparkSession, name: str, parents: int) -> DataFrame:
    """(parent, src, dst, w) of all ordered pairs of different nodes; weighted graphs are symmetric."""
    rows = spark.range(parents * NODES * NODES).select(F.floor(F.col("id") / NODES**2).alias("parent"), F.floor(F.col("id") / NODES % NODES).alias("src"), (F.col("id") % NODES).alias("dst")).where("src <> dst")
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    u = lambda tag, a, b: _uniform(name, tag, F.col("parent"), a, b)
    weights = {  # fixed values: the registered graph models
        "weighted_random": F.when(u("there", low, high) < 0.25, 0.05 + 0.45 * u("w", low, high)).otherwise(0.0),
        "weighted_community": F.greatest(F.lit(0.0), F.when(F.floor(low / 4) == F.floor(high / 4), 0.9).otherwise(0.05) + 0.03 * ladder.hash_normal(name, F.col("parent"), low, high)),
        "directed_acyclic": F.when((F.col("src") < F.col("dst")) & (u("there", F.col("src"), F.col("dst")) < 0.22), 0.2 + 0.8 * u("w", F.col("src"), F.col("dst"))).otherwise(0.0),
        "directed_cycle": F.when(F.col("dst") == (F.col("src") + 1) % NODES, 0.9 + 0.2 * u("w", F.col("src"), F.col("dst"))).when(F.col("dst") == (F.col("src") + 4) % NODES, 0.25).otherwise(0.0),
    }
    return rows.select("parent", "src", "dst", weights[name].alias("w"))


def point_family(spark: SparkSession, name: str, parents: int) -> DataFrame:
    """(parent, pos, x, y, value) of irregular fields or of ordered points about a centre."""
    rows = spark.range(parents * POINTS).select(F.floor(F.col("id") / POINTS).alias("parent"), (F.col("id") % POINTS).alias("pos"))
    u = lambda tag: _uniform(name, tag, F.col("parent"), F.col("pos"))
    noise = lambda tag: ladder.hash_normal(name, tag, F.col("parent"), F.col("pos"))
    if name.startswith("irregular"):
        rows = rows.withColumn("x", 2 * u("x") - 1).withColumn("y", 2 * u("y") - 1)
        return rows.withColumn("value", F.col("x") + 0.7 * F.col("y") + 0.08 * noise("v") if name == "irregular_gradient" else noise("v"))
    ring = name == "ordered_ring"
    angle = 2 * PI * F.col("pos") / POINTS - PI + 0.005 * noise("a") if ring else 2 * PI * u("a") - PI
    radius = 1 + 0.015 * noise("r") if ring else F.sqrt(0.05 + 0.95 * u("r"))
    return rows.withColumn("a", angle).withColumn("r", radius).select("parent", "pos", (F.col("r") * F.cos("a")).alias("x"), (F.col("r") * F.sin("a")).alias("y"), F.sin("a").alias("value"))


def correlation_family(spark: SparkSession, parents: int, *, factor: bool) -> DataFrame:
    """(parent, left, right, r) of SERIES series of SAMPLES values, independent or with a common factor."""
    rows = spark.range(parents * SAMPLES).select(F.floor(F.col("id") / SAMPLES).alias("parent"), (F.col("id") % SAMPLES).alias("row"))
    own = lambda c: ladder.hash_normal("correlation", c, F.col("parent"), F.col("row"))
    series = {f"c{k}": 0.85 * own("common") + 0.35 * own(str(k)) if factor else own(str(k)) for k in range(SERIES)}
    wide = rows.select("parent", *(v.alias(c) for c, v in series.items()))
    pairs = [(a, b) for a in range(SERIES) for b in range(SERIES)]
    sums = wide.groupBy("parent").agg(*(F.corr(f"c{a}", f"c{b}").alias(f"r{a}_{b}") for a, b in pairs))
    every = F.array(*(F.struct(F.lit(a).cast("long").alias("left"), F.lit(b).cast("long").alias("right"), F.col(f"r{a}_{b}").alias("r")) for a, b in pairs))
    return sums.select("parent", F.explode(every).alias("e")).select("parent", "e.*")


def _whole_fields(spark: SparkSession, names: list[str], parents: int) -> DataFrame:
    """(family, parent, cells): all cells of each parent's field as (cell, seen, c0, c1, c2), in no order."""
    parts = []
    for name in names:
        components = [*FAMILIES[name].fields, None, None][:3]
        cell = ((F.col("k") * SIZE + F.col("i")) * SIZE + F.col("j")).cast("int").alias("cell")
        values = [(F.col(c) if c else F.lit(None).cast("double")).alias(f"c{n}") for n, c in enumerate(components)]
        parts.append(field_family(spark, name, parents).select(F.lit(name).alias("family"), "parent", F.struct(cell, "seen", *values).alias("cell")))
    return reduce(DataFrame.union, parts).groupBy("family", "parent").agg(F.collect_list("cell").alias("cells"))


def _suite_scores(spark: SparkSession, names: list[str], parents: int, children: int) -> DataFrame:
    """(family, parent, child, score): the channel of parents (child 0), their turned copies (child -1) and null children.

    A field has at most 8 x SIZE x SIZE cells, so it is gathered once and its children are made and scored in arrays; of
    families of any number there is one exchange of cells and one of fields.
    """
    whole = _whole_fields(spark, names, parents)
    starts = F.explode(F.sequence(F.lit(1), F.lit(children), F.lit(COPIES)))
    columns = ("cell", "seen", "c0", "c1", "c2")
    tasks = whole.select("family", "parent", *(F.col(f"cells.{c}").alias(c) for c in columns), starts.alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, parent, start = (batch.column(c)[row].as_py() for c in ("family", "parent", "start"))
                cells, seen, *values = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in columns)
                family, order = FAMILIES[name], np.argsort(cells)
                shape = (family.depth, SIZE, SIZE)
                field = rasters.Field(family.kind, family.channel, tuple(family.fields), np.stack([v[order].reshape(shape) for v in values[: len(family.fields)]]), seen[order].astype(bool).reshape(shape), parent, name)
                found = [(child, field.score(field.child(child))) for child in range(start, min(start + COPIES, children + 1))]
                if start == 1:
                    found.append((0, field.score(field.values)))
                    if family.kind in rasters.TURNS:
                        turned = rasters.Field(family.kind, family.channel, field.components, rasters.TURNS[family.kind](field.values), rasters.turned(field.seen), parent, name)
                        found.append((-1, turned.score(turned.values)))
                kids, scores = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kids), pa.string()), pa.array([parent] * len(kids), pa.int64()), pa.array(kids, pa.int64()), pa.array(scores, pa.float64())], names=["family", "parent", "child", "score"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with arrow_rows(spark, 16):  # whole fields
        return stored(tasks.repartition(4 * parts, "family", "parent", "start").mapInArrow(run, "family string, parent long, child long, score double"), "scores")


def suite(spark: SparkSession, names: list[str], parents: int = 20, children: int = 31) -> DataFrame:
    """(family, truth, parent, observed, null_median, upper_p, detected, status) of families of fields: the channel's absolute
    score, against its null children of the same parent with ties counted, and whether a turn leaves it as it is."""
    own = lambda child: F.max(F.when(F.col("child") == child, F.col("score"))).over(Window.partitionBy("family", "parent"))
    scores = _suite_scores(spark, names, parents, children).withColumn("observed", own(0)).withColumn("turned", own(-1))
    tested = scores.where("child > 0").groupBy("family", "parent").agg(F.max("observed").alias("observed"), F.max("turned").alias("turned"), F.median("score").alias("null_median"),
                                                                       ((F.count_if(F.col("score") >= F.col("observed") - tie_tolerance(F.col("observed"))) + 1) / (children + 1)).alias("upper_p"))
    same = F.abs(F.col("turned") - F.col("observed")) <= typed.TOLERANCE * F.greatest(F.lit(1.0), F.col("observed"))
    turns = F.col("family").isin([name for name in names if FAMILIES[name].kind in rasters.TURNS])
    status = F.when(~turns, "NOT_APPLICABLE").when(same, "PASS").otherwise("DISAGREEMENT")
    truth = F.create_map(*(F.lit(x) for name in names for x in (name, FAMILIES[name].truth)))[F.col("family")]
    return tested.select("family", truth.alias("truth"), "parent", "observed", "null_median", "upper_p", (F.col("upper_p") <= 0.05).alias("detected"), status.alias("status"))


def suite_summary(rows: DataFrame) -> DataFrame:
    """Per family: parents, detections with their rate and Wilson interval, and scores that a turn changes."""
    rates = inference.rates(rows, ["family", "truth"], "detected")
    moved = rows.groupBy("family").agg(F.count_if(F.col("status") == "DISAGREEMENT").alias("disagreements"))
    return rates.join(moved, "family")


def calibration_series(spark: SparkSession, parents: int, days: int, *, positive: bool, phi: float = 0.92, spread: float = 0.35) -> DataFrame:
    """(parent, day_idx, day, value): independent normal days, or days that follow an autoregression inside each calendar month,
    each month brought to mean 0 and deviation 1. A month is one array; its recursion is a fold."""
    rows = spark.range(parents * days).select(F.floor(F.col("id") / days).alias("parent"), (F.col("id") % days).alias("day_idx"))
    rows = rows.withColumn("day", F.expr("date_add(date'2013-03-01', cast(day_idx as int))")).withColumn("e", ladder.hash_normal("calibration", str(positive), F.col("parent"), F.col("day_idx")))
    if not positive:
        return rows.withColumnRenamed("e", "value")
    months = rows.groupBy("parent", F.trunc("day", "month").alias("month")).agg(F.array_sort(F.collect_list(F.struct("day_idx", "day", "e"))).alias("d"))
    start = F.array(F.lit(0.0))
    walk = F.aggregate(F.slice("d", F.lit(2), F.size("d")), start, lambda acc, x: F.concat(acc, F.array(phi * F.element_at(acc, -1) + spread * x["e"])))
    months = months.withColumn("w", walk)
    mean = F.aggregate("w", F.lit(0.0), lambda a, b: a + b) / F.size("w")
    months = months.withColumn("mean", mean).withColumn("sd", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, b: a + (b - F.col("mean")) * (b - F.col("mean"))) / F.size("w")))
    out = months.select("parent", F.explode(F.zip_with("d", "w", lambda a, b: F.struct(a["day_idx"].alias("day_idx"), a["day"].alias("day"), ((b - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("value")))).alias("x"))
    return out.select("parent", "x.*")


def calibrated(spark: SparkSession, *, positive: bool, parents: int = 12, days: int = 1461, children: int = 127, sizes: tuple[int, ...] = tuple(range(6, 15))) -> DataFrame:
    """The surface of a calibration series against its month-permuted children: the negative one should separate nowhere, the
    positive one somewhere."""
    from gneiss.operators import blocks

    series = calibration_series(spark, parents, days, positive=positive)
    observed = series.select("parent", F.lit(0).cast("long").alias("child"), "day_idx", "value")
    both = observed.union(nulls.month_strata_nulls(series, children))
    cells = inference.parent_cells(blocks.block_persistence(both, ["parent", "child"], list(sizes)), ["parent", "n"], children)
    return inference.surface(cells.withColumn("fixture", F.lit("positive" if positive else "negative")), ["fixture"])


#: Longest ladder that one task permutes as arrays (some 100 bytes a position); longer ones are ranked by windows.
ARRAY_LADDER = 1_000_000
#: Copies of a ladder, or null children of a field, that one task makes.
COPIES = 8


def _permuted(seed: str, child: int, places: np.ndarray, ends: list[bytes], omega: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Places, in an array, of ``nulls.permuted_within``."""
    return omega[nulls.md5_order(f"{seed}|{child}", ends, places)]


def _noisy(seed: str, child: int, places: np.ndarray, ends: list[bytes], omega: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Omega and sigma times ``ladder.hash_normal`` of (seed, child, ladder, pos)."""
    def uniform(tag: str) -> np.ndarray:
        bits = nulls.digests(f"{tag}|{seed}|{child}", ends)[:, 1:6].astype(np.uint64)  # 40 of the first 48 bits
        return (bits @ (np.uint64(256) ** np.arange(4, -1, -1, dtype=np.uint64)) + 0.5) / float(2**40)

    return omega + sigma * np.sqrt(-2 * np.log(uniform("u"))) * np.cos(ladder.TWO_PI * uniform("v"))


def _copied_chis(ladders: DataFrame, children: int, copy: Callable[..., np.ndarray], seed: str) -> DataFrame:
    """(ladder, child, chi): ``ladder.chi`` of copies of ladders (ladder, pos, omega, sigma).

    Rows of a ladder are gathered once and its copies are made and summed in arrays, so neither hashes nor copies are
    sorted or exchanged as rows. Omegas that are null count for nothing.
    """
    whole = ladders.groupBy("ladder").agg(F.array_sort(F.collect_list(F.struct("pos", "omega", "sigma"))).alias("rows"))
    starts = F.explode(F.sequence(F.lit(1), F.lit(children), F.lit(COPIES)))
    tasks = whole.select("ladder", *(F.col(f"rows.{c}").alias(c) for c in ("pos", "omega", "sigma")), starts.alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, start = batch.column("ladder")[k].as_py(), batch.column("start")[k].as_py()
                places, omega, sigma = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("pos", "omega", "sigma"))
                unknown = [batch.column(c)[k].values.is_null().to_numpy(zero_copy_only=False) for c in ("omega", "sigma")]
                ends, kids, chis = [f"|{name}|{p}".encode() for p in places.tolist()], [], []
                for child in range(start, min(start + COPIES, children + 1)):
                    terms = copy(seed, child, places, ends, omega, sigma) / places
                    lost = copy(seed, child, places, ends, unknown[0].astype(float), unknown[1].astype(float)) != 0 if unknown[0].any() or unknown[1].any() else np.zeros(len(places), bool)
                    kids.append(child)
                    chis.append(None if lost.all() else float(terms[~lost].sum()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kids), pa.string()), pa.array(kids, pa.int64()), pa.array(chis, pa.float64())], names=["ladder", "child", "chi"])

    parts = max(ladders.sparkSession.sparkContext.defaultParallelism, int(ladders.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with arrow_rows(ladders.sparkSession, 1):  # whole ladders
        return stored(tasks.repartition(4 * parts, "ladder", "start").mapInArrow(run, "ladder string, child long, chi double"), "chis")


def order_benchmark(ladders: DataFrame, window: tuple[int, int], *, permutations: int = 64, noise: int = 64, epsilon: float = 0.5) -> DataFrame:
    """Per ladder (ladder, pos, omega, sigma_omega): closure winner, and the shares of permuted and of noisy copies with the
    same winner. Copies are summed where they are made; no copy of a ladder's rows is exchanged."""
    def winners(rows: DataFrame, keys: list[str]) -> DataFrame:
        chis = rows if "chi" in rows.columns else ladder.chi(rows, keys)
        return ladder.closure_winner(ladder.closure_scores(chis, keys, window), keys).select(*keys, "winner")

    ladders = stored(ladders.select("ladder", "pos", "omega", (epsilon * F.col("sigma_omega")).alias("sigma")), "ladders")
    own = stored(winners(ladders, ["ladder"]), "winners")
    sizes = stored(ladders.groupBy("ladder").agg(F.count(F.lit(1)).alias("n")), "sizes")
    some = lambda kind: ladders.join(F.broadcast(sizes.where(kind).select("ladder")), "ladder")
    short, long = some(F.col("n") <= ARRAY_LADDER), some(F.col("n") > ARRAY_LADDER)
    permuted, noisy = _copied_chis(short, permutations, _permuted, "benchmark"), _copied_chis(short, noise, _noisy, "benchmark")
    if not long.isEmpty():
        permuted = permuted.union(ladder.chi(nulls.permuted_within(long, ["ladder"], "pos", [F.lit(0)], permutations, seed="benchmark", value="omega"), ["ladder", "child"]))
        copies = nulls.with_children(long, noise)
        noisy = noisy.union(ladder.chi(copies.withColumn("omega", F.col("omega") + F.col("sigma") * ladder.hash_normal("benchmark", F.col("child"), F.col("ladder"), F.col("pos"))), ["ladder", "child"]))

    def share(rows: DataFrame, name: str) -> DataFrame:
        again = winners(rows, ["ladder", "child"]).withColumnRenamed("winner", "again").join(own, "ladder")
        return again.groupBy("ladder").agg(F.avg((F.col("again") == F.col("winner")).cast("double")).alias(name))

    return own.join(share(permuted, "permuted_share"), "ladder").join(share(noisy, "noisy_share"), "ladder")


#: Generators by family name, for families that are no fields.
OTHERS: dict[str, Callable[[SparkSession, int], DataFrame]] = {
    **{n: (lambda spark, parents, n=n: graph_family(spark, n, parents)) for n in ("weighted_random", "weighted_community", "directed_acyclic", "directed_cycle")},
    **{n: (lambda spark, parents, n=n: point_family(spark, n, parents)) for n in ("irregular_random", "irregular_gradient", "unordered_disk", "ordered_ring")},
    "correlation_identity": lambda spark, parents: correlation_family(spark, parents, factor=False),
    "correlation_factor": lambda spark, parents: correlation_family(spark, parents, factor=True),
    "phase_randomized": phase_randomized,
}


def ring_coherence(points: DataFrame, keys: list[str]) -> DataFrame:
    """Winding coherence of ordered points, by keys."""
    return geometry.winding(points, keys).select(*keys, F.col("coherence").alias("score"))
