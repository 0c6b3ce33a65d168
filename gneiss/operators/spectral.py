"""Spectra, eigenvalues, surrogates and sequential recurrences: Arrow kernels over one field or series per group.

A group is one field, series or matrix, which these methods need whole; tables of many of them run in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def generator(*parts: object) -> np.random.Generator:
    """A generator of its own for each set of parts, so that results don't depend on where groups run."""
    return np.random.default_rng(int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16))


#: Cells of a raster, or of a matrix, that one task holds at most (128 MB of doubles); larger ones are an error.
CELLS = 1 << 24


def _checked(cells: int) -> None:
    if cells > CELLS:
        raise ValueError(f"{cells} cells are more than a task holds ({CELLS}); downsample first")


def _raster(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    _checked(int(rows["i"].max() + 1) * int(rows["j"].max() + 1))
    values, seen = np.zeros((rows["i"].max() + 1, rows["j"].max() + 1)), np.zeros((rows["i"].max() + 1, rows["j"].max() + 1), bool)
    values[rows["i"], rows["j"]] = rows["value"]
    seen[rows["i"], rows["j"]] = rows["seen"]
    return values, seen


def _per_field(grid: DataFrame, keys: str | list[str], outputs: str, compute: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    kinds = dict(grid.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), outputs])
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(compute(*_raster(rows)), columns=names)
        for place, k in enumerate(keys):
            out.insert(place, k, rows[k].iloc[0])
        return out

    return grid.select(*keys, "i", "j", "value", "seen").groupBy(*keys).applyInPandas(run, schema)


def concentration(values: np.ndarray, seen: np.ndarray) -> float:
    """Share of a raster's power (without its mean) in its top 5 % of frequencies; unobserved cells are at the mean."""
    centred = np.where(seen, values - (values[seen].mean() if seen.any() else 0.0), 0.0)
    power = np.abs(np.fft.fft2(centred)) ** 2
    power.flat[0] = 0
    ordered = np.sort(power.ravel())
    return float(ordered[-max(1, int(np.ceil(0.05 * len(ordered)))) :].sum() / max(ordered.sum(), EPS))


def spectral_concentration(grid: DataFrame, keys: str | list[str]) -> DataFrame:
    """``concentration`` of each field."""
    return _per_field(grid, keys, "concentration double", lambda values, seen: [(concentration(values, seen),)])


def modal_trace(grid: DataFrame, keys: str | list[str], counts: list[int], *, penalty: float = 0.0) -> DataFrame:
    """Power left beyond the n strongest modes, for every n of ``counts``, plus ``penalty`` times the squared
    distance from their median."""
    def compute(values, seen):
        power = np.sort((np.abs(np.fft.rfft2(values - values.mean())) ** 2).ravel())[::-1]
        middle, total = float(np.median(counts)), max(float(power.sum()), EPS)
        return [(n, float(power[n:].sum() / total) + penalty * (n - middle) ** 2 + EPS) for n in counts]

    return _per_field(grid, keys, "n long, residual double", compute)


def concentration_norm(supports: DataFrame, keys: str | list[str], *, iterations: int = 64) -> DataFrame:
    """Norm of restricting to a set of cells and then to a set of frequencies, by power iteration, of (i, j, value, seen)
    where ``seen`` marks the cells and a positive ``value`` the frequencies."""
    def compute(values, seen):
        vector, frequencies = seen.astype(complex), values > 0
        for _ in range(iterations):
            size = np.linalg.norm(vector)
            if size <= EPS:
                return [(0.0,)]
            vector = np.fft.ifft2(np.fft.fft2(vector / size, norm="ortho") * frequencies, norm="ortho") * seen
        size = np.linalg.norm(vector)
        return [(float(np.linalg.norm(np.fft.fft2(vector / size, norm="ortho") * frequencies)) if size > EPS else 0.0,)]

    return _per_field(supports, keys, "norm double", compute)


def correlation_spectrum(correlations: DataFrame, key: str) -> DataFrame:
    """Entropy rank exp(-sum p ln p) of the eigenvalues' shares, and the least eigenvalue, of (key, left, right, r)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = rows.pivot(index="left", columns="right", values="r").to_numpy()
        roots = np.linalg.eigvalsh(matrix)
        share = roots / max(roots.sum(), EPS)
        return pd.DataFrame([(rows[key].iloc[0], float(np.exp(-(share * np.log(np.maximum(share, EPS))).sum())), float(roots[0]))], columns=[key, "effective_rank", "least_eigenvalue"])

    return correlations.select(key, "left", "right", "r").groupBy(key).applyInPandas(run, f"{key} long, effective_rank double, least_eigenvalue double")


def graph_spectrum(edges: DataFrame, key: str) -> DataFrame:
    """Spectral radius and the largest normalised return trace over powers 2..n, of (key, src, dst, w)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(rows["src"]) | set(rows["dst"]))
        _checked(len(nodes) ** 2)
        place = {n: k for k, n in enumerate(nodes)}
        matrix = np.zeros((len(nodes), len(nodes)))
        np.add.at(matrix, (rows["src"].map(place), rows["dst"].map(place)), rows["w"])
        roots = np.linalg.eigvals(matrix)
        radius = float(np.abs(roots).max())
        scaled = roots / max(radius, EPS)
        best = max((abs(float((scaled**p).sum().real)) / len(nodes) for p in range(2, len(nodes) + 1)), default=0.0)
        return pd.DataFrame([(rows[key].iloc[0], radius, best)], columns=[key, "spectral_radius", "return_trace"])

    return edges.select(key, "src", "dst", "w").groupBy(key).applyInPandas(run, f"{key} long, spectral_radius double, return_trace double")


def hashed_draws(n: int, count: int, *parts: object) -> np.ndarray:
    """Whole numbers in [0, n) for places 0 to ``count`` - 1: the hash of ``nulls.draw``, which every engine can repeat."""
    stem = "|".join(map(str, parts))
    return np.array([int(hashlib.md5(f"{stem}|{k}".encode()).hexdigest()[:12], 16) % n for k in range(count)], np.int64)


def _series_children(panel: DataFrame, children: int, make: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day_idx")
        values, parent = rows["value"].to_numpy(float), int(rows["parent"].iloc[0])
        missing = np.isnan(values)
        filled = np.where(missing, np.nanmedian(values) if not missing.all() else 0.0, values)
        out = []
        for child in range(1, children + 1):
            made = make(filled, child, parent)
            out.append(pd.DataFrame({"parent": rows["parent"].to_numpy(), "child": child, "day_idx": rows["day_idx"].to_numpy(), "value": pd.array(np.where(missing, np.nan, made), "Float64")}))
        return pd.concat(out)

    return panel.select("parent", "day_idx", "value").groupBy("parent").applyInPandas(run, "parent long, child long, day_idx long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def phase_surrogates(panel: DataFrame, children: int, *, seed: str = "phase") -> DataFrame:
    """Children with the same amplitudes and hashed phases; missing days are filled by the median and stay missing."""
    def make(x: np.ndarray, child: int, parent: int) -> np.ndarray:
        spectrum = np.fft.rfft(x)
        phases = 2 * np.pi * hashed_draws(2**40, len(spectrum), seed, child, parent) / 2.0**40
        phases[0] = 0
        if len(x) % 2 == 0:
            phases[-1] = 0
        return np.fft.irfft(np.abs(spectrum) * np.exp(1j * phases), n=len(x))

    return _series_children(panel, children, make)


def ar1_surrogates(panel: DataFrame, children: int, *, seed: str = "ar1") -> DataFrame:
    """Children that rerun a first-order autoregression with residuals drawn by hash."""
    def make(x: np.ndarray, child: int, parent: int) -> np.ndarray:
        before, after = x[:-1], x[1:]
        phi = float(before @ after / max(before @ before, 1e-12))
        drawn = (after - phi * before)[hashed_draws(max(1, len(x) - 1), len(x) - 1, seed, child, parent)]
        out = np.empty_like(x)
        out[0] = x[0]
        for k in range(1, len(x)):
            out[k] = phi * out[k - 1] + drawn[k - 1]
        return out

    return _series_children(panel, children, make)


SERIES = ("iid", "ar1", "seasonal", "burst", "change_point")


def synthetic_series(cells: DataFrame, length: int, *, seed: str = "series") -> DataFrame:
    """(kind, phi, replicate, day_idx, value) of named generators for rows (kind, phi, replicate)."""
    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                rng = generator(seed, row.kind, row.phi, row.replicate)
                noise = rng.normal(size=length)
                out = noise.copy()
                for k in range(1, length):
                    out[k] = row.phi * out[k - 1] + noise[k]
                if row.kind == "iid":
                    out = noise
                elif row.kind == "seasonal":
                    out = out + np.sin(2 * np.pi * np.arange(length) / 365.25)
                elif row.kind == "burst":
                    out = out + 4 * (rng.random(length) < 0.02)
                elif row.kind == "change_point":
                    out = out + np.where(np.arange(length) >= length // 2, 1.0, 0.0)
                yield pd.DataFrame({"kind": row.kind, "phi": row.phi, "replicate": row.replicate, "day_idx": np.arange(length), "value": out})

    return cells.select("kind", "phi", "replicate").mapInPandas(run, "kind string, phi double, replicate long, day_idx long, value double")


def simulated_power(grid: DataFrame, simulations: int, *, seed: str = "power") -> DataFrame:
    """Chance that an exact sign test rejects, for rows (parents, icc, effect, missing)."""
    from math import comb

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                rng = generator(seed, r.parents, r.icc, r.effect, r.missing)
                common = rng.normal(size=(simulations, 1)) * np.sqrt(r.icc)
                x = r.effect + common + rng.normal(size=(simulations, r.parents)) * np.sqrt(1 - r.icc)
                known = rng.random((simulations, r.parents)) >= r.missing
                up, n = ((x > 0) & known).sum(1), known.sum(1)
                tail = {(k, m): sum(comb(int(m), j) for j in range(int(k), int(m) + 1)) / 2 ** int(m) if m else 1.0 for k, m in set(zip(up, n))}
                rows.append((r.parents, r.icc, r.effect, r.missing, float(np.mean([tail[(k, m)] <= 0.05 for k, m in zip(up, n)]))))
            yield pd.DataFrame(rows, columns=["parents", "icc", "effect", "missing", "power"])

    return grid.select("parents", "icc", "effect", "missing").mapInPandas(run, "parents long, icc double, effect double, missing double, power double")


def mutated_ladders(points: DataFrame, *, seed: int = 1407) -> DataFrame:
    """``points`` with ``v``: the array ``base`` after round(1.5 ``mutation`` n) swaps of two places drawn from the
    point's own stream, seeded by its ``x`` and ``y``; null for an empty or null base."""
    import random

    from pyspark.sql import types as T

    schema = T.StructType([*points.schema.fields, T.StructField("v", T.ArrayType(T.DoubleType()))])

    def swapped(base, mutation, x, y):
        if base is None or not len(base):
            return None
        rng, v = random.Random(seed + x * 73_856_093 + y * 19_349_663), list(base)  # fixed values: the seed's factors
        for _ in range(round(mutation * len(v) * 1.5)):
            a, b = rng.randrange(len(v)), rng.randrange(len(v))
            v[a], v[b] = v[b], v[a]
        return v

    def run(batches):
        for batch in batches:
            yield batch.assign(v=[swapped(*row) for row in zip(batch["base"], batch["mutation"], batch["x"].tolist(), batch["y"].tolist())])

    return points.mapInPandas(run, schema)


def ladder_points(points: DataFrame, *, seed: int = 1407, steps: int = 12, separation: float = 0.08, least_z: float = 1.0,
                  escape: float = 0.6, recovery: float = 0.78, survival: float = 0.46) -> DataFrame:
    """Mutate a ladder at every grid point, relax it, and classify the point.

    ``points`` has x, y, ``mutation``, ``anchoring``, the ladder ``base`` (an array) and its null coherence's ``null_mean``
    and ``null_deviation``; other columns are kept. Added: classification, t_e, s_e, recovery_step, coherence, similarity,
    failure. A point that cannot be computed is UNRESOLVED with its failure, never lost. Only the swaps run in Python;
    the steps are a fold over arrays.
    """
    from gneiss.operators.ladder import array_coherence, array_deviation, array_similarity, relaxed_array

    rows = mutated_ladders(points, seed=seed).withColumn("_sd", array_deviation(F.col("base")))
    alike = lambda v: array_similarity(v, F.col("base"), F.col("_sd"))
    rows = rows.withColumn("_escaped", alike(F.col("v")) < escape)
    none = F.lit(None).cast("long")
    start = F.struct(F.col("v").alias("v"), F.array().cast("array<boolean>").alias("flags"), none.alias("back"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))

    def step(acc, k):
        now = F.struct(array_coherence(acc["v"]).alias("c"), alike(acc["v"]).alias("s"))
        return F.transform(F.array(now), lambda m: F.struct(
            relaxed_array(acc["v"], F.col("base"), F.col("anchoring")).alias("v"),
            F.concat(acc["flags"], F.array((m["c"] - F.col("null_mean") >= separation) & ((m["c"] - F.col("null_mean")) / F.nullif("null_deviation", F.lit(0.0)) >= least_z))).alias("flags"),
            F.when(acc["back"].isNull() & F.col("_escaped") & (m["s"] >= recovery), k).otherwise(acc["back"]).alias("back"), m["c"].alias("c"), m["s"].alias("s")))[0]

    rows = rows.withColumn("_end", F.when(F.col("v").isNotNull(), F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long")), start, step)))
    flags, born = F.col("_end.flags"), F.array_position(F.col("_end.flags"), True)
    alive = F.slice(flags, born.cast("int"), F.size(flags))
    rows = rows.withColumn("t_e", F.when(born > 0, born - 1).cast("long")).withColumn(
        "s_e", F.when(born > 0, F.size(F.filter(alive, lambda x: x)) / F.size(alive)).otherwise(0.0))
    last, known = F.element_at(flags, -1), F.col("v").isNotNull() & F.col("null_deviation").isNotNull() & F.col("null_mean").isNotNull() & (F.col("null_deviation") != 0)
    kind = (F.when(~known, "UNRESOLVED").when(F.col("_escaped") & F.col("_end.back").isNotNull(), "RECOVERED").when(F.col("_escaped") & (F.col("_end.s") < recovery), "ESCAPED")
            .when(last & (F.col("s_e") >= survival), "BOUNDED").when(last, "UNRESOLVED").otherwise("NULL_LIKE"))
    failure = F.when(F.col("v").isNull(), "EMPTY_LADDER").when(~known, "NO_NULL_COHERENCE")
    return rows.select(*points.columns, kind.alias("classification"), "t_e", "s_e", F.col("_end.back").alias("recovery_step"), F.round("_end.c", 8).alias("coherence"), F.round("_end.s", 8).alias("similarity"), failure.alias("failure"))
