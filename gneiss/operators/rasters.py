"""One field of cells in arrays: its null children, its turn and the channel it is tested by, as ``typed`` has them for rows.

A field is ``values`` (components, depth, rows, columns) and ``seen`` (depth, rows, columns); a field without depth has one
slice. It is small enough for one task, so neither its children nor hashes are sorted or exchanged as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gneiss.operators import nulls, spectral
from gneiss.operators.geometry import EPS

#: Kinds whose fields may have unobserved cells here.
MASKED = ("scalar_field_2d", "coupled_multi_system")


def coherence(values: np.ndarray, seen: np.ndarray) -> float:
    """``geometry.neighbour_coherence`` of one slice."""
    if not seen.any():
        return 0.0
    centred = np.where(seen, values - values[seen].mean(), 0.0)
    pairs = [(centred[:, :-1] * centred[:, 1:])[seen[:, :-1] & seen[:, 1:]], (centred[:-1] * centred[1:])[seen[:-1] & seen[1:]]]
    count, variance = sum(len(p) for p in pairs), float((centred[seen] ** 2).mean())
    return sum(float(p.sum()) for p in pairs) / count / variance if variance > EPS and count else 0.0


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's; None where a side has no spread."""
    if not len(x):
        return None
    a, b = x - x.mean(), y - y.mean()
    spread = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum()) / spread if spread > 0 else None


def curl(values: np.ndarray) -> tuple[float, float]:
    """Energy and coherence of ``geometry.curl_scores`` of one slice without unobserved cells."""
    (du_di, _), (_, dv_dj) = np.gradient(values[0]), np.gradient(values[1])
    turn = dv_dj - du_di
    energy = float((turn * turn).mean())
    return energy, float(turn.mean()) ** 2 / max(energy, EPS)


def volume_curl(values: np.ndarray) -> float:
    """Coherence of ``typed.volume_curl_scores`` of a volume without unobserved cells."""
    (du_dk, du_di, _), (dv_dk, _, dv_dj), (_, dw_di, dw_dj) = (np.gradient(c) for c in values)
    turns = (dw_di - dv_dk, du_dk - dw_dj, dv_dj - du_di)
    energy = float(sum(t * t for t in turns).mean())
    return sum(float(t.mean()) ** 2 for t in turns) / max(energy, EPS)


def lag_of_means(slices: np.ndarray) -> float | None:
    """``geometry.lag_one`` of the slices' means."""
    means = slices.mean(axis=(1, 2))
    return correlation(means[:-1], means[1:]) if len(means) > 2 and means.std() > EPS else 0.0


#: The channels of ``typed.CHANNELS``: a function of (values, seen).
CHANNELS: dict[tuple[str, str], Callable[[np.ndarray, np.ndarray], float | None]] = {
    ("scalar_field_2d", "neighbour_coherence"): lambda v, s: coherence(v[0, 0], s[0]),
    ("scalar_field_2d", "spectral_concentration"): lambda v, s: spectral.concentration(*_shown(v[0, 0], s[0])),
    ("scalar_volume_3d", "median_slice_neighbour_coherence"): lambda v, s: float(np.median([coherence(*x) for x in zip(v[0], s)])),
    ("spatiotemporal_scalar", "lag1_frame_mean"): lambda v, s: lag_of_means(v[0]),
    ("vector_field_2d", "curl_energy"): lambda v, s: curl(v[:, 0])[0],
    ("vector_field_2d", "curl_coherence"): lambda v, s: curl(v[:, 0])[1],
    ("vector_volume_3d", "curl_coherence_3d"): lambda v, s: volume_curl(v),
    ("spatiotemporal_vector", "median_curl_coherence"): lambda v, s: float(np.median([curl(v[:, k])[1] for k in range(v.shape[1])])),
    ("coupled_multi_system", "u_v_correlation"): lambda v, s: correlation(v[0][s], v[1][s]),
}


def _shown(values: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not seen.all():
        raise ValueError("rasters of null children end at their last observed cell; a masked one has no spectrum here")
    return values, seen


def turned(values: np.ndarray) -> np.ndarray:
    """Cells (i, j) go to (j, H - 1 - i)."""
    return np.rot90(values, -1, axes=(-2, -1))


#: ``typed.TURNS`` of values.
TURNS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    **dict.fromkeys(("scalar_field_2d", "scalar_volume_3d", "spatiotemporal_scalar", "coupled_multi_system"), turned),
    "vector_field_2d": lambda values: turned(np.stack([-values[1], values[0]])),
}


class Field:
    """A parent's field and what its null children share."""

    def __init__(self, kind: str, channel: str, components: tuple[str, ...], values: np.ndarray, seen: np.ndarray, parent: int, seed: str) -> None:
        if (kind, channel) not in CHANNELS:
            raise ValueError(f"no channel {channel} of {kind} is registered for arrays")
        if kind not in MASKED and not seen.all():
            raise ValueError(f"a {kind} with unobserved cells is not for arrays")
        self.kind, self.channel, self.components, self.values, self.seen, self.parent, self.seed = kind, channel, components, values, seen, parent, seed
        self.places = np.flatnonzero(seen)
        k, i, j = np.unravel_index(self.places, seen.shape)
        self.frames, cells = (k, i * 1_000_000 + j) if kind.startswith("spatiotemporal") else (None, (k * 1_000_000 + i) * 1_000_000 + j)
        named = zip(k.tolist(), cells.tolist()) if self.frames is not None else ((c,) for c in cells.tolist())
        self.ends = ["|".join(map(str, ("", parent, *name))).encode() for name in named]

    def score(self, values: np.ndarray) -> float | None:
        """The channel's absolute score."""
        found = CHANNELS[self.kind, self.channel](values, self.seen)
        return None if found is None else abs(found)

    def _moved(self, values: np.ndarray, seed: str, child: int) -> np.ndarray:
        """Observed values change cells, inside each frame where there are frames."""
        order = nulls.md5_order(f"{seed}|{child}", self.ends, self.places, self.frames)
        flat = values.reshape(len(values), -1).copy()
        flat[:, self.places] = flat[:, self.places[order]]
        return flat.reshape(values.shape)

    def child(self, child: int) -> np.ndarray:
        """Values of a null child of ``typed.typed_null``."""
        if self.kind == "coupled_multi_system":
            return np.concatenate([self._moved(self.values[[n]], f"{self.seed}|{c}", child) for n, c in enumerate(self.components)])
        moved = self._moved(self.values, self.seed, child)
        if self.frames is None:
            return moved
        frames = np.arange(self.values.shape[1])
        return moved[:, nulls.md5_order(f"{self.seed}|order|{child}", [f"|{self.parent}|{k}".encode() for k in frames], frames)]
