"""Generated point sets for clustering tests: circles, moons, blobs and their variants, from a seed.

Each is standardised (mean 0, deviation 1 a feature) and scaled by ten, with the group that a row was drawn from.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_BLOB_CENTRES = 10.0


def _blobs(rng: np.random.Generator, n: int, d: int, deviations: list[float], centres: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    k = len(deviations)
    centres = rng.uniform(-_BLOB_CENTRES, _BLOB_CENTRES, (k, d)) if centres is None else centres
    group = np.arange(n) % k
    return centres[group] + rng.normal(size=(n, d)) * np.array(deviations)[group, None], group


def _circles(rng: np.random.Generator, n: int, noise: float = 0.05, inner: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    group, angle = np.arange(n) % 2, rng.uniform(0, 2 * np.pi, n)
    radius = np.where(group == 0, 1.0, inner)
    return np.c_[radius * np.cos(angle), radius * np.sin(angle)] + rng.normal(scale=noise, size=(n, 2)), group


def _moons(rng: np.random.Generator, n: int, noise: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    group, angle = np.arange(n) % 2, rng.uniform(0, np.pi, n)
    x = np.where(group == 0, np.cos(angle), 1 - np.cos(angle))
    y = np.where(group == 0, np.sin(angle), 0.5 - np.sin(angle))
    return np.c_[x, y] + rng.normal(scale=noise, size=(n, 2)), group


def _aniso(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    x, group = _blobs(rng, n, 2, [1.0] * 3)
    return x @ np.array([[0.6, -0.6], [-0.4, 0.8]]), group


def _grid(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    corners = np.array([(a, b) for a in (-8.0, 0.0, 8.0) for b in (-8.0, 0.0, 8.0)])
    return _blobs(rng, n, 2, [0.5] * 9, corners)


DATASETS: dict[str, Callable[[np.random.Generator, int], tuple[np.ndarray, np.ndarray]]] = {
    "noisy_circles": _circles,
    "noisy_moons": _moons,
    "varied": lambda rng, n: _blobs(rng, n, 2, [1.0, 2.5, 0.5]),
    "aniso": _aniso,
    "blobs": lambda rng, n: _blobs(rng, n, 2, [1.0] * 3),
    "no_structure": lambda rng, n: (rng.uniform(size=(n, 2)), np.zeros(n, int)),
    "unbalanced_blobs": lambda rng, n: (lambda x, g: (x[np.argsort(g, kind="stable")], np.sort(g)))(*_blobs(rng, n, 2, [0.3, 1.0, 3.0, 1.0])),
    "grid_blobs": _grid,
    "wide_blobs": lambda rng, n: _blobs(rng, n, 16, [1.0] * 5),
}


def generate(spark: SparkSession, name: str, n: int = 1500, seed: int = 0) -> DataFrame:
    """``id, features, group``: for tests, so made on the driver; at most a million rows."""
    if name not in DATASETS:
        raise ValueError(f"no dataset {name}: {', '.join(DATASETS)}")
    if n > 1_000_000:
        raise ValueError(f"{n} rows are too many for a generated set")
    x, group = DATASETS[name](np.random.default_rng(seed), n)
    x = (x - x.mean(0)) / x.std(0) * 10
    return spark.createDataFrame([(k, [float(v) for v in row], int(g)) for k, (row, g) in enumerate(zip(x, group, strict=True))], "id long, features array<double>, group long")
