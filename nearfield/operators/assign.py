"""Assignment of points to a small model of centroids or medoids: a narrow projection, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.operators.neighbors import exact_distances
from nearfield.points import matrix


def _nearest(model: np.ndarray, labels: np.ndarray, n: int, metric: str, distinct: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        d = exact_distances(matrix(b.column("features")), model, metric)
        order = np.argsort(d, axis=1, kind="stable")
        best = np.take_along_axis(d, order, 1)
        if distinct:  # the nth smallest of the distinct distances
            order, best = order.copy(), best.copy()
            for r in range(len(best)):
                first = np.concatenate([[True], best[r, 1:] != best[r, :-1]])
                m = int(first.sum())
                order[r, :m], best[r, :m] = order[r, first], best[r, first]
                best[r, m:] = np.finfo(float).max
        k = min(n, len(model))
        ids = np.repeat(b.column("id").to_numpy(), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(labels[order[:, :k]].ravel()), pa.array(best[:, :k].ravel())], names=["id", "rank", "cluster", "dist"])


def nth_nearest(points: DataFrame, model: np.ndarray, n: int, *, labels: np.ndarray | None = None, metric: str = "euclidean", distinct: bool = False) -> DataFrame:
    """``id, rank, cluster, dist`` for the ``n`` nearest rows of ``model``, lowest place first among equals.
    ``cluster`` is the place or its label; ``distinct`` ranks distinct distances, as some definitions do."""
    if n < 1 or n > len(model):
        raise ValueError(f"rank {n} of a model of {len(model)} rows")
    labels = np.arange(len(model)) if labels is None else labels
    return points.select("id", "features").mapInArrow(partial(_nearest, np.asarray(model, float), np.asarray(labels, np.int64), n, metric, distinct), "id long, rank int, cluster long, dist double")


def with_nearest(points: DataFrame, model: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """``id, cluster, dist``."""
    return nth_nearest(points, model, 1, metric=metric).drop("rank")
