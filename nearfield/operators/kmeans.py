"""K-means with centroids on the driver and one aggregation job a step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.assign import with_nearest
from nearfield.operators.neighbors import distances
from nearfield.operators.sampling import kmeans_plus_plus
from nearfield.plans.scratch import Scratch
from nearfield.points import matrix, width


@dataclass(frozen=True)
class KMeansOptions:
    max_iter: int = 100
    early_stopping: bool = True
    patience: int = 0
    tolerance: float = 0.0
    n_init: int = 1
    #: "lloyd", or "hamerly": the same steps with distance bounds, where a row equally near to two keeps its cluster.
    step: str = "lloyd"


def _partial(model: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, distance and feature sums per cluster: k rows a task, whatever it reads."""
    k, d = model.shape
    n, loss, sums = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d))
    for b in batches:
        if not b.num_rows:
            continue
        x = matrix(b.column("features"))
        dist = distances(x, model)
        at = dist.argmin(1)
        n += np.bincount(at, minlength=k)
        loss += np.bincount(at, dist[np.arange(len(at)), at], minlength=k)
        np.add.at(sums, at, x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(loss), pa.array(list(sums))], names=["cluster", "n", "loss", "sums"])


def step_sums(points: DataFrame, model: np.ndarray) -> DataFrame:
    """``cluster, n, loss, sums`` of the points nearest to each centroid."""
    d = model.shape[1]
    parts = points.select("features").mapInArrow(partial(_partial, np.asarray(model, float)), "cluster long, n long, loss double, sums array<double>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.array(*[F.sum(F.col("sums")[i]) for i in range(d)]).alias("sums"))


def lloyd_step(points: DataFrame, model: np.ndarray) -> tuple[np.ndarray, float]:
    """The means of the points nearest to each centroid, and the sum of distances before the move. A centroid
    without points stays where it is."""
    out, loss = np.array(model, float), 0.0
    for r in step_sums(points, model).collect():
        loss += r.loss
        if r.n:
            out[r.cluster] = np.array(r.sums) / r.n
    return out, loss


def _bounded(model: np.ndarray, moved: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their cluster, an upper bound of the distance to it and a lower bound of all others. Only rows
    whose bounds overlap have distances computed; ``moved`` is how far each centroid went (none: first step)."""
    k = len(model)
    gaps = distances(model, model)
    np.fill_diagonal(gaps, np.inf)
    half = gaps.min(1) / 2 if k > 1 else np.full(k, np.inf)
    for b in batches:
        if not b.num_rows:
            continue
        x = matrix(b.column("features"))
        if moved is None:
            at, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf)
        else:
            at = b.column("cluster").to_numpy().copy()
            upper, lower = b.column("upper").to_numpy() + moved[at], b.column("lower").to_numpy() - moved.max()
        far = np.flatnonzero(upper >= np.maximum(lower, half[at]) * (1 - 1e-12))
        if len(far):
            d = distances(x[far], model)
            near, own = d.argmin(1), at[far]
            rows = np.arange(len(far))
            if moved is not None:
                near = np.where(d[rows, own] == d[rows, near], own, near)
            at[far], upper[far] = near, d[rows, near]
            d[rows, near] = np.inf
            lower[far] = d.min(1)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("features"), pa.array(at), pa.array(upper), pa.array(lower)], names=["id", "features", "cluster", "upper", "lower"])


class Hamerly:
    """Assignment kept with bounds between steps, in one scratch table a step. It saves distances where there
    are many centroids, and costs that write."""

    def __init__(self, points: DataFrame):
        self.rows, self.moved, self.turn = points.select("id", "features"), None, 0
        self.scratch = Scratch(points.sparkSession, "hamerly")

    def step(self, model: np.ndarray) -> np.ndarray:
        """The means of the rows of each centroid; one without rows stays where it is."""
        names = "id long, features array<double>, cluster long, upper double, lower double"
        self.rows = self.scratch.save(self.rows.mapInArrow(partial(_bounded, model, self.moved), names), f"step{self.turn}")
        if self.turn:
            self.scratch.drop(f"step{self.turn - 1}")
        self.turn += 1
        out, d = np.array(model, float), model.shape[1]
        for r in self.rows.groupBy("cluster").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(d)]).alias("mean")).collect():
            out[r.cluster] = r["mean"]
        self.moved = np.sqrt(((out - model) ** 2).sum(1))
        return out


class KMeans:
    """``initialiser`` takes points, k and a seed and returns k starts."""

    def __init__(self, k: int, options: KMeansOptions = KMeansOptions(), initialiser: Callable[[DataFrame, int, int], np.ndarray] = kmeans_plus_plus):
        self.k, self.options, self.initialiser = k, options, initialiser
        self.centroids: np.ndarray | None = None
        self.loss = float("inf")

    def fit(self, points: DataFrame, seed: int = 0, start: np.ndarray | None = None) -> KMeans:
        width(points)
        if self.options.step not in ("lloyd", "hamerly"):
            raise ValueError(self.options.step)
        o = self.options
        for run in range(1 if start is not None else o.n_init):
            c = np.array(start, float) if start is not None else self.initialiser(points, self.k, seed + run)
            still = 0
            bounds = Hamerly(points) if o.step == "hamerly" else None
            for _ in range(o.max_iter):
                new = bounds.step(c) if bounds else lloyd_step(points, c)[0]
                same = np.abs(new - c).max() <= o.tolerance
                c = new
                still = still + 1 if same else 0
                if o.early_stopping and still > o.patience:
                    break
            if bounds:
                bounds.scratch.drop()
            loss = lloyd_step(points, c)[1]
            if loss < self.loss:
                self.centroids, self.loss = c, loss
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        """``id, cluster``."""
        return with_nearest(points, self.centroids).select("id", "cluster")

    def forward(self, points: DataFrame) -> DataFrame:
        """``id, dist`` to the nearest centroid."""
        return with_nearest(points, self.centroids).select("id", "dist")


def cluster_sizes(labels: DataFrame, k: int | None = None) -> DataFrame:
    """``cluster, n`` with zeros for empty clusters of 0..k-1 (default: up to the largest label)."""
    spark = labels.sparkSession
    if k is None:
        top = labels.agg(F.max("cluster")).first()[0]
        k = 0 if top is None else top + 1
    counts = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return spark.range(k).withColumnRenamed("id", "cluster").join(counts, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
