"""Seeded draws: rows, weighted rows, and starting centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.assign import with_nearest
from nearfield.points import collect_model


def random_rows(points: DataFrame, n: int, seed: int = 0, subset: DataFrame | None = None) -> DataFrame:
    """``n`` rows without replacement by a seeded hash of the id, of ``subset``'s ids if given; the same rows
    on every run and every partitioning. A bounded top-n."""
    rows = points if subset is None else points.join(subset.select("id"), "id", "left_semi")
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def first_rows(points: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the smallest ids, a start that needs no seed."""
    return points.orderBy("id").limit(n)


def integers(spark, lo: int, hi: int, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct integers of ``[lo, hi)``."""
    return random_rows(spark.range(lo, hi), n, seed)


def uniform_integers(spark, lo: int, hi: int, n: int, seed: int = 0) -> DataFrame:
    """``id, value``: ``n`` integers of the closed range, with replacement; the same on every partitioning."""
    return spark.range(n).select("id", (F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(hi - lo + 1))).alias("value"))


def uniform_reals(spark, lo: float, hi: float, n: int, seed: int = 0) -> DataFrame:
    """``id, value``: ``n`` reals of ``[lo, hi)``."""
    return spark.range(n).select("id", (F.lit(lo) + _unit("id", seed) * (hi - lo)).alias("value"))


def normal_reals(spark, mean: float, deviation: float, n: int, seed: int = 0) -> DataFrame:
    """``id, value``: ``n`` normal draws, two uniform ones each (Box and Muller)."""
    z = F.sqrt(-2 * F.log(1 - _unit("id", seed))) * F.cos(2 * np.pi * _unit("id", seed + 1_000_003))
    return spark.range(n).select("id", (F.lit(mean) + z * deviation).alias("value"))


def binomial_integers(spark, trials: int, p: float, n: int, seed: int = 0) -> DataFrame:
    """``id, value``: ``n`` counts of successes in ``trials`` draws, the integers' partner of ``normal_reals``."""
    hits = F.filter(F.sequence(F.lit(1), F.lit(trials)), lambda t: (F.shiftrightunsigned(F.xxhash64("id", t, F.lit(seed)), 11) / float(1 << 53)) < p)
    return spark.range(n).select("id", F.size(hits).cast("long").alias("value"))


def _unit(column: str, seed: int):
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / float(1 << 53)


def weighted_row(values: DataFrame, seed: int = 0) -> DataFrame:
    """One row of ``(id, weight)`` with probability in proportion to its weight, by exponential races; with all
    weights zero every row is as likely."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    total = values.agg(F.sum("weight")).first()[0]
    w = F.col("weight") if total else F.lit(1.0)
    return values.where(w > 0).orderBy(-F.log(u) / w, "id").limit(1)


def uniform_in_box(points: DataFrame, k: int, d: int, seed: int = 0) -> np.ndarray:
    """``k`` centroids uniform within the features' ranges."""
    row = points.agg(*[f(F.col("features")[i]) for f in (F.min, F.max) for i in range(d)]).first()
    lo, hi = np.array(row[:d], float), np.array(row[d:], float)
    return lo + np.random.default_rng(seed).random((k, d)) * (hi - lo)


def uniform_rows(points: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    return collect_model(random_rows(points, k, seed))[1]


def kmeans_plus_plus(points: DataFrame, k: int, seed: int = 0, power: int = 1, previous_only: bool = False) -> np.ndarray:
    """Starts drawn with weights by the distance (``power`` 1) or squared distance (2) to the nearest start so
    far, or to the previous one alone; one aggregation job a start."""
    chosen = [collect_model(random_rows(points, 1, seed))[1][0]]
    for i in range(1, k):
        near = with_nearest(points, np.array(chosen[-1:] if previous_only else chosen)).select("id", F.pow("dist", F.lit(power)).alias("weight"))
        pick = weighted_row(near, seed + i).select("id")
        chosen.append(collect_model(points.join(F.broadcast(pick), "id", "left_semi"))[1][0])
    return np.array(chosen)
