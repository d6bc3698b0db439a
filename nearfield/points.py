"""Point tables: ``id BIGINT, features ARRAY<DOUBLE>``, which every operator takes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_points(df: DataFrame, id_col: str, features: str | list[str], *keep: str) -> DataFrame:
    """Points from an array column or from numeric columns; the cast to double comes before any arithmetic.
    Rows with a null id or feature are left out; ``keep`` names further columns to carry."""
    x = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    out = df.select(F.col(id_col).cast("long").alias("id"), x.alias("features"), *keep)
    return out.where(F.col("id").isNotNull() & F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull()))


def width(points: DataFrame) -> int:
    """The common number of features (0 for no rows); raises where rows differ."""
    lo, hi = points.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if lo != hi:
        raise ValueError(f"points of {lo} and {hi} features")
    return lo or 0


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a dense two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def collect_model(points: DataFrame, limit: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """A small model on the driver: ids and features, ordered by id. Raises above ``limit`` rows."""
    rows = points.select("id", "features").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a model of more than {limit} rows")
    rows.sort(key=lambda r: r.id)
    return np.array([r.id for r in rows], np.int64), np.array([r.features for r in rows], float)


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
