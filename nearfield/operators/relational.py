"""Membership, gathering, visited pairs and the parts of selection, as joins and ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def members(rows: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """The rows whose ``on`` is among ``ids``; also for the first of a pair, with its column named."""
    return rows.join(ids.select(F.col("id").alias(on)).distinct(), on, "left_semi")


def non_members(rows: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """The other rows."""
    return rows.join(ids.select(F.col("id").alias(on)).distinct(), on, "left_anti")


def gather(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``pos`` and the columns of ``rows`` for each ``(pos, id)`` of ``order``; an id may be asked for repeatedly."""
    return order.select("pos", "id").join(rows, "id").select("pos", *rows.columns)


def visited(pairs: DataFrame, *more: DataFrame) -> DataFrame:
    """The set of unordered pairs ``i, j`` seen in any of the tables, ``i`` the smaller."""
    both = pairs.select("i", "j")
    for other in more:
        both = both.union(other.select("i", "j"))
    return both.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def unvisited(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """The unordered pairs of ``pairs`` that ``seen`` hasn't, once each."""
    return visited(pairs).join(visited(seen), ["i", "j"], "left_anti")


def median_of_three(values: DataFrame) -> DataFrame:
    """``id, value``: the middle one by value of the first, the middle and the last row in id order."""
    n = values.count()
    ends = values.agg(F.min("id"), F.max("id")).first()
    middle = values.orderBy("id").limit((n - 1) // 2 + 1).orderBy(F.col("id").desc()).limit(1).select("id")
    some = values.where(F.col("id").isin([x for x in ends if x is not None])).union(values.join(middle, "id", "left_semi").select(*values.columns)).dropDuplicates(["id"])
    count = some.count()
    nth = F.row_number().over(Window.orderBy("value", "id"))  # three rows at most
    return some.withColumn("nth", nth).where(F.col("nth") == (count + 1) // 2).select("id", "value")


def partition_around(values: DataFrame, pivot: Column | float) -> DataFrame:
    """``id, value, side``: below the pivot, equal to it, or above; with the counts of each the pivot's final place
    follows."""
    p = pivot if isinstance(pivot, Column) else F.lit(pivot)
    side = F.when(F.col("value") < p, "below").when(F.col("value") == p, "equal").otherwise("above")
    return values.select("id", "value", side.alias("side"))


def sorted_by_feature(points: DataFrame, feature: int) -> DataFrame:
    """Points in order of one feature, ties by id: a range-partitioned sort."""
    return points.orderBy(F.col("features")[feature], "id")


def sorted_edges(edges: DataFrame) -> DataFrame:
    """``i, j, weight``, lightest first."""
    return edges.orderBy("weight", "i", "j").select("i", "j", "weight")
