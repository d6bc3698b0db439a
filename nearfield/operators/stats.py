"""Per-feature statistics, order statistics, normalisation and transposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.plans.scratch import Scratch


def by_feature(points: DataFrame, d: int, mask: list[int] | None = None, **aggregates) -> DataFrame:
    """``pos`` and one column for each named aggregate function, over the features of ``mask`` (default all).
    One aggregation job with a column a feature, turned round afterwards."""
    at = list(mask) if mask is not None else list(range(d))
    cols = [f(F.col("features")[k]).alias(f"{name}_{k}") for k in at for name, f in aggregates.items()]
    row = points.agg(*cols)
    parts = F.array(*[F.struct(F.lit(k).cast("long").alias("pos"), *[F.col(f"{n}_{k}").alias(n) for n in aggregates]) for k in at])
    return row.select(F.explode(parts).alias("f")).select("f.*")


def mean(points: DataFrame, d: int, mask: list[int] | None = None) -> DataFrame:
    return by_feature(points, d, mask, value=F.avg)


def variance(points: DataFrame, d: int, mask: list[int] | None = None) -> DataFrame:
    """Sample variance."""
    return by_feature(points, d, mask, value=F.var_samp)


def population_variance(points: DataFrame, d: int, mask: list[int] | None = None) -> DataFrame:
    """Variance with division by n."""
    return by_feature(points, d, mask, value=F.var_pop)


def argmax_variance(points: DataFrame, d: int, mask: list[int] | None = None) -> DataFrame:
    """The feature of the largest variance, the first of equals."""
    return variance(points, d, mask).agg(F.max_by("pos", F.struct("value", -F.col("pos"))).alias("pos"))


def tight_box(points: DataFrame, d: int, mask: list[int] | None = None) -> DataFrame:
    """``pos, lo, hi``; one feature in ``mask`` gives its segment."""
    return by_feature(points, d, mask, lo=F.min, hi=F.max)


def longest_axis(points: DataFrame, d: int, mask: list[int] | None = None) -> DataFrame:
    spread = by_feature(points, d, mask, lo=F.min, hi=F.max)
    return spread.agg(F.max_by("pos", F.struct(F.col("hi") - F.col("lo"), -F.col("pos"))).alias("pos"))


def group_boxes(points: DataFrame, group: str, d: int) -> DataFrame:
    """``group, lo, hi`` as arrays."""
    return points.groupBy(group).agg(*[F.array(*[f(F.col("features")[k]) for k in range(d)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))])


def extremes(values: DataFrame) -> DataFrame:
    """``kind, id, value`` of the smallest and largest value of ``(id, value)``, first ids of equals."""
    row = values.agg(F.min(F.struct("value", "id")).alias("lo"), F.max(F.struct("value", -F.col("id"))).alias("hi"))
    both = F.array(F.struct(F.lit("min").alias("kind"), F.col("lo.id").alias("id"), F.col("lo.value").alias("value")), F.struct(F.lit("max").alias("kind"), (-F.col("hi.col2")).alias("id"), F.col("hi.value").alias("value")))
    return row.select(F.explode(both).alias("x")).select("x.*")


def nth(values: DataFrame, n: int, *, largest: bool = False) -> DataFrame:
    """``id, value`` at place ``n`` from 1, by value and then id. A bounded top-n, not a whole sort."""
    first = values.orderBy(F.col("value").desc() if largest else F.col("value"), "id").limit(n)
    return first.orderBy(F.col("value") if largest else F.col("value").desc(), F.col("id").desc()).limit(1).select("id", "value")


#: Up to so many rows of a group are ordered in one task; larger groups are narrowed by counts in bins first.
ONE_TASK_ROWS, BINS = 100_000, 256


def lower_medians(rows: DataFrame, scratch: Scratch, name: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``node_id, cut``: the left-rounded median of ``v`` in each group of ``rows`` (``node_id, v``); exact.

    While a group's median lies in a range of more than ``one_task_rows`` rows, one aggregation counts the range's
    rows in ``BINS`` bins and goes on with the median's bin. What is left is ordered."""
    state = rows.where(F.col("v").isNotNull()).groupBy("node_id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.select("node_id", "lo", "hi", F.expr("(n - 1) div 2").alias("rank"), "n")
    state, turn = scratch.save(state, f"{name}-0"), 0
    nth = Window.partitionBy("node_id").orderBy("bin")
    while not state.where((F.col("n") > one_task_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
        inside = rows.join(state, "node_id").where(F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
        bins = inside.withColumn("bin", F.when(F.col("lo") < F.col("hi"), place).otherwise(0)).groupBy("node_id", "rank", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = bins.withColumn("before", F.sum("n").over(nth) - F.col("n"))
        hit = bins.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        turn += 1
        state = scratch.save(hit.select("node_id", "lo", "hi", (F.col("rank") - F.col("before")).alias("rank"), "n"), f"{name}-{turn}")
    done = state.where("lo = hi").select("node_id", F.col("lo").alias("cut"))
    rest = rows.join(state.where("lo < hi"), "node_id").where(F.col("v").between(F.col("lo"), F.col("hi")))
    at = F.row_number().over(Window.partitionBy("node_id").orderBy("v")) - 1
    return done.union(rest.withColumn("at", at).where(F.col("at") == F.col("rank")).select("node_id", F.col("v").alias("cut")))


def median_split(values: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``id, side``: left of, at or right of the left-rounded median; all equal values lie on the cut's right."""
    whole = values.select(F.lit(0).cast("long").alias("node_id"), F.col("value").alias("v"))
    found = lower_medians(whole, Scratch(values.sparkSession, "median"), "median", one_task_rows).first()
    cut = F.lit(found.cut if found else None)
    return values.select("id", F.when(F.col("value") < cut, "left").otherwise("right").alias("side"))


def minmax_scores(values: DataFrame) -> DataFrame:
    """``id, value``: 1 for the smallest, 0 for the largest; 1/n each if all are equal."""
    whole = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = whole
    if lo is None:
        return values
    return values.select("id", (F.lit(1.0 / n) if lo == hi else 1 - (F.col("value") - lo) / (hi - lo)).alias("value"))


def sum_normalised(values: DataFrame) -> DataFrame:
    total = values.agg(F.sum("value")).first()[0]
    return values.select("id", (F.col("value") / F.lit(total)).alias("value"))


def transpose(points: DataFrame, most_rows: int = 10_000_000) -> DataFrame:
    """``pos, ids, features``: a row per feature with the values of all points in id order. As wide as the
    table is long: raises above ``most_rows``; ``transpose_blocks`` has no limit."""
    if (n := points.count()) > most_rows:
        raise ValueError(f"{n} points are too many for one row: use transpose_blocks")
    long = points.select("id", F.posexplode("features").alias("pos", "v"))
    pairs = F.array_sort(F.collect_list(F.struct("id", "v")))
    return long.groupBy(F.col("pos").cast("long").alias("pos")).agg(pairs.alias("p")).select("pos", F.col("p.id").alias("ids"), F.col("p.v").alias("features"))


def transpose_blocks(points: DataFrame, rows_a_block: int = 1 << 16) -> DataFrame:
    """``pos, block, ids, features``: ``transpose`` in blocks of ids, ``rows_a_block`` wide."""
    long = points.select("id", F.floor(F.col("id") / rows_a_block).cast("long").alias("block"), F.posexplode("features").alias("pos", "v"))
    pairs = F.array_sort(F.collect_list(F.struct("id", "v")))
    return long.groupBy(F.col("pos").cast("long").alias("pos"), "block").agg(pairs.alias("p")).select("pos", "block", F.col("p.id").alias("ids"), F.col("p.v").alias("features"))


def rank_values(values: DataFrame, *by: str) -> DataFrame:
    return values.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("value", "id")))
