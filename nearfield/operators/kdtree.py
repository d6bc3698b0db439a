"""A space partition by axis-aligned cuts, level by level, for export and for box-pruned searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import vectors as v
from nearfield.operators.stats import lower_medians
from nearfield.plans.scratch import Scratch

#: Depth, width and feature mask to an aggregate that names a node's axis; a node's values to an aggregate cut.
AxisRule = Callable[[int, int, list[int]], Column]
SplitRule = Callable[[Column], Column]


def cycle(depth: int, d: int, mask: list[int]) -> Column:
    """The features of the mask in turn."""
    return F.lit(mask[depth % len(mask)])


def _largest(of: Callable[[int], Column], mask: list[int]) -> Column:
    scored = F.array(*[F.struct(F.coalesce(of(k), F.lit(0.0)).alias("v"), F.lit(-k).alias("k")) for k in mask])
    return -F.array_max(scored)["k"]


def highest_variance(depth: int, d: int, mask: list[int]) -> Column:
    return _largest(lambda k: F.var_samp(F.col("features")[k]), mask)


def maximum_spread(depth: int, d: int, mask: list[int]) -> Column:
    return _largest(lambda k: F.max(F.col("features")[k]) - F.min(F.col("features")[k]), mask)


def sampled_variance(depth: int, d: int, mask: list[int]) -> Column:
    """The highest variance of a tenth of the rows; of the spread where that has fewer than three."""
    some = F.pmod(F.xxhash64("id", F.lit(41)), F.lit(10)) == 0
    spread = lambda x: F.max(x) - F.min(x)
    return _largest(lambda k: F.when(F.count_if(some) >= 3, F.var_samp(F.when(some, F.col("features")[k]))).otherwise(spread(F.col("features")[k])), mask)


def midpoint(v: Column) -> Column:
    """A cut in the middle of the node's range."""
    return F.min(v) + (F.max(v) - F.min(v)) / 2


POLICIES = {"cycle": cycle, "highest_variance": highest_variance, "maximum_spread": maximum_spread, "sampled_variance": sampled_variance}
SPLITS = {"midpoint": midpoint}


def build(points: DataFrame, d: int, *, bucket_size: int = 40, max_depth: int = 16, axis: str | AxisRule = "highest_variance", split: str | SplitRule = "median", mask: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, nodes)``: ``id, features, node_id, depth`` and ``node_id, depth, axis, cut, n, lo, hi`` with null
    axis and cut for leaves. Node 1 is the root, 2v and 2v+1 the children of v; rows below the left-rounded
    median go left. A node is cut while it has more than ``bucket_size`` rows and depth is left. Two
    aggregations a level, however many nodes it has, and a few more where a node is too large to order; ``axis``
    and ``split`` may be rules of one's own."""
    rule, mask = POLICIES[axis] if isinstance(axis, str) else axis, mask or list(range(d))
    scratch = Scratch(points.sparkSession, "kdtree")
    rows, nodes, done = points.select("id", "features").withColumn("node_id", F.lit(1).cast("long")), None, None
    for depth in range(max_depth + 1):
        box = [F.array(*[f(F.col("features")[k]) for k in range(d)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
        level = rows.groupBy("node_id").agg(F.count("*").alias("n"), rule(depth, d, mask).alias("axis"), *box)
        open_ = (F.col("n") > bucket_size) & F.lit(depth < max_depth)
        level = level.withColumn("axis", F.when(open_, F.col("axis")))
        value = F.element_at("features", (F.col("axis") + 1).cast("int"))
        on_axis = rows.join(level.where(F.col("axis").isNotNull()).select("node_id", "axis"), "node_id").select("node_id", value.alias("v"))
        if split == "median":
            cuts = lower_medians(on_axis, scratch, f"median{depth}")
        else:
            cuts = on_axis.groupBy("node_id").agg((SPLITS[split] if isinstance(split, str) else split)(F.col("v")).alias("cut"))
        level = scratch.save(level.join(cuts, "node_id", "left").withColumn("depth", F.lit(depth)), f"level{depth}")
        nodes = level if nodes is None else nodes.union(level)
        at = rows.join(level.select("node_id", "axis", "cut"), "node_id")
        leaves = at.where(F.col("axis").isNull()).select("id", "features", "node_id", F.lit(depth).alias("depth"))
        done = leaves if done is None else done.union(leaves)
        inner = at.where(F.col("axis").isNotNull())
        rows = scratch.save(inner.select("id", "features", (F.col("node_id") * 2 + (value >= F.col("cut")).cast("long")).alias("node_id")), f"rows{depth}")
        if rows.isEmpty():
            break
    return done, nodes.select("node_id", "depth", "axis", "cut", "n", "lo", "hi")


def descend(points: DataFrame, nodes: DataFrame, max_depth: int = 16) -> DataFrame:
    """``id, features, node_id``: the leaf that each point falls into, left of a cut where it is smaller.
    One join a level with the nodes of that level."""
    at = points.select("id", "features").withColumn("node_id", F.lit(1).cast("long"))
    for depth in range(max_depth):
        cuts = nodes.where((F.col("depth") == depth) & F.col("axis").isNotNull()).select("node_id", "axis", "cut")
        value = F.element_at("features", (F.col("axis") + 1).cast("int"))
        child = F.when(F.col("axis").isNull(), F.col("node_id")).otherwise(F.col("node_id") * 2 + (value >= F.col("cut")).cast("long"))
        at = at.join(cuts, "node_id", "left").select("id", "features", child.alias("node_id"))
    return at


def _in_leaves(rows: DataFrame, nodes: DataFrame, keep: Column) -> DataFrame:
    leaves = nodes.where(F.col("axis").isNull() & keep).select("node_id")
    return rows.join(leaves, "node_id", "left_semi")


def box_search(rows: DataFrame, nodes: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """``id, dist`` to the centre of the closed box, for the rows inside; only leaves that meet it are read."""
    low, high = (F.array(*[F.lit(float(a)) for a in side]) for side in (lo, hi))
    found = _in_leaves(rows, nodes, v.box_box_distance(F.col("lo"), F.col("hi"), low, high) == 0)
    return found.select("id", v.box_distance(F.col("features"), low, high).alias("dist")).where(F.col("dist").isNotNull())


def ball_search(rows: DataFrame, nodes: DataFrame, centre: list[float], radius: float) -> DataFrame:
    """``id, dist`` of the rows strictly nearer than ``radius``; only leaves that come that near are read."""
    at = F.array(*[F.lit(float(a)) for a in centre])
    found = _in_leaves(rows, nodes, v.box_box_distance(F.col("lo"), F.col("hi"), at, at) < radius)
    return found.select("id", v.ball_distance(F.col("features"), at, F.lit(float(radius))).alias("dist")).where(F.col("dist").isNotNull())
