"""Connected components by alternating large-star and small-star rounds.

The edge list never leaves the executors. Each half round is one grouped minimum, combined before the
shuffle, and one join back on the same key, which adaptive execution can split when a hub holds a large
share of all edges. A round's edges go to a scratch table, and the loop ends when the edge set repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.plans.scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's long edges as stars round the smallest node of each of its components: one edge a node."""
    parent: dict[int, int] = {}
    for b in batches:
        for ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            roots = []
            for x in ends:
                parent.setdefault(x, x)
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                roots.append(x)
            parent[max(roots)] = min(roots)
    u, v = [], []
    for x in sorted(parent):  # parents are smaller, so theirs is final
        parent[x] = parent[parent[x]]
        if parent[x] != x:
            u.append(x)
            v.append(parent[x])
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``src, dst`` with the same components as the long ``edges``, at most one edge a node and task, so that
    what dense neighbourhoods hold never reaches a shuffle. A task's memory grows with its nodes alone."""
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    return pairs.mapInArrow(_forest, "u long, v long").select(F.col("u").alias("src"), F.col("v").alias("dst"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; ``component`` is the smallest node id reached.

    Loops and repeated edges are allowed; an edge with a null end is ignored. Nodes may be of any orderable
    type. Rounds grow with the logarithm of the longest path; ``max_rounds`` is a guard that raises.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = scratch.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "r0")
    seen = None
    for k in range(1, max_rounds + 1):
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        e = scratch.save(_small_star(_large_star(e)), f"r{k}")
        if k > 1:
            scratch.drop(f"r{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
