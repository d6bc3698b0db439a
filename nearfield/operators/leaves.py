"""An index for proximity joins: points grouped by the leaves of a space partition, each with its tight box.

The partition's cuts come from a bounded sample; every point is then assigned, so boxes and results are exact. A
leaf that is too large, because many points are equal or the sample missed them, is split by a hash of the ids.
Queries visit leaves in rounds, from the nearest box on, and only while a box is nearer than the query's bound. A
round's visits are grouped by leaf, hot leaves by several groups, so a task holds one leaf and some queries. Where some
queries show that boxes admit so many leaves that visits cost more than all pairs, the rest goes by all pairs of large
blocks, with the bounds found so far.

What a driver or task holds besides is bounded: ``SAMPLE`` points, and one box for each of at most about twice
``MOST_LEAVES`` leaves (leaves grow with larger tables).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from nearfield.operators.neighbors import block_join, blocks_for, schema_of
from nearfield.plans.scratch import Scratch
from nearfield.points import matrix

LEAF, MOST_LEAVES, SAMPLE, QUERIES_A_GROUP, WIDER = 4096, 8192, 20_000, 4096, 8
#: A row dealt out costs as much as so many distances; queries that show what boxes admit; leaves visited at once.
ROW_COST, PROBE, FEW = 1000, 500, 16


class Cuts:
    """A binary space partition: at node v feature ``axis[v]`` is cut at ``cut[v]``; leaves have axis -1."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.child, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(sample, max(1, leaves))

    def _grow(self, x: np.ndarray, leaves: int) -> int:
        v = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        self.leaf.append(-1)
        spread = x.max(0) - x.min(0) if len(x) > 1 else np.zeros(1)
        if leaves > 1 and spread.max() > 0:
            f = int(spread.argmax())
            cut = float(np.sort(x[:, f])[len(x) // 2])
            low = x[:, f] < cut
            if not low.any():  # the median is the least value
                cut = float(x[x[:, f] > cut, f].min())
                low = x[:, f] < cut
            self.axis[v], self.cut[v] = f, cut
            self.child[v] = self._grow(x[low], leaves // 2), self._grow(x[~low], leaves - leaves // 2)
        else:
            self.leaf[v] = self.leaves
            self.leaves += 1
        return v

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            v, at = todo.pop()
            if self.axis[v] < 0:
                out[at] = self.leaf[v]
            elif len(at):
                low = x[at, self.axis[v]] < self.cut[v]
                todo += [(self.child[v][0], at[low]), (self.child[v][1], at[~low])]
        return out


def _assign(cuts: Cuts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield b.append_column("tree_leaf", pa.array(cuts.assign(matrix(b.column("features")))))


def box_distances(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str) -> np.ndarray:
    """The least distance of each row of ``x`` to each box."""
    total = np.zeros((len(x), len(lo)))
    for f in range(x.shape[1]):
        gap = np.maximum(np.maximum(lo[:, f] - x[:, f, None], x[:, f, None] - hi[:, f]), 0)
        total += gap if metric == "manhattan" else gap * gap
    return np.sqrt(total) if metric == "euclidean" else total


def _visits(lo: np.ndarray, hi: np.ndarray, first: int, last: int, all_of: int, metric: str, strict: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query once for each leaf among the ``first`` to ``last`` nearest; one with a bound for each of the ``first``
    to ``all_of`` nearest that it admits."""
    for b in batches:
        for s in range(0, b.num_rows, step := max(1, (1 << 20) // max(1, len(lo)))):
            part = b.slice(s, step)
            d, bound = box_distances(matrix(part.column("features")), lo, hi, metric), part.column("bound").to_numpy()
            bounded = np.flatnonzero(bound < np.inf)
            # a hair wider than the bound, as boxes and points round differently
            limit = bound[bounded, None] * (1 + 1e-9)
            i, leaf = np.nonzero(d[bounded] < limit if strict else d[bounded] <= limit)
            if first or all_of < len(lo):
                order = np.lexsort((leaf, d[bounded[i], leaf], i))
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                order = order[(nth >= first) & (nth < all_of)]
                i, leaf = i[order], leaf[order]
            i, free = bounded[i], np.flatnonzero(bound == np.inf)
            if len(free):
                near = d[free].argmin(1)[:, None] if last == 1 else np.argsort(d[free], axis=1, kind="stable")[:, first:last]
                i, leaf = np.r_[i, np.repeat(free, near.shape[1])], np.r_[leaf, near.ravel()]
                met = np.isfinite(d[i, leaf])  # a hash part may be without rows
                i, leaf = i[met], leaf[met]
            yield part.take(pa.array(i)).append_column("leaf", pa.array(leaf.astype(np.int64)))


def _with_long(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema, StructField(name, LongType())])


class Leaves:
    """The index of ``points`` (``id, features`` and further columns)."""

    def __init__(self, points: DataFrame, *, n: int | None = None, leaf: int | None = None, sample: int = SAMPLE):
        self.scratch = Scratch(points.sparkSession, "leaves")
        n = self.n = points.count() if n is None else n
        self.leaf = max(leaf or LEAF, -(-n // MOST_LEAVES))
        share = min(1.0, sample / max(1, n))
        picked = points.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30))).select("features").limit(4 * sample)
        rows = [r.features for r in picked.collect()]
        self.cuts = Cuts(np.array(rows, float), -(-n // self.leaf)) if rows else None
        if not self.cuts:
            self.rows, self.lo, self.hi = points.withColumn("leaf", F.lit(0).cast("long")), np.empty((0, 0)), np.empty((0, 0))
            if n:  # the sample is empty: one leaf
                self.cuts = Cuts(np.zeros((1, 1)), 1)
        if self.cuts:
            placed = self.scratch.save(points.mapInArrow(partial(_assign, self.cuts), _with_long(points, "tree_leaf")), "placed")
            counts = placed.groupBy("tree_leaf").agg(F.count("*").alias("n")).collect()
            parts, at = {}, 0
            for r in sorted(counts):
                parts[r.tree_leaf] = (at, -(-r.n // (2 * self.leaf)))
                at += parts[r.tree_leaf][1]
            table = points.sparkSession.createDataFrame([(k, a, m) for k, (a, m) in parts.items()], "tree_leaf long, first long, parts long")
            leaf_no = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
            self.rows = placed.join(F.broadcast(table), "tree_leaf").withColumn("leaf", leaf_no).drop("tree_leaf", "first", "parts")
            self.lo, self.hi = self._boxes(at)

    def _boxes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list[np.ndarray]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x, leaf = matrix(b.column("features")), b.column("leaf").to_numpy()
                order = np.argsort(leaf, kind="stable")
                starts = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]])
                for k, lo, hi in zip(leaf[order][starts].tolist(), np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts), strict=True):
                    found[k] = [np.minimum(found[k][0], lo), np.maximum(found[k][1], hi)] if k in found else [lo, hi]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([list(v[0]) for v in found.values()], pa.list_(pa.float64())), pa.array([list(v[1]) for v in found.values()], pa.list_(pa.float64()))], names=["leaf", "lo", "hi"])

        parts = self.rows.select("leaf", "features").mapInArrow(bounds, "leaf long, lo array<double>, hi array<double>")
        d = len(self.rows.select("features").first().features)
        best = parts.groupBy("leaf").agg(F.array(*[F.min(F.col("lo")[k]) for k in range(d)]).alias("lo"), F.array(*[F.max(F.col("hi")[k]) for k in range(d)]).alias("hi"))
        lo, hi = np.full((n, d), np.inf), np.full((n, d), -np.inf)  # a hash part without rows is infinitely far
        for r in best.collect():
            lo[r.leaf], hi[r.leaf] = r.lo, r.hi
        return lo, hi

    def _admitted(self, q: DataFrame, metric: str) -> float | None:
        """How many leaves a query with a bound meets, as some of them show; None if none has a bound."""
        some = q.where(F.col("bound") < float("inf")).orderBy(F.xxhash64("id", F.lit(31)), "id").select("features", "bound").limit(PROBE).collect()
        if not some or not len(self.lo):
            return None
        d = box_distances(np.array([r.features for r in some], float), self.lo, self.hi, metric)
        return float((d <= np.array([r.bound for r in some])[:, None] * (1 + 1e-9)).sum(1).mean())

    def _costs_all(self, admitted: float) -> bool:
        """Whether so many visits of each query cost more than all pairs by blocks."""
        return admitted * (ROW_COST + self.leaf) > self.n + ROW_COST * blocks_for(self.n, self.lo.shape[1])

    def _join(self, q: DataFrame, first: int, last: int, all_of: int, metric: str, strict: bool, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, name: str) -> DataFrame | None:
        """``run`` on each visited leaf and the queries that visit it; None if there is no visit."""
        if not len(self.lo):
            return None
        fields = schema_of(schema)
        visits = q.mapInArrow(partial(_visits, self.lo, self.hi, first, last, all_of, metric, strict), _with_long(q, "leaf"))
        visits = self.scratch.save(visits, name)
        groups = visits.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_A_GROUP).cast("long").alias("groups"))
        groups = groups.sparkSession.createDataFrame(groups.collect(), "leaf long, groups long")  # a row a leaf
        if groups.isEmpty():
            return None
        left = visits.join(F.broadcast(groups), "leaf").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups"))).drop("groups")
        right = self.rows.join(F.broadcast(groups), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            return run(a, b) if a.num_rows and b.num_rows else fields.empty_table()

        return left.groupBy("leaf", "part").cogroup(right.groupBy("leaf", "part")).applyInArrow(both, schema)

    def within(self, q: DataFrame, radius: float, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, metric: str = "euclidean") -> DataFrame:
        """``run`` on each leaf with the queries that are nearer than ``radius`` to its box."""
        asked = q.withColumn("bound", F.lit(float(radius)))
        admitted = self._admitted(asked, metric)
        if admitted is not None and self._costs_all(admitted):
            return block_join(q, self.rows.drop("leaf"), run, schema)
        found = self._join(asked, 0, len(self.lo), len(self.lo), metric, True, run, schema, "visits")
        return found if found is not None else q.sparkSession.createDataFrame([], schema)

    def nearest(self, q: DataFrame, k: int, run: Callable[[pa.Table, pa.Table], pa.Table], metric: str = "euclidean") -> DataFrame:
        """``q, id, dist, rank``: the best ``k`` of what ``run`` finds. The first round looks at the nearest leaf, each
        further one at ``WIDER`` times as many for queries that have no k-th distance yet; those that have one meet
        all leaves that it admits, or first the nearest of them if they are many."""
        infinite, schema = F.lit(float("inf")), "q long, id long, dist double"
        at, width, turn, best, left = 0, 1, 0, None, q
        rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
        while at < len(self.lo):
            asked, all_of = left.withColumn("bound", infinite), len(self.lo)
            if best is not None:
                worst = best.where(F.col("rank") == k).select(F.col("q").alias("of"), F.col("dist").alias("kth"))
                asked = left.join(worst, left["id"] == worst["of"], "left").withColumn("bound", F.coalesce("kth", infinite)).drop("of", "kth")
                admitted = self._admitted(asked, metric)
                if admitted is not None and (self._costs_all(admitted) and (turn > 2 or 2 * admitted > len(self.lo))):
                    found = block_join(asked, self.rows.drop("leaf"), run, schema)
                    found = found.union(best.join(asked.select(F.col("id").alias("q")), "q", "left_anti").select("q", "id", "dist"))
                    return self.scratch.save(found.withColumn("rank", rank).where(F.col("rank") <= k), f"best{turn}")
                if admitted is not None and admitted > FEW and turn < 3:
                    all_of = min(at + width, len(self.lo))
            found = self._join(asked, at, min(at + width, len(self.lo)), all_of, metric, False, run, schema, f"visits{turn}")
            if found is None:
                break
            if best is not None:
                found = found.union(best.select("q", "id", "dist"))
            best = self.scratch.save(found.withColumn("rank", rank).where(F.col("rank") <= k), f"best{turn}")
            if all_of == len(self.lo):  # queries with a bound are done
                left = asked.where(F.col("bound") == infinite).drop("bound")
            at, width, turn = at + width, width * WIDER, turn + 1
        return best if best is not None else q.sparkSession.createDataFrame([], "q long, id long, dist double, rank int")
