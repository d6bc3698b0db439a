"""Density clustering in closed form: a radius join, components of core points, and a border rule."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.components import connected_components, contracted
from nearfield.operators.neighbors import collapsed, neighbour_counts, radius_chunks, radius_join
from nearfield.plans.scratch import Scratch
from nearfield.points import matrix

#: So many contracted links, at most, are joined in one task, which saves most rounds.
ONE_TASK_EDGES = 2_000_000


@dataclass(frozen=True)
class DbscanOptions:
    radius: float = 0.1
    min_samples: int = 5
    #: "ordered": a border point joins what a scan in id order would give it; "adopt": any adjacent cluster.
    border: str = "ordered"


def core_points(counts: DataFrame, min_samples: int) -> DataFrame:
    """``id`` of the rows with more than ``min_samples`` rows in their open ball, themselves counted."""
    return counts.where(F.col("n") > min_samples).select("id")


def _ball_links(points: DataFrame, radius: float, index: bool | int | None) -> DataFrame:
    """``u, v, border`` from points with a ``core`` flag (1 or 0): links that connect the core points of each
    group of rows, at most one a row, and for each other row the smallest core neighbour of every such part (at
    most ``min_samples`` of them, or the row would be core)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.filter(pc.equal(t.column("core"), 1)) for t in (left, right))
        ids_a, ids_b = a.column("id").to_numpy(), b.column("id").to_numpy()
        u, v, border = [], [], []
        if not len(ids_b):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "border": pa.array([], pa.int64())})
        ids, y = np.unique(np.concatenate([ids_a, ids_b])), matrix(b.column("features"))
        label, at_a, at_b = np.arange(len(ids)), np.searchsorted(ids, ids_a), np.searchsorted(ids, ids_b)
        if len(ids_a):
            for i, j, _ in radius_chunks(matrix(a.column("features")), y, radius, groups=lambda: (label[at_a], label[at_b])):
                if not len(i):
                    continue
                tied = np.flatnonzero(label != np.arange(len(ids)))
                label = smallest_reached(np.r_[tied, at_a[i]], np.r_[label[tied], at_b[j]], len(ids))
            tied = np.flatnonzero(label != np.arange(len(ids)))
            u.append(ids[tied])
            v.append(ids[label[tied]])
            border.append(np.zeros(len(tied), np.int64))
        others = left.filter(pc.equal(left.column("core"), 0))
        if others.num_rows:
            ids_o = others.column("id").to_numpy()
            for i, j, _ in radius_chunks(matrix(others.column("features")), y, radius):
                part, near = label[at_b[j]], ids_b[j]
                order = np.lexsort((near, part, i))
                i, part, near = i[order], part[order], near[order]
                first = np.r_[True, (i[1:] != i[:-1]) | (part[1:] != part[:-1])][: len(i)]
                u.append(ids_o[i[first]])
                v.append(near[first])
                border.append(np.ones(int(first.sum()), np.int64))
        whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (u, v, border)]
        return pa.table(dict(zip(("u", "v", "border"), whole, strict=True)))

    return radius_join(points, points, radius, run, "u long, v long, border long", index=index)


def smallest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place that the links ``a - b`` reach, by hooking and shortcutting."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def dbscan(points: DataFrame, options: DbscanOptions = DbscanOptions(), index: bool | int | None = None) -> DataFrame:
    """``id, label``: clusters from 1 in order of their smallest core id, noise 0.

    Two radius joins: the first counts neighbours, the second yields at most one link a row and group of rows.
    The rank of clusters is a window over one row a cluster."""
    scratch = Scratch(points.sparkSession, "dbscan")
    points = points.select("id", "features")
    both = collapsed(points, scratch, "points", numbered=False)  # one row for all of equal features, where there are many
    whole, points = points, both[0] if both else points
    counts = neighbour_counts(points, options.radius, index=index)
    flag = counts.select("id", (F.col("n") > options.min_samples).cast("long").alias("core"))
    marked = scratch.save(points.select("id", "features").join(flag, "id", "left").fillna(0, ["core"]), "marked")
    core = marked.where("core = 1").select("id")
    links = scratch.save(_ball_links(marked, options.radius, index), "links")
    forest = scratch.save(contracted(links.where("border = 0"), "u", "v"), "forest")
    if forest.count() <= ONE_TASK_EDGES:  # one task's stars are the components
        comp = contracted(forest.coalesce(1)).toDF("node", "component")
    else:
        comp = connected_components(forest)
    comp = core.join(comp, core["id"] == comp["node"], "left").select("id", F.coalesce("component", "id").alias("entry"))
    entries = comp.select("entry").distinct().withColumn("label", F.row_number().over(Window.orderBy("entry")).cast("long"))
    comp = scratch.save(comp.join(entries, "entry"), "comp")
    scratch.keep("comp", "links", "points-all")
    border = links.where("border = 1").select(F.col("u").alias("q"), F.col("v").alias("id")).join(comp, "id")
    if both:  # entries are smallest ids of copies, so what holds for a row holds for its copies, but for the border rule
        copies = both[1].withColumnRenamed("id", "copy")
        border = border.join(copies, border["q"] == copies["rep"]).select(F.col("copy").alias("q"), "id", "entry", "label")
        comp = comp.join(copies, comp["id"] == copies["rep"]).select(F.col("copy").alias("id"), "label")
    if options.border == "ordered":  # the smallest neighbour of a part is its entry if the entry is a neighbour
        border = border.where((F.col("entry") < F.col("q")) | (F.col("id") == F.col("entry")))
    border = border.groupBy(F.col("q").alias("id")).agg(F.min("label").alias("label"))
    labelled = comp.select("id", "label").union(border)
    return whole.select("id").join(labelled, "id", "left").select("id", F.coalesce("label", F.lit(0)).cast("long").alias("label"))
