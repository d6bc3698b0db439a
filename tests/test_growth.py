"""What larger tables need: few blocks, few visits, rows of equal features asked once, searches of any size."""

import numpy as np
import pyarrow as pa
import pytest

from nearfield.operators import density, hierarchy, kmedoids, leaves, neighbors, quality
from nearfield.plans.scratch import Scratch
from tests.test_operators import cloud, dist, frame, kruskal, sequential_dbscan  # noqa: F401


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_rows_are_dealt_few_times():
    assert neighbors.blocks_for(100_000, 64) == neighbors.blocks_for(600_000, 64) == 12
    assert neighbors.blocks_for(100_000, 2000) > 40 and neighbors.blocks_for(500) == 2


@pytest.mark.parametrize("scale", [1.0, 1e16])
def test_wide_kernels_equal_their_definition(monkeypatch, scale):
    monkeypatch.setattr(neighbors, "TILE_ROWS", 32)
    monkeypatch.setattr(neighbors, "TILE_COLUMNS", 16)
    x = unit(90, 40, 3)
    x[50:60], x[61] = x[5], x[7] + 1e-9
    x *= scale
    g, core = np.arange(90) % 4, np.random.default_rng(1).random(90) * 1.5 * scale
    t = pa.table({"id": np.arange(90), "features": pa.array(list(x)), "g": g, "core": core})
    t = pa.concat_tables([t])
    d = neighbors.exact_distances(x, x)
    away, self_ = np.where(g[:, None] == g, np.inf, d), d.copy()
    np.fill_diagonal(self_, np.inf)
    lift = np.where(g[:, None] == g, np.inf, np.maximum(np.maximum(d, core[:, None]), core))
    cases = ((d, {}), (self_, {"exclude_self": True}), (away, {"foreign": "g"}), (lift, {"foreign": "g", "lifted": True}), (np.where(d == 0, np.inf, d), {"skip_zero": True}))
    for want, options in cases:
        run = neighbors.nearest_kernel(4, "euclidean", options.pop("exclude_self", False), options.pop("foreign", None), **options)
        got = run(t, t)
        order = np.argsort(want, 1, kind="stable")[:, :4]
        assert (got.column("id").to_numpy().reshape(90, 4) == order).all()
        assert (got.column("dist").to_numpy().reshape(90, 4) == np.take_along_axis(want, order, 1)).all()
    seen = [[r, (r + 1) % 90] if r % 2 else None for r in range(90)]
    got = neighbors.nearest_kernel(3, "euclidean", False, None)(t.append_column("_seen", pa.array(seen, pa.list_(pa.int64()))), t)
    want = d.copy()
    for r, ids in enumerate(seen):
        want[r, ids or []] = np.inf
    assert (got.column("id").to_numpy().reshape(90, 3) == np.argsort(want, 1, kind="stable")[:, :3]).all()
    radius = float(np.median(d))
    assert (neighbors.radius_counts(x, x, radius) == (d < radius).sum(1)).all()
    assert sorted((i, j) for a, b, _ in neighbors.radius_chunks(x, x, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip(*map(list, np.nonzero(d < radius)), strict=True))


def test_leaves_give_way_where_boxes_say_nothing(spark, monkeypatch):
    monkeypatch.setattr(leaves, "ROW_COST", 1)
    p = frame(spark, unit(300, 40, 5)).persist()
    tree = leaves.Leaves(p, leaf=8)
    got = tree.nearest(p, 3, neighbors.nearest_kernel(3, "euclidean", False, None)).selectExpr("q", "id", "rank").collect()
    assert sorted(got) == sorted(neighbors.k_nearest(p, p, 3, index=False).selectExpr("q", "id", "rank").collect())
    assert all(name in ("placed", "visits0", "best0", "best1") for name in tree.scratch.saved)


@pytest.mark.parametrize("k", [1, 4])
def test_trees_by_lists(spark, monkeypatch, k):
    """Far groups and copies use up the lists, so that rows are searched anew."""
    monkeypatch.setattr(hierarchy, "LIST", 3)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (15, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 0), (6, 6, 1))])
    x[20:26] = x[20]
    d = dist(x)
    core = np.sort(d, 1)[:, k - 1]
    w = np.maximum(d, np.maximum(core[:, None], core)) if k > 1 else d
    rows = hierarchy.spanning_tree(frame(spark, x), k, index=8).collect()
    small = hierarchy.spanning_tree(frame(spark, x), k, index=False).collect()
    assert (sum(r.weight for r in rows), len(rows)) == (pytest.approx(kruskal(w)[0]), 59)
    assert sorted((r.i, r.j, round(r.weight, 9)) for r in rows) == sorted((r.i, r.j, round(r.weight, 9)) for r in small)


def test_medoids_beyond_one_task(spark, cloud, monkeypatch):  # noqa: F811
    x, p = cloud
    d = dist(x)
    build = [r.id for r in kmedoids.kmedoids(p, 3, method="build").orderBy("cluster").collect()]
    monkeypatch.setattr(kmedoids, "ONE_TASK", 20)
    assert [r.id for r in kmedoids.kmedoids(p, 3, method="build").orderBy("cluster").collect()] == build
    for k in (1, 2, 4):
        ratio = lambda ids: (lambda s: np.divide(s[:, 0], s[:, 1], out=np.zeros(60), where=s[:, 1] > 0).sum())(np.sort(d[:, ids], 1))
        found = [r.id for r in kmedoids.kmedoids(p, k, method="msc", start=list(range(k))).orderBy("cluster").collect()]
        if k == 1:
            assert found == [0]
        else:
            best = min(ratio([c if j == i else m for j, m in enumerate(found)]) for i in range(k) for c in range(60) if c not in found)
            assert ratio(found) <= best + 1e-9 and ratio(found) < ratio(list(range(k)))


def test_copies_are_asked_once(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "IDS_A_ROW", 3)
    monkeypatch.setattr(neighbors, "ROWS_A_TASK", 200)
    rng = np.random.default_rng(6)
    x = np.repeat(np.round(rng.random((40, 2)) * 3, 1), 4, 0)[rng.permutation(160)]
    p, d = frame(spark, x).persist(), dist(x)
    pairs = sorted(zip(*map(list, np.nonzero(d < 0.35)), strict=True))
    for found in (neighbors.within_radius(p, p, 0.35, index=16), neighbors.within_radius_grid(p, p, 0.35, 2)):
        assert sorted(map(tuple, found.select("q", "id").collect())) == pairs
    scratch = Scratch(spark, "test")
    assert neighbors.collapsed(p, scratch, "p")[0].count() < 45 and neighbors.collapsed(frame(spark, rng.random((40, 2))), scratch, "q") is None
    near = neighbors.k_nearest(p, p, 6, index=16).selectExpr("q", "id", "rank", "round(dist, 9)").collect()
    assert sorted(near) == sorted(neighbors.k_nearest(p, p, 6, index=False).selectExpr("q", "id", "rank", "round(dist, 9)").collect())
    for radius, few in ((0.15, 4), (0.25, 12)):
        labels = [r.label for r in density.dbscan(p, density.DbscanOptions(radius, few), index=16).orderBy("id").collect()]
        assert labels == sequential_dbscan(d, radius, few)


def test_pairs_are_made_with_their_weight(spark, cloud):  # noqa: F811
    x, p = cloud
    want = hierarchy.mutual_reachability(neighbors.pairwise(p), hierarchy.core_distances(p, 5))
    got = hierarchy.mutual_reachability_matrix(p, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Parquet")[0].split("CoGroup")[0]


def test_silhouettes_in_tiles(spark, cloud, monkeypatch):  # noqa: F811
    x, p = cloud
    labelled = p.selectExpr("id", "features", "CASE WHEN id < 20 THEN 0 WHEN id < 23 THEN 7 ELSE 3 END AS cluster")
    labelled = labelled.selectExpr("id", "features", "CAST(cluster AS BIGINT) AS cluster").persist()
    d, c = dist(x), np.array([0] * 20 + [7] * 3 + [3] * 37)
    got = quality.silhouette(labelled).orderBy("id").collect()
    for r in got:
        means = {k: d[r.id, (c == k) & (np.arange(60) != r.id)].mean() for k in (0, 3, 7)}
        assert (r.cohesion, r.separation) == (pytest.approx(means.pop(c[r.id])), pytest.approx(min(means.values())))
