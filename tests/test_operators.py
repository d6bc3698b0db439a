"""Invariants, definitions on small inputs, and sequential partners for what SQL doesn't check."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors as v
from nearfield.operators import density, hierarchy, kdtree, kmeans, kmedoids, leaves, neighbors, quality, relational, sampling, stats
from nearfield.operators.components import connected_components, contracted
from nearfield.plans.scratch import Scratch
from nearfield.points import to_points, width
from nearfield.sources import console, datasets, files


def frame(spark, x):
    return spark.createDataFrame([(k, [float(a) for a in row]) for k, row in enumerate(x)], "id long, features array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (20, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    x[7] = x[3]
    return x, frame(spark, x).persist()


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def test_points_leave_nulls_out_and_reject_mixed_widths(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (None, [1.0, 2.0]), (2, [1.0, 2.0])], "id long, x array<float>")
    assert [r.id for r in to_points(df, "id", "x").collect()] == [2]
    with pytest.raises(ValueError):
        width(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>"))


def test_bounds(spark):
    a = lambda *x: F.array(*[F.lit(float(k)) for k in x])
    row = spark.range(1).select(v.box_box_distance(a(0, 0), a(1, 1), a(0, 2), a(10, 2)), v.ball_ball_distance(a(-10, 0), F.lit(1.0), a(10, 0), F.lit(5.0)), v.unbounded_distance(), v.box_diameter(a(0, 0), a(3, 4)), v.safe_divide(F.lit(1.0), F.lit(0.0)), v.cosine_similarity(a(0, 0), a(1, 1)), v.box_distance(a(1, 1), a(0, 0), a(2, 2))).first()
    assert tuple(row) == (1.0, 14.0, 0.0, 5.0, 0.0, float("inf"), 0.0)


def test_statistics_of_three_by_three(spark):
    p = frame(spark, np.arange(1, 10).reshape(3, 3))
    assert [r.value for r in stats.mean(p, 3).orderBy("pos").collect()] == [4, 5, 6]
    assert [r.value for r in stats.variance(p, 3).orderBy("pos").collect()] == [9, 9, 9]
    assert [r.value for r in stats.population_variance(p, 3).orderBy("pos").collect()] == [6, 6, 6]
    assert tuple(stats.tight_box(p, 3, [1]).first()) == (1, 2, 8)
    assert stats.argmax_variance(p, 3).first().pos == 0
    assert stats.variance(frame(spark, np.arange(1, 10).reshape(9, 1)), 1).first().value == 7.5


def test_constant_scores(spark):
    values = spark.createDataFrame([(k, 2.0) for k in range(4)], "id long, value double")
    assert {r.value for r in stats.minmax_scores(values).collect()} == {0.25}


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    hub = [(5, k) for k in range(6, 40)] + [(5, 5), (6, 5)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(path + hub, "src long, dst long")).collect()}
    assert {found[k] for k in range(100, 161)} == {100} and {found[k] for k in range(5, 40)} == {5}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_grid_equals_blocks(spark, cloud):
    x, p = cloud
    a, b = (sorted(map(tuple, d.select("q", "id").collect())) for d in (neighbors.within_radius_grid(p, p, 0.4, 2), neighbors.within_radius(p, p, 0.4)))
    split = sorted(map(tuple, neighbors.within_radius_grid(p, p, 0.4, 2, rows_a_cell=3).select("q", "id").collect()))
    assert a == b == split == sorted(zip(*map(list, np.nonzero(dist(x) < 0.4)), strict=True))


def test_closest_pair_passes_over_duplicates(spark, cloud):
    x, p = cloud
    d = dist(x)
    want = min((d[i, j], i, j) for i in range(60) for j in range(60) if d[i, j] > 0)
    got = neighbors.closest_pairs(p, p).first()
    assert (got.i, got.j) == want[1:] and got.dist == pytest.approx(want[0])


def sequential_dbscan(d, radius, min_samples):
    n = len(d)
    label, seen, c = [0] * n, [False] * n, 0
    for p in range(n):
        if seen[p]:
            continue
        seen[p] = True
        near = [q for q in range(n) if d[p, q] < radius]
        if len(near) <= min_samples:
            continue
        c += 1
        label[p] = c
        queue = list(near)
        for q in queue:
            if not seen[q]:
                seen[q] = True
                more = [r for r in range(n) if d[q, r] < radius]
                if len(more) > min_samples:
                    queue += [r for r in more if not seen[r]]
            if not label[q]:
                label[q] = c
    return label


@pytest.mark.parametrize("radius, index, one_task", [(0.25, True, 10**6), (0.4, True, 0), (0.25, False, 0), (0.4, False, 10**6)])
def test_dbscan_equals_the_scan_in_id_order(spark, cloud, monkeypatch, radius, index, one_task):
    x, p = cloud
    monkeypatch.setattr(density, "ONE_TASK_EDGES", one_task)
    got = [r.label for r in density.dbscan(p, density.DbscanOptions(radius, 4), index).orderBy("id").collect()]
    assert got == sequential_dbscan(dist(x), radius, 4)


def kruskal(d):
    n = len(d)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    total, edges = 0.0, 0
    for w, i, j in sorted((d[i, j], i, j) for i, j in itertools.combinations(range(n), 2)):
        if find(i) != find(j):
            parent[find(j)] = find(i)
            total, edges = total + w, edges + 1
    return total, edges


@pytest.mark.parametrize("k, one_task", [(1, 10**6), (4, 10**6), (1, 0), (4, 0)])
def test_spanning_tree_is_minimal(spark, cloud, monkeypatch, k, one_task):
    x, p = cloud
    monkeypatch.setattr(hierarchy, "ONE_TASK_EDGES", one_task)
    d = dist(x)
    core = np.sort(d, 1)[:, k - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None])) if k > 1 else d
    rows = hierarchy.spanning_tree(p, k).collect()
    assert (sum(r.weight for r in rows), len(rows)) == (pytest.approx(kruskal(w)[0]), 59)
    if one_task:
        monkeypatch.setattr(leaves, "LEAF", 8)
        found = hierarchy.spanning_tree(p, k, index=True).collect()
        assert sorted((r.i, r.j, round(r.weight, 9)) for r in found) == sorted((r.i, r.j, round(r.weight, 9)) for r in rows)


def test_hierarchies(spark, cloud):
    x, p = cloud
    tree = hierarchy.spanning_tree(p).persist()
    assert hierarchy.merge_tree(tree).agg(F.max("size")).first()[0] == 60
    cut = hierarchy.single_linkage_labels(p, tree, 1.5, 2)
    assert cut.groupBy("label").count().orderBy("label").collect() == [(1, 20), (2, 20), (3, 20)]
    labels = {r.id: r.label for r in hierarchy.hdbscan(p, k=3, min_size=8).collect()}
    groups = [{labels[i] for i in range(s, s + 20)} - {0} for s in (0, 20, 40)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert hierarchy.condensed_tree(tree, 8, allow_single=False).where("selected").count() == 3


def test_kmeans_loss_never_rises_and_empty_clusters_stay(spark, cloud):
    x, p = cloud
    c, last = np.array([[0.0, 0.0], [0.1, 0.1], [50.0, 50.0]]), np.inf
    for _ in range(5):
        c, loss = kmeans.lloyd_step(p, c)
        sq = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        assert sq <= last + 1e-9
        last = sq
    assert c[2].tolist() == [50.0, 50.0]
    fit = kmeans.KMeans(3, kmeans.KMeansOptions(n_init=3)).fit(p, seed=4)
    assert fit.predict(p).select("cluster").distinct().count() == 3


def test_medoid_searches_do_not_lose(spark, cloud):
    x, p = cloud
    d = dist(x)
    cost = lambda ids: d[:, ids].min(1).sum()
    start = [0, 1, 2]
    found = [r.id for r in kmedoids.kmedoids(p, 3, start=start).collect()]
    assert cost(found) == pytest.approx(min(cost(list(c)) for c in itertools.product(range(20), range(20, 40), range(40, 60))))
    build = [r.id for r in kmedoids.kmedoids(p, 3, method="build").collect()]
    assert cost(build) <= cost(start)
    msc = [r.id for r in kmedoids.kmedoids(p, 3, method="msc", start=start).collect()]
    ratio = lambda ids: (lambda s: np.divide(s[:, 0], s[:, 1], out=np.zeros(60), where=s[:, 1] > 0).sum())(np.sort(d[:, ids], 1))
    assert ratio(msc) <= ratio(start) and len({i // 20 for i in msc}) == 3


def test_silhouette_options(spark):
    p = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)], "id long, features array<double>, cluster long")
    got = [r.silhouette for r in quality.silhouette(p).orderBy("id").collect()]
    assert got == [pytest.approx(1 - 1 / 9), pytest.approx(1 - 1 / 8), 0.0]
    assert quality.silhouette(p, singleton_scores_one=True).orderBy("id").collect()[2].silhouette == 1.0


def test_draws_are_seeded_and_distinct(spark, cloud):
    _, p = cloud
    draw = lambda s: [r.id for r in sampling.random_rows(p, 10, s).collect()]
    assert draw(1) == draw(1) != draw(2) and len(set(draw(1))) == 10
    assert sampling.kmeans_plus_plus(p, 3, seed=2).shape == (3, 2)
    heavy = spark.createDataFrame([(k, 0.0 if k else 1.0) for k in range(9)], "id long, weight double")
    assert sampling.weighted_row(heavy).first().id == 0


def test_kdtree_cuts_at_left_rounded_medians(spark, cloud):
    x, p = cloud
    rows, nodes = kdtree.build(p, 2, bucket_size=10, axis="cycle")
    assert rows.count() == 60 and rows.groupBy("node_id").count().agg(F.max("count")).first()[0] <= 11
    root = nodes.where("node_id = 1").first()
    assert root.cut == sorted(x[:, 0])[29] and root.n == 60


def test_leaves_equal_scans_and_visit_few(spark):
    """Clustered points, equal points that no cut can part, other points as queries."""
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(c, 0.05, (120, 3)) for c in rng.random((8, 3)) * 9]), 3)
    x[100:300] = x[100]
    p, q = frame(spark, x).withColumn("g", F.col("id") % 3).persist(), frame(spark, rng.random((50, 3)) * 9).withColumn("g", F.col("id") % 3)
    tree = leaves.Leaves(p, leaf=32)
    assert len(tree.lo) > 25 and tree.rows.groupBy("leaf").count().agg(F.max("count")).first()[0] < 100
    for asked, options in ((p, {}), (p, {"exclude_self": True}), (p, {"foreign": "g"}), (q, {})):
        run = neighbors.nearest_kernel(4, "euclidean", options.get("exclude_self", False), options.get("foreign"))
        got = tree.nearest(asked, 4, run).selectExpr("q", "id", "rank", "round(dist, 9)").collect()
        assert sorted(got) == sorted(neighbors.k_nearest(asked, p, 4, index=False, **options).selectExpr("q", "id", "rank", "round(dist, 9)").collect())
    tree.nearest(p, 4, neighbors.nearest_kernel(4, "euclidean", False, None))
    visits = sum(spark.read.parquet(f"{tree.scratch.root}/visits{t}").count() for t in range(3))
    assert visits < 960 * len(tree.lo) / 4
    empty = p.limit(0)
    assert neighbors.k_nearest(p, empty, 3, index=True).count() == neighbors.k_nearest(empty, p, 3, index=True).count() == 0
    assert neighbors.within_radius(p, empty, 3.0, index=True).count() == 0


@pytest.mark.parametrize("width", [2, 40, 300])
def test_distances_equal_their_definition(width):
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(70, width)) + 3, rng.normal(size=(90, width)) + 3
    b[3], b[4], b[5] = a[6], a[6] + 1e-9, 0
    diff = a[:, None] - b[None]
    sq = (diff * diff).sum(2)
    assert np.allclose(neighbors.distances(a, b, "sq_euclidean"), sq, rtol=1e-11, atol=0) and neighbors.distances(a, b)[6, 3] == 0
    assert np.allclose(neighbors.distances(a, b), np.sqrt(sq), rtol=1e-11) and np.allclose(neighbors.distances(a, b, "manhattan"), np.abs(diff).sum(2))
    assert np.isinf(neighbors.distances(a, b, "cosine")[:, 5]).all()
    assert np.allclose(neighbors.paired_distances(a, b[:70]), np.sqrt(sq[np.arange(70), np.arange(70)]), rtol=1e-12)


def test_swaps_follow_their_definition():
    rng = np.random.default_rng(1)

    def value(d, med, ratio):
        s = np.sort(d[:, med], 1)
        return np.divide(s[:, 0], s[:, 1], out=np.zeros(len(d)), where=s[:, 1] > 0).sum() if ratio else s[:, 0].sum()

    for turn in range(24):
        x = np.round(rng.random((30, 2)), 2)
        x[5] = x[6]
        d, k = dist(x), 1 + turn % 4
        for changes, ratio in ((kmedoids._LossChanges, False), (kmedoids._RatioChanges, True)):
            if ratio and k < 2:
                continue
            near = kmedoids._Nearest(d, list(range(k)))
            sums = changes(near)
            for c in rng.permutation(np.arange(k, 30))[:5].tolist():
                delta, now = sums(d[c]), value(d, near.medoids, ratio)
                for i in range(k):
                    other = [c if j == i else m for j, m in enumerate(near.medoids)]
                    assert now + delta[i] == pytest.approx(value(d, other, ratio))
                near.swap(int(delta.argmin()), c)
                sums.refresh()
            found = (kmedoids._msc if ratio else kmedoids._pam)(d, list(range(k)), 50)
            assert all(value(d, [c if j == i else m for j, m in enumerate(found)], ratio) >= value(d, found, ratio) - 1e-9 for i in range(k) for c in range(30))


def test_medoids_in_passes(spark, cloud):
    x, p = cloud
    cost = lambda ids: dist(x)[:, ids].min(1).sum()
    for k in (1, 3):
        found = [r.id for r in kmedoids.kmedoids_in_passes(p, k, start=list(range(k))).orderBy("cluster").collect()]
        best = min(cost([c if j == i else m for j, m in enumerate(found)]) for i in range(k) for c in range(60))
        assert cost(found) <= best + 1e-9 and cost(found) < cost(list(range(k)))
    ranks = sorted(map(tuple, kmedoids.nearest_medoids(neighbors.pairwise(p), [5, 25, 45], 2).selectExpr("id", "rank", "cluster", "round(dist, 9)").collect()))
    near = dist(x)[:, [5, 25, 45]]
    order = np.argsort(near, 1, kind="stable")
    assert ranks == [(i, r + 1, int(order[i, r]), round(float(near[i, order[i, r]]), 9)) for i in range(60) for r in range(2)]


def test_medians_by_counts(spark):
    rng = np.random.default_rng(2)
    values = {0: rng.normal(size=3000), 1: np.repeat([1.0, 2.0], [700, 1300]), 2: np.array([5.0]), 3: np.exp(rng.normal(size=501) * 9)}
    rows = spark.createDataFrame([(g, float(a)) for g, x in values.items() for a in x], "node_id long, v double")
    got = {r.node_id: r.cut for r in stats.lower_medians(rows, Scratch(spark, "test"), "m", 20).collect()}
    assert got == {g: float(np.sort(x)[(len(x) - 1) // 2]) for g, x in values.items()}
    table = spark.createDataFrame([(k, float(a)) for k, a in enumerate(values[0])], "id long, value double")
    assert {r.side: r["count"] for r in stats.median_split(table, 50).groupBy("side").count().collect()} == {"left": 1499, "right": 1501}


def test_tree_rules(spark, cloud):
    x, p = cloud
    for options in ({"axis": "sampled_variance"}, {"axis": "maximum_spread", "split": "midpoint"}, {"split": lambda v: F.avg(v)}):
        rows, nodes = kdtree.build(p, 2, bucket_size=10, **options)
        assert rows.count() == 60 and nodes.where("axis IS NULL").agg(F.max("n")).first()[0] <= 11
    spread = nodes.where("node_id = 1").first()
    assert spread.cut == pytest.approx(x[:, spread.axis].mean())


def test_relational_parts(spark):
    values = spark.createDataFrame([(k, float(a)) for k, a in enumerate([7, 1, 9, 4, 4])], "id long, value double")
    some = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    assert {r.id for r in relational.members(values, some).collect()} == {1, 3} and {r.id for r in relational.non_members(values, some).collect()} == {0, 2, 4}
    order = spark.createDataFrame([(0, 4), (1, 0), (2, 4)], "pos long, id long")
    assert sorted((r.pos, r.id, r.value) for r in relational.gather(values, order).collect()) == [(0, 4, 4.0), (1, 0, 7.0), (2, 4, 4.0)]
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "i long, j long")
    assert sorted(map(tuple, relational.visited(pairs).collect())) == [(1, 2), (1, 3)]
    assert [tuple(r) for r in relational.unvisited(pairs, pairs.where("i = 3")).collect()] == [(1, 2)]
    assert tuple(relational.median_of_three(values).first()) == (0, 7.0)
    sides = {r.id: r.side for r in relational.partition_around(values, 4.0).collect()}
    assert sides == {0: "above", 1: "below", 2: "above", 3: "equal", 4: "equal"}
    points = frame(spark, [[3.0, 1.0], [1.0, 2.0], [2.0, 0.0]])
    assert [r.id for r in relational.sorted_by_feature(points, 1).collect()] == [2, 0, 1]


def test_joining_edge(spark, cloud):
    x, p = cloud
    parts, d = p.withColumn("c", (F.col("id") >= 20).cast("int")), dist(x)
    want = min((d[i, j], i, j) for i in range(20) for j in range(20, 60))
    assert tuple(hierarchy.joining_edge(parts, "c").first()) == (want[1], want[2], pytest.approx(want[0]))
    core = np.sort(d, 1)[:, 9]
    lifted = np.maximum(d, np.maximum(core[:, None], core))
    got = hierarchy.joining_edge(parts, "c", hierarchy.core_distances(p, 10)).first()
    assert got.weight == pytest.approx(lifted[:20, 20:].min()) and lifted[got.i, got.j] == pytest.approx(got.weight)
    assert hierarchy.joining_edge(p.withColumn("c", F.lit(1)), "c").count() == 0


def test_draws_have_their_moments(spark):
    f = lambda df: np.array([r.value for r in df.collect()], float)
    n = f(sampling.normal_reals(spark, 3.0, 2.0, 4000, 1))
    assert abs(n.mean() - 3) < 0.15 and abs(n.std() - 2) < 0.1
    u = f(sampling.uniform_integers(spark, -2, 2, 4000, 1))
    assert set(u) == {-2, -1, 0, 1, 2} and abs(u.mean()) < 0.1
    r = f(sampling.uniform_reals(spark, 5.0, 7.0, 4000, 1))
    assert 5 <= r.min() and r.max() < 7 and abs(r.mean() - 6) < 0.05
    b = f(sampling.binomial_integers(spark, 20, 0.3, 4000, 1))
    assert abs(b.mean() - 6) < 0.15 and b.min() >= 0 and b.max() <= 20


def test_draws_of_starts(spark, cloud):
    x, p = cloud
    assert sampling.kmeans_plus_plus(p, 3, seed=2, previous_only=True).shape == (3, 2)
    box = sampling.uniform_in_box(p, 50, 2, seed=1)
    assert (box >= x.min(0)).all() and (box <= x.max(0)).all()
    assert len(np.unique(sampling.uniform_rows(p, 5, 3), axis=0)) == 5
    assert {r.id for r in sampling.random_rows(p, 3, 1, p.where("id < 4")).collect()} <= set(range(4))
    assert {r.id for r in sampling.integers(spark, 5, 9, 4).collect()} == {5, 6, 7, 8}


def test_sizes_of_labels(spark):
    zeros = spark.createDataFrame([(k, 0) for k in range(3)], "id long, cluster long")
    assert [tuple(r) for r in kmeans.cluster_sizes(zeros).collect()] == [(0, 3)] and kmeans.cluster_sizes(zeros.limit(0)).count() == 0


def test_a_large_side_is_cut_into_blocks(spark):
    q, p = frame(spark, np.arange(3000).reshape(-1, 1)), frame(spark, np.arange(5).reshape(-1, 1))
    sizes = neighbors.block_join(q, p, lambda a, b: __import__("pyarrow").table({"n": [a.num_rows]}), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 1000
    assert neighbors.k_nearest(q, p, 2).count() == 6000


@pytest.mark.parametrize("name", sorted(datasets.DATASETS))
def test_datasets(spark, name):
    points = datasets.generate(spark, name, 90, seed=3)
    x = np.array([r.features for r in points.orderBy("id").collect()])
    assert len(x) == 90 and np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0), 10)


@pytest.mark.parametrize("name, k, min_size", [("noisy_circles", 3, 10), ("noisy_moons", 3, 10), ("blobs", 5, 15)])
def test_hierarchical_clusters_find_the_groups(spark, name, k, min_size):
    points = datasets.generate(spark, name, 240, seed=1).persist()
    labels = hierarchy.hdbscan(points.select("id", "features"), k=k, min_size=min_size, allow_single=False).where("label > 0")
    both = labels.join(points, "id").groupBy("label").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("n"))
    if name != "blobs":
        assert both.agg(F.max("groups"), F.sum("n")).first()[0] == 1
    assert both.agg(F.sum("n")).first()[0] > 150


def test_documents_and_console(spark, cloud, tmp_path):
    x, p = cloud
    rows, nodes = kdtree.build(p, 2, bucket_size=10)
    files.write_tree(rows, nodes, str(tmp_path / "tree"), bucket_size=10, axis="highest_variance")
    found = files.read_document(spark, str(tmp_path / "tree"))

    def ids(v):
        return v["ids"] if "ids" in v else ids(v["left"]) + ids(v["right"])

    assert sorted(ids(found["root"])) == list(range(60)) and found["options"]["bucket_size"] == 10 and found["samples"]["3"] == x[3].tolist()
    assert found["bounding_box"]["lo"] == x.min(0).tolist()
    tree = hierarchy.spanning_tree(p)
    merges = hierarchy.merge_tree(tree).persist()
    files.write_merges(merges, str(tmp_path / "merges"))
    root = files.read_document(spark, str(tmp_path / "merges"))["root"]
    assert root["size"] == 60 and root["left"]["size"] + root["right"]["size"] == 60
    files.write_json(merges, str(tmp_path / "rows"))
    assert files.read_json(spark, str(tmp_path / "rows")).count() == 59
    files.write_edges(tree, str(tmp_path / "edges"))
    assert spark.read.text(str(tmp_path / "edges")).count() == 59
    assert all("part-" in r.path and r.length >= 0 for r in files.list_files(spark, str(tmp_path / "edges")).collect())
    files.write_binary(p, str(tmp_path / "bin"), rows_a_file=25)
    back = np.array([r.features for r in files.read_records(spark, str(tmp_path / "bin"), 2).orderBy("id").collect()])
    assert np.allclose(back, x, atol=1e-6)
    few = frame(spark, [[0.0], [3.0], [7.0]])
    assert console.matrix_text(neighbors.pairwise(few), 1) == "0.0 3.0 7.0\n3.0 0.0 4.0\n7.0 4.0 0.0"
    small = hierarchy.spanning_tree(few)
    assert console.edges_text(small) == "0 1 3.0\n1 2 4.0"
    assert console.tree_text(hierarchy.merge_tree(small)).splitlines()[0] == "4 level 4.0 size 3"
    assert console.components_text(hierarchy.components_below(small, 3.5)) == "0: 0 1"
    with pytest.raises(ValueError):
        console.edges_text(spark.range(2000).selectExpr("id as i", "id as j", "id * 1.0 as weight"))


def test_transposes(spark, cloud):
    x, p = cloud
    rows = {r.pos: r.features for r in stats.transpose(p).collect()}
    assert rows == {0: x[:, 0].tolist(), 1: x[:, 1].tolist()}
    parts = {(r.pos, r.block): r.features for r in stats.transpose_blocks(p, 25).collect()}
    assert parts[1, 2] == x[50:, 1].tolist() and len(parts) == 6
    with pytest.raises(ValueError):
        stats.transpose(p, 10)


def test_files_round_trip(spark, cloud, tmp_path):
    x, p = cloud
    files.write_text(p, str(tmp_path / "t.txt"))
    back = np.array([r.features for r in files.read_points(spark, str(tmp_path / "t.txt")).orderBy("id").collect()])
    assert back.tolist() == x.tolist() and files.text_width(spark, str(tmp_path / "t.txt")) == 2
    raw = files.packed(p).first().content
    (tmp_path / "p.bin").write_bytes(raw)
    back = files.read_points(spark, str(tmp_path / "p.bin"), n_features=2).orderBy("row").collect()
    assert np.allclose([r.features for r in back], x, atol=1e-6)
    with pytest.raises(ValueError):
        files.read_points(spark, "x.csv")


def test_bounded_steps_equal_plain_steps(spark, cloud):
    x, p = cloud
    fits = [kmeans.KMeans(3, kmeans.KMeansOptions(max_iter=20, step=s)).fit(p, start=x[[0, 1, 25]]) for s in ("lloyd", "hamerly")]
    assert np.allclose(fits[0].centroids, fits[1].centroids) and fits[0].loss == pytest.approx(fits[1].loss)
    with pytest.raises(ValueError):
        kmeans.KMeans(3, kmeans.KMeansOptions(step="other")).fit(p, start=x[:3])


def test_medoids_from_points_and_from_their_distances(spark, cloud):
    x, p = cloud
    own, given = kmedoids.KMedoids(3, n_init=2).fit(p), kmedoids.KMedoids(3).fit(p, pairs=neighbors.pairwise(p))
    assert own.loss <= given.loss + 1e-9 and sorted(given.ids) == sorted(kmedoids.KMedoids(3).fit(p).ids)
    near = dist(x)[:, own.ids]
    assert own.loss == pytest.approx(near.min(1).sum())
    assert [r.cluster for r in own.predict(p).orderBy("id").collect()] == near.argmin(1).tolist()
    assert [r.dist for r in own.forward(p).orderBy("id").collect()] == pytest.approx(near.min(1).tolist())


def test_tree_searches_equal_scans(spark, cloud):
    x, p = cloud
    rows, nodes = kdtree.build(p, 2, bucket_size=8, max_depth=5)
    rows, nodes = rows.persist(), nodes.persist()
    assert sorted(kdtree.descend(p, nodes, 5).select("id", "node_id").collect()) == sorted(rows.select("id", "node_id").collect())
    box = {r.id for r in kdtree.box_search(rows, nodes, [-0.3, -0.3], [4.1, 0.2]).collect()}
    assert box == set(np.flatnonzero(((x >= [-0.3, -0.3]) & (x <= [4.1, 0.2])).all(1)).tolist())
    ball = {r.id: r.dist for r in kdtree.ball_search(rows, nodes, [3.8, 0.1], 0.5).collect()}
    d = np.sqrt(((x - [3.8, 0.1]) ** 2).sum(1))
    assert ball == pytest.approx({k: d[k] for k in np.flatnonzero(d < 0.5).tolist()})


def test_contraction_keeps_components(spark):
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(60)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    want = {tuple(r) for r in connected_components(df).collect()}
    assert {tuple(r) for r in connected_components(contracted(df)).collect()} == want
    assert {tuple(r) for r in connected_components(contracted(df.coalesce(1))).collect()} == want


def test_unsigned_distances(spark):
    a = lambda *x: F.array(*[F.lit(k) for k in x])
    assert tuple(spark.range(1).select(v.unsigned_manhattan(a(1, 9), a(4, 2)), v.unsigned_manhattan_norm(a(4, 2))).first()) == (10.0, 6.0)
