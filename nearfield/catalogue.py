"""Queries over the driver's tables, each on its whole tables, and the DuckDB SQL that checks it.

Start models (the first ten embeddings as centroids, the first five as medoids) are parameters of a query.
Floats are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import vectors as v
from nearfield.operators import density, hierarchy, kdtree, kmeans, kmedoids, neighbors, quality, sampling, stats
from nearfield.operators.assign import nth_nearest, with_nearest
from nearfield.points import collect_model, rounded, to_points
from nearfield.streaming import assign as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def embeddings(spark, sf: str, *keep: str) -> DataFrame:
    return to_points(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", *keep)


def parts(spark, sf: str, scale: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf}/part.parquet")
    return to_points(df.withColumns({"p_size": F.col("p_size") / 50.0, "p_retailprice": (F.col("p_retailprice") - 900.0) / 100.0}) if scale else df, "p_partkey", ["p_size", "p_retailprice"])


def lines(spark, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return to_points(df, "k", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def balances(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))


def start(spark, sf: str, k: int = 10) -> np.ndarray:
    return collect_model(sampling.first_rows(embeddings(spark, sf), k))[1]


def labelled(spark, sf: str) -> DataFrame:
    e = embeddings(spark, sf)
    return e.join(with_nearest(e, start(spark, sf)).select("id", "cluster"), "id")


E = "E AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
C = "C AS (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS cluster, id, x FROM E WHERE id IN (SELECT id FROM E ORDER BY id LIMIT {k}))"
#: The distance to every centroid, ranked.
RANKED = f"WITH {E}, {C}, R AS (SELECT e.id, e.x, e.label, c.cluster, list_distance(e.x, c.x) AS dist, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.x, c.x), c.cluster) AS r FROM E e, C c)"
R10, R5 = RANKED.format(k=10), RANKED.format(k=5)
PT = "P AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b FROM part)"
PS = "P AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS a, (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS b FROM part)"


# -- assignment ---------------------------------------------------------------------------------------------


@query(f"{R10} SELECT id, cluster, round(dist, 6) AS dist FROM R WHERE r = 1")
def nearest_centroid(spark, sf):
    return with_nearest(embeddings(spark, sf), start(spark, sf)).select("id", "cluster", rounded("dist").alias("dist"))


@query(f"{R10} SELECT id, round(dist, 6) AS dist FROM R WHERE r = 1")
def nearest_centroid_distance(spark, sf):
    return with_nearest(embeddings(spark, sf), start(spark, sf)).select("id", rounded("dist").alias("dist"))


@query(f"{R10} SELECT id, round(dist, 6) AS dist FROM R WHERE r = 2")
def second_nearest_centroid(spark, sf):
    ranks = nth_nearest(embeddings(spark, sf), start(spark, sf), 2, distinct=True)
    return ranks.where("rank = 2").select("id", rounded("dist").alias("dist"))


@query(f"WITH {E}, {C.format(k=10)} SELECT a.cluster, round(min(list_distance(a.x, b.x)), 6) AS dist FROM C a JOIN C b ON a.cluster <> b.cluster GROUP BY a.cluster")
def centroid_gap(spark, sf):
    c = sampling.first_rows(embeddings(spark, sf), 10)
    near = neighbors.k_nearest(c, c, 1, exclude_self=True)
    rank = F.row_number().over(Window.orderBy("q")) - 1
    return near.select(rank.cast("long").alias("cluster"), rounded("dist").alias("dist"))


@query(f"{R5} SELECT id, r::INT AS rank, cluster, round(dist, 6) AS dist FROM R WHERE r <= 3")
def nth_nearest_medoid(spark, sf):
    return nth_nearest(embeddings(spark, sf), start(spark, sf, 5), 3).select("id", "rank", "cluster", rounded("dist").alias("dist"))


@query(f"WITH {E}, {C.format(k=5)} SELECT cluster, unnest(range(64))::INT AS pos, unnest(x) AS value FROM C")
def medoids_to_centroids(spark, sf):
    e = embeddings(spark, sf)
    medoids = spark.createDataFrame([(k, k) for k in range(5)], "cluster long, id long")
    return e.join(F.broadcast(medoids), "id").select("cluster", F.posexplode("features").alias("pos", "value"))


@query(f"{R10} SELECT count(*) FILTER (cluster = label) AS matches, count(*) FILTER (cluster = label AND label = 3) AS matches_of_3 FROM R WHERE r = 1")
def match_counts(spark, sf):
    e = embeddings(spark, sf, "label").select("id", "label")
    both = with_nearest(embeddings(spark, sf), start(spark, sf)).join(e, "id")
    same = F.col("cluster") == F.col("label")
    return both.agg(F.count_if(same).alias("matches"), F.count_if(same & (F.col("label") == 3)).alias("matches_of_3"))


@query(f"{R10} SELECT c.cluster, count(r.id) AS n FROM C c LEFT JOIN R r ON r.cluster = c.cluster AND r.r = 1 GROUP BY c.cluster")
def cluster_sizes(spark, sf):
    return kmeans.cluster_sizes(with_nearest(embeddings(spark, sf), start(spark, sf)), 10)


SUMS = "U AS (SELECT cluster, unnest(range(64))::INT AS pos, unnest(x) AS v FROM R WHERE r = 1)"


@query(f"{R10}, {SUMS} SELECT cluster, pos, round(sum(v), 6) AS value FROM U GROUP BY cluster, pos")
def cluster_sums(spark, sf):
    sums = kmeans.step_sums(embeddings(spark, sf), start(spark, sf)).where("n > 0")
    return sums.select("cluster", F.posexplode("sums").alias("pos", "value")).select("cluster", "pos", rounded("value").alias("value"))


@query(f"{R10}, {SUMS} SELECT cluster, pos, min(v) AS lo, max(v) AS hi FROM U GROUP BY cluster, pos")
def cluster_boxes(spark, sf):
    boxes = stats.group_boxes(labelled(spark, sf), "cluster", D)
    return boxes.select("cluster", F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "b")).select("cluster", "pos", "b.lo", "b.hi")


# -- pairs, neighbours --------------------------------------------------------------------------------------


def _pairs(name: str, metric: str, expr: str):
    @query(f"WITH {E} SELECT a.id AS i, b.id AS j, round({expr}, 6) AS dist FROM E a JOIN E b ON a.id < b.id")
    def pairs(spark, sf):
        return neighbors.pairwise(embeddings(spark, sf), metric=metric).select("i", "j", rounded("dist").alias("dist"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("pairs"), ORACLE_SQL.pop("pairs")


_pairs("pairwise_matrix", "euclidean", "list_distance(a.x, b.x)")
_pairs("dist_sq_euclidean", "sq_euclidean", "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")
_pairs("dist_manhattan", "manhattan", "list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2])))")
_pairs("cosine_similarity", "cosine", "list_cosine_similarity(a.x, b.x)")


@query(f"WITH {E} SELECT id, round(sqrt(list_sum(list_transform(x, lambda z: z * z))), 6) AS l2, round(list_sum(list_transform(x, lambda z: abs(z))), 6) AS l1 FROM E")
def norms(spark, sf):
    return embeddings(spark, sf).select("id", rounded(v.norm(F.col("features"))).alias("l2"), rounded(v.manhattan_norm(F.col("features"))).alias("l1"))


#: DuckDB measures bytes, so each of the table's code points, under 128 of them, is written as one; else no value.
LEVENSHTEIN = """WITH U AS (SELECT item_id, generate_subscripts(string_split(text, ''), 1) AS pos, unnest(string_split(text, '')) AS c FROM benchmark),
A AS (SELECT c, row_number() OVER (ORDER BY c) AS nth FROM (SELECT DISTINCT c FROM U)),
B AS (SELECT item_id, string_agg(chr(nth::INT), '' ORDER BY pos) AS t FROM U JOIN A USING (c) GROUP BY item_id)
SELECT a.item_id AS i, b.item_id AS j, CASE WHEN (SELECT max(nth) FROM A) < 128 THEN levenshtein(a.t, b.t) END::INT AS value FROM B a JOIN B b ON a.item_id < b.item_id"""


@query(LEVENSHTEIN)
def levenshtein_items(spark, sf):
    """Whole texts by code points; a row a pair is what it asks for."""
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    a, b = b.select(F.col("item_id").alias("i"), F.col("text").alias("s")), b.select(F.col("item_id").alias("j"), F.col("text").alias("t"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", v.levenshtein(F.col("s"), F.col("t")).alias("value"))


@query(f"""WITH {E}, F AS (SELECT id AS first, x AS y FROM E ORDER BY id LIMIT 10)
SELECT e.id, f.first, round(list_sum(list_transform(list_zip(e.x, f.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS sq_euclidean, round(list_distance(e.x, f.y), 6) AS euclidean,
round(list_sum(list_transform(list_zip(e.x, f.y), lambda z: abs(z[1] - z[2]))), 6) AS manhattan, round(list_sum(list_transform(list_zip(e.x, f.y), lambda z: greatest(z[1], z[2]) - least(z[1], z[2]))), 6) AS unsigned_manhattan,
round(list_cosine_similarity(e.x, f.y), 6) AS cosine, round(list_distance(e.x, f.y), 6) AS auto, list_distance(e.x, f.y) < 1.2 AS inside FROM E e, F f""")
def distance_columns(spark, sf):
    e = embeddings(spark, sf)
    few = sampling.first_rows(e, 10).select(F.col("id").alias("first"), F.col("features").alias("y"))
    x, y = F.col("features"), F.col("y")
    made = {"sq_euclidean": v.sq_euclidean(x, y, D), "euclidean": v.euclidean(x, y, D), "manhattan": v.manhattan(x, y, D), "unsigned_manhattan": v.unsigned_manhattan(x, y, D), "cosine": v.cosine_similarity(x, y, D), "auto": v.auto_distance(x, y, "float", D)}
    return e.crossJoin(F.broadcast(few)).select("id", "first", *[rounded(c).alias(n) for n, c in made.items()], v.in_ball(x, y, F.lit(1.2), D).alias("inside"))  # ten rows on one side


@query(f"""WITH {PT} SELECT id, round(sqrt(a * a + b * b), 6) AS auto_norm, (abs(a::BIGINT - 25) + abs(floor(b)::BIGINT - 950))::BIGINT AS auto_integers, abs(a::BIGINT) + abs(floor(b)::BIGINT) AS auto_norm_integers, a + floor(b) AS unsigned_norm,
round(a - 25, 6) AS moved_a, round(b - 950, 6) AS moved_b, round(b, 6) AS only_b, (a BETWEEN 10 AND 30 AND b BETWEEN 920 AND 960) AS in_box, 0.0::DOUBLE AS unbounded, true AS in_unbounded, (abs(a - 25) <= 0.5) AS near, (abs(a - 25) > 0.5) AS far, round(CASE WHEN a = 25 THEN -1 ELSE b / (a - 25) END, 6) AS quotient,
round(greatest(0, sqrt((a - 25) ** 2 + (b - 950) ** 2) - 3), 6) AS ball_gap, 20.0::DOUBLE AS box_mid, 10.0::DOUBLE AS box_half, round(sqrt(2000), 6) AS diameter FROM P""")
def vector_functions(spark, sf):
    x, at = F.col("features"), F.array(F.lit(25.0), F.lit(950.0))
    lo, hi = F.array(F.lit(10.0), F.lit(920.0)), F.array(F.lit(30.0), F.lit(960.0))
    whole = F.transform(x, lambda c: F.floor(c).cast("long"))
    longs = F.array(F.lit(25).cast("long"), F.lit(950).cast("long"))
    moved = v.translate(at, x)
    made = {
        "auto_norm": rounded(v.auto_norm(x, "double")), "auto_integers": v.auto_distance(whole, longs, "long"), "auto_norm_integers": v.auto_norm(whole, "long"), "unsigned_norm": v.unsigned_manhattan_norm(F.transform(whole, lambda c: c.cast("double"))),
        "moved_a": rounded(moved[0]), "moved_b": rounded(moved[1]), "only_b": rounded(v.subset(x, [1])[0]), "in_box": v.in_box(x, lo, hi), "unbounded": v.unbounded_distance(), "in_unbounded": v.in_unbounded(), "near": v.near(x[0], at[0], 0.5), "far": v.differs(x[0], at[0], 0.5), "quotient": rounded(v.safe_divide(x[1], x[0] - 25, -1.0)),
        "ball_gap": rounded(v.ball_ball_distance(x, F.lit(1.0), at, F.lit(2.0))), "box_mid": v.box_centre(lo, hi)[0], "box_half": v.box_half_widths(lo, hi)[0], "diameter": rounded(v.box_diameter(lo, hi)),
    }
    return parts(spark, sf).select("id", *[c.alias(n) for n, c in made.items()])


@query(f"WITH {PT} SELECT id, round(sqrt(a * a + b * b), 6) AS radius, round(atan2(b, a), 6) AS angle FROM P")
def polar(spark, sf):
    p = v.polar(F.col("features"))
    return parts(spark, sf).select("id", rounded(p[0]).alias("radius"), rounded(p[1]).alias("angle"))


@query(f"WITH {PT} SELECT id, round(sqrt((a - 25) ** 2 + (b - 950) ** 2), 6) AS dist FROM P WHERE sqrt((a - 25) ** 2 + (b - 950) ** 2) < 20")
def ball_filter(spark, sf):
    centre = F.array(F.lit(25.0), F.lit(950.0))
    return parts(spark, sf).select("id", rounded(v.ball_distance(F.col("features"), centre, F.lit(20.0), 2)).alias("dist")).where(F.col("dist").isNotNull())


@query(f"WITH {PT} SELECT id, round(sqrt((a - 20) ** 2 + (b - 940) ** 2), 6) AS dist FROM P WHERE a BETWEEN 10 AND 30 AND b BETWEEN 920 AND 960")
def box_filter(spark, sf):
    return neighbors.within_box(parts(spark, sf), [10, 920], [30, 960]).select("id", rounded("dist").alias("dist"))


BOXES = f"WITH {PT}, B AS (SELECT p_brand AS brand, min(p_size)::DOUBLE AS la, max(p_size)::DOUBLE AS ha, min(p_retailprice) AS lb, max(p_retailprice) AS hb FROM part GROUP BY p_brand)"


@query(f"{BOXES} SELECT a.brand AS brand_a, b.brand AS brand_b, round(sqrt(greatest(b.la - a.ha, a.la - b.ha, 0) ** 2 + greatest(b.lb - a.hb, a.lb - b.hb, 0) ** 2), 6) AS gap FROM B a JOIN B b ON a.brand < b.brand")
def box_gap(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet")
    boxes = stats.group_boxes(to_points(df, "p_partkey", ["p_size", "p_retailprice"], "p_brand"), "p_brand", 2)
    a, b = (boxes.select(F.col("p_brand").alias(f"brand_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
    gap = v.box_box_distance(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))
    return a.join(b, F.col("brand_a") < F.col("brand_b")).select("brand_a", "brand_b", rounded(gap).alias("gap"))


def _knn(where: str, k: int = 5) -> str:
    return f"WITH {E}, N AS (SELECT a.id AS q, b.id, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM E a JOIN E b ON {where}) SELECT q, id, rank::INT AS rank, round(dist, 6) AS dist FROM N WHERE rank <= {k}"


@query(_knn("TRUE"))
def knn(spark, sf):
    e = embeddings(spark, sf)
    return neighbors.k_nearest(e, e, 5).select("q", "id", "rank", rounded("dist").alias("dist"))


@query(_knn("b.id NOT IN (a.id, a.id + 1)"))
def knn_excluding(spark, sf):
    e = embeddings(spark, sf)
    seen = e.select(F.col("id").alias("q"), F.explode(F.array("id", F.col("id") + 1)).alias("id"))
    return neighbors.k_nearest(e, e, 5, exclude=seen).select("q", "id", "rank", rounded("dist").alias("dist"))


@query(_knn("a.label <> b.label"))
def knn_foreign(spark, sf):
    e = embeddings(spark, sf, "label")
    return neighbors.k_nearest(e, e, 5, foreign="label").select("q", "id", "rank", rounded("dist").alias("dist"))


@query(f"WITH {PS}, N AS (SELECT x.id AS q, y.id, row_number() OVER (PARTITION BY x.id ORDER BY sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), y.id) AS rank FROM P x, P y) SELECT q, id, rank::INT AS rank FROM N WHERE rank <= 3")
def knn_ties(spark, sf):
    p = parts(spark, sf, scale=True)
    return neighbors.k_nearest(p, p, 3).select("q", "id", "rank")


@query(f"WITH {E} SELECT a.id AS q, b.id, round(list_distance(a.x, b.x), 6) AS dist FROM E a, E b WHERE list_distance(a.x, b.x) < 1.2")
def radius_join(spark, sf):
    e = embeddings(spark, sf)
    return neighbors.within_radius(e, e, 1.2).select("q", "id", rounded("dist").alias("dist"))


@query(f"WITH {PS} SELECT x.id AS q, y.id FROM P x, P y WHERE sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) < 0.015")
def radius_join_grid(spark, sf):
    p = parts(spark, sf, scale=True)
    return neighbors.within_radius_grid(p, p, 0.015, 2).select("q", "id")


@query(_knn("TRUE"))
def knn_index(spark, sf):
    """``knn`` by the leaf index, whatever the size."""
    e = embeddings(spark, sf)
    return neighbors.k_nearest(e, e, 5, index=128).select("q", "id", "rank", rounded("dist").alias("dist"))


@query(_knn("a.label <> b.label"))
def knn_foreign_index(spark, sf):
    e = embeddings(spark, sf, "label")
    return neighbors.k_nearest(e, e, 5, foreign="label", index=128).select("q", "id", "rank", rounded("dist").alias("dist"))


@query(f"WITH {PS}, Q AS (SELECT l_orderkey * 10 + l_linenumber AS q, (l_quantity / 50.0)::DOUBLE AS a, (l_discount * 10)::DOUBLE AS b FROM lineitem WHERE l_linenumber = 1), N AS (SELECT q, P.id, sqrt((Q.a - P.a) * (Q.a - P.a) + (Q.b - P.b) * (Q.b - P.b)) AS dist FROM Q, P), R AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM N) SELECT q, id, rank::INT AS rank, round(dist, 6) AS dist FROM R WHERE rank <= 2")
def knn_two_tables_index(spark, sf):
    """Other points as queries: first order lines against parts."""
    q = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber = 1")
    q = q.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array((F.col("l_quantity") / 50.0).cast("double"), (F.col("l_discount") * 10).cast("double")).alias("features"))
    return neighbors.k_nearest(q, parts(spark, sf, scale=True), 2, index=256).select("q", "id", "rank", rounded("dist").alias("dist"))


@query(f"WITH {PS} SELECT x.id AS q, y.id FROM P x, P y WHERE sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) < 0.015")
def radius_join_index(spark, sf):
    p = parts(spark, sf, scale=True)
    return neighbors.within_radius(p, p, 0.015, index=256).select("q", "id")


@query(f"WITH {E} SELECT e.id, count(*) AS n FROM E e, E f WHERE list_distance(e.x, f.x) < 1.2 GROUP BY e.id")
def neighbour_counts(spark, sf):
    return neighbors.neighbour_counts(embeddings(spark, sf), 1.2)


CLOSE = f"WITH {E}, N AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS dist FROM E a, E b WHERE a.label < 5 AND b.label >= 5)"


@query(f"{CLOSE} SELECT i, j, round(dist, 6) AS dist FROM N WHERE dist > 0 ORDER BY N.dist, i, j LIMIT 1")
def closest_pair(spark, sf):
    e = embeddings(spark, sf, "label")
    return neighbors.closest_pairs(e.where("label < 5"), e.where("label >= 5")).select("i", "j", rounded("dist").alias("dist"))


@query(f"{CLOSE} SELECT i, j, round(dist, 6) AS dist FROM N WHERE dist > 0 ORDER BY N.dist, i, j LIMIT 1 OFFSET 4")
def kth_closest_pair(spark, sf):
    e = embeddings(spark, sf, "label")
    return neighbors.closest_pairs(e.where("label < 5"), e.where("label >= 5"), 5).where("rank = 5").select("i", "j", rounded("dist").alias("dist"))


@query(f"WITH {E}, N AS (SELECT a.label, a.id AS i, b.id AS j, list_distance(a.x, b.x) AS dist FROM E a JOIN E b ON a.label <> b.label), F AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, i, j) AS r FROM N) SELECT label, i, j, round(dist, 6) AS dist FROM F WHERE r = 1")
def closest_pair_foreign(spark, sf):
    e = embeddings(spark, sf, "label")
    near = neighbors.closest_foreign(e, "label").join(e.select(F.col("id").alias("q"), "label"), "q")
    best = near.groupBy("label").agg(F.min(F.struct("dist", "q", "id")).alias("m"))
    return best.select("label", F.col("m.q").alias("i"), F.col("m.id").alias("j"), rounded("m.dist").alias("dist"))


# -- statistics ---------------------------------------------------------------------------------------------

LONG = f"WITH {E}, U AS (SELECT id, unnest(range(64)) AS pos, unnest(x) AS v FROM E)"
L4 = "WITH U AS (SELECT unnest(range(4)) AS pos, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)"


@query(f"{LONG} SELECT pos, round(avg(v), 6) AS value FROM U GROUP BY pos")
def mean_per_feature(spark, sf):
    return stats.mean(embeddings(spark, sf), D).select("pos", rounded("value").alias("value"))


@query(f"{L4} SELECT pos, round(avg(v), 4) AS value FROM U WHERE pos IN (0, 2) GROUP BY pos")
def masked_mean(spark, sf):
    return stats.mean(lines(spark, sf), 4, [0, 2]).select("pos", rounded("value", 4).alias("value"))


@query(f"{LONG} SELECT pos, round(var_samp(v), 6) AS value FROM U GROUP BY pos")
def variance_per_feature(spark, sf):
    return stats.variance(embeddings(spark, sf), D).select("pos", rounded("value").alias("value"))


@query(f"{L4} SELECT arg_max(pos, value) AS pos FROM (SELECT pos, var_samp(v) AS value FROM U WHERE pos <> 1 GROUP BY pos)")
def argmax_variance(spark, sf):
    return stats.argmax_variance(lines(spark, sf), 4, [0, 2, 3])


@query("SELECT 'min' AS kind, c_custkey AS id, c_acctbal AS value FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1) UNION ALL SELECT 'max', c_custkey, c_acctbal FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1)")
def min_max_index(spark, sf):
    return stats.extremes(balances(spark, sf))


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1 OFFSET 1")
def second_max(spark, sf):
    return stats.nth(balances(spark, sf), 2, largest=True)


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1 OFFSET 6")
def nth_smallest(spark, sf):
    return stats.nth(balances(spark, sf), 7)


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < (SELECT quantile_disc(c_acctbal, 0.5) FROM customer) THEN 'left' ELSE 'right' END AS side FROM customer")
def median_split(spark, sf):
    return stats.median_split(balances(spark, sf))


@query(f"{LONG} SELECT pos, min(v) AS lo, max(v) AS hi FROM U GROUP BY pos")
def tight_box(spark, sf):
    return stats.tight_box(embeddings(spark, sf), D)


@query(f"{L4} SELECT arg_max(pos, s) AS pos FROM (SELECT pos, max(v) - min(v) AS s FROM U GROUP BY pos)")
def longest_axis(spark, sf):
    return stats.longest_axis(lines(spark, sf), 4)


@query("SELECT c_custkey AS id, round(1 - (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS value FROM customer")
def minmax_scores(spark, sf):
    return stats.minmax_scores(balances(spark, sf)).select("id", rounded("value").alias("value"))


@query("SELECT c_custkey AS id, round(c_acctbal / sum(c_acctbal) OVER (), 9) AS value FROM customer")
def sum_normalised(spark, sf):
    return stats.sum_normalised(balances(spark, sf)).select("id", rounded("value", 9).alias("value"))


@query(f"WITH {E} SELECT id, round(list_sum(list_transform(list_zip(x, (SELECT x FROM E ORDER BY id LIMIT 1)), lambda z: least(z[1], z[2]))), 6) AS value FROM E")
def elementwise_min(spark, sf):
    first = F.array(*[F.lit(float(x)) for x in start(spark, sf, 1)[0]])
    low = v.elementwise_min(F.col("features"), first)
    return embeddings(spark, sf).select("id", rounded(F.aggregate(low, F.lit(0.0), lambda a, x: a + x)).alias("value"))


@query(f"{LONG} SELECT pos, count(*) AS n, round(list_sum(list(v * (1 + id % 7) ORDER BY id)), 6) AS weighted FROM U GROUP BY pos")
def transpose(spark, sf):
    t = stats.transpose(embeddings(spark, sf))
    total = F.aggregate(F.arrays_zip("ids", "features"), F.lit(0.0), lambda a, z: a + z["features"] * (1 + z["ids"] % 7))
    return t.select("pos", F.size("features").cast("long").alias("n"), rounded(total).alias("weighted"))


# -- partitional clustering ---------------------------------------------------------------------------------

RANKS3 = f"{R5}, T AS (SELECT id, any_value(x) AS x, arg_min(cluster, r) AS c1, max(cluster) FILTER (r = 2) AS c2, max(dist) FILTER (r = 1) AS d1, max(dist) FILTER (r = 2) AS d2, max(dist) FILTER (r = 3) AS d3 FROM R GROUP BY id)"


@query(f"{R5} SELECT round(sum(dist), 6) AS value FROM R WHERE r = 1")
def total_deviation(spark, sf):
    ranks = kmedoids.medoid_ranks(embeddings(spark, sf), start(spark, sf, 5))
    return kmedoids.total_deviation(ranks).select(rounded("value").alias("value"))


@query(f"{RANKS3} SELECT c1 AS cluster, round(sum(d2 - d1), 6) AS value FROM T GROUP BY c1")
def removal_loss(spark, sf):
    ranks = kmedoids.medoid_ranks(embeddings(spark, sf), start(spark, sf, 5))
    return kmedoids.removal_loss(ranks).select("cluster", rounded("value").alias("value"))


@query(f"{RANKS3}, L AS (SELECT c1 AS cluster, d2 / d3 - d1 / d2 AS v FROM T UNION ALL SELECT c2, d1 / d3 - d1 / d2 FROM T) SELECT cluster, round(sum(v), 6) AS value FROM L GROUP BY cluster")
def removal_loss_silhouette(spark, sf):
    ranks = kmedoids.medoid_ranks(embeddings(spark, sf), start(spark, sf, 5), 3)
    return kmedoids.removal_loss_silhouette(ranks).select("cluster", rounded("value").alias("value"))


@query(f"{R5}, S AS (SELECT c.cluster, sum(least(m.dist, list_distance(m.x, k.x)) - n.dist) AS value FROM C c JOIN (SELECT r.id, r.x, c.cluster AS gone, min(r.dist) AS dist FROM R r JOIN C c ON r.cluster <> c.cluster GROUP BY r.id, r.x, c.cluster) m ON m.gone = c.cluster JOIN R n ON n.id = m.id AND n.r = 1 CROSS JOIN (SELECT x FROM E ORDER BY id LIMIT 1 OFFSET 7) k GROUP BY c.cluster) SELECT cluster, round(value, 6) AS value FROM S")
def swap_deltas(spark, sf):
    e = embeddings(spark, sf)
    ranks = kmedoids.medoid_ranks(e, start(spark, sf, 5))
    return kmedoids.swap_deltas(e, ranks, start(spark, sf, 8)[7], 5).select("cluster", rounded("value").alias("value"))


@query(f"WITH {E}, S AS (SELECT a.id, sum(list_distance(a.x, b.x)) AS value FROM E a, E b GROUP BY a.id) SELECT id, round(value, 6) AS value FROM S ORDER BY round(S.value, 9), id LIMIT 1")
def first_medoid(spark, sf):
    return kmedoids.first_medoid(embeddings(spark, sf)).select("id", rounded("value").alias("value"))


def _lloyd_sql(steps: int) -> str:
    ctes = [E, C.format(k=10).replace("C AS", "C0 AS")]
    for k in range(steps):
        ctes.append(f"A{k} AS (SELECT id, x, cluster FROM (SELECT e.id, e.x, c.cluster, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.x, c.x), c.cluster) AS r FROM E e, C{k} c) WHERE r = 1)")
        ctes.append(f"M{k} AS (SELECT cluster, pos, avg(v) AS v FROM (SELECT cluster, unnest(range(64)) AS pos, unnest(x) AS v FROM A{k}) GROUP BY cluster, pos)")
        ctes.append(f"C{k + 1} AS (SELECT cluster, list(v ORDER BY pos) AS x FROM M{k} GROUP BY cluster)")
    return f"WITH {', '.join(ctes)} SELECT cluster, unnest(range(64))::INT AS pos, round(unnest(x), 6) AS value FROM C{steps}"


def _centroids(spark, c: np.ndarray) -> DataFrame:
    rows = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(c)], "cluster long, x array<double>")
    return rows.select("cluster", F.posexplode("x").alias("pos", "v")).select("cluster", "pos", rounded("v").alias("value"))


@query(_lloyd_sql(1))
def lloyd_step(spark, sf):
    return _centroids(spark, kmeans.lloyd_step(embeddings(spark, sf), start(spark, sf))[0])


@query(_lloyd_sql(3))
def kmeans_3_steps(spark, sf):
    fit = kmeans.KMeans(10, kmeans.KMeansOptions(max_iter=3, early_stopping=False)).fit(embeddings(spark, sf), start=start(spark, sf))
    return _centroids(spark, fit.centroids)


@query(_lloyd_sql(3))
def hamerly_3_steps(spark, sf):
    options = kmeans.KMeansOptions(max_iter=3, early_stopping=False, step="hamerly")
    return _centroids(spark, kmeans.KMeans(10, options).fit(embeddings(spark, sf), start=start(spark, sf)).centroids)


@query()
def kmeans_fit(spark, sf):
    return _centroids(spark, kmeans.KMeans(10, kmeans.KMeansOptions(max_iter=30)).fit(embeddings(spark, sf), seed=1).centroids)


@query()
def kmeanspp_init(spark, sf):
    return _centroids(spark, sampling.kmeans_plus_plus(embeddings(spark, sf), 10, seed=1))


@query()
def uniform_init(spark, sf):
    return _centroids(spark, sampling.uniform_in_box(embeddings(spark, sf), 10, D, seed=1))


@query()
def random_rows(spark, sf):
    return sampling.random_rows(embeddings(spark, sf), 20, seed=1).select("id")


@query()
def kmedoids_pam(spark, sf):
    return kmedoids.kmedoids(embeddings(spark, sf), 5, start=[0, 1, 2, 3, 4])


@query()
def kmedoids_msc(spark, sf):
    return kmedoids.kmedoids(embeddings(spark, sf), 5, method="msc", start=[0, 1, 2, 3, 4], max_iter=5)


def _build_sql(k: int) -> str:
    ctes = [E, "G AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS dist FROM E a, E b)", "B0 AS MATERIALIZED (SELECT i AS id FROM G GROUP BY i ORDER BY sum(dist), i LIMIT 1)", "N0 AS MATERIALIZED (SELECT j, dist FROM G WHERE i = (SELECT id FROM B0))"]
    for c in range(1, k):
        ctes.append(f"B{c} AS MATERIALIZED (SELECT g.i AS id FROM G g JOIN N{c - 1} n USING (j) GROUP BY g.i ORDER BY sum(greatest(n.dist - g.dist, 0)) DESC, g.i LIMIT 1)")
        ctes.append(f"N{c} AS MATERIALIZED (SELECT j, least(n.dist, g.dist) AS dist FROM N{c - 1} n JOIN G g USING (j) WHERE g.i = (SELECT id FROM B{c}))")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {c}::BIGINT AS cluster, id FROM B{c}" for c in range(k))


@query(_build_sql(5))
def pam_build(spark, sf):
    return kmedoids.kmedoids(embeddings(spark, sf), 5, method="build")


# -- silhouette ---------------------------------------------------------------------------------------------

SIL = f"""{R10}, A AS (SELECT id, x, cluster FROM R WHERE r = 1),
M AS (SELECT a.id, a.cluster AS own, b.cluster, sum(list_distance(a.x, b.x)) FILTER (a.id <> b.id) AS t, count(*) FILTER (a.id <> b.id) AS n FROM A a, A b GROUP BY a.id, a.cluster, b.cluster),
S AS (SELECT id, coalesce(max(t / n) FILTER (own = cluster AND n > 0), 0.0) AS cohesion, min(t / n) FILTER (own <> cluster) AS separation, max(n) FILTER (own = cluster) AS mates FROM M GROUP BY id),
V AS (SELECT *, CASE WHEN mates = 0 OR separation IS NULL THEN 0.0 WHEN cohesion < separation THEN 1 - cohesion / separation WHEN cohesion = separation THEN 0.0 ELSE separation / cohesion - 1 END AS s FROM S)"""


@query(f"{SIL} SELECT id, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation, round(s, 6) AS silhouette FROM V")
def silhouette(spark, sf):
    return quality.silhouette(labelled(spark, sf)).select("id", *[rounded(c).alias(c) for c in ("cohesion", "separation", "silhouette")])


@query(f"{SIL} SELECT round(avg(s), 6) AS value FROM V")
def average_silhouette(spark, sf):
    return quality.average_silhouette(labelled(spark, sf)).select(rounded("value").alias("value"))


@query(f"{CLOSE} SELECT i, j, round(dist, 6) AS dist FROM N WHERE dist > 0 ORDER BY N.dist, i, j LIMIT 1")
def closest_pair_index(spark, sf):
    """``closest_pair`` by the leaf index."""
    e = embeddings(spark, sf, "label")
    return neighbors.closest_pairs(e.where("label < 5"), e.where("label >= 5"), index=64).select("i", "j", rounded("dist").alias("dist"))


@query()
def k_sweep(spark, sf):
    return quality.k_sweep(embeddings(spark, sf), range(2, 5), seed=1)


# -- density, hierarchy -------------------------------------------------------------------------------------

DB = f"""WITH RECURSIVE {E}, NB AS (SELECT a.id AS q, b.id FROM E a, E b WHERE list_distance(a.x, b.x) < 1.2),
CORE AS (SELECT q AS id FROM NB GROUP BY q HAVING count(*) > 5),
CC AS (SELECT n.q, n.id FROM NB n JOIN CORE a ON n.q = a.id JOIN CORE b ON n.id = b.id),
REACH AS (SELECT id AS s, id FROM CORE UNION SELECT r.s, c.id FROM REACH r JOIN CC c ON c.q = r.id),
COMP AS (SELECT id, min(s) AS entry FROM REACH GROUP BY id),
RK AS (SELECT entry, row_number() OVER (ORDER BY entry) AS label FROM (SELECT DISTINCT entry FROM COMP)),
B AS (SELECT n.q AS id, min(k.label) AS label FROM NB n JOIN COMP c ON n.id = c.id JOIN RK k ON k.entry = c.entry WHERE n.q NOT IN (SELECT id FROM CORE) AND (c.entry < n.q OR n.id = c.entry) GROUP BY n.q)"""


@query(f"{DB} SELECT e.id, coalesce(k.label, b.label, 0)::BIGINT AS label FROM E e LEFT JOIN COMP c ON c.id = e.id LEFT JOIN RK k ON k.entry = c.entry LEFT JOIN B b ON b.id = e.id")
def dbscan(spark, sf):
    return density.dbscan(embeddings(spark, sf), density.DbscanOptions(radius=1.2))


@query(f"{DB} SELECT id FROM CORE")
def dbscan_core(spark, sf):
    return density.core_points(neighbors.neighbour_counts(embeddings(spark, sf), 1.2), 5)


DB2 = f"""WITH RECURSIVE {PS}, NB AS MATERIALIZED (SELECT x.id AS q, y.id FROM P x, P y WHERE sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) < 0.03),
CORE AS MATERIALIZED (SELECT q AS id FROM NB GROUP BY q HAVING count(*) > 5),
CC AS MATERIALIZED (SELECT n.q, n.id FROM NB n JOIN CORE a ON n.q = a.id JOIN CORE b ON n.id = b.id),
REACH AS (SELECT id AS s, id FROM CORE UNION SELECT r.s, c.id FROM REACH r JOIN CC c ON c.q = r.id),
COMP AS MATERIALIZED (SELECT id, min(s) AS entry FROM REACH GROUP BY id),
RK AS (SELECT entry, row_number() OVER (ORDER BY entry) AS label FROM (SELECT DISTINCT entry FROM COMP)),
B AS (SELECT n.q AS id, min(k.label) AS label FROM NB n JOIN COMP c ON n.id = c.id JOIN RK k ON k.entry = c.entry WHERE n.q NOT IN (SELECT id FROM CORE) AND (c.entry < n.q OR n.id = c.entry) GROUP BY n.q)"""


@query(f"{DB2} SELECT p.id, coalesce(k.label, b.label, 0)::BIGINT AS label FROM P p LEFT JOIN COMP c ON c.id = p.id LEFT JOIN RK k ON k.entry = c.entry LEFT JOIN B b ON b.id = p.id")
def dbscan_index(spark, sf):
    return density.dbscan(parts(spark, sf, scale=True), density.DbscanOptions(radius=0.03), index=256)


@query(f"WITH {E}, N AS (SELECT a.id, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM E a, E b) SELECT id, round(dist, 6) AS core FROM N WHERE r = 5")
def core_distance(spark, sf):
    return hierarchy.core_distances(embeddings(spark, sf), 5).select("id", rounded("core").alias("core"))


@query(f"WITH {E}, N AS MATERIALIZED (SELECT a.id, b.id AS other, list_distance(a.x, b.x) AS dist FROM E a, E b), K AS MATERIALIZED (SELECT id, dist AS core FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM N) WHERE r = 5) SELECT n.id AS i, n.other AS j, round(greatest(n.dist, a.core, b.core), 6) AS weight FROM N n JOIN K a ON a.id = n.id JOIN K b ON b.id = n.other WHERE n.id < n.other")
def mutual_reachability(spark, sf):
    e = embeddings(spark, sf)
    found = hierarchy.mutual_reachability_matrix(e, 5)
    return found.select("i", "j", rounded("weight").alias("weight"))


@query(f"WITH RECURSIVE {E}, L AS (SELECT a.id AS q, b.id FROM E a, E b WHERE list_distance(a.x, b.x) < 1.12), REACH AS (SELECT id AS s, id FROM E UNION SELECT r.s, l.id FROM REACH r JOIN L l ON l.q = r.id), G AS (SELECT id, min(s) AS c FROM REACH GROUP BY id), K AS (SELECT c, row_number() OVER (ORDER BY c) AS label FROM G GROUP BY c HAVING count(*) >= 2) SELECT g.id, coalesce(k.label, 0)::BIGINT AS label FROM G g LEFT JOIN K k ON k.c = g.c")
def single_linkage_cut(spark, sf):
    e = embeddings(spark, sf)
    return hierarchy.single_linkage_labels(e, hierarchy.spanning_tree(e), 1.12, 2)


def _tree_sql(k: int) -> str:
    """The minimum spanning tree grown from the first point: each step takes the lightest edge, by weight and ends,
    that leaves the points reached so far, which are the ones of a bit string."""
    core = "K AS MATERIALIZED (SELECT id, dist AS core FROM (SELECT i AS id, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM A) WHERE r = %d)" % k
    weight, joins = ("greatest(a.dist, p.core, q.core)", "JOIN K p ON p.id = a.i JOIN K q ON q.id = a.j") if k > 1 else ("a.dist", "")
    ctes = [E, "A AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS dist FROM E a, E b)", *([core] if k > 1 else []), "O AS MATERIALIZED (SELECT id, (row_number() OVER (ORDER BY id) - 1)::INT AS place FROM E)"]
    ctes.append(f"W AS MATERIALIZED (SELECT w.*, a.place AS pi, b.place AS pj, row_number() OVER (ORDER BY weight, i, j) AS nth FROM (SELECT a.i, a.j, {weight} AS weight FROM A a {joins} WHERE a.i < a.j) w JOIN O a ON a.id = w.i JOIN O b ON b.id = w.j)")
    step = "SELECT min(w.nth) AS nth, any_value(t.seen) AS seen FROM T t, W w WHERE get_bit(t.seen, w.pi) <> get_bit(t.seen, w.pj)"
    ctes.append(f"T AS (SELECT 0::BIGINT AS nth, set_bit(repeat('0', (SELECT count(*) FROM E)::INT)::BIT, 0, 1) AS seen UNION ALL SELECT x.nth, set_bit(set_bit(x.seen, w.pi, 1), w.pj, 1) FROM ({step}) x JOIN W w ON w.nth = x.nth)")
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT w.i, w.j, round(w.weight, 6) AS weight FROM T t JOIN W w ON w.nth = t.nth"


@query(_tree_sql(1))
def spanning_tree(spark, sf):
    return hierarchy.spanning_tree(embeddings(spark, sf)).select("i", "j", rounded("weight").alias("weight"))


@query(_tree_sql(1))
def spanning_tree_index(spark, sf):
    """``spanning_tree`` by rounds of the leaf index."""
    return hierarchy.spanning_tree(embeddings(spark, sf), index=128).select("i", "j", rounded("weight").alias("weight"))


@query(_tree_sql(5))
def spanning_tree_mr(spark, sf):
    return hierarchy.spanning_tree(embeddings(spark, sf), 5).select("i", "j", rounded("weight").alias("weight"))


@query()
def merge_tree(spark, sf):
    return hierarchy.merge_tree(hierarchy.spanning_tree(embeddings(spark, sf)))


@query()
def condensed_tree(spark, sf):
    return hierarchy.condensed_tree(hierarchy.spanning_tree(embeddings(spark, sf)), 5)


@query()
def hdbscan(spark, sf):
    return hierarchy.hdbscan(embeddings(spark, sf), k=5, min_size=5)


def _nodes_sql(levels: int, bucket: int) -> str:
    ctes = [PT, "R0 AS (SELECT id, a, b, 1::BIGINT AS node_id FROM P)"]
    for k in range(levels + 1):
        axis = f"CASE WHEN count(*) > {bucket} AND {k} < {levels} THEN CASE WHEN coalesce(var_samp(b), 0) > coalesce(var_samp(a), 0) THEN 1 ELSE 0 END END"
        ctes.append(f"L{k} AS MATERIALIZED (SELECT node_id, count(*) AS n, {axis} AS axis, quantile_disc(a, 0.5) AS ca, quantile_disc(b, 0.5) AS cb FROM R{k} GROUP BY node_id)")
        value = "CASE l.axis WHEN 0 THEN r.a ELSE r.b END >= CASE l.axis WHEN 0 THEN l.ca ELSE l.cb END"
        ctes.append(f"R{k + 1} AS MATERIALIZED (SELECT r.id, r.a, r.b, r.node_id * 2 + ({value})::BIGINT AS node_id FROM R{k} r JOIN L{k} l USING (node_id) WHERE l.axis IS NOT NULL)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT node_id, {k}::INT AS depth, coalesce(axis, -1)::INT AS axis, CASE axis WHEN 0 THEN ca WHEN 1 THEN cb END AS cut, n FROM L{k}" for k in range(levels + 1))


@query(_nodes_sql(16, 40))
def kdtree_nodes(spark, sf):
    nodes = kdtree.build(parts(spark, sf), 2)[1]
    return nodes.select("node_id", "depth", F.coalesce("axis", F.lit(-1)).cast("int").alias("axis"), "cut", "n")  # -1: a leaf


@query("SELECT p_partkey AS id, round(sqrt(pow(p_size - 15.0, 2) + pow(p_retailprice::DOUBLE - 940.0, 2)), 6) AS dist FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 920 AND 960")
def kdtree_box_search(spark, sf):
    rows, nodes = kdtree.build(parts(spark, sf), 2)
    return kdtree.box_search(rows, nodes, [10, 920], [20, 960]).select("id", rounded("dist").alias("dist"))


# -- streaming ----------------------------------------------------------------------------------------------

STREAM_MODEL = [[0.0], [20.0], [60.0], [150.0]]


@query("WITH C AS (SELECT unnest(range(4)) AS cluster, unnest([0.0, 20.0, 60.0, 150.0])::DOUBLE AS c), N AS (SELECT event_id, cluster, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - c), cluster) AS r FROM events, C WHERE value IS NOT NULL) SELECT cluster, count(*) AS n FROM N WHERE r = 1 GROUP BY cluster")
def streaming_assign(spark, sf):
    stream = streaming.assign_stream(spark, f"{sf}/events.parquet", "event_id", ["value"], np.array(STREAM_MODEL))
    return streaming.counts(streaming.run_to_table(stream))
