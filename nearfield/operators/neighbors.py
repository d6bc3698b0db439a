"""Proximity joins: k nearest, radius, all pairs, closest pairs.

Small tables are dealt into blocks by a hash of their ids, and a task gets one pair of blocks as dense arrays,
computes its distances in tiles, and returns only what the operator keeps (k rows a query, pairs within a radius,
the best k edges). Blocks hold up to ``BLOCK_BYTES`` of features, so that rows are dealt few times. Large tables go
through ``leaves``: points are grouped by a space partition, and a query meets only the leaves whose boxes its bound
admits. Either way no intermediate row stands for a pair.

In many features candidates are found by single-precision products whose error is bounded, and only those are
measured exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.plans.scratch import Scratch
from nearfield.points import matrix

BLOCK, CHUNK, INDEXED_FROM = 4096, 1 << 21, 50_000
#: Features of a block, in bytes; so many blocks of a side at least, where it has so many thousand rows; a tile.
BLOCK_BYTES, LEAST_BLOCKS, TILE_ROWS, TILE_COLUMNS = 32 << 20, 12, 512, 1024
#: Ids of equal rows in one list, and the rows that a task makes of pairs of lists.
IDS_A_ROW, ROWS_A_TASK = 1024, 4_000_000
#: Up to this many features distances are summed feature by feature; beyond it by matrix products, with those
#: recomputed by differences that lie under ``NEAR`` of the norms, where products lose digits.
EXACT_WIDTH, NEAR = 32, 1e-2
METRICS = ("euclidean", "sq_euclidean", "manhattan", "cosine")


def _by_feature(a: np.ndarray, b: np.ndarray, absolute: bool, out: np.ndarray) -> None:
    """Sums over features of squared or absolute differences, a block that stays in cache at a time."""
    cols, step = np.ascontiguousarray(b.T), max(1, (1 << 17) // max(1, len(b)))
    part = np.empty((min(step, len(a)), len(b)))
    for k in range(0, len(a), step):
        x, total = a[k : k + step], out[k : k + step]
        t = part[: len(x)]
        total[:] = 0
        for f in range(a.shape[1]):
            np.subtract(x[:, f, None], cols[f], out=t)
            if absolute:
                np.abs(t, out=t)
            else:
                np.multiply(t, t, out=t)
            total += t


def _by_product(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left = np.concatenate([-2 * a, na[:, None], np.ones((len(a), 1))], 1)
    right, top = np.concatenate([b, np.ones((len(b), 1)), nb[:, None]], 1).T, np.nanmax(nb, initial=0)
    step = max(1, CHUNK // max(1, len(b)))
    for k in range(0, len(a), step):
        x, o = a[k : k + step], out[k : k + step]
        np.matmul(left[k : k + step], right, out=o)
        i, j = np.divmod(np.flatnonzero(o <= NEAR * (na[k : k + step, None] + top)), len(b))
        few = max(1, (1 << 18) // a.shape[1])
        for m in range(0, len(i), few):
            diff = x[i[m : m + few]] - b[j[m : m + few]]
            o[i[m : m + few], j[m : m + few]] = np.einsum("ij,ij->i", diff, diff)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances of the rows of ``a`` and ``b``; a few rows of ``a`` at a time, so that only the result is large."""
    out = np.empty((len(a), len(b)))
    if metric == "cosine":
        step = max(1, CHUNK // max(1, len(b)))
        for k in range(0, len(a), step):
            x = a[k : k + step]
            norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[k : k + step] = np.where(norms == 0, np.inf, (x @ b.T) / norms)
        return out
    if not out.size:
        return out
    if metric == "manhattan" or a.shape[1] <= EXACT_WIDTH:
        _by_feature(a, b, metric == "manhattan", out)
    else:
        _by_product(a, b, out)
    return np.sqrt(out, out=out) if metric == "euclidean" else out


def exact_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """``distances`` summed feature by feature at any width: rows that are equal have equal distances."""
    if metric == "cosine":
        return distances(a, b, metric)
    out = np.empty((len(a), len(b)))
    _by_feature(a, b, metric == "manhattan", out)
    return np.sqrt(out, out=out) if metric == "euclidean" else out


def paired_distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The distance of each row of ``a`` to the row of ``b`` at the same place, summed in feature order."""
    total = np.zeros(len(a))
    for f in range(a.shape[1]):
        t = a[:, f] - b[:, f]
        total += np.abs(t) if metric == "manhattan" else t * t
    return np.sqrt(total) if metric == "euclidean" else total


def tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """Parts of ``n`` rows by ``m`` columns that are small enough for a processor's cache."""
    for r in range(0, n, TILE_ROWS):
        for c in range(0, m, TILE_COLUMNS):
            yield slice(r, r + TILE_ROWS), slice(c, c + TILE_COLUMNS)


class Rough:
    """Squared distances to the rows of ``y`` in single precision, by one product a tile. ``off`` is how far those
    of a row may be from the true ones. Values too large for single precision are taken in double."""

    def __init__(self, y: np.ndarray):
        sound = np.isfinite(y).all(1)
        self.mid = y[sound].mean(0) if sound.any() else np.zeros(y.shape[1])
        z = y - self.mid
        norms = np.einsum("ij,ij->i", z, z)
        self.top = float(np.sqrt(norms[sound].max())) if sound.any() else 0.0
        self.kind = np.float32 if self.top < 1e15 else np.float64
        self.y = np.concatenate([z, np.ones((len(y), 1)), norms[:, None]], 1).T.astype(self.kind)

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``to`` takes for the rows of ``x``, and their ``off``."""
        z = x - self.mid
        norms = np.einsum("ij,ij->i", z, z)
        reach = np.sqrt(norms) + self.top
        kind = self.kind if not (reach > 1e15).any() else np.float64
        off = (x.shape[1] + 10) * float(np.finfo(kind).eps) * reach * reach
        return np.concatenate([-2 * z, norms[:, None], np.ones((len(x), 1))], 1).astype(kind), off

    def to(self, rows: np.ndarray, columns: slice) -> np.ndarray:
        return rows @ self.y[:, columns].astype(rows.dtype, copy=False)


def blocks_for(n: int, width: int = 0, block: int | None = None) -> int:
    """Enough blocks for ``block`` rows each (by default as many as their features allow), and a few for small
    tables so that tasks run side by side."""
    rows = block or max(1024, BLOCK_BYTES // (8 * width) if width else BLOCK)
    return max(-(-n // rows), min(4, -(-n // 256)), min(LEAST_BLOCKS, -(-n // 1024)), 1)


def _dealt(df: DataFrame, own: str, blocks: tuple[int, int], triangle: bool) -> DataFrame:
    """Each row once for every block of the other side; ``blocks`` are those of ``qb`` and ``pb``."""
    mine, theirs = blocks if own == "qb" else blocks[::-1]
    rows = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int"))
    rows = rows.withColumn("qb" if own == "pb" else "pb", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    return rows.where("qb <= pb") if triangle else rows


def schema_of(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def block_join(q: DataFrame, p: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, n: int | None = None, triangle: bool = False, block: int | None = None) -> DataFrame:
    """``run`` on every pair of a block of ``q`` and one of ``p`` that both have rows; with ``triangle`` (one table on both sides) on
    each unordered pair of blocks once. ``n``: the rows of both sides, where they are known; ``block``: rows of a block."""
    n_p = n if n is not None else p.count()
    first = p.select(F.size("features").alias("d")).first() if block is None else None
    d = first.d if first else 0
    blocks = blocks_for(n_p if n is not None or q is p else q.count(), d, block), blocks_for(n_p, d, block)
    fields = schema_of(schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows and right.num_rows else fields.empty_table()

    p = p.select(*[F.col(c).alias(c) for c in p.columns])  # its own columns, also where both sides are one table
    left = _dealt(q, "qb", blocks, triangle).groupBy("qb", "pb")
    return left.cogroup(_dealt(p, "pb", blocks, triangle).groupBy("qb", "pb")).applyInArrow(both, schema)


def _ids(t: pa.Table, column: str = "id") -> np.ndarray:
    return t.column(column).to_numpy()


def _places(ids: np.ndarray, some: list[int]) -> np.ndarray:
    """The places in sorted ``ids`` of those of ``some`` that are there."""
    at = np.searchsorted(ids, some)
    return at[(at < len(ids)) & (ids[at.clip(max=len(ids) - 1)] == some)] if len(some) else np.empty(0, np.int64)


def leaf_size(index: bool | int | None) -> int | None:
    """The rows a leaf that an ``index`` option asks for, if it is a number of more than 1."""
    return int(index) if index is not None and index > 1 else None


def _nearest_wide(x: np.ndarray, y: np.ndarray, k: int, metric: str, own: np.ndarray | None, groups: tuple[np.ndarray, np.ndarray] | None, seen: list | None, skip_zero: bool, cores: tuple[np.ndarray, np.ndarray] | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances of each row's ``k`` nearest, in order. ``own``: the place in ``y`` of each row itself (or
    -1), ``groups``: codes of both sides that must differ, ``seen``: places in ``y`` that don't count, a list a row,
    ``cores``: least distances of both sides, ``bound``: a distance beyond which a row asks for nothing."""
    rough, out = Rough(y), []
    far = (cores[1] ** 2).astype(rough.kind) if cores else None
    measure = lambda i, j: paired_distances(x[i], y[j], metric)
    for r in range(0, len(x), TILE_ROWS):
        rows, off = rough.rows(x[r : r + TILE_ROWS])
        m = len(rows)
        limit = np.full(m, np.inf)
        if bound is not None:
            b = bound[r : r + m]
            limit = (b if metric == "sq_euclidean" else b * b) * (1 + 1e-9) + off
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, rough.kind))]
        for c in range(0, len(y), TILE_COLUMNS):
            near = rough.to(rows, slice(c, c + TILE_COLUMNS))
            w = near.shape[1]
            if cores:
                np.maximum(near, far[c : c + w], out=near)
                np.maximum(near, (cores[0][r : r + m] ** 2).astype(near.dtype)[:, None], out=near)
            if own is not None:
                at = own[r : r + m] - c
                mine = np.flatnonzero((at >= 0) & (at < w))
                near[mine, at[mine]] = np.inf
            if seen is not None:
                for s, places in enumerate(seen[r : r + m]):
                    if len(places):
                        near[s, places[(places >= c) & (places < c + w)] - c] = np.inf
            other = groups[0][r : r + m, None] != groups[1][c : c + w] if groups else None
            if (open_ := np.flatnonzero(limit == np.inf)).size and w > k:
                some = np.where(np.isnan(near[open_]), np.inf, near[open_])
                if other is not None:
                    some[~other[open_]] = np.inf
                if skip_zero:
                    some[some <= 2 * off[open_, None]] = np.inf
                limit[open_] = np.partition(some, k - 1, axis=1)[:, k - 1] + 2 * off[open_]
            mask = near <= np.minimum(limit * (1 + 1e-6), np.finfo(near.dtype).max).astype(near.dtype)[:, None]
            if other is not None:
                mask &= other
            flat = np.flatnonzero(mask)
            if not len(flat):
                continue
            new_i, new_j = flat // w, flat % w + c
            new_d = near.ravel()[flat]
            if skip_zero and (low := np.flatnonzero(new_d <= 2 * off[new_i])).size:
                zero = low[measure(new_i[low] + r, new_j[low]) == 0]
                new_i, new_j, new_d = (np.delete(v, zero) for v in (new_i, new_j, new_d))
            held.append((new_i, new_j, new_d))
            if sum(len(h[0]) for h in held) > 4 * k * m or not c or c + w == len(y):
                i, j, d = (np.concatenate(v) for v in zip(*held, strict=True))
                order = np.lexsort((d, i))
                i, j, d = i[order], j[order], d[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                last = nth == k - 1
                limit[i[last]] = np.minimum(limit[i[last]], d[last].astype(float) + 2 * off[i[last]])
                keep = (nth < k) | (d <= limit[i] * (1 + 1e-6))
                held = [(i[keep], j[keep], d[keep])]
        i, j, _ = (np.concatenate(v) for v in zip(*held, strict=True))
        w = measure(i + r, j)
        if cores:
            w = np.maximum(np.maximum(w, cores[0][i + r]), cores[1][j])
        best = np.lexsort((j, w, i))
        nth = np.arange(len(i)) - np.searchsorted(i[best], i[best])
        best = best[nth < k]
        out.append((i[best] + r, j[best], w[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest_kernel(k: int, metric: str, exclude_self: bool, foreign: str | None, skip_zero: bool = False, lifted: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``k`` nearest rows of the right table for each row of the left one. Candidates come from ``distances``;
    those that rounding could order wrongly are compared by distances summed feature by feature. With ``lifted``
    a distance is at least the ``core`` of both rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, pi = _ids(left), _ids(right)
        order = np.argsort(pi, kind="stable")
        pi, x, y = pi[order], matrix(left.column("features")), matrix(right.column("features"))[order]
        lf, rf = (left.column(foreign).to_numpy(zero_copy_only=False), right.column(foreign).to_numpy(zero_copy_only=False)[order]) if foreign else (None, None)
        lc, rc = (left.column("core").to_numpy(), right.column("core").to_numpy()[order]) if lifted else (None, None)
        out_q, out_i, out_d = [], [], []
        skip = left.column("_seen").to_pylist() if "_seen" in left.column_names else None
        exact = metric == "cosine" or x.shape[1] <= EXACT_WIDTH
        if metric in ("euclidean", "sq_euclidean") and not exact:
            at = np.searchsorted(pi, qi).clip(max=len(pi) - 1)
            own = np.where(pi[at] == qi, at, -1) if exclude_self else None
            seen = [_places(pi, ids or []) for ids in skip] if skip is not None else None
            if foreign:
                both = pa.chunked_array([*left.column(foreign).chunks, *right.column(foreign).chunks]).combine_chunks().dictionary_encode()
                both = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            bound = left.column("bound").to_numpy() if "bound" in left.column_names else None
            i, j, w = _nearest_wide(x, y, k, metric, own, (both[: len(qi)], both[len(qi) :][order]) if foreign else None, seen, skip_zero, (lc, rc) if lifted else None, bound)
            return pa.table({"q": qi[i], "id": pi[j], "dist": w})
        step = max(1, CHUNK // len(pi))
        for s in range(0, len(qi), step):
            d = distances(x[s : s + step], y, metric)
            if lifted:
                d = np.maximum(np.maximum(d, lc[s : s + step, None]), rc)
            if exclude_self:
                d[qi[s : s + step, None] == pi[None, :]] = np.nan
            if foreign:
                d[lf[s : s + step, None] == rf[None, :]] = np.nan
            if skip_zero:
                d[d == 0] = np.nan
            if skip is not None:
                for r, ids in enumerate(skip[s : s + step]):
                    if ids:
                        d[r, np.isin(pi, ids)] = np.nan
            at = min(k, len(pi)) - 1
            worst = np.partition(d, at, axis=1)[:, at]  # nan sorts last
            worst = np.where(np.isnan(worst), np.inf, worst)
            i, j = np.nonzero(d <= worst[:, None] * (1 + 1e-9))
            w = d[i, j] if exact or lifted else paired_distances(x[s : s + step][i], y[j], metric)
            best = np.lexsort((j, w, i))
            nth = np.arange(len(i)) - np.searchsorted(i[best], i[best])
            best = best[nth < k]
            out_q.append(qi[s : s + step][i[best]])
            out_i.append(pi[j[best]])
            out_d.append(w[best])
        return pa.table({"q": np.concatenate(out_q), "id": np.concatenate(out_i), "dist": np.concatenate(out_d)})

    return run


def has_copies(points: DataFrame) -> bool:
    """Whether at least about half of the rows are copies of others' features, by a sketch of their hashes."""
    n, distinct = points.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("features"))).first()
    return 2 * distinct <= n


def collapsed(points: DataFrame, scratch: Scratch, name: str, numbered: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """``(id, features, copies)``, a row for all of equal features under a number (or their smallest id), and ``(rep,
    id)`` for every row; None where less than half of the rows are copies, so that it would not pay."""
    if not has_copies(points):
        return None
    one = points.groupBy("features").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    one = one.select((F.monotonically_increasing_id() if numbered else F.col("id")).alias("id"), "features", "copies")
    one = scratch.save(one, f"{name}-one")
    return one, scratch.save(points.select("id", "features").join(one.select(F.col("id").alias("rep"), "features"), "features").select("rep", "id"), f"{name}-all")


def k_nearest(q: DataFrame, p: DataFrame, k: int, *, metric: str = "euclidean", exclude_self: bool = False, foreign: str | None = None, exclude: DataFrame | None = None, index: bool | int | None = None, lifted: bool = False) -> DataFrame:
    """``q, id, dist, rank``: the ``k`` rows of ``p`` nearest to each row of ``q``, ties by id.

    A row is its own nearest neighbour unless ``exclude_self``. With ``foreign``, a column of both, only rows
    of another group count; ``exclude`` has pairs ``(q, id)`` that don't. ``index``: by leaves (a number: of so many
    rows), or by all pairs of blocks; by default leaves for large tables and all metrics but cosine. ``lifted``: no
    distance is less than the ``core`` of either row.

    By leaves, equal queries are asked once, and of equal rows of ``p`` those of the smallest ids stand for all.
    """
    if exclude is not None:
        seen = exclude.groupBy(F.col("q").alias("id")).agg(F.collect_set("id").alias("_seen"))
        q = q.join(seen, "id", "left")
    run, n = nearest_kernel(k, metric, exclude_self, foreign, lifted=lifted), p.count()
    if n > INDEXED_FROM and metric != "cosine" if index is None else index:
        from nearfield.operators.leaves import Leaves

        scratch, plain = Scratch(p.sparkSession, "nearest"), not (exclude_self or foreign or lifted) and exclude is None
        if exclude is None and not lifted and has_copies(p):
            nth = F.row_number().over(Window.partitionBy("features", *([foreign] if foreign else [])).orderBy("id"))
            few = scratch.save(p.withColumn("_nth", nth).where(F.col("_nth") <= k + exclude_self).drop("_nth"), "few")
            p, n = few, few.count()
        both = collapsed(q, scratch, "q") if plain else None
        found = Leaves(p, n=n, leaf=leaf_size(index)).nearest(both[0].select("id", "features") if both else q, k, run, metric)
        if not both:
            return found
        found = found.withColumnRenamed("q", "rep").join(both[1].withColumnRenamed("id", "q"), "rep").select("q", "id", "dist")
        rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))  # an id may ask with several rows
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
    found = block_join(q, p, run, "q long, id long, dist double", n=n if q is p else None)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def radius_chunks(x: np.ndarray, y: np.ndarray, radius: float, metric: str = "euclidean", groups: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of the pairs strictly nearer than ``radius``, a tile at a time, so that a dense
    neighbourhood is never held whole. ``groups`` gives codes of both sides, anew for each tile; pairs of equal ones
    are left out."""
    wide = metric in ("euclidean", "sq_euclidean") and x.shape[1] > EXACT_WIDTH
    rough = Rough(y) if wide else None
    square = radius if metric == "sq_euclidean" else radius * radius
    for s, c in tiles(len(x), len(y)):
        if not wide:
            near = distances(x[s], y[c], metric)
            mask = near <= radius * (1 + 1e-9)
        else:
            if not c.start:
                rows, off = rough.rows(x[s])
            near = rough.to(rows, c)
            mask = near <= ((square + off) * (1 + 1e-6)).astype(near.dtype)[:, None]
        if groups is not None:
            a, b = groups()
            mask &= a[s, None] != b[c]
        i, j = np.divmod(np.flatnonzero(mask), mask.shape[1])
        w = paired_distances(x[s][i], y[c][j], metric) if wide or (metric not in ("cosine",) and x.shape[1] > EXACT_WIDTH) else near[i, j]
        ok = w < radius
        yield i[ok] + s.start, j[ok] + c.start, w[ok]


def radius_counts(x: np.ndarray, y: np.ndarray, radius: float, metric: str = "euclidean", weights: np.ndarray | None = None) -> np.ndarray:
    """For each row of ``x`` how many of ``y`` (or their ``weights``) are strictly nearer than ``radius``; only pairs
    that single precision leaves open are measured exactly."""
    n = np.zeros(len(x), np.int64)
    if metric not in ("euclidean", "sq_euclidean") or x.shape[1] <= EXACT_WIDTH or weights is not None:
        for i, j, _ in radius_chunks(x, y, radius, metric):
            n += np.bincount(i, None if weights is None else weights[j], minlength=len(n)).astype(np.int64)
        return n
    rough, square = Rough(y), radius if metric == "sq_euclidean" else radius * radius
    for s, c in tiles(len(x), len(y)):
        if not c.start:
            rows, off = rough.rows(x[s])
        near = rough.to(rows, c)
        inner, outer = ((square - off) * (1 - 1e-6)).astype(near.dtype)[:, None], ((square + off) * (1 + 1e-6)).astype(near.dtype)[:, None]
        sure, maybe = near < inner, near <= outer
        n[s] += np.count_nonzero(sure, axis=1)
        i, j = np.divmod(np.flatnonzero(maybe ^ sure), maybe.shape[1])
        w = paired_distances(x[s][i], y[c][j], metric)
        n[s] += np.bincount(i[w < radius], minlength=len(rows))
    return n


def radius_join(q: DataFrame, p: DataFrame, radius: float, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, metric: str = "euclidean", index: bool | int | None = None) -> DataFrame:
    """``run`` on groups of rows that together hold every pair within ``radius``: of leaves, or of all blocks."""
    n = p.count()
    if n > INDEXED_FROM and metric != "cosine" if index is None else index:
        from nearfield.operators.leaves import Leaves

        return Leaves(p, n=n, leaf=leaf_size(index)).within(q, radius, run, schema, metric)
    return block_join(q, p, run, schema, n=n if q is p else None)


def within_radius(q: DataFrame, p: DataFrame, radius: float, *, metric: str = "euclidean", index: bool | int | None = None) -> DataFrame:
    """``q, id, dist`` of all pairs strictly nearer than ``radius``; a row is near itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(radius_chunks(matrix(left.column("features")), matrix(right.column("features")), radius, metric))
        i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"q": _ids(left)[i], "id": _ids(right)[j], "dist": d})

    def find(q: DataFrame, p: DataFrame) -> DataFrame:
        return radius_join(q, p, radius, run, "q long, id long, dist double", metric=metric, index=index)

    return _of_copies(q, p, find) if index or index is None else find(q, p)


def _of_copies(q: DataFrame, p: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``find`` of ``q, id`` and more on one row for all of equal features, where both sides have many such; every pair
    of rows comes from its pair of features and two lists of ids, so that nothing as large as the result is shuffled."""
    scratch = Scratch(p.sparkSession, "copies")
    ours = collapsed(p, scratch, "p")
    theirs = None if ours is None else ours if q is p else collapsed(q, scratch, "q")
    if theirs is None:
        return find(q, p)
    found = scratch.save(find(theirs[0].select("id", "features"), ours[0].select("id", "features")), "found").withColumnRenamed("id", "_p").withColumnRenamed("q", "_q")
    sides = []
    for name, of in (("_q", theirs), ("_p", ours)):
        nth = F.row_number().over(Window.partitionBy("rep").orderBy("id")) - 1
        some = of[1].withColumn("part", F.floor(nth / IDS_A_ROW)).groupBy(F.col("rep").alias(name), F.col("part").alias(f"{name}_part"))
        sides.append(some.agg(F.collect_list("id").alias(f"{name}_ids")))
    found = scratch.save(found.join(sides[0], "_q").join(sides[1], "_p"), "lists")
    rows = found.agg(F.sum(F.size("_q_ids").cast("long") * F.size("_p_ids"))).first()[0] or 0
    if rows > ROWS_A_TASK:
        found = found.repartition(-(-rows // ROWS_A_TASK), "_q", "_p", "_q_part", "_p_part")
    more = [c for c in found.columns if not c.startswith("_")]
    return found.withColumn("q", F.explode("_q_ids")).withColumn("id", F.explode("_p_ids")).select("q", "id", *more)


def neighbour_counts(points: DataFrame, radius: float, *, metric: str = "euclidean", index: bool | int | None = None) -> DataFrame:
    """``id, n``: how many rows lie strictly nearer than ``radius`` to each, itself counted. Pairs are counted where
    they are found and never become rows. A column ``copies`` says how many rows each stands for."""
    weighed = "copies" in points.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = matrix(left.column("features")), matrix(right.column("features"))
        n = radius_counts(x, y, radius, metric, right.column("copies").to_numpy() if weighed else None)
        at = np.flatnonzero(n)
        return pa.table({"id": _ids(left)[at], "n": n[at]})

    found = radius_join(points, points, radius, run, "id long, n long", metric=metric, index=index)
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def within_radius_grid(q: DataFrame, p: DataFrame, radius: float, d: int, rows_a_cell: int = BLOCK) -> DataFrame:
    """``within_radius`` for up to three features: cells of one radius, each query against its neighbour cells. A
    cell of more than ``rows_a_cell`` rows is split by a hash of the ids, and its queries meet every part."""
    if not 1 <= d <= 3:
        raise ValueError("the grid is for one to three features")
    return _of_copies(q, p, lambda q, p: _grid(q, p, radius, d, rows_a_cell))


def _grid(q: DataFrame, p: DataFrame, radius: float, d: int, rows_a_cell: int) -> DataFrame:
    axis = lambda k: F.floor(F.col("features")[k] / radius).cast("long")
    cells = p.select("id", F.col("features").alias("y"), F.array(*[axis(k) for k in range(d)]).alias("cell"))
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > rows_a_cell).select("cell", F.ceil(F.col("n") / rows_a_cell).alias("parts"))
    cells = cells.join(crowded, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    near = q.select(F.col("id").alias("q"), F.col("features").alias("x"), *[axis(k).alias(f"c{k}") for k in range(d)])
    for k in range(d):
        near = near.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + o for o in (-1, 0, 1)])))
    near = near.select("q", "x", F.array(*[F.col(f"c{k}") for k in range(d)]).alias("cell")).join(crowded, "cell", "left")
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dist = F.sqrt(sum(((F.col("x")[k] - F.col("y")[k]) * (F.col("x")[k] - F.col("y")[k]) for k in range(1, d)), (F.col("x")[0] - F.col("y")[0]) * (F.col("x")[0] - F.col("y")[0])))
    return near.join(cells, ["cell", "part"]).select("q", "id", dist.alias("dist")).where(F.col("dist") < radius)


def within_box(points: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """Points in the closed box with their distance to its centre."""
    from nearfield.functions import vectors as v

    bounds = [F.array(*[F.lit(float(x)) for x in side]) for side in (lo, hi)]
    return points.select("id", v.box_distance(F.col("features"), *bounds).alias("dist")).where(F.col("dist").isNotNull())


def pairwise(points: DataFrame, *, metric: str = "euclidean", block: int = BLOCK // 2, lifted: bool = False) -> DataFrame:
    """``i, j, dist`` for every ``i < j``; with ``lifted`` a distance is at least the ``core`` of both rows. Blocks
    are small, since a task holds a row for every pair of theirs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        same = left.column("qb")[0] == right.column("pb")[0]
        left, right = left.sort_by("id"), right.sort_by("id")
        qi, pi = _ids(left), _ids(right)
        x, y, parts = matrix(left.column("features")), matrix(right.column("features")), []
        for s in range(0, len(qi), TILE_ROWS):
            d = distances(x[s : s + TILE_ROWS], y, metric)
            if lifted:
                d = np.maximum(np.maximum(d, left.column("core").to_numpy()[s : s + TILE_ROWS, None]), right.column("core").to_numpy())
            i, j = np.nonzero(qi[s : s + TILE_ROWS, None] < pi) if same else np.divmod(np.arange(d.size), len(pi))
            a, b = qi[s + i], pi[j]
            parts.append(pa.table({"i": np.minimum(a, b), "j": np.maximum(a, b), "dist": d[i, j]}))
        return pa.concat_tables(parts)

    return block_join(points, points, run, "i long, j long, dist double", triangle=True, block=block)


def closest_pairs(a: DataFrame, b: DataFrame, k: int = 1, *, metric: str = "euclidean", skip_zero: bool = True, index: bool | int | None = None) -> DataFrame:
    """``i, j, dist, rank``: the ``k`` shortest edges between two sets, ties by ids. Distance 0 is passed over
    with ``skip_zero``, which leaves duplicates and, for one set on both sides, each row itself out. Large sets go
    by the leaf index: the ``k`` nearest of each row, and of those the shortest."""
    if (index if index is not None else metric != "cosine" and b.count() > INDEXED_FROM):
        from nearfield.operators.leaves import Leaves

        near = Leaves(b.select("id", "features"), leaf=leaf_size(index)).nearest(a.select("id", "features"), k, nearest_kernel(k, metric, False, None, skip_zero), metric)
        near = near.select(F.col("q").alias("i"), F.col("id").alias("j"), "dist").orderBy("dist", "i", "j").limit(k)
        return near.withColumn("rank", F.row_number().over(Window.orderBy("dist", "i", "j")))

    nearest = nearest_kernel(k, metric, False, None, skip_zero)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        near = nearest(left, right)
        return near.sort_by([("dist", "ascending"), ("q", "ascending"), ("id", "ascending")]).slice(0, k).rename_columns(["i", "j", "dist"])

    found = block_join(a, b, run, "i long, j long, dist double").orderBy("dist", "i", "j").limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("dist", "i", "j")))


def closest_foreign(points: DataFrame, group: str) -> DataFrame:
    """``q, id, dist``: the nearest row of another group, for every row."""
    return k_nearest(points, points, 1, foreign=group).select("q", "id", "dist")
