"""Operator 3: near-duplicate documents by a chosen-path set similarity join.

Every distinct shingle set is one class (equal sets are linked by their digest, so thousands of exact
copies cost one row). A class has a minwise signature; tree ``r`` starts by branching on coordinate ``r``.
A node of at most ``node_limit`` classes and ``shingle_limit`` shingles, which bounds a task's memory, is
compared exhaustively. A larger node is branched again on
``branch`` coordinates that its path hash selects; where the largest child keeps more than half of its node
the node is dense, branching would not shrink it, and it is cut into blocks whose pairs of blocks are
compared instead, each in its own task. Nothing is dropped at any size.

A pair is looked at in every tree whose root it shares, until one of them has compared it: a root that was
branched further may have parted it, so that the trees that follow look at it again. Signatures only rule pairs out
(where so few coordinates agree that a pair at the threshold has them with probability ``miss`` at most); each
link is confirmed on the full sets.
Within a node, links that would join what is already joined are skipped, so a node of n classes yields at
most n - 1 links. Two sets at similarity 0.85 share none of the 12 roots with probability 0.15**12 = 1e-10.

Results at the edges: a null or wordless text has no shingle, is linked with nothing and keeps its own id;
rows with a null id are linked through their text and get the smallest non-null id of their group (null if
there is none); repeated rows are copies of one another; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import WordHash, shingles, slices, sorted_runs, splitmix, whole_row
from nearfield.operators.components import connected_components
from nearfield.plans.scratch import Scratch

COORDS, TREES = 48, 12


def least_agreement(threshold: float, miss: float) -> int:
    """The most coordinates to ask for: at the threshold, fewer of them agree with probability ``miss`` at most."""
    tail = 0.0
    for k in range(COORDS):
        tail += math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k)
        if tail > miss:
            return max(1, k)
    return COORDS


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, words: WordHash, of) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, [words]):
        out = [of(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_pylist([], schema) if not out else pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _sign(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, a, b = WordHash(), splitmix(101, COORDS) | np.uint64(1), splitmix(202, COORDS)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def one(doc_id, text):
        th = None if text is None else int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)).astype(np.int64))
        s = shingles(text, width, words)
        if not len(s):
            return doc_id, th, 0, None, None
        low = ((s[:8192, None] ^ b) * a).min(axis=0)
        for k in range(8192, len(s), 8192):
            np.minimum(low, ((s[k : k + 8192, None] ^ b) * a).min(axis=0), out=low)
        return doc_id, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), (low >> np.uint64(32)).astype("<u4").tobytes()

    yield from _rows(batches, schema, words, one)


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, schema = WordHash(), pa.schema([("digest", pa.binary()), ("members", pa.binary())])
    one = lambda text: (xxhash.xxh3_128_digest(s := shingles(text, width, words).tobytes()), s)
    yield from _rows(batches, schema, words, one)


def _plausible(sig: np.ndarray, n: np.ndarray, blk: np.ndarray, tree: int, cross: bool, parted: int, i: int, lo: int, hi: int, need: int, threshold: float) -> np.ndarray:
    """Of the members lo..hi, which may be linked with i: marks and agreeing coordinates. A pair is left to an
    earlier tree whose root it shares, unless that root was branched: the bits of ``parted``, for i's roots."""
    eq = sig[lo:hi] == sig[i]
    agree = eq.sum(axis=1)
    ok = agree >= need
    if settled := [r for r in range(tree) if not parted >> r & 1]:
        ok &= ~eq[:, settled].any(axis=1)
    if cross:
        ok &= blk[lo:hi] != blk[i]
    ok &= np.minimum(n[lo:hi], n[i]) >= (threshold - 1e-9) * np.maximum(n[lo:hi], n[i])
    return np.where(ok, agree, 0)


def _sieve(need: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop from each node the members whose signature agrees enough with no other one."""
    schema = pa.schema([("path", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("blk", pa.int32()), ("tree", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("parted", pa.int32())])
    out: dict[str, list] = {f.name: [] for f in schema}

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for v in out.values():
            v.clear()
        return batch

    for g in sorted_runs(batches, ["path", "bi", "bj"]):
        m = len(g["n"])
        if m < 2:
            continue
        sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(m, COORDS)
        tree, cross, keep = int(g["tree"][0]), g["bi"][0] != g["bj"][0], np.zeros(m, bool)
        for i in range(1, m):
            hit = _plausible(sig, g["n"], g["blk"], tree, cross, int(g["parted"][i]), i, 0, i, need, threshold) > 0
            if hit.any():
                keep[:i] |= hit
                keep[i] = True
        for i in np.flatnonzero(keep).tolist():
            for k in out:
                out[k].append(g[k][i])
        if len(out["n"]) >= 4096:
            yield flush()
    yield flush()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _link(need: int, num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links that join a node's members, at most one fewer than members."""
    schema = pa.schema([("src", pa.binary()), ("dst", pa.binary())])
    src, dst = [], []
    for g in sorted_runs(batches, ["path", "bi", "bj"]):
        m = len(g["n"])
        sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(m, COORDS)
        sets = [np.frombuffer(x, np.uint64) for x in g["members"]]
        tree, cross, label = int(g["tree"][0]), g["bi"][0] != g["bj"][0], np.arange(m)
        for i in range(1, m):
            agree = _plausible(sig, g["n"], g["blk"], tree, cross, int(g["parted"][i]), i, 0, i, need, num / den)
            todo = np.flatnonzero(agree)
            todo = todo[np.argsort(-agree[todo], kind="stable")]
            while len(todo := todo[label[todo] != label[i]]):
                for at, j in enumerate(todo.tolist()):
                    both = _common(sets[i], sets[j])
                    if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        src.append(g["digest"][i])
                        dst.append(g["digest"][j])
                        label[label == label[j]] = label[i]
                        todo = todo[at + 1 :]
                        break
                else:
                    break
        if len(src) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], schema=schema)
            src, dst = [], []
    yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], schema=schema)


def _coordinate(c) -> F.Column:
    return F.substring("sig", 4 * c + 1, 4) if isinstance(c, int) else F.expr(f"substring(sig, 4 * ({c}) + 1, 4)")


def _parts(limits: tuple[int, int]) -> F.Column:
    """How many blocks a node needs for its members and their shingles to fit; 1 if it fits whole."""
    return F.greatest(F.ceil(F.col("size") / limits[0]), F.ceil(F.col("weight") / limits[1])).cast("int")


def _blocks(rows: DataFrame, limits: tuple[int, int]) -> DataFrame:
    """Each member once for every pair of blocks that its own block is in."""
    parts = _parts(limits)
    rows = rows.withColumn("parts", parts).withColumn("blk", F.pmod(F.xxhash64("digest", "path"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return rows.select("path", "tree", "digest", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "blk")


def _nodes(classes: DataFrame, scratch: Scratch, limits: tuple[int, int], branch: int, max_depth: int) -> tuple[DataFrame, DataFrame | None]:
    """``path, tree, digest, bi, bj, blk``: the nodes to compare exhaustively, whole or in pairs of blocks; and
    ``digest, parted``: the trees, as bits, whose root a class has in common with others and was branched."""
    roots = F.array(*[F.struct(F.lit(r).alias("tree"), F.xxhash64(F.lit(r), _coordinate(r)).alias("path")) for r in range(TREES)])
    level = classes.select("digest", "n", F.explode(roots).alias("x")).select("x.path", "x.tree", "digest", "n")
    shared = level.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    level = scratch.save(level.join(shared, "path"), "level0")
    whole = lambda df: df.select("path", "tree", "digest", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("blk"))
    found, per, parted = whole(level.where(_parts(limits) == 1)), (COORDS - TREES) // branch, None
    for depth in range(1, max_depth + 1):
        large = level.where(_parts(limits) > 1)
        if large.isEmpty():
            return found, parted
        if depth == max_depth:
            return found.union(_blocks(large, limits)), parted
        picks = [f"{TREES + b * per} + pmod(xxhash64(path, {b}), {per})" for b in range(branch)]
        kids = F.array(*[F.expr(f"xxhash64(path, {b}, substring(sig, 4 * cast({p} as int) + 1, 4))") for b, p in enumerate(picks)])
        kids = large.join(classes.select("digest", "sig"), "digest").select("path", "size", "tree", "digest", "n", F.explode(kids).alias("child"))
        sizes = scratch.save(kids.groupBy("path", "size", "child").agg(F.count("*").alias("kept"), F.sum("n").alias("weight")), f"sizes{depth}")
        dense = sizes.groupBy("path", "size").agg(F.max("kept").alias("kept")).select("path", (F.col("kept") * 2 > F.col("size")).alias("dense"))
        large = large.join(dense, "path")
        found = found.union(_blocks(large.where("dense"), limits))
        if depth == 1:
            parted = large.where("not dense").groupBy("digest").agg(F.bit_or(F.expr("shiftleft(1, tree)")).alias("parted"))
        open_kids = kids.join(dense.where("not dense").select("path"), "path").join(sizes.where("kept > 1").select("path", "child", "kept", "weight"), ["path", "child"])
        level = scratch.save(open_kids.select(F.col("child").alias("path"), "tree", "digest", "n", F.col("kept").alias("size"), "weight"), f"level{depth}")
        found = found.union(whole(level.where(_parts(limits) == 1)))
    return found, parted


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), *, node_limit: int = 4096, shingle_limit: int = 1 << 21, branch: int = 6, max_depth: int = 5, miss: float = 1e-8) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, first`` for every row of ``docs`` (``doc_id``, ``text``).

    ``threshold`` is the least similarity as a fraction; ``component_id`` is the smallest id that links reach.
    ``first`` marks the row of that id (of several texts the one of the smallest hash; without ids by hash alone).
    """
    num, den = threshold
    t = num / den
    need = least_agreement(t, miss)
    scratch = Scratch(docs.sparkSession, "paths")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(texts.mapInArrow(partial(_sign, width), "doc_id long, text_hash long, n_shingles long, digest binary, sig binary"), "signed")
    of_text = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(of_text).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = classes.select("digest", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "n", "sig")
    classes = scratch.save(classes, "classes")
    nodes, parted = _nodes(classes, scratch, (node_limit, shingle_limit), branch, max_depth)
    known = classes.select("digest", "n", "sig")
    known = known.withColumn("parted", F.lit(0)) if parted is None else known.join(parted, "digest", "left").fillna(0, ["parted"])
    nodes = nodes.join(known, "digest")
    keys = ["path", "bi", "bj"]
    fields = "path long, bi int, bj int, blk int, tree int, digest binary, n long, sig binary, parted int"
    sieved = nodes.select(*[x.split()[0] for x in fields.split(", ")]).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_sieve, need, t), fields)
    sieved = scratch.save(sieved, "sieved")
    wanted = sieved.select("digest").distinct().join(classes, "digest").select("rep", "rep_hash")
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("rep_hash"))
    sets = texts.join(wanted, is_rep, "left_semi").select("text").mapInArrow(partial(_sets, width), "digest binary, members binary").dropDuplicates(["digest"])
    full = sieved.join(sets, "digest").repartition(*keys).sortWithinPartitions(*keys)
    links = scratch.save(full.mapInArrow(partial(_link, need, num, den), "src binary, dst binary"), "links")
    scratch.keep("signed", "classes", "links")
    comp = connected_components(links)
    grouped = classes.join(comp, classes["digest"] == comp["node"], "left").select("digest", F.struct(F.col("rep").isNull().alias("none"), "rep", "rep_hash").alias("rep"), F.coalesce("component", "digest").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("rep").alias("first"))
    ids = grouped.join(lowest, "component").select("digest", "first")
    out = signed.select("doc_id", "text_hash", "n_shingles", "digest").join(ids, "digest", "left")
    alone = F.col("digest").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.rep"))
    first = alone | (F.col("doc_id").eqNullSafe(F.col("first.rep")) & (F.col("text_hash") == F.col("first.rep_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), first.alias("first"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the document of the smallest id of each group, and those without a word; repeated rows of one id
    and text become one, that of the smallest hash over all columns."""
    found = near_duplicates(docs, **options).where("first")
    kept = found.select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash")).distinct()
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in plain])
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hash"), order.alias("order"))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & F.col("hash").eqNullSafe(F.col("keep_hash"))
    return rows.join(kept, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", "order").alias("row")).select("row.*")


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, threshold=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
