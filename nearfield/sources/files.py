"""Point files: delimited text, packed binary, and JSON exports.

The row number is the id, as a file has none. It is numbered by partition counts and an offset a partition,
so no task sees more than its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.points import matrix


def text_width(spark: SparkSession, path: str, delimiter: str = " ") -> int:
    """Columns of the first line."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return len(first[0][0].strip().split(delimiter))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``id`` from 0 in the order of its partitions and rows."""
    marked = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33).cast("int"))
    counts = sorted((r[0], r[1]) for r in marked.groupBy("_p").count().collect())
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p] = total
        total += n
    if not offsets:
        return marked.withColumn("id", F.lit(0).cast("long")).drop("_m", "_p")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_p"))
    return marked.withColumn("id", offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p")


def read_text(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """Points from a file or folder of lines of numbers; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    cells = F.split(F.trim("value"), "\\Q" + delimiter + "\\E")
    return numbered(lines.select(F.transform(cells, lambda c: c.cast("double")).alias("features"))).select("id", "features")


def write_text(points: DataFrame, path: str, delimiter: str = " ") -> None:
    """One line a point, in id order across the part files."""
    points.orderBy("id").select(F.array_join(F.transform("features", lambda v: v.cast("string")), delimiter).alias("value")).write.mode("overwrite").text(path)


def _unpack(n_features: int, dtype: str, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            x = np.frombuffer(content, dtype)
            if len(x) % n_features:
                raise ValueError(f"{path}: {len(x)} values are no rows of {n_features}")
            x = x.reshape(-1, n_features)[:, :keep].astype(float)
            for k in range(0, len(x), 65_536):
                part = x[k : k + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "row", "features"])


def read_records(spark: SparkSession, path: str, n_features: int, dtype: str = "<f4") -> DataFrame:
    """Points from packed arrays of any size: files are split at rows, so a large one is many tasks. ``id`` counts
    the rows from 0, files in order of their names. (Fixed-length records have no DataFrame reader, hence the one RDD.)"""
    kind, at = np.dtype(dtype), spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    paths = sorted(f.getPath().toString() for f in found if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
    records = spark.sparkContext.binaryRecords(",".join(paths), n_features * kind.itemsize)
    rows = spark.createDataFrame(records.map(lambda r: (r,)), "content binary")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("content").to_pylist()), kind).reshape(-1, n_features).astype(float)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, n_features, dtype=np.int32)), flat)], names=["features"])

    return numbered(rows.mapInArrow(unpack, "features array<double>")).select("id", "features")


def read_binary(spark: SparkSession, path: str, n_features: int, dtype: str = "<f4", keep: int | None = None) -> DataFrame:
    """``path, row, features`` from packed arrays, one file a row of the binary source; ``keep`` leaves the
    first features only."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_unpack, n_features, dtype, keep or n_features), "path string, row long, features array<double>")


def _pack(dtype: str, table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("id").to_numpy())
    return pa.table({"part": table.column("part").slice(0, 1), "content": pa.array([matrix(table.column("features"))[order].astype(dtype).tobytes()], pa.binary())})


def packed(points: DataFrame, rows_a_file: int = 1 << 20, dtype: str = "<f4") -> DataFrame:
    """``part, content``: packed rows in id order, ``rows_a_file`` ids each, to write with any sink."""
    return points.withColumn("part", F.floor(F.col("id") / rows_a_file).cast("long")).groupBy("part").applyInArrow(lambda t: _pack(dtype, t), "part long, content binary")


def read_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension: ``.txt`` or ``.bin``; raises for others."""
    readers = {"txt": read_text, "bin": read_binary}
    kind = path.rsplit(".", 1)[-1]
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path, **options)


def write_binary(points: DataFrame, folder: str, rows_a_file: int = 1 << 20, dtype: str = "<f4") -> None:
    """``part-00000.bin`` and so on in ``folder``: packed rows in id order. The driver writes the files one after
    another through Hadoop's file system, and holds one at a time."""
    spark = points.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in packed(points, rows_a_file, dtype).orderBy("part").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{r.part:05d}.bin")
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(r.content)
        finally:
            out.close()


def write_json(nodes: DataFrame, path: str) -> None:
    """A tree's nodes or merge rows, one JSON object a line."""
    nodes.write.mode("overwrite").json(path)


#: A nested document is one text, so trees above this many nodes or samples go by ``write_json``.
MOST_NODES = 100_000


def _few(df: DataFrame, what: str) -> list:
    rows = df.limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} {what}: use write_json")
    return rows


def _write_document(spark: SparkSession, document: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_tree(rows: DataFrame, nodes: DataFrame, path: str, **options) -> None:
    """A space partition as one JSON document: the samples, the build's ``options``, the bounding box, and nested
    nodes with their cut and children or, for leaves, the ids that they hold."""
    found = {r.node_id: r for r in _few(nodes, "nodes")}
    samples = sorted(_few(rows.select("id", "features", "node_id"), "samples"))
    held: dict[int, list[int]] = {}
    for r in samples:
        held.setdefault(r.node_id, []).append(r.id)
    tree: dict[int, dict] = {}
    for v in sorted(found, reverse=True):  # children before their parents
        r = found[v]
        tree[v] = {"node": v, "axis": r.axis, "cut": r.cut, "left": tree.get(2 * v), "right": tree.get(2 * v + 1)} if r.axis is not None else {"node": v, "ids": held.get(v, [])}
    root = found.get(1)
    box = {"lo": list(root.lo), "hi": list(root.hi)} if root else {}
    _write_document(rows.sparkSession, {"samples": {str(r.id): list(r.features) for r in samples}, "options": options, "bounding_box": box, "root": tree.get(1)}, path)


def write_merges(merges: DataFrame, path: str) -> None:
    """A single-linkage tree as one JSON document of nested nodes, from the last merge on."""
    rows, tree = sorted(_few(merges, "merges"), key=lambda r: r.node), {}
    for r in rows:
        tree[r.node] = {"node": r.node, "level": r.level, "size": r.size, "representative": r.representative, "left": tree.get(r.left, {"node": r.left, "level": 0.0, "size": 1}), "right": tree.get(r.right, {"node": r.right, "level": 0.0, "size": 1})}
    _write_document(merges.sparkSession, {"root": tree[rows[-1].node] if rows else None}, path)


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON document that ``write_tree`` or ``write_merges`` has written."""
    return json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first().value)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows that ``write_json`` has written."""
    return spark.read.json(path)


def write_edges(tree: DataFrame, path: str) -> None:
    """``i j weight`` lines, lightest first."""
    tree.orderBy("weight", "i", "j").select("i", "j", "weight").write.mode("overwrite").csv(path, sep=" ")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the regular files of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")
