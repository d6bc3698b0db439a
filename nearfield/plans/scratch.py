"""Scratch tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a table under ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read and never the whole history of the loop. The folder is read
from the session; a temporary one is made only in local mode, where the setting may be absent.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or a temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    return _own[app]


class Scratch:
    """A folder of one operator call. ``save`` writes and rereads; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/nearfield-{label}-{uuid.uuid4().hex[:12]}"
        self.saved: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.saved.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Delete all saved tables but the named ones, which results still read."""
        spent = [n for n in dict.fromkeys(self.saved) if n not in names]
        if spent:
            self.drop(*spent)
        self.saved = [n for n in self.saved if n in names]

    def drop(self, *names: str) -> None:
        """Delete the named tables, or the whole folder when no name is given."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
