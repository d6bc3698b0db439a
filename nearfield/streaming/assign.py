"""Assignment of a stream of points to a fitted model. Stateless, so any output mode and trigger fits."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.assign import with_nearest
from nearfield.plans.scratch import shared_dir
from nearfield.points import to_points


def assign_stream(spark: SparkSession, path: str, id_col: str, features: list[str], model: np.ndarray) -> DataFrame:
    """A streaming frame ``id, cluster, dist`` over the Parquet files of ``path``."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return with_nearest(to_points(stream, id_col, features), model)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Drive a bounded stream to its end into Parquet under the shared folder, and read it."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/nearfield-stream-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))
