"""Bounded training samples for the two text classifiers.

At most ``LABELLED`` documents of a class are learnt from, the first by a hash of their ids; the same bound,
expected, holds for unlabelled ones. Of a document at most ``FEATURES`` distinct features are, those of the
smallest hashes. Executors send hashed features, never texts, to the driver, so what it gathers is bounded by the
sample and doesn't grow with the corpus. Scoring covers every row and all of its features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import mix

LABELLED, FEATURES = 6000, 20_000


def all_labels(labels: DataFrame, column: str, use: Column) -> DataFrame:
    """``doc_id, y`` of all labelled ids that ``use`` admits; null ids and labels are left out, and an id labelled
    twice counts as its largest label."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & use)
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def first_labels(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """At most ``bound`` of the given labels, by the hash of their ids."""
    return labels.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(bound)


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``y, text`` of the given labels' documents, one row an id (of different texts the first)."""
    return docs.join(F.broadcast(labels), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")


def sample_texts(docs: DataFrame, use: Column, bound: int = LABELLED) -> DataFrame:
    """``text`` of about ``bound`` distinct rows ``(doc_id, text)`` of those that ``use`` admits."""
    rows = docs.where(use).select("text", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(17)), 1).alias("h"))
    n = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, bound / max(1, n))
    return rows.where((F.col("h") < share * float(1 << 63)) | F.lit(share >= 1)).groupBy("h").agg(F.min("text").alias("text")).select("text")


def fewest(ids: np.ndarray) -> np.ndarray:
    """The places of the ``FEATURES`` features of the smallest hashes, in order; of all if there are no more."""
    if len(ids) <= FEATURES:
        return np.arange(len(ids))
    return np.sort(np.argsort(mix(ids.astype(np.uint64)), kind="stable")[:FEATURES])
