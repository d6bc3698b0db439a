"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Language ID drops texts whose language is unclear; line dedup deletes lines that earlier documents hold, and
documents of which nothing is left; near-dedup keeps the first document of each group of near copies (five-word
shingles, similarity 0.8); mixing repeats and drops documents to reach the sources' target words; the last
stage encodes what is left with a public SentencePiece vocabulary. All but the last return the columns of
``documents``. An empty table passes through every stage; null texts and ids are the operators' business, as
their modules say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.line_align import remove_common_lines
from nearfield.llm.minhash_paths import keep_first
from nearfield.llm.mixing import mix_documents
from nearfield.llm.pieces import encode_documents
from nearfield.llm.text import WORD
from nearfield.llm.zstd_language import keep_identified, learn
from nearfield.plans.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that loses lines and has no word left is a copy of earlier ones and goes; ``n_chars``
    follows the text that is left."""
    found = remove_common_lines(docs)
    found = found.where((F.col("removed") == 0) | F.col("row.text").rlike(WORD))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("row", F.when(F.col("removed") == 0, F.col("row")).otherwise(F.col("row").withField("n_chars", F.length("row.text").cast(kind))))
    return found.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, width=5, threshold=(80, 100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, keep_ids=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: Compression sizes, learned on a sample, and merge-type encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents`` of ``sf_dir``."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.keep(name)  # the stage before is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
