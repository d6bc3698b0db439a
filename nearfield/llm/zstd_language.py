"""Operator 10: language ID by compression.

Each language has a raw-content dictionary of sampled training text. A text, lower-cased and in chunks of
``CHUNK`` bytes so that a long one doesn't become its own dictionary, is compressed once with each; the
language of the smallest sum wins, and the score is its lead over the next, as a share of the next one's
size. A text whose lead is under ``MARGIN`` is rejected by ``identify(...).rejected``.

Learning is bounded: the ``SAMPLE`` training documents of each language with the smallest hashes of id and text,
or all if there are fewer (repeated rows count once), of which ``DICTIONARY`` bytes are used, dealt evenly over
the sampled texts, of each from a place that its hash chooses.

Edges: a null text or one without a letter is ``und`` with score 0 and rejected; null languages are not
learnt; without any learnt language all are ``und``; with one, its score is 1; ties go to the first by name;
null ids, repeated rows and other columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import fold, slices

SAMPLE, DICTIONARY, CHUNK, LEVEL, MARGIN = 200, 96 << 10, 4096, 12, 0.01
#: A text under SHORT bytes is written REPEAT times: stored raw, as a few words would be, it has one size in
#: every language.
SHORT, REPEAT = 512, 3
_LETTER = re.compile(r"[^\W\d_]")


def learn(docs: DataFrame, where: Column | None = None) -> dict[str, bytes]:
    """Dictionary content by language, from the rows of ``docs`` that ``where`` admits."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (where if where is not None else F.lit(True)).alias("use"))
    rows = rows.where(F.col("use") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(7)), 1).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    # the hash is cut at a share that leaves about twice SAMPLE distinct rows, and again at a larger one where it left too few
    wide = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(256, DICTIONARY // max(1, min(SAMPLE, int(0.8 * n)))))]), F.col("lang")) if counts else F.lit(0)
    start = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("text") - wide, F.lit(0)) + 1).cast("int")
    shares, texts = {k: min(1.0, 2 * SAMPLE / max(1, n)) for k, n in counts.items()}, {}
    while shares:
        share = F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, v)]), F.col("lang"))
        picked = rows.where(F.col("lang").isin(list(shares)) & ((share >= 1) | (F.col("h") < share * float(1 << 63))))
        found: dict[str, list[tuple[int, bytes]]] = {}
        for lang, h, text in picked.groupBy("lang", "h").agg(F.min(F.col("text").substr(start + 1, wide))).collect():
            found.setdefault(lang, []).append((h, text.lower().encode("utf-8", "surrogatepass")))
        texts |= {k: sorted(v)[:SAMPLE] for k, v in found.items()}
        shares = {k: min(1.0, 8 * v) for k, v in shares.items() if v < 1 and len(found.get(k, [])) < SAMPLE}
    out = {}
    for lang, found in texts.items():
        each = max(256, DICTIONARY // len(found))
        starts = [h % (max(0, len(t) - each) + 1) for h, t in found]
        out[lang] = b"\n".join(t[k : k + each] for k, (_, t) in zip(starts, found, strict=True))[:DICTIONARY]
    return {k: out[k] for k in sorted(out) if len(out[k]) >= 8}


class Identifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs, self.tools = list(contents), []
        for data in contents.values():
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def identify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        raw = text.lower().encode("utf-8", "surrogatepass")
        if len(raw) < SHORT:
            raw = b"\n".join([raw] * REPEAT)
        chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
        sizes = [sum(len(t.compress(c)) for c in chunks) for t in self.tools]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        return self.langs[best], min(1.0, max(0.0, 1 - sizes[best] / second))


def _identify(contents: dict[str, bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = Identifier(contents)
    for b in slices(batches):
        found = [tool.identify(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, contents: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = slim.mapInArrow(partial(_identify, contents), "doc_id long, lang_pred string, score double")
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | (F.col("score") < margin))


def _keep(contents: dict[str, bytes], margin: float, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = Identifier(contents)
    for b in slices(batches):
        found = [tool.identify(t) for t in b.column(at).to_pylist()]
        yield b.filter(pa.array([lang != "und" and score >= margin for lang, score in found]))


def keep_identified(docs: DataFrame, contents: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is clear, with their own columns."""
    return docs.mapInArrow(partial(_keep, contents, margin, docs.columns.index("text")), docs.schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    found = identify(docs, learn(docs, ~held))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
