"""Operator 7: quality by supervised subword embeddings.

Hashed words and character 3- and 4-grams (as bytes, across no inner space) have learned vectors; a document
is their average, and a softmax over it gives the label. The
vectors and the output layer are trained together by stochastic gradient descent, document by document, with
a rate that falls to zero. As everything between the vectors and the two logits is linear, scoring needs one
number per feature: its vector's dot product with the difference of the output rows.

Samples are bounded as ``learning`` says.

Edges: a null or empty text has no feature and scores the bias alone; null ids, repeated rows and other
columns change nothing; with no labels, or only one class, every score is the share of good labels (0.5 with
none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.learning import LABELLED, all_labels, fewest, first_labels, labelled_texts
from nearfield.llm.text import WordHash, fold, mix, slices, splitmix

BITS, WIDTH, MAX_GRAM_BLOCK = 18, 16, 1 << 20
_MASK = np.uint64((1 << BITS) - 1)
_GRAM = {n: (splitmix(40 + n, n) | np.uint64(1)) for n in (3, 4)}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _grams(raw: bytes) -> Iterator[np.ndarray]:
    """Feature numbers of the byte n-grams of a text padded with spaces, block by block."""
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    for k in range(0, len(data), MAX_GRAM_BLOCK):
        block = data[k : k + MAX_GRAM_BLOCK + 3]
        wide, gap = block.astype(np.uint64), _SPACE[block]
        for n, c in _GRAM.items():
            m = min(len(block) - n + 1, MAX_GRAM_BLOCK)
            if m <= 0:
                continue
            h = wide[:m] * c[0]
            for i in range(1, n):
                h += wide[i : i + m] * c[i]
            inner = gap[1 : 1 + m].copy()
            for i in range(2, n - 1):
                inner |= gap[i : i + m]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield ((h >> np.uint64(40)) & _MASK).astype(np.int32)[~inner]


def features(text: str | None, words: WordHash) -> Iterator[np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    h = words.of(raw.split())
    if not len(h):
        return
    yield (mix(h) & _MASK).astype(np.int32)
    yield from _grams(raw)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in slices(batches, [words]):
        ids, counts = [], []
        for t in b.column("text").to_pylist():
            found = list(features(t, words))
            i, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
            some = fewest(i)
            ids.append(i[some].astype(np.int32).tobytes())
            counts.append(n[some].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["y", "ids", "counts"])


def train_embeddings(docs: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 12, rate: float = 0.5, seed: int = 9) -> tuple[np.ndarray, float]:
    """One number per feature and the bias; the log-odds of label 1 is the mean number plus the bias."""
    table = np.zeros(1 << BITS, np.float32)
    share = np.mean([y for *_, y in docs]) if docs else 0.5
    if share in (0, 1):
        return table, float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20))
    if not docs or share == 0.5 and len(docs) < 2:
        return table, 0.0
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2)
    step, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, share_of, y = docs[k]
            lr = rate * (1 - step / total)
            step += 1
            if not len(ids):
                continue
            mean = share_of @ vec[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = (p @ out).astype(np.float32)
            out -= (lr * np.outer(p, mean)).astype(np.float32)
            bias -= 0.1 * lr * p
            vec[ids] -= np.outer(share_of, lr * 20 * back)
    return (vec @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _score(table: np.ndarray, bias: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in slices(batches, [words]):
        z = []
        for t in b.column("text").to_pylist():
            total, n = 0.0, 0
            for ids in features(t, words):
                total += float(table[ids].sum(dtype=np.float64))
                n += len(ids)
            z.append(bias + (total / n if n else 0.0))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -30, 30))))], names=["doc_id", "score"])


def learn_quality(docs: DataFrame, labels: DataFrame, use, bound: int = LABELLED) -> tuple[np.ndarray, float]:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = labelled_texts(slim, first_labels(all_labels(labels, "quality", use), bound))
    sample = []
    for r in rows.mapInArrow(_packed, "y int, ids binary, counts binary").collect():
        n = np.frombuffer(r.counts, np.float32)
        sample.append((np.frombuffer(r.ids, np.int32), n / max(1.0, n.sum()), int(r.y == 1)))
    sample.sort(key=lambda x: (x[0].tobytes(), x[1].tobytes(), x[2]))  # whatever order the rows came in
    return train_embeddings(sample)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score`` of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(partial(_score, *model), "doc_id long, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, learn_quality(docs, labels, fold("doc_id", 4) != 2))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
