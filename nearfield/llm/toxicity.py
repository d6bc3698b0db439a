"""Operator 2: toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed lower-cased words and word starts (present or not) learns from confirmed toxic examples and
unlabelled text alone. With prior ``p`` and logistic loss ``l``, the risk is
``p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)])``; where the second part falls under zero the step goes back
along its gradient instead, so a flexible model can't drive the risk below zero on memorised examples. An
l1 step, scaled to what chance would do in as many examples, keeps only words that tell, which is what keeps
long clean texts from adding up noise.

Labels tell which examples are confirmed, and their mean over all labelled ids is the prior. Negative labels
count in that mean alone; no negative example is learnt from. At most ``LABELLED`` confirmed examples and about
as many unlabelled texts are, as ``learning`` says.

Edges: a null or empty text scores the model's bias; null ids, repeated rows and other columns change
nothing; without a positive label every score is the prior (0 if there are no labels at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.learning import LABELLED, all_labels, fewest, first_labels, labelled_texts, sample_texts
from nearfield.llm.text import WordHash, fold, slices

BITS, MIN_DOCS, STARTS = 20, 3, (4, 5, 6)
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_ids(text: str | None, words: WordHash) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    found = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())
    for k in STARTS:
        found |= {b"<" + w[:k] for w in found if len(w) > k and w[:1] != b"<"}
    return np.unique(words.of(list(found)) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in slices(batches, [words]):
        ids = [word_ids(t, words) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([x[fewest(x)].tobytes() for x in ids], pa.binary())], names=["y", "ids"])


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, *, epochs: int = 40, steps: int = 400, rate: float = 0.5, l1: float = 2.0, batch: int = 512, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights by feature number and the bias, by mini-batch steps with Adagrad rates, at least ``steps``."""
    weights = np.zeros(1 << BITS, np.float32)
    if not positive or not 0 < prior < 1:
        return weights, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    df = np.bincount(np.concatenate([*positive, *unlabelled]), minlength=1 << BITS)
    used = np.flatnonzero(df >= MIN_DOCS)
    column = np.full(1 << BITS, -1, np.int64)
    column[used] = np.arange(len(used))

    def rows(docs):
        at = [column[d] for d in docs]
        at = [a[a >= 0] for a in at]
        return np.concatenate([[0], np.cumsum([len(a) for a in at])]), np.concatenate(at) if at else np.empty(0, np.int64)

    (ps, pc), (us, uc) = rows(positive), rows(unlabelled)
    w, g2 = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-6)
    w[-1] = np.log(prior / (1 - prior))
    # what chance alone moves a feature's gradient by, times l1: a few examples can't carry rare words
    chance = np.append(l1 * prior * np.sqrt(df[used] / (len(positive) + len(unlabelled)) / len(positive)), 0.0)
    rng = np.random.default_rng(seed)

    def pick(starts, cols, which):
        n = starts[which + 1] - starts[which]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(which)), n), cols[np.repeat(starts[which], n) + inner]

    def margin(r, c, m):
        return np.bincount(r, w[c], minlength=m) + w[-1]

    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(max(epochs, steps * batch // len(unlabelled) if unlabelled else 0)):
        order = rng.permutation(len(unlabelled))
        for k in range(0, len(order), batch):
            u = order[k : k + batch]
            p = rng.integers(0, len(positive), min(batch, len(positive)))
            (pr, pcol), (ur, ucol) = pick(ps, pc, p), pick(us, uc, u)
            fp, fu = margin(pr, pcol, len(p)), margin(ur, ucol, len(u))
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            dp_neg, du = -prior * sigmoid(fp) / len(p), sigmoid(fu) / len(u)
            if negative >= 0:
                dp, back = -prior * sigmoid(-fp) / len(p) + dp_neg, du
            else:
                dp, back = -dp_neg, -du
            grad = np.bincount(np.concatenate([pcol, ucol]), np.concatenate([dp[pr], back[ur]]), minlength=len(used) + 1)
            grad[-1] = dp.sum() + back.sum()
            g2 += grad * grad
            step = rate / np.sqrt(g2)
            w -= 0.1 * step * grad
            shrink = np.minimum(0.1 * step * chance, np.abs(w))
            w -= np.sign(w) * shrink
    weights[used] = w[:-1]
    return weights, float(w[-1])


def least_risk_margin(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin at which to call a text toxic: least non-negative risk with zero-one loss, between two
    neighbouring margins of the given texts; of equal ones the middle of the range."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    missed = np.searchsorted(np.sort(positive), cuts) / max(1, len(positive))
    called = 1 - np.searchsorted(np.sort(unlabelled), cuts) / max(1, len(unlabelled))
    risk = prior * missed + np.maximum(0, called - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    below = cuts[best[0] - 1] if best[0] else cuts[best[0]] - 1
    return float((below + cuts[best[-1]]) / 2)


def fold_numbers(positive: list[np.ndarray], unlabelled: list[np.ndarray], folds: int) -> tuple[list[int], list[int]]:
    """The folds of the examples. Equal ones share a fold, also where one is confirmed and the other unlabelled: most
    confirmed texts are among the unlabelled too."""
    place: dict[bytes, int] = {}
    at, also = ([place.setdefault(xxhash.xxh3_128_digest(d), len(place) % folds) for d in docs] for docs in (positive, unlabelled))
    return at, also


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, folds: int = 3) -> tuple[np.ndarray, float]:
    """The mean of the folds' models, its bias set on margins of examples that a fold's model hasn't seen."""
    at = fold_numbers(positive, unlabelled, folds)
    if min(len(set(x)) for x in at) < folds:
        return train_nnpu(positive, unlabelled, prior)
    seen: list[list[float]] = [[], []]
    mean, mean_bias = np.zeros(1 << BITS), 0.0
    for k in range(folds):
        fit, rest = ([[d for d, f in zip(docs, of, strict=True) if (f == k) == out] for docs, of in zip((positive, unlabelled), at, strict=True)] for out in (False, True))
        weights, bias = train_nnpu(*fit, prior)
        for margins, docs in zip(seen, rest, strict=True):
            margins += (bias + float(weights[d].sum()) for d in docs)
        mean, mean_bias = mean + weights / folds, mean_bias + bias / folds
    return mean, mean_bias - least_risk_margin(*map(np.array, seen), prior)


def _score(at: np.ndarray, values: np.ndarray, bias: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, weights = WordHash(), np.zeros(1 << BITS)
    weights[at] = values
    for b in slices(batches, [words]):
        z = np.array([bias + weights[word_ids(t, words)].sum() for t in b.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, use, bound: int = LABELLED) -> tuple[np.ndarray, float]:
    """A model from the labels of ids that ``use`` admits and from unlabelled rows of those ids."""
    known = all_labels(labels, "toxic", use)
    n, positives = known.agg(F.count("*"), F.sum("y")).first()
    prior = (positives or 0) / n if n else 0.0
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    confirmed = labelled_texts(slim, first_labels(known.where("y = 1"), bound))
    any_ = sample_texts(slim, use, bound).select(F.lit(0).alias("y"), "text")
    found = confirmed.union(any_).mapInArrow(_features, "y int, ids binary").collect()
    take = lambda y: [np.frombuffer(x, np.int32) for x in sorted(r.ids for r in found if r.y == y)]
    mixed = lambda docs: [docs[k] for k in np.random.default_rng(3).permutation(len(docs))]
    return train(mixed(take(1)), mixed(take(0)), prior)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score`` of every row."""
    at = np.flatnonzero(model[0])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(partial(_score, at, model[0][at], model[1]), "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_toxicity(docs, learn_toxicity(docs, labels, fold("doc_id", 5) != 0))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
