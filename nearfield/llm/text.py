"""Shared text primitives: words, 64-bit word hashes, shingle sets, folds and sorted runs.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D, which is what ``bytes.split()``
yields, so the Python and the SQL side (``WORD``) agree on every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 spelling of a word.
WORD = r"[^\x20\x09-\x0D]+"
_MASK = (1 << 64) - 1


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit words from the SplitMix64 rule."""
    out = []
    for i in range(1, n + 1):
        z = (seed + i * 0x9E3779B97F4A7C15) & _MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


class Generations(dict):
    """A cache that keeps at most twice ``limit`` entries: when the young generation is full it becomes the old
    one, so what is used often stays and memory is bounded on any vocabulary."""

    def __init__(self, limit: int = 1 << 17):
        super().__init__()
        self.limit, self.old = limit, {}

    def recall(self, key):
        """The value that the old generation has, moved to the young one; None if it has none."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.old = {}
        self.clear()


class WordHash(Generations):
    """Word bytes to 64-bit hash. Words of over ``LONGEST`` bytes are hashed each time and not kept."""

    LONGEST = 48

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
            if len(word) > self.LONGEST:
                return h
        self.keep(word, h)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterator[pa.RecordBatch], caches: Iterable[Generations] = (), rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at once. At the end of the task
    the caches are emptied and freed memory is given back, since the worker lives on."""
    try:
        for b in batches:
            for k in range(0, b.num_rows, rows):
                yield b.slice(k, rows)
            del b
    finally:
        for c in caches:
            c.forget()
        pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles, A-Z lower-cased. A text of fewer words
    has one shingle, its whole sequence; a null text or one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    h = cache.of(words)
    n = len(words) - width + 1
    s = np.zeros(n, np.uint64)
    for k, c in enumerate(splitmix(11, width) | np.uint64(1)):
        s += h[k : k + n] * c
    return np.unique(mix(s))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(parts))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct named ``row``, so that no other column can clash with them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def ascii_word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list | np.ndarray]]:
    """Runs of equal integer ``keys`` in batches that arrive sorted by them, each as a dict of columns.

    Integer columns come as arrays, others as lists. One run is held at a time, besides its batch.
    """
    rest: dict[str, list | np.ndarray] | None = None
    for b in slices(batches, rows=1024):
        cols: dict[str, list | np.ndarray] = {}
        for name, col in zip(b.schema.names, b.columns, strict=True):
            cols[name] = col.to_numpy(zero_copy_only=False) if pa.types.is_integer(col.type) else col.to_pylist()
        if not b.num_rows:
            continue
        if rest is not None:
            cols = {k: np.concatenate([rest[k], v]) if isinstance(v, np.ndarray) else rest[k] + v for k, v in cols.items()}
        n = len(cols[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for s, e in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield {k: v[s:e] for k, v in cols.items()}
        rest = {k: v[cuts[-2] :] for k, v in cols.items()}
    if rest is not None and len(rest[keys[0]]):
        yield rest
