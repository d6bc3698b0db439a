"""Operator 5: quality rules from tokeniser fertility, over a base of counting rules.

Two public vocabularies read every whole text. A text whose characters per token, share of byte-fallback
tokens or token entropy (bits) leave the band of its main script is rejected: text that a vocabulary knows
takes few tokens, and noise, markup and repetition show as many tokens, byte pieces or few distinct ones.
The bands of ``BANDS`` are for texts of at least ``MIN_WORDS`` words, which the base rules ask for anyway.

A text is read in chunks, each a word and the spaces before it, whose tokens are kept in a bounded cache. Neither
vocabulary has a token across the border of two chunks, but where a character says otherwise (``Odd``); such texts
go through the libraries whole.

Edges: a null or wordless text has zero counts, fails the base rules and isn't kept; null ids and repeated
rows are judged like any other; other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.pieces import NORMAL, SPACE, parse_vocabulary
from nearfield.llm.text import Generations, WordHash, mix, slices, splitmix

MIN_WORDS = 50
#: By script: least and most characters per token (piece vocabulary), the same (byte vocabulary), the most
#: byte-fallback share, the least and most token entropy.
BANDS = {
    "latin": (1.40, 12.0, 1.79, 12.0, 0.10, 5.5, 14.0),
    "cyrillic": (0.80, 12.0, 0.60, 12.0, 0.20, 5.0, 14.0),
    "greek": (0.50, 12.0, 0.40, 12.0, 0.50, 4.5, 14.0),
    "other": (0.20, 12.0, 0.20, 12.0, 0.95, 4.0, 14.0),
}
_SYMBOLS, _BLANK = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: The byte vocabulary's pattern for which texts may be cut into chunks: no match goes on from another character into
#: white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code point ranges of letters.
_SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "cyrillic": ((0x400, 0x52F),),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
}


def script_of(text: str) -> str:
    """The script of most letters: latin, cyrillic, greek or other."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {}
    for script, ranges in _SCRIPTS.items():
        counts[script] = sum(int(np.count_nonzero((points - np.uint32(lo)) <= hi - lo)) for lo, hi in ranges)
        if 2 * counts[script] >= len(points):  # most characters, so most letters too
            return script
    best = max(counts, key=counts.get)
    return best if 2 * counts[best] >= sum(map(str.isalpha, text)) else "other"


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more, its first place included."""
    if len(h) < 4:
        return 0
    c = splitmix(31, 3) | np.uint64(1)
    w = mix(h[:-2] * c[0] + h[1:-1] * c[1] + h[2:] * c[2])
    ordered = np.sort(w)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.zeros(len(h), bool)
    twice = again[np.minimum(np.searchsorted(again, w), len(again) - 1)] == w
    for k in range(3):
        hit[k : k + len(w)] |= twice
    return int(hit.sum())


def base_counts(text: str | None, words: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    return _counts(text, words.of(text.encode("utf-8", "surrogatepass").split()))


def _counts(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """``base_counts`` from the hashes of the text's words."""
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    chars = len(text) - sum(map(text.count, _BLANK))
    return len(h), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


class Odd(Exception):  # noqa: N818
    """A text that may not be cut into chunks."""


class Fertility(Generations):
    """Measures by two vocabularies; one instance for a worker. Keeps by chunk: the word's hash, the ids in the piece
    vocabulary as 16-bit numbers, and the number of tokens in the byte vocabulary."""

    LONGEST = 64
    _chunks = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")

    def __init__(self, model: bytes, ranks: bytes, pattern: str, cache_limit: int = 1 << 18):
        import sentencepiece
        import tiktoken

        super().__init__(cache_limit)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.pieces.is_byte(i) and self.pieces.id_to_piece(i) != "<0x0A>" for i in range(self.pieces.vocab_size())])
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        try:
            normal = [p for p, _, kind in parse_vocabulary(model) if kind == NORMAL]
        except ValueError:
            normal = None
        #: Spaces that some piece has after another character: no chunk may begin with them.
        self.joined = {c for p in normal or () for c in p[1:] if c in _BLANK}
        self.line_end = self.pieces.encode("\n")[-1]
        self.cuts = pattern == _PATTERN and normal is not None and "\n" not in self.joined and not any(SPACE in p.lstrip(SPACE) or "\n" in p[:-1] for p in normal)

    def _hash(self, chunk: str) -> int:
        """The hash of the chunk's word. Raises ``Odd`` if the next chunk's spaces would belong with its last character."""
        if chunk[-1] == SPACE or (chunk[-1].isspace() and chunk[-1] not in _BLANK):
            raise Odd
        return xxhash.xxh3_64_intdigest(chunk.lstrip(_BLANK).encode("utf-8", "surrogatepass"))

    def _made(self, chunks: list[str]) -> Iterator[tuple[int, bytes, int]]:
        """What is kept of chunks that stand inside a text, read in one go with line ends between them."""
        if any(c[0] in self.joined for c in chunks):
            raise Odd
        ids = np.array(self.pieces.encode("\n" + "\n".join(chunks)), np.uint16)
        ends = [*np.flatnonzero(ids == self.line_end).tolist(), len(ids)]
        at = 0
        for c in chunks:
            start, at = at, at + 1 + c.count("\n")
            yield self._hash(c), ids[ends[start] + 1 : ends[at]].tobytes(), len(self.bytes.encode_ordinary(c))

    def __missing__(self, chunk: str) -> tuple[int, bytes, int]:
        """For chunks that are too long to be kept, and those that have just become old."""
        return self.recall(chunk) or next(self._made([chunk]))

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """The hashes of a text's words, its ids in the piece vocabulary, its number of tokens in the other. Raises
        ``Odd`` for a text that may not be cut."""
        if not self.cuts:
            raise Odd
        first, *chunks = self._chunks.findall(text) or [""]
        if not first:
            return np.empty(0, np.uint64), np.empty(0, np.uint16), 0
        lacking = [c for c in filterfalse(self.__contains__, set(chunks)) if len(c) <= self.LONGEST and self.recall(c) is None]
        if lacking:
            for c, found in zip(lacking, self._made(lacking), strict=True):
                self.keep(c, found)
        begin = self._hash(first), array("H", self.pieces.encode(first)).tobytes(), len(self.bytes.encode_ordinary(first))
        hashes, ids, n = zip(begin, *map(self.__getitem__, chunks), strict=True)
        words = len(hashes) - (text[-1] in _BLANK)
        return np.fromiter(hashes, np.uint64, len(hashes))[:words], np.frombuffer(b"".join(ids), np.uint16), sum(n)

    def measure(self, text: str, words: WordHash) -> tuple[tuple[int, int, int, int, int], tuple[float, float, float, float]]:
        """The base counts; characters per piece, per byte-vocabulary token, byte-fallback share, entropy of pieces in bits."""
        try:
            h, ids, n_bytes = self.read(text)
            counts = _counts(text, h)
        except Odd:
            counts, ids, n_bytes = base_counts(text, words), np.array(self.pieces.encode(text), np.int64), len(self.bytes.encode_ordinary(text))
        if not len(ids):
            return counts, (0.0, 0.0, 0.0, 0.0)
        n = np.bincount(ids)
        p = n[n > 0] / len(ids)
        return counts, (counts[1] / len(ids), counts[1] / max(1, n_bytes), float(self.is_byte[ids].mean()), float(-(p * np.log2(p)).sum()))


_shared: dict[int, Fertility] = {}
_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("script", pa.string()), ("chars_per_piece", pa.float64()), ("chars_per_byte_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()), ("kept", pa.bool_())]


def _judge(model: bytes, ranks: bytes, pattern: str, bands: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, schema = WordHash(), pa.schema(_FIELDS)
    if (key := hash((model, ranks))) not in _shared:
        _shared.clear()
        _shared[key] = Fertility(model, ranks, pattern)
    fertility = _shared[key]

    def one(doc_id, text):
        text = text or ""
        (n, chars, symbols, dup, rep), (a, b, share, h) = fertility.measure(text, words)
        failed = n < MIN_WORDS or 100 * rep > 50 * n
        script = script_of(text)
        lo_a, hi_a, lo_b, hi_b, most, lo_h, hi_h = bands[script]
        fits = lo_a <= a <= hi_a and lo_b <= b <= hi_b and share <= most and lo_h <= h <= hi_h
        return doc_id, n, chars, symbols, dup, rep, failed, script, a, b, share, h, fits and not failed

    for batch in slices(batches, [words]):
        rows = [one(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def judge_fertility(docs: DataFrame, bands: dict | None = None, model: str | None = None, ranks: str | None = None) -> DataFrame:
    """All counts, measures and the verdict of every row of ``docs`` (``doc_id``, ``text``)."""
    import public_tokenizers as public

    with open(model or public.path("piece_bpe_32k.model"), "rb") as f, open(ranks or public.path("byte_bpe_multi_50k.tiktoken"), "rb") as g:
        run = partial(_judge, f.read(), g.read(), public.PATTERN, bands or BANDS)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    return slim.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS))


def op5_fertility(spark, sf_dir: str) -> DataFrame:
    found = judge_fertility(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
