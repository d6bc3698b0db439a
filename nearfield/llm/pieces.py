"""Operator 8: exact merge-type SentencePiece encoding by backtracking, and decoding.

A text becomes the piece sequence that merging would give, found without merging it: an Aho-Corasick
automaton yields the pieces that match at each position; the longest is taken if it is compatible with the
piece before it, that is if re-merging the two together gives back the same two; else shorter ones are
tried, and where none fits the last piece is given up. A bit for every position that has failed keeps any
position from being tried twice, so the work stays linear in the length.

No piece has a space after another character, so a text is cut before each run of spaces and at
characters outside the vocabulary; the cuts' encodings are kept in bounded caches. Characters outside the vocabulary
become byte pieces.

Edges: a null or empty text has no ids and decodes to the empty text; any length is encoded whole; repeated
rows and null ids are encoded like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm.text import Generations, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def parse_vocabulary(model: bytes) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` by id. Raises for a model that isn't merge-type with byte fallback, identity
    normalisation, an added leading space and at most 65,536 pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    norm, train = m.normalizer_spec, m.trainer_spec
    plain = train.model_type == pb.TrainerSpec.BPE and train.byte_fallback and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not train.treat_whitespace_as_suffix
    kinds = {p.type for p in m.pieces}
    if not plain or len(m.pieces) > 1 << 16 or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only merge-type models with byte fallback and identity normalisation are supported")
    return [(p.piece, p.score, p.type) for p in m.pieces]


def read_vocabulary(path: str | None = None) -> list[tuple[str, float, int]]:
    with open(path or default_model(), "rb") as f:
        return parse_vocabulary(f.read())


class PieceCodec:
    #: Up to this length the longest matches are searched anew after a shorter one; the search copies the string.
    SHORT = 256

    def __init__(self, vocabulary: list[tuple[str, float, int]], cache_limit: int = 1 << 18):
        self.score = {p: s for p, s, k in vocabulary if k == NORMAL}
        self.id = {p: i for i, (p, s, k) in enumerate(vocabulary) if k == NORMAL}
        self.byte_id = {int(p[3:5], 16): i for i, (p, s, k) in enumerate(vocabulary) if k == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space inside")
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, s, k in vocabulary]
        self.decimal = [b"%d" % i for i in range(len(vocabulary))]
        self.kind = [k for _, _, k in vocabulary]
        self.alphabet = {c for p in self.id for c in p}
        #: Neighbours inside some piece; between any other two characters no merge can ever reach across.
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.controls = {i for i, (_, _, k) in enumerate(vocabulary) if k == CONTROL}
        self.piece = [p for p, _, _ in vocabulary]
        self.automaton = ahocorasick.Automaton()
        made = {p: i for p, i in self.id.items() if self.merge(p) == [p]}  # merging never makes others of their own characters
        if not self.alphabet <= made.keys():
            raise ValueError("a character of a piece is no piece")
        for p, i in made.items():
            self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.size = list(map(len, self.piece))
        #: By id the longest piece that begins it, which is the next shorter match wherever it matches; else -1.
        self.shorter = [-1] * len(vocabulary)
        for p, i in made.items():
            self.shorter[i] = next((made[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made), -1)
        #: A word is cut from the mark after it, unless some piece has the two characters side by side; so it is read
        #: once whatever follows.
        before: dict[str, str] = {c: "" for c in map(chr, range(33, 127)) if not c.isalnum()}
        for x, y in self.inside:
            if y in before and re.match(r"[^\W\d_]", x):
                before[y] += re.escape(x)
        free = "".join(re.escape(c) for c, letters in before.items() if not letters)
        rest = "".join(f"|(?<![{letters}]){re.escape(c)}" for c, letters in before.items() if letters)
        self._parts = re.compile(f"▁*+[^\\W\\d_]++(?=[▁\n{free}]|\\Z{rest})|▁+[^▁\n]*|[^▁\n]+|\n").findall
        self._pair, self._known = Generations(cache_limit), Generations(cache_limit)
        self._histories: dict[int, list] = {}  # of one entry a piece at most

    def merge(self, text: str) -> list[str]:
        """Merging proper, for short strings: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _history(self, i: int) -> list[tuple[float, str | None, str | None]]:
        """The merges that make piece ``i`` of its characters: score, and the first and last part where they change."""
        found = self._histories.get(i)
        if found is None:
            found, parts = [], list(self.piece[i])
            while len(parts) > 1:
                scores = [self.score.get(x) for x in map(add, parts, parts[1:])]
                best = max(x for x in scores if x is not None)
                at = scores.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found.append((best, parts[0] if at == 0 else None, parts[-1] if at == len(parts) - 1 else None))
            self._histories[i] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging two pieces' characters together gives them back: both are merged again step by step, best
        score first, and no pair across their border may come first at any time."""
        key = left << 16 | right
        ok = self._pair.get(key)
        if ok is None:
            ok = self._pair.recall(key)
        if ok is None:
            ok = self._remerge(left, right)
            self._pair.keep(key, ok)
        return ok

    def _remerge(self, left: int, right: int) -> bool:
        x, y, score = self.piece[left][-1], self.piece[right][0], self.score
        if x + y not in self.inside:
            return True
        a, b, cross = iter(self._history(left)), iter(self._history(right)), score.get(x + y)
        in_a, in_b = next(a, None), next(b, None)
        while True:
            if cross is not None and (in_a is None or cross > in_a[0]) and (in_b is None or cross >= in_b[0]):
                return False
            if in_a is not None and (in_b is None or in_a[0] >= in_b[0]):
                changed, in_a = in_a[2], next(a, None)
                if changed:
                    x = changed
                    cross = score.get(x + y)
            elif in_b is not None:
                changed, in_b = in_b[1], next(b, None)
                if changed:
                    y = changed
                    cross = score.get(x + y)
            else:
                return True

    def backtrack(self, text: str) -> list[int] | None:
        """The ids of a string over the vocabulary's alphabet; None if it has other characters."""
        n, size, shorter, pair, iter_long = len(text), self.size, self.shorter, self._pair, self.automaton.iter_long
        ahead = found = failed = None
        if n <= self.SHORT:
            ahead = iter_long(text)
        else:
            found = [-1] * n
            for end, (back, i) in self.automaton.iter(text):
                found[end - back] = i  # the ends rise, so the longest comes last
        pos, out = 0, []
        while pos < n:
            if found is None:
                end, (back, i) = next(ahead, (n, (0, 0)))
                if end - back != pos:
                    return None
                end += 1
            else:
                i = found[pos]
                if i < 0:
                    return None
                end = pos + size[i]
            longest = i
            while True:
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if not out:
                        break
                    key = out[-1] << 16 | i
                    ok = pair.get(key)
                    if ok is None:
                        ok = self.compatible(out[-1], i)
                    if ok:
                        break
                i = shorter[i]
                while i < 0:  # nothing that matches here fits: the piece before is given up for a shorter one
                    if not out:
                        raise ValueError(f"no encoding of {text!r}")
                    if failed is None:
                        failed = bytearray((n >> 3) + 1)
                    failed[pos >> 3] |= 1 << (pos & 7)
                    i, longest = out.pop(), -1
                    pos -= size[i]
                    i = shorter[i]
                end = pos + size[i]
            out.append(i)
            pos = end
            if i != longest and found is None:
                ahead = iter_long(text, pos)
        return out

    def _new(self, run: str) -> bytes | None:
        ids = self.backtrack(run)
        if ids is None:
            return None
        packed = array("H", ids).tobytes()
        if len(run) <= 64:  # longer ones seldom return
            self._known.keep(run, packed)
        return packed

    def _run(self, run: str) -> bytes:
        known = self._known
        return known.get(run) or known.recall(run) or self._new(run) or array("H", [self.byte_id[b] for b in run.encode("utf-8", "surrogatepass")]).tobytes()

    def cut(self, part: str) -> bytes:
        """The ids of a part that the young cache hasn't; run by run between cuts that no merge crosses, if it has
        characters outside the vocabulary."""
        ids = self._known.recall(part) or self._new(part)
        if ids is not None:
            return ids
        joined = map(self.inside.__contains__, map(add, part, part[1:]))
        cuts = [0, *(k for k, j in enumerate(joined, 1) if not j), len(part)]
        ids = b"".join(self._run(part[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        if len(part) <= 16:
            self._known.keep(part, ids)
        return ids

    def parts(self, text: str) -> list[str]:
        """The normalised text in parts that encode by themselves."""
        return self._parts(SPACE + text.replace(" ", SPACE))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian 16-bit numbers."""
        if not text:
            return b""
        known, out = self._known, []
        for part in self.parts(text):
            ids = known.get(part)
            if ids is None:
                ids = self.cut(part)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u2").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids; a byte that is no part of a character becomes U+FFFD."""
        ids = list(ids)
        surface = list(map(self.surface.__getitem__, ids))
        first = next((k for k, i in enumerate(ids) if self.kind[i] != CONTROL), None)
        if first is not None and self.kind[ids[first]] == NORMAL and surface[first][:1] == b" ":
            surface[first] = surface[first][1:]
        if self.controls.isdisjoint(ids):
            try:
                return b"".join(surface).decode()
            except UnicodeDecodeError:
                pass
        return self._salvage(ids, surface)

    def _salvage(self, ids: list[int], surface: list[bytes]) -> str:
        out, run = [], b""
        for i, s in [*zip(ids, surface, strict=True), (None, b"")]:
            if i is not None and self.kind[i] == BYTE:
                run += s
                continue
            while run:
                for k in (4, 3, 2, 1):
                    try:
                        c = run[:k].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1:
                        out.append(c)
                        run = run[k:]
                        break
                else:
                    out.append("�")
                    run = run[1:]
            out.append(s.decode())
        return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def shared_codec(vocabulary: list[tuple[str, float, int]]) -> PieceCodec:
    """One codec for all tasks of a Python worker, with its caches, which are bounded."""
    key = hash(tuple(vocabulary))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(vocabulary)
    return _codecs[key]


def _encode(vocabulary: list, keep_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = shared_codec(vocabulary)
    for b in slices(batches):
        cols: list[list] = [[], [], [], [], []]
        for text in b.column(b.num_columns - 1).to_pylist():
            packed = np.frombuffer(codec.encode_packed(text), "<u2")
            ids = packed.tolist()
            decoded = codec.decode(ids)
            row = (len(ids), hashlib.sha256(b",".join(map(codec.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), packed.astype(np.int32) if keep_ids else None, decoded if keep_ids else None)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(made if keep_ids else made[:3])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])])


def encode_documents(docs: DataFrame, model: str | None = None, keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids`` and ``decoded``."""
    from pyspark.sql import functions as F

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return slim.mapInArrow(partial(_encode, read_vocabulary(model), keep_ids), schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
