"""Operator 4: line dedup by pairwise alignment.

Documents are ordered by id (then by a hash of the text). Anchors are the shortest runs of consecutive lines
of at least ``ANCHOR_WORDS`` words that begin or end at some line: a long line by itself, short ones
together. An anchor that several documents hold makes pairs of a later and an earlier document: with every
earlier holder while it is rare (at most ``RARE`` holders), and beyond that with its first holder alone, which
is enough to find it, since the first holder is compared with its whole text. So a line held by a third of all
documents makes one pair a document, and no count is capped. Every block that can be deleted is covered by
anchors inside it, and each of these goes with its first holder, so what is deleted doesn't depend on ``RARE``.

A pair is aligned by patience diff: lines unique on both sides, the longest increasing run of them, then the
same between neighbours, with equal lines next to an anchor taken along. The common lines that the alignment
finds form blocks of consecutive lines on both sides; blocks of at least ``BLOCK_WORDS`` words are deleted
from the later document. Where common lines are left, every other run of consecutive lines of at least
``BLOCK_WORDS`` words that both hold is found by its hashes and deleted too, so that a passage that crosses
the alignment goes, and so does one that either document repeats. A line is compared with its outer blanks
off and runs of blanks as one.

Edges: a null text has no lines and stays null; a text whose lines all go becomes empty; rows of one id and
text are one document and share their deletions; a null id orders last; other columns are kept as they are;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import slices, whole_row
from nearfield.plans.scratch import Scratch

ANCHOR_WORDS, RARE, BLOCK_WORDS = 8, 4, 8
_LAST = (1 << 63) - 1


def _text_hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)).astype(np.int64))


def line_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the number of words of each line; 0 words and hash 0 for a blank line."""
    hashes, words = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        found = line.split()
        words.append(len(found))
        hashes.append(xxhash.xxh3_64_intdigest(b" ".join(found)) if found else 0)
    return np.array(hashes, np.uint64).astype(np.int64), np.array(words, np.int32)


def shortest_runs(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the shortest runs of at least ``least`` words from each line on and up to each line.
    A run that reaches ``least`` words is covered by those of them that lie in it. No line is blank."""
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends, starts = np.searchsorted(sums, sums[:-1] + least), np.searchsorted(sums, sums[1:] - least, side="right") - 1
    on = {(k, e) for k, e in enumerate(ends.tolist()) if e < len(sums)}
    return sorted(on | {(s, k + 1) for k, s in enumerate(starts.tolist()) if s >= 0})


def anchors(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The distinct hashes of a document's anchors; that of a single line is the line's own."""
    full = words > 0
    h, raw = hashes[full], hashes[full].tobytes()
    runs = shortest_runs(words[full], ANCHOR_WORDS)
    several = [xxhash.xxh3_64_intdigest(raw[8 * s : 8 * e]) for s, e in runs if e - s > 1]
    return np.unique(np.concatenate([h[words[full] >= ANCHOR_WORDS], np.array(several, np.uint64).astype(np.int64)]))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its place in the order, all its lines, and the hashes that can be anchors."""
    schema = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("hashes", pa.binary()), ("words", pa.binary()), ("anchors", pa.list_(pa.int64()))])
    for b in slices(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text is not None:
                h, w = line_keys(text)
                rows.append((_LAST if doc_id is None else doc_id, _text_hash(text), h.tobytes(), w.tobytes(), anchors(h, w)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tails, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            piles.append(i)
        else:
            tails[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a: dict[int, int] = {}
        seen_b: dict[int, int] = {}
        for seen, side, lo, hi in ((seen_a, a, a0, a1), (seen_b, b, b0, b1)):
            for k in range(lo, hi):
                seen[side[k]] = -1 if side[k] in seen else k
        both = [(i, seen_b[h]) for h, i in seen_a.items() if i >= 0 and seen_b.get(h, -1) >= 0]
        if not both:
            continue
        anchors = [both[k] for k in _increasing([j for _, j in both])]
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def common_runs(a: list[int], b: list[int], words: np.ndarray) -> set[int]:
    """Positions of ``b`` in runs of at least ``BLOCK_WORDS`` words that ``a`` holds anywhere."""
    raw_a, raw_b = (np.array(side, np.int64).tobytes() for side in (a, b))
    held: dict[int, set[bytes]] = {}
    out: set[int] = set()
    for s, e in shortest_runs(words, BLOCK_WORDS):
        n = e - s
        if n not in held:
            held[n] = {raw_a[8 * k : 8 * (k + n)] for k in range(len(a) - n + 1)}
        if raw_b[8 * s : 8 * e] in held[n]:
            out.update(range(s, e))
    return out


def common_blocks(a: list[int], b: list[int], words: np.ndarray) -> list[int]:
    """Positions of ``b`` in blocks that ``a`` holds too and that are long enough. Blank lines are passed over.
    Where the alignment leaves common lines, blocks that it can't place, moved or repeated, are searched for."""
    keep_a, keep_b = ([k for k, h in enumerate(side) if h] for side in (a, b))
    in_a, in_b, gone = [a[k] for k in keep_a], [b[k] for k in keep_b], set()
    found, start = patience(in_a, in_b), 0
    for k in range(1, len(found) + 1):
        if k == len(found) or found[k] != (found[k - 1][0] + 1, found[k - 1][1] + 1):
            block = [j for _, j in found[start:k]]
            if sum(int(words[keep_b[j]]) for j in block) >= BLOCK_WORDS:
                gone.update(block)
            start = k
    if not {h for j, h in enumerate(in_b) if j not in gone}.isdisjoint(in_a):
        gone |= common_runs(in_a, in_b, words[keep_b])
    return sorted(keep_b[j] for j in gone)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: list[list] = [[], [], []]
        for k in range(b.num_rows):
            row = {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
            gone = common_blocks(np.frombuffer(row["e_hashes"], np.int64).tolist(), np.frombuffer(row["hashes"], np.int64).tolist(), np.frombuffer(row["words"], np.int32))
            if gone:
                for c, v in zip(out, (row["ord"], row["th"], gone), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], names=["ord", "th", "gone"])


def deletions(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """``ord, th, gone``: the sorted positions of the lines that each later document loses. An anchor of at most
    ``rare`` holders pairs each with every earlier one, which changes nothing but which pair finds a block."""
    scratch = Scratch(docs.sparkSession, "lines")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = scratch.save(slim.mapInArrow(_lines, "ord long, th long, hashes binary, words binary, anchors array<long>").dropDuplicates(["ord", "th"]), "lines")
    held = lines.select("ord", "th", F.explode("anchors").alias("h"))
    first = held.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("ord", "th")).alias("first")).where("n > 1")
    first = scratch.save(first, "shared")
    held = scratch.save(held.join(first, "h"), "held")
    earlier = F.struct(F.col("e.ord"), F.col("e.th")) < F.struct(F.col("l.ord"), F.col("l.th"))
    few = held.where(F.col("n") <= rare)
    near = few.alias("l").join(few.alias("e"), (F.col("l.h") == F.col("e.h")) & earlier).select("l.ord", "l.th", F.col("e.ord").alias("e_ord"), F.col("e.th").alias("e_th"))
    far = held.where((F.col("n") > rare) & (F.struct("ord", "th") > F.col("first"))).select("ord", "th", F.col("first.ord").alias("e_ord"), F.col("first.th").alias("e_th"))
    pairs = near.union(far).distinct()
    own = lines.select("ord", "th", "hashes", "words")
    other = lines.select(F.col("ord").alias("e_ord"), F.col("th").alias("e_th"), F.col("hashes").alias("e_hashes"))
    both = pairs.join(other, ["e_ord", "e_th"]).join(own, ["ord", "th"])
    gone = both.select("ord", "th", "hashes", "words", "e_hashes").mapInArrow(_align, "ord long, th long, gone array<int>")
    return gone.select("ord", "th", F.explode("gone").alias("at")).groupBy("ord", "th").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def remove_common_lines(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """``row``, a struct of the columns of ``docs`` with ``text`` less its deleted lines; ``lines``, how many lines
    the text had, and ``removed``, how many of them went."""
    gone = deletions(docs, rare)
    rows = docs.select(whole_row(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("o"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("t"))
    rows = rows.join(gone, (F.col("o") == F.col("ord")) & (F.col("t") == F.col("th")), "left")
    left = F.expr("array_join(filter(split(row.text, '\\n', -1), (x, i) -> NOT array_contains(gone, i)), '\\n')")
    row = F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField("text", left))
    lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1)))
    return rows.select(row.alias("row"), lines.alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.col("row.text")
    return remove_common_lines(docs).select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))
