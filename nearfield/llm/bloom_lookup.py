"""Operator 9: document fingerprints by invertible Bloom lookup sketches. DataFrame functions only.

A text's paragraphs are its lines, a long line in pieces of ``PIECE`` words, each known by a 64-bit digest. A
sketch has three subtables of ``s`` cells; a digest goes to one cell of each, adding one to its count and
xor-ing itself and a check hash in. Two sketches of one size subtract cell by cell; what both texts hold
cancels, and a cell with count 1 or -1 and a matching check is one differing digest, which is taken out of
its other two cells, and so on (peeling, one subtable at a time, so no digest is taken out twice). From the
number of recovered digests and the two sizes follows the Jaccard likeness.

The fingerprint is the sketch itself, with ``CELLS`` cells a subtable for every text: its nonzero cells, packed
in ``CELL_BYTES`` bytes each, in base64. A pair is first compared by subtracting its two fingerprints. Where
cells remain, more differs than so small a sketch can tell, and both sketches are made again: as large as two
texts that share nothing would need, and ``GROWTH`` times larger each time that this fails.

``lead_text`` pairs each document with the next in descending id order: rows are put into ranges between
approximate quantiles of the ids (an id that is a quantile several times over, or null, is split by the hash of
the text), each range is ordered by itself, and the first row of each range is copied to the range before it. A
range's order is a sort that can spill; only rows equal in id and text can't be split.

Edges: a null text is the empty text, with an empty sketch; two empty sketches have likeness 1; a null id
orders last, rows of one id by the hash of their text; repeated rows follow one another; the next document
of the last is the first, and of a sole document itself; repeated paragraphs count once; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.plans.scratch import Scratch

PIECE, CELLS, CELL_BYTES, ROUNDS, GROWTH = 16, 16, 17, 6, 4
ROWS_A_RANGE, CUTS, ROWS_A_TASK, BROADCAST_RANGES = 50_000, 1000, 20_000, 100_000
_PIECES = rf"[^\x20\x09-\x0D]++(?:[\x20\x09\x0B-\x0D]++[^\x20\x09-\x0D]++){{0,{PIECE - 1}}}"
_CHECK, _CELL = 99, 100


def paragraphs(text: F.Column) -> F.Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda x: F.xxhash64(x)))


def _place(rows: DataFrame, rows_a_range: int) -> DataFrame:
    """``rows`` with ``range``, which falls as the order goes on: descending id, null last, then rising hash."""
    ids = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("m"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    wanted = max(1, min(ids.n // 2000, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-ids.n // rows_a_range))
    coarse = min(wanted, CUTS)
    found = rows.agg(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)], 20 * coarse)).first()[0] if coarse > 1 and ids.m else []
    cuts, fine = sorted(set(found or [])), -(-wanted // coarse)
    parts = [c * fine if (c := found.count(x)) > 1 else 1 for x in cuts]
    unit = "(shiftrightunsigned(th, 11) / 9007199254740992D)"
    by_hash = lambda m: f"({m} - 1 - cast(floor({m} * (CASE WHEN th < 0 THEN {unit} - 0.5D ELSE {unit} + 0.5D END)) AS long))"
    nulls = max(1, -(-(ids.n - ids.m) * wanted // max(1, ids.n)))
    at = f"array({', '.join(f'{x}L' for x in cuts)})" if cuts else "cast(array() AS array<bigint>)"
    heavy = f"array({', '.join(f'{x}L' for x in parts)})" if cuts else "cast(array() AS array<bigint>)"
    powers = ", ".join(str(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1))
    place = f"aggregate(array({powers}), 0, (p, k) -> CASE WHEN get({at}, p + k - 1) <= doc_id THEN p + k ELSE p END)" if cuts else "0"
    rows = rows.withColumn("place", F.expr(place)).withColumn("low", F.expr(f"coalesce(get({at}, place - 1), {ids.lo or 0}L)")).withColumn("m", F.expr(f"coalesce(get({heavy}, place - 1), 1L)"))
    share = f"(cast(doc_id AS double) - low) / greatest(1D, cast(coalesce(get({at}, place), {ids.hi or 0}L) AS double) - low)"
    part = f"CASE WHEN doc_id = low AND m > 1 THEN {by_hash('m')} ELSE m + least({fine - 1}L, cast(floor({share} * {fine}) AS long)) END"
    return rows.withColumn("range", F.expr(f"CASE WHEN doc_id IS NULL THEN {by_hash(f'{nulls}L')} - shiftleft(1L, 40) ELSE shiftleft(cast(place AS long), 32) + {part} END")).drop("place", "low", "m")


def lead_text(docs: DataFrame, scratch: Scratch, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``rid`` (unique), ``doc_id, text, units, next_text, next_units``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = _place(rows, rows_a_range)
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("th").alias("t"))).alias("h"))
    nth = F.row_number().over(Window.orderBy("range"))  # one row a range
    heads = heads.select("range", F.col("h.doc_id").alias("h_id"), F.bitwise_not("h.t").alias("h_th"), nth.alias("nth"))
    heads = scratch.save(heads, "heads")
    top = heads.count()
    heads = heads.withColumn("to", F.when(F.col("nth") == top, 1).otherwise(F.col("nth") + 1))  # the last one's next is the first
    rows = rows.join(F.broadcast(heads) if top <= BROADCAST_RANGES else heads, "range")
    is_head = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th"))
    here, there = (F.struct(F.col(c).alias("range"), F.lit(copy).alias("copy")) for c, copy in (("nth", False), ("to", True)))
    rows = rows.withColumn("units", paragraphs(F.col("text"))).withColumn("p", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("p.range", "p.copy", "doc_id", "th", F.struct("text", "units").alias("own"))
    order = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "th")
    rows = rows.withColumn("next", F.lead("own").over(order)).withColumn("nth", F.row_number().over(order)).where(~F.col("copy"))
    rid = F.shiftleft(F.col("range").cast("long"), 40) + F.col("nth")
    return rows.select(rid.alias("rid"), "doc_id", F.col("own.text").alias("text"), F.col("own.units").alias("units"), F.col("next.text").alias("next_text"), F.col("next.units").alias("next_units"))


def _sum(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    return out.where((F.col("cnt") != 0) | (F.col("key") != 0) | (F.col("chk") != 0))


def _check(key: str) -> str:
    return f"(xxhash64({key}, {_CHECK}) & 4294967295L)"


def sketch(digests: DataFrame, keys: list[str]) -> DataFrame:
    """Cells ``(*keys, s, cell, cnt, key, chk)``, nonzero ones only, of digests ``(*keys, s, d, g)`` of sign g."""
    cells = ", ".join(f"named_struct('cell', {j} * s + cast(pmod(xxhash64(d, {_CELL + j}), s) as int), 'cnt', g, 'key', d)" for j in range(3))
    out = digests.select(*keys, "s", F.expr(_check("d")).alias("chk"), F.explode(F.expr(f"array({cells})")).alias("c"))
    return _sum(out.select(*keys, "s", "c.cell", "c.cnt", "c.key", "chk"), [*keys, "s", "cell"])


def sketches(rows: DataFrame, sides: list[str]) -> DataFrame:
    """The fingerprints' cells of the digest arrays ``sides`` of each ``rid``; ``side`` is the place in the list."""
    units = "concat(" + ", ".join(f"transform({c}, d -> named_struct('side', {k}, 'd', d))" for k, c in enumerate(sides)) + ")"
    digests = rows.select("rid", F.explode(F.expr(units)).alias("u")).select("rid", "u.side", F.lit(CELLS).alias("s"), "u.d", F.lit(1).cast("long").alias("g"))
    return sketch(digests, ["rid", "side"])


def subtract(cells: DataFrame) -> DataFrame:
    """Cells by ``rid, pair``: side 0 less side 1 (pair 0), and less side 2 (pair 1)."""
    signs = "CASE WHEN side = 0 THEN array(named_struct('pair', 0, 'g', 1L), named_struct('pair', 1, 'g', 1L)) ELSE array(named_struct('pair', side - 1, 'g', -1L)) END"
    both = cells.select("rid", "s", "cell", "cnt", "key", "chk", F.explode(F.expr(signs)).alias("x"))
    return _sum(both.select("rid", "x.pair", "s", "cell", (F.col("cnt") * F.col("x.g")).alias("cnt"), "key", "chk"), ["rid", "pair", "s", "cell"])


def peel(cells: DataFrame, keys: list[str], rounds: int = ROUNDS, keep_digests: bool = False) -> DataFrame:
    """Cells after ``rounds``; cell -1 counts what was recovered or, with ``keep_digests``, is one row per
    recovered ``digest`` whose count is 1 or -1 by the side that holds it."""
    extra = ["digest"] * keep_digests
    if keep_digests:
        cells = cells.withColumn("digest", F.lit(None).cast("long"))
    found = "named_struct('cell', -1, 'cnt', {}, 'key', 0L, 'chk', 0L{})".format(*(("cnt", ", 'digest', key") if keep_digests else ("1L", "")))
    none = ", 'digest', cast(null as long)" if keep_digests else ""
    same = ", 'digest', digest" if keep_digests else ""
    for t in range(rounds):
        t %= 3
        pure = f"cell div s = {t} AND abs(cnt) = 1 AND chk = {_check('key')}"
        out = [f"named_struct('cell', {j} * s + cast(pmod(xxhash64(key, {_CELL + j}), s) as int), 'cnt', -cnt, 'key', key, 'chk', chk{none})" for j in range(3) if j != t]
        step = f"CASE WHEN cell >= 0 AND {pure} THEN array({found}, {', '.join(out)}) ELSE array(named_struct('cell', cell, 'cnt', cnt, 'key', key, 'chk', chk{same})) END"
        cells = _sum(cells.select(*keys, "s", F.explode(F.expr(step)).alias("c")).select(*keys, "s", "c.*"), [*keys, "s", "cell", *extra])
    return cells


def differences(base: DataFrame, scratch: Scratch, partitions: int, max_sizes: int = 14) -> DataFrame:
    """``rid, pair, differing`` of the rows of ``base`` (``rid, units, edited_units, next_units``): how many
    digests differ between ``units`` and the two others. Pairs that differ in nothing may be left out."""
    rows = base.select("rid", "units", "edited_units", "next_units")
    left, done = subtract(sketches(rows.repartition(partitions, "rid"), ["units", "edited_units", "next_units"])), None
    for k in range(max_sizes):
        sums = peel(left, ["rid", "pair"]).groupBy("rid", "pair", "s").agg(F.sum(F.when(F.col("cell") < 0, F.col("cnt")).otherwise(0)).alias("differing"), F.max("cell").alias("stuck"))
        sums = scratch.save(sums, f"peeled{k}")
        ok = sums.where("stuck < 0").select("rid", "pair", "differing")
        done = ok if done is None else done.union(ok)
        stuck = sums.where("stuck >= 0").groupBy("rid").agg(*[F.max(F.when(F.col("pair") == p, F.col("s"))).alias(f"s{p}") for p in (0, 1)])
        if stuck.isEmpty():
            return done
        rows = rows.join(stuck, "rid")
        if k:
            rows = scratch.save(rows, f"again{k}")
        larger = lambda p, b: f"CASE WHEN s{p} IS NOT NULL THEN greatest(s{p} * {GROWTH}, cast(pow(2D, ceil(log2(size(units) + size({b}) + 1D))) AS int)) END"
        pairs = ", ".join(f"named_struct('pair', {p}, 's', {larger(p, b)}, 'b', {b})" for p, b in enumerate(("edited_units", "next_units")))
        pair = rows.select("rid", "units", F.explode(F.expr(f"filter(array({pairs}), x -> x.s IS NOT NULL)")).alias("x"))
        both = "concat(transform(units, d -> named_struct('d', d, 'g', 1L)), transform(x.b, d -> named_struct('d', d, 'g', -1L)))"
        left = sketch(pair.select("rid", "x.pair", "x.s", F.explode(F.expr(both)).alias("u")).select("rid", "pair", "s", "u.d", "u.g"), ["rid", "pair"])
        rows = rows.drop("s0", "s1")
    raise RuntimeError("a sketch did not peel")


def _likeness(a: F.Column, b: F.Column, differing: F.Column) -> F.Column:
    both = a + b
    common = (both - F.coalesce(differing, F.lit(0))) / 2
    return F.when(both == 0, F.lit(1.0)).otherwise(common / (both - common))


def fingerprints(base: DataFrame, sides: list[str], partitions: int) -> DataFrame:
    """``rid`` and ``f0, f1, ...``: the packed sketches of the digest arrays ``sides``. A cell is its number (1 byte),
    count (4), digests (8) and checks (4) together."""
    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    cells = sketches(base.select("rid", *sides).repartition(partitions, "rid"), sides)
    packed = F.concat(wide("cell", 2), wide("cnt", 8), wide("key", 16), wide("chk", 8))
    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == k, packed))) for k in range(len(sides))]
    return cells.groupBy("rid").agg(*[F.base64(F.unhex(F.array_join(x, ""))).alias(f"f{k}") for k, x in enumerate(lists)])


def version_likeness(docs: DataFrame) -> DataFrame:
    """The op9 columns: each document against an edited version of itself and against the next one."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sketch")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = lead_text(docs, scratch).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.select("rid", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "units", paragraphs(F.col("edited")).alias("edited_units"), "next_units")
    base = scratch.save(rows, "base")
    scratch.keep("base")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // ROWS_A_TASK))
    found = differences(base, scratch, partitions)
    found = found.groupBy("rid").agg(*[F.max(F.when(F.col("pair") == k, F.col("differing"))).alias(f"d{k}") for k in (0, 1)])
    own = fingerprints(base, ["units", "edited_units"], partitions)
    out = base.select("rid", "doc_id", "n_chars", "edited_sha256", F.size("units").alias("n0"), F.size("edited_units").alias("n1"), F.size("next_units").alias("n2"))
    out = out.join(found, "rid", "left").join(own, "rid", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return out.select("doc_id", "n_chars", "edited_sha256", blank("f0").alias("fingerprint"), blank("f1").alias("edited_fingerprint"), _likeness(F.col("n0"), F.col("n1"), F.col("d0")).alias("near_edited"), _likeness(F.col("n0"), F.col("n2"), F.col("d1")).alias("near_next"))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return version_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
