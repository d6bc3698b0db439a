"""Operator 1: mixing sources to target weights by Pareto order sampling.

A document expects ``m = ratio * weight`` copies, where ``ratio`` brings its source to the source's target
words. ``floor(m)`` copies are certain. The fraction ``p = m - floor(m)`` is its inclusion probability for
one more: with a uniform draw ``u`` the rank is ``(u / (1 - u)) / (p / (1 - p))``, and a source takes the
ranks in order until its words are as near to the rest of its target as a prefix gets. One document, the one
whose size best closes the gap that remains, is then added to or taken from the prefix.

Draws are a hash of the seed and ``doc_id``, so reruns agree whatever the partitioning. Rows equal in id, text
and source have one draw and are counted as one group, and a cut inside a group takes some of its rows. No source
is sorted in one task: ranks are put into bins (``BINS``, more for large tables), only the bin in which a source's
cut falls is ordered, and all else is a bin number against a small table with one row per source (broadcast only
while that table has at most ``BROADCAST_SOURCES`` rows). Only the rows of a group that is taken in part are
numbered, at most two groups a source.

Edges: a null text has size 0; null sources form one source that sorts last; a null ``doc_id`` draws as the
empty text; repeated rows each count; one id with different texts has one draw, ties settled by the text's hash;
other columns, whatever their names, are carried along; an empty table gives an empty result. A source without
words has target 0 and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.text import ascii_word_count, whole_row
from nearfield.plans.scratch import Scratch

BINS, ROWS_A_BIN, BROADCAST_SOURCES, SEED = 1 << 12, 1 << 18, 10_000, "mix-1"
_KEY = ["rank", "u", "id", "tie"]


def _sized(docs: DataFrame, weight: str | None, *carried: Column) -> DataFrame:
    """What a draw needs of each row: size, weight, uniform draw, tie breakers; and the ``carried`` columns."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    return docs.select(F.col("source").cast("string").alias("source"), ascii_word_count(F.col("text")).alias("size"), w.alias("w"), u.alias("u"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"), *carried)


def _running(col: str, order: list[Column]) -> Column:
    return F.coalesce(F.sum(col).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def water_fill(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``source, source_size, weighted, target``. Sources in code point order, null last, take ``weights`` in turn
    and share the sum of all sizes; a target stops at ``cap`` sizes and the excess is shared anew by weight.

    Sources are filled in order of the level at which they stop: one stops if its size times ``cap`` is at
    most its share of what those before it leave. One row per source is ordered here, never documents.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("wt", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(at, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("stop", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("stop") / F.col("wt"))
    order = [F.col("level"), F.col("source").asc_nulls_last()]
    whole = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(whole) - _running("stop", order)).withColumn("rest_wt", F.sum("wt").over(whole) - _running("wt", order))
    s = s.withColumn("full", F.col("stop") * F.col("rest_wt") <= F.col("rest") * F.col("wt"))
    rate = (F.sum("source_size").over(whole) - F.sum(F.when(F.col("full"), F.col("stop")).otherwise(0.0)).over(whole)) / F.sum(F.when(~F.col("full"), F.col("wt"))).over(whole)
    return s.select("source", "source_size", "weighted", F.when(F.col("full"), F.col("stop")).otherwise(rate * F.col("wt")).cast("double").alias("target"))


def _with_source(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` with the columns of their source's row of ``table``."""
    t = table.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(t) if n_sources <= BROADCAST_SOURCES else t, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _joined(table: DataFrame, more: DataFrame) -> DataFrame:
    return table.join(more.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _ranked(rows: DataFrame, cap: float, bins: int) -> DataFrame:
    """Certain copies, the chance of one more, the rank and its bin (null where there is no chance). Bins go by the
    rank times the odds that an average row of the source has, which spreads a source's rows over all of them."""
    ratio = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0)
    rows = rows.withColumn("m", F.least(F.lit(float(cap)), ratio * F.col("w"))).withColumn("sure", F.floor("m")).withColumn("p", F.col("m") - F.col("sure"))
    x = (F.col("u") + 0.5) / F.lit(float(1 << 52))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, (x / (1 - x)) * ((1 - F.col("p")) / F.col("p"))))
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    usual = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), mean - F.floor(mean)))
    even = F.col("rank") * (usual / (1 - usual))
    return rows.withColumn("bin", F.floor(F.lit(float(bins)) * even / (1 + even)))


class Mix:
    """The plan of one mix: ``table`` has a row per source with its target, cut and closing document."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, weight: str | None = None):
        self.cap = cap
        scratch = Scratch(docs.sparkSession, "mix")
        self.slim = scratch.save(_sized(docs, weight, F.col("doc_id")), "slim")
        groups = scratch.save(self.slim.groupBy("source", "size", "w", "u", "id", "tie").agg(F.count("*").alias("n")), "groups")
        sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("w") * F.col("size") * F.col("n")).alias("weighted"), F.count("*").alias("groups"))
        sources = scratch.save(sources, "sources")
        self.n_sources, largest = sources.agg(F.count("*"), F.coalesce(F.max("groups"), F.lit(0))).first()
        self.bins = max(BINS, 1 << max(0, (largest // ROWS_A_BIN).bit_length()))
        targets = scratch.save(water_fill(sources.drop("groups"), weights, cap), "targets")
        ranked = self._ranked(groups, targets)
        bins = ranked.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.col("size") * F.col("sure") * F.col("n")).alias("sure"))
        w = Window.partitionBy("source")
        before = F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("words"))).over(w.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = _with_source(bins.withColumn("sure", F.sum("sure").over(w)).withColumn("before", before), targets, self.n_sources).withColumn("rest", F.col("target") - F.col("sure"))
        cut = bins.where(F.col("bin").isNotNull()).groupBy("source").agg(F.max("rest").alias("rest"), F.max(F.when(F.col("before") < F.col("rest"), F.struct("bin", "before"))).alias("at"))
        table = scratch.save(_joined(targets, cut), "cuts")
        edge = self._ranked(groups, table).where(F.col("bin") == F.col("at.bin"))
        edge = edge.withColumn("so_far", F.coalesce(F.sum(F.col("size") * F.col("n")).over(w.orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("at.before"))
        fits = F.floor((2 * (F.col("rest") - F.col("so_far")) + F.col("size")) / (2 * F.col("size")))  # rows of the group, in a prefix nearest to the rest
        fits = F.when(F.col("size") == 0, F.when(F.col("so_far") <= F.col("rest"), F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), fits)).cast("long")
        edge = edge.withColumn("k", fits).where("k > 0").withColumn("taken", F.col("so_far") + F.col("k") * F.col("size"))
        last = edge.groupBy("source").agg(F.max(F.struct(*_KEY, "k", "n", "taken")).alias("end"))
        last = last.select("source", F.struct(*[F.col(f"end.{c}") for c in _KEY]).alias("last"), F.col("end.k").alias("last_k"), F.col("end.n").alias("last_n"), F.col("end.taken").alias("taken"))
        table = _joined(table, last)
        table = scratch.save(table.withColumn("gap", F.col("rest") - F.coalesce("taken", "at.before", F.lit(0))), "table")
        near = self._taken(self._ranked(groups, table)).where(F.col("bin").isNotNull())
        left = F.abs(F.abs("gap") - F.col("size"))
        able = F.when(F.col("gap") < 0, F.col("inside") > 0).otherwise(F.col("inside") < F.col("n"))
        fix = near.where(able & (F.col("gap") != 0) & (left < F.abs("gap"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), *_KEY, "n", "inside")).alias("x"))
        fix = fix.select("source", F.struct(*[F.col(f"x.{k}") for k in _KEY]).alias("fix"), F.col("x.n").alias("fix_n"), F.col("x.inside").alias("fix_inside"))
        table = _joined(table, fix)
        some = lambda e, n: (F.col(e) > 0) & (F.col(e) < F.col(n))
        end = F.col("last_k") + F.when(F.col("fix") == F.col("last"), F.signum("gap")).otherwise(0)
        table = table.withColumn("last_k", F.coalesce(end, F.col("last_k")).cast("long")).withColumn("fix_k", (F.col("fix_inside") + F.signum("gap")).cast("long"))
        self.table = scratch.save(table.withColumn("parts", F.coalesce(some("last_k", "last_n"), F.lit(False)) | F.coalesce(some("fix_k", "fix_n"), F.lit(False))), "final")
        self.parts = not self.table.where("parts").isEmpty()
        scratch.keep("slim", "final")

    def _ranked(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        return _ranked(_with_source(rows, table, self.n_sources), self.cap, self.bins)

    @staticmethod
    def _taken(groups: DataFrame) -> DataFrame:
        """``inside``: the rows of a group that the prefix holds."""
        key = F.struct(*_KEY)
        whole = (F.col("bin") < F.col("at.bin")) | ((F.col("bin") == F.col("at.bin")) & (key < F.col("last")))
        return groups.withColumn("inside", F.when(key == F.col("last"), F.col("last_k")).when(whole, F.col("n")).otherwise(0))

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` (sized) with their source's columns and ``copies``, how often the mix takes each."""
        rows, key = self._ranked(rows, self.table), F.struct(*_KEY)
        yes = lambda c: F.coalesce(c, F.lit(False)) & F.col("bin").isNotNull()
        is_fix, is_last = yes(key == F.col("fix")), yes(key == F.col("last"))
        whole = yes((F.col("bin") < F.col("at.bin")) | ((F.col("bin") == F.col("at.bin")) & (key < F.col("last"))))
        # how many rows of the row's group have one copy more, and of how many; of groups that aren't at a cut all or none
        rows = rows.withColumn("more", F.when(is_last, F.col("last_k")).when(is_fix, F.col("fix_k")).otherwise(whole.cast("long")))
        rows = rows.withColumn("of", F.when(is_last, F.col("last_n")).when(is_fix, F.col("fix_n")).otherwise(1))
        if self.parts:
            part = (F.col("more") > 0) & (F.col("more") < F.col("of"))
            nth = F.row_number().over(Window.partitionBy("source", *_KEY, "size", "w").orderBy(F.lit(0)))
            numbered = rows.where(part).withColumn("more", (nth <= F.col("more")).cast("long"))
            rows = rows.where(~part).unionByName(numbered)
        return rows.withColumn("copies", F.col("sure").cast("int") + (F.col("more") > 0).cast("int"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, weight: str | None = None) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it. ``weight`` names a
    column of relative preferences within a source."""
    plan = Mix(docs, weights, cap, weight)
    rows = plan.copies(_sized(docs, weight, whole_row(docs)))
    times = F.expr("CASE WHEN copies > 0 THEN array_repeat(0, copies) END")
    return rows.select("row", F.explode(times)).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    plan = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.copies(plan.slim).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT] AS w FROM src),
levels AS (SELECT *, source_size * 3.0::DOUBLE AS stop, source_size * 3.0::DOUBLE / w AS level FROM weighted),
rest AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(stop) OVER b, 0) AS left_words, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
  FROM levels WINDOW b AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, stop * left_w <= left_words * w AS is_full FROM rest),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN stop ELSE
      (sum(source_size) OVER ()::DOUBLE - sum(CASE WHEN is_full THEN stop ELSE 0.0 END) OVER ()) / sum(CASE WHEN NOT is_full THEN w END) OVER () * w END AS target
  FROM stopped),
ranked AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0.0 END AS m
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, floor(m)::BIGINT AS sure, target - sum(floor(m)::BIGINT * size) OVER (PARTITION BY source) AS need,
    sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM ranked),
prefix AS (SELECT *, m > floor(m) AND run - size < need AND 2 * run - size <= 2 * need AS inside FROM placed),
gaps AS (SELECT *, need - coalesce(sum(CASE WHEN inside THEN size END) OVER (PARTITION BY source), 0) AS gap FROM prefix),
fixes AS (
  SELECT *, abs(gap - CASE WHEN inside THEN -size ELSE size END) AS left_gap,
    m > floor(m) AND inside = (gap < 0) AND abs(gap - CASE WHEN inside THEN -size ELSE size END) < abs(gap) AS fits FROM gaps),
closing AS (SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY source, fits ORDER BY left_gap, u, doc_id) END AS nth FROM fixes)
SELECT doc_id, size, source_size, target, (size * (sure + (inside <> coalesce(nth = 1, false))::INT))::BIGINT AS taken FROM closing
"""
