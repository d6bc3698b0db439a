"""Operator 6: URL filters by a sort-merge range join.

A host's labels are reversed, so that a rule's host and all its subdomains are one interval of keys, and the
intervals of nested rules nest. URLs are dealt into key ranges cut at a sample of their own keys; a rule goes
to every range that its interval meets. Each range is sorted and swept once: a rule's interval is pushed on a
stack when the sweep reaches it and popped when it has passed, so the stack holds exactly the rules whose
hosts contain the URL's, the innermost on top. Of those whose path begins the URL's path, the rule with the
longest text wins (host and path together; of two verdicts for one rule, block).

The cut keys end in a hash of the row, so a host, or one URL, that holds a third of all rows is split over as
many ranges as it needs; only rows equal in id and path stay together, in a sweep that holds one batch. There are
at most ``MOST_RANGES`` ranges, whose rows are sorted with spilling; the driver gathers ``MOST_KEYS`` sampled keys
at most, of ``KEY_CHARS`` characters of the host, and tasks get one a range. No URL or rule is collected.

Edges: a null url, or one without ``://``, has an empty host and path, which no rule with a host fits; rules
with a null host or path are ignored; repeated rows and null ids are judged like others; an empty rule table
leaves the default verdict everywhere; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_END = "\U0010ffff"
ROWS_A_RANGE, KEYS_A_RANGE, MOST_RANGES, MOST_KEYS, KEY_CHARS = 500_000, 24, 20_000, 200_000, 200

#: host, path, verdict
PRODUCTION_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _key(host) -> F.Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))
    rows = rows.withColumn("key", _key(F.col("host")))
    return rows.withColumn("cut", F.concat_ws("\x00", F.substring("key", 1, KEY_CHARS), F.hex(F.xxhash64("page_id", "path"))))


def _deal(cuts: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's range number, or the first and last of a rule's."""
    for b in batches:
        lo = pa.array([bisect_right(cuts, x) for x in b.column("cut").to_pylist()], pa.int32())
        hi = pa.array([bisect_right(cuts, x) for x in b.column("upto").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([lo, hi, *b.columns], names=["lo", "hi", *b.schema.names])


def _sweep(default: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by range, key, rules before URLs, path."""
    names = ["page_id", "host", "path", "rule", "verdict"]
    at, stack = None, []  # of (key, {path: (text, verdict)}, path lengths from long to short)
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for part, is_url, key, path, page_id, host, verdict in zip(*(b.column(c).to_pylist() for c in ("part", "is_url", "key", "path", "page_id", "host", "verdict")), strict=True):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, rules, lengths = stack[-1]
                if path not in rules or verdict == "block":
                    rules[path] = (host + path, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best = None
            for _, rules, lengths in stack:
                for n in lengths:
                    if (found := rules.get(path[:n])) and n <= len(path):
                        if best is None or len(found[0]) >= len(best[0]):
                            best = found
                        break
            for c, v in zip(out, (page_id, host, path, best and best[0], best[1] if best else default), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], names=names)


def match_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``); ``rules`` has
    ``host``, ``path`` and ``verdict`` (allow or block)."""
    spark = pages.sparkSession
    urls = _parts(pages)
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n := pages.count()) // ROWS_A_RANGE)))
    share = min(1.0, min(ranges * KEYS_A_RANGE, MOST_KEYS) / max(1, n))
    keys = sorted(r[0] for r in urls.where(F.pmod(F.xxhash64("cut", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("cut").collect())
    cuts = [keys[k * len(keys) // ranges] for k in range(1, ranges)] if len(keys) >= ranges else sorted(set(keys))
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), "path", "verdict").where(F.col("host").isNotNull() & F.col("path").isNotNull()).withColumn("key", _key(F.col("host")))
    fields = "page_id long, host string, path string, verdict string, key string, is_url boolean, cut string, upto string"
    names = [f.split()[0] for f in fields.split(", ")]
    ends = rules.select(F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict", "key", F.lit(False).alias("is_url"), F.substring("key", 1, KEY_CHARS).alias("cut"), F.concat(F.substring("key", 1, KEY_CHARS), F.lit(_END)).alias("upto"))
    rows = urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("verdict"), "key", F.lit(True).alias("is_url"), "cut", F.col("cut").alias("upto"))
    dealt = rows.select(*names).union(ends.select(*names)).mapInArrow(partial(_deal, cuts), "lo int, hi int, " + fields)
    dealt = dealt.select(F.explode(F.sequence("lo", "hi")).alias("part"), "is_url", "key", "path", "page_id", "host", "verdict")
    order = ["part", "key", "is_url", "path"]
    return dealt.repartition(ranges, "part").sortWithinPartitions(*order).mapInArrow(partial(_sweep, default), "page_id long, host string, path string, rule string, verdict string")


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(PRODUCTION_RULES, "host string, path string, verdict string")
    return match_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP6_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fits AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM fits GROUP BY page_id, host, path
"""
