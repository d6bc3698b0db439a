"""Every catalogue query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from nearfield import catalogue
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(([None if x != x else x for x in r] for r in df[cols].astype(object).values.tolist()), key=lambda r: [(x is None, str(x)) for x in r]), cols


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = rows(catalogue.QUERIES[name](spark, SMALL).toPandas()), rows(duck.sql(catalogue.ORACLE_SQL[name]).df())
    assert got == want


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_levenshtein_takes_whole_texts(spark, duck, tmp_path):
    texts = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    got = {(r.i, r.j): r.value for r in catalogue.QUERIES["levenshtein_items"](spark, SMALL).collect()}
    assert len(got) == len(texts) * (len(texts) - 1) // 2
    some = [p for p in sorted(got) if not (texts[p[0]].isascii() and texts[p[1]].isascii())][:40]
    assert some and all(got[p] == edits(texts[p[0]], texts[p[1]]) for p in some)
    odd = ["日本", "日", "déjà 🙂", "deja", "", None]
    spark.createDataFrame(list(enumerate(odd)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.i, r.j): r.value for r in catalogue.QUERIES["levenshtein_items"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): None if odd[j] is None else edits(odd[i], odd[j]) for i in range(6) for j in range(i + 1, 6)}
