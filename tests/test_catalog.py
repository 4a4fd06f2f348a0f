"""Every registered query of the core against its DuckDB statement on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lumora.plans import catalog, library, searches

QUERIES, SQL = catalog.QUERIES | library.QUERIES | searches.QUERIES, catalog.SQL | library.SQL | searches.SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    return round(float(v), 3) if isinstance(v, int | float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(str(tuple(map(plain, r))) for r in cur.fetchall())
    assert sorted(str(tuple(map(plain, r))) for r in got.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_merge_rules_of_all_documents(spark, duck):
    rows = duck.execute("SELECT doc_id, source, lang, text FROM documents").fetchall()
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    first = {}
    for k, source, lang, text in rows:
        for rule in (("kind", source, lang), ("text", text)):
            if None not in rule:
                a, b = sorted((find(k), find(first.setdefault(rule, k))))
                root[b] = a
    got = {r.node: r.root for r in catalog.QUERIES["merge_rules"](spark, DATA).collect()}
    assert got == {k: find(k) for k in root}
