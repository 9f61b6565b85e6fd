"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from quire import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return int(v)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([plain(x) for x in r]) for r in cur.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in got.select(*columns).collect()) == want


def test_missing_files_of_pages_that_share_an_address(spark, tmp_path):
    urls = ["http://x/a", "http://x/a", None, "ftp://x/b", "/data/http://x/a", ""]
    rows = [(k, urls[k % len(urls)], "") for k in range(-60, 60)] + [(7, "http://x/7", ""), (7, "http://x/7", ""), (None, "http://x/n", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(con.execute(queries.SQL["missing_files_anti"]).fetchall(), key=repr)
    assert len(want) > 5
    assert sorted((tuple(r) for r in queries.QUERIES["missing_files_anti"](spark, str(tmp_path)).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 200
