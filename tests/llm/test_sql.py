"""Queries with SQL give DuckDB's rows, on the smallest tables; the others run over them."""

import duckdb
import pytest

from quire.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([plain(x) for x in r]) for r in cur.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in got.select(*columns).collect()) == want


COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op2_line_dedup": ["doc_id", "n_lines", "n_removed"],
    "op3_resharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert got.count() == 200
