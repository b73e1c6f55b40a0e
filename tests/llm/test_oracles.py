"""Queries of whole tables against their SQL on an independent engine, at the scale of the correctness check."""

import duckdb
import pytest

from lumigrid.llm import registry

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = registry.QUERIES[name](spark, D)
    names = sorted(df.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    assert got == sorted(repr([r[i] for i in at]) for r in want.fetchall())
