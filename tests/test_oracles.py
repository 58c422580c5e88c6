"""Every query with SQL against DuckDB at sf0.001; every other one yields rows."""

import duckdb
import pytest

from cinderglass.plans import catalog_queries

D = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "events", "conversations", "labels", "benchmark", "embeddings"]


@pytest.mark.parametrize("name", list(catalog_queries.QUERIES))
def test_query(spark, name):
    df = catalog_queries.QUERIES[name](spark, D)
    rows = df.collect()
    if name not in catalog_queries.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    res = con.execute(catalog_queries.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(key([r[c] for c in names]) for r in rows) == sorted(map(key, res.fetchall()))
