import duckdb
import pytest

from tidemark.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want, key=repr)
