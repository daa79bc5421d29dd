"""Queries of the subpackage that SQL can express give DuckDB's rows."""

import duckdb
import pytest

from factloom.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_sql(spark, oracle, name):
    found = oracle.execute(entries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    df = entries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    at = {c[0]: k for k, c in enumerate(found.description)}
    want = sorted(repr([r[at[c]] for c in columns]) for r in found.fetchall())
    # by value: a row of Spark's is compared as the plain values that it holds
    plain = lambda v: v.asDict(recursive=True) if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
