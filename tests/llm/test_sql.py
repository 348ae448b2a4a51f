"""The queries of this subpackage that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())
