"""Every registered query of the corpus operators against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from auditmill.llm import queries

from tests.test_queries import SF, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    mine = [tuple(r) for r in got.collect()]
    sql = queries.oracle_sql().get(name)
    if sql is None:
        whole = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct() if name.startswith("op13") else spark.read.parquet(f"{SF}/documents.parquet")
        assert len(mine) == whole.count()
        return
    said = duck.execute(sql)
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, mine) == rows(names, said.fetchall())
