"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import __spark_entry__
import duckdb
import pytest
from auditmill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def normal(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(normal(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    mine = [tuple(r) for r in got.collect()]
    if name not in SQL:
        assert mine
        return
    said = duck.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, mine) == rows(names, said.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
