import os

import duckdb
import pytest

import __spark_entry__ as entry
from chatlake.jobs import registry
from tests.conftest import SF


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def test_every_query_has_a_counterpart():
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES) and set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_counterpart(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    rel = tables.sql(registry.ORACLE_SQL[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert len(rel.columns) == len(columns)
    theirs = sorted(repr([_plain(r[i]) for i in at]) for r in rel.fetchall())
    assert ours == theirs
