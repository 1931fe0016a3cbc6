"""Every query with an oracle gives the oracle's rows."""

from __future__ import annotations

import pytest

from sitewise import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def clean(v):
    return (0.0 if v == 0 else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(clean(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds


def test_queries_without_oracle_give_rows(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, sf).count() > 0, name


def test_entry_points():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
