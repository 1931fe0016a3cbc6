"""Alignment queries over documents of which some have an empty text, or none."""

from __future__ import annotations

import pytest

from sitewise import registry

NAMES = ["aligned_columns", "column_residues", "domain_bounds", "family_columns", "gap_positions", "msa_conservation", "msa_entropy", "sequence_positions"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_texts_equal_sql(name, spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    texts = "(0, 'ab - X', 'en'), (1, '', 'en'), (2, '', 'en'), (3, 'a b', 'fr'), (4, '', 'de'), (5, NULL, 'it'), (6, '', NULL), (8, '  ', 'fr')"
    con.execute(f"CREATE TABLE documents AS SELECT CAST(column0 AS BIGINT) AS doc_id, column1 AS text, column2 AS lang FROM (VALUES {texts}) t(column0, column1, column2)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = registry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
