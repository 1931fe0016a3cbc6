"""Queries over tables whose ids outgrow fixed columns and codes."""

from __future__ import annotations

import pytest

from sitewise import registry


def clean(v):
    return (0.0 if v == 0 else round(v, 9)) if isinstance(v, float) else v


def same_as_sql(name, spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, str(folder))
    rel = con.sql(registry.oracle_sql()[name])
    at = [df.columns.index(c) for c in rel.columns]
    got = sorted((tuple(clean(r[i]) for i in at) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(clean, r)) for r in rel.fetchall()), key=repr)
    return got


@pytest.fixture(scope="module")
def wide(tmp_path_factory, sf):
    """Vectors twice: with ids below 7,000 and, ten times as far, above 60,000."""
    duckdb = pytest.importorskip("duckdb")
    folder = tmp_path_factory.mktemp("wide")
    shifted = " UNION ALL ".join(f"SELECT vec_id + {k} AS vec_id, * EXCLUDE vec_id FROM '{sf}/embeddings.parquet' WHERE vec_id < 150" for k in (6200, 62000))
    duckdb.connect().execute(f"COPY ({shifted}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return folder


def test_residue_numbers_beyond_four_digits_survive_a_structure_file(spark, wide):
    rows = same_as_sql("source_structures", spark, wide)
    assert len(rows) == 300


def test_structures_whose_codes_start_alike_are_not_the_same(spark, wide):
    assert same_as_sql("annotate_sites", spark, wide)


@pytest.mark.parametrize("n", [-999, -1, 0, 9_999, 10_000, 1_223_055, 1_223_056, 2_436_111])
def test_hybrid_numbers_come_back(spark, n):
    from pyspark.sql import functions as F
    from sitewise.sources.structures import _hybrid, _number

    text = spark.range(1).select(_hybrid(F.lit(n), 4).alias("t")).first()["t"]
    assert len(text) == 4 and _number(text) == n


def test_a_number_without_room_is_an_error(spark):
    from pyspark.sql import functions as F
    from sitewise.sources.structures import _hybrid

    with pytest.raises(Exception, match="no room"):
        spark.range(1).select(_hybrid(F.lit(2_436_112), 4)).collect()
