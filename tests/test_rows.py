"""Alignment rows taken apart in their own task, against the operators on cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sitewise import registry
from sitewise.operators import rows, sampling, sequence

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("AC-Xde-é𝄞") for _ in range(n)) for n in (1, 63, 64, 65, 255, 256, 257, 700)]
    made += ["-" * 70, "", None, "A", "-"]
    return spark.createDataFrame([(i, "f" if i % 3 else "g", t) for i, t in enumerate(made)], "r int, f string, seq string").repartition(3)


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(b.columns) == columns
    x, y = (sorted(map(tuple, d.select(columns).collect())) for d in (a, b))
    assert x == y and x


def test_positions(texts):
    cells = sequence.alignment_cells(texts, ["r"], "seq")
    same(rows.positions(texts, ["r"], "seq"), sequence.ungapped_positions(cells, ["r"]).drop("ch"))
    same(rows.positions(texts, ["r"], "seq", ("-", "X"), None), sequence.sequence_positions(cells, ["r"]).drop("ch"))


def test_full_columns(texts):
    cells = sequence.alignment_cells(texts, ["f"], "seq")
    few = texts.where("r IN (6, 7) OR r = 4")
    same(rows.full_columns(texts.where("seq NOT LIKE '-%'"), ["f"], "seq"), sequence.aligned_columns(sequence.alignment_cells(texts.where("seq NOT LIKE '-%'"), ["f"], "seq"), ["f"]))
    same(rows.full_columns(few, ["f"], "seq"), sequence.aligned_columns(sequence.alignment_cells(few, ["f"], "seq"), ["f"]))
    assert cells.count() > 1000


def test_pair_columns(texts):
    pairs = texts.crossJoin(texts.select(F.col("r").alias("s"), F.col("seq").alias("seq2"))).where("r < s")
    letters = ["A", "C", "e", "é"]
    every = pairs.select("r", "s", F.explode(sequence.valid_pair_columns(F.col("seq"), F.col("seq2"), letters)).alias("col"))
    same(rows.pair_columns(pairs, ["r", "s"], "seq", "seq2", letters), every)
    same(rows.pair_columns(pairs, ["r", "s"], "seq", "seq2", letters, 3, 5), sampling.take_hashed(every, 3, "col", ["r", "s"], 5))


def test_placed_in_columns(texts):
    cells = sequence.alignment_cells(texts, ["r", "f"], "seq")
    conserved = sequence.column_entropy(cells, ["f"]).select("f", "col", "conservation")
    want = sequence.ungapped_positions(cells, ["r"]).where("seq_pos >= 0").join(conserved, ["f", "col"]).drop("ch")
    same(rows.placed_in_columns(texts, ["r", "f"], ["f"], "seq", conserved, "conservation"), want)


@pytest.mark.parametrize("name", ["gap_positions", "sequence_positions"])
def test_positions_are_not_shuffled(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["aligned_columns", "column_residues", "position_pair_sample"])
def test_characters_are_not_shuffled(name, spark, sf):
    """No sort or window over single characters is left."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and (name == "column_residues" or "posexplode" not in plan)


def test_column_counts(texts):
    cells = sequence.alignment_cells(texts, ["f"], "seq")
    same(rows.column_counts(texts, ["f"], "seq"), cells.groupBy("f", "col", "ch").agg(F.count("*").alias("n")))


def test_smoothing_copies_no_value_per_weight(spark):
    """Chunks, mirrors of short rows and nulls, against the plain sum; and no join per position."""
    import math

    rng = random.Random(5)
    own = {n: [None if rng.random() < 0.05 else rng.random() for _ in range(n)] for n in (1, 2, 7, 20, 41, 1023, 1024, 1045, 2100)}
    df = spark.createDataFrame([(n, i, v) for n, vs in own.items() for i, v in enumerate(vs)], "k int, pos long, v double").repartition(3)
    found = sequence.gaussian_smooth(df, ["k"], "pos", "v")
    got = {(r["k"], r["pos"]): r["smooth"] for r in found.collect()}
    w = [math.exp(-0.5 * (j / 5) ** 2) for j in range(-20, 21)]
    assert len(got) == sum(own)
    for n, vs in own.items():
        for i in range(n):
            at = [(i + j) % (2 * n) for j in range(-20, 21)]
            used = [(x, vs[a if a < n else 2 * n - 1 - a]) for x, a in zip(w, at)]
            want = sum(x * v for x, v in used if v is not None) / sum(w) if any(v is not None for _, v in used) else None
            assert (got[n, i] is None) == (want is None) and (want is None or abs(got[n, i] - want) < 1e-12), (n, i)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the sizes of the sequences
