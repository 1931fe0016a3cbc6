"""Nearest rows: blocks reach a task once, and a task hands on its nearest only."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.functions.columns import unit
from sitewise.operators import vectors


@pytest.mark.parametrize("folds", [None, 3])
def test_a_task_hands_on_its_nearest_only(spark, monkeypatch, folds):
    """Many equal vectors, a zero vector and a null one, in small blocks of few a strip."""
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 60)
    monkeypatch.setattr(vectors, "STRIP_BLOCKS", 7)
    monkeypatch.setattr(vectors, "block_pairs", None)
    rng = random.Random(2)
    v = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(300)]
    for i in range(40, 120):
        v[i] = v[40]
    v[7] = [0.0] * 6
    rows = [(i, i % 4, x) for i, x in enumerate(v)] + [(999, 1, None)]
    db = vectors.unit_vectors(spark.createDataFrame(rows, "id long, letter int, embedding array<double>")).repartition(3)
    q = db.withColumnRenamed("id", "q")
    u = np.array(v) / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    cos = np.round(u @ u.T, 9)
    other = lambda i, j: i != j if folds is None else i % folds != j % folds
    want = {i: sorted((-cos[i, j], j) for j in range(300) if other(i, j))[:4] for i in range(300)}
    near = vectors.similarity_join(q, db, -2.0, "q", "id", best=4, folds=folds)
    assert near.groupBy(F.spark_partition_id(), "q").count().agg(F.max("count")).first()[0] <= 4 * 5
    got: dict = {}
    for r in near.collect():
        got.setdefault(r["q"], []).append((-r["cos"], r["id"]))
    assert {i: sorted(x)[:4] for i, x in got.items()} == want
    vote = {r["id"]: r["predicted"] for r in vectors.nearest_vote(db, "id", "letter", 4, folds).collect()}
    for i, near_ in want.items():
        n = [sum(j % 4 == k for _, j in near_) for k in range(4)]
        assert vote[i] == n.index(max(n))


def test_a_vectors_length_is_taken_once(spark):
    df = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: i.cast("double") + F.col("id")).alias("a")).repartition(1).cache()
    df.count()
    began = time.perf_counter()
    total = df.select(F.aggregate(unit(F.col("a")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).agg(F.min("n"), F.max("n")).first()
    assert time.perf_counter() - began < 30 and all(abs(x - 1) < 1e-9 for x in total)  # 900 million steps otherwise
    odd = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],), ([3.0, 4.0],), ([1.0, None],)], "a array<double>").select(unit(F.col("a")).alias("u"))
    assert [r["u"] for r in odd.collect()] == [None, [], [0.0, 0.0], [0.6, 0.8], [0.0, 0.0]]
