"""Quantiles and shares of all pairs' cosines, scored again in each pass."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise import registry
from sitewise.operators import pair_scores, vectors


@pytest.fixture(scope="module")
def rows(spark):
    """Three groups: of plain vectors, of copies, and of a single row."""
    rng = np.random.default_rng(4)
    e = [rng.normal(size=5).tolist() for _ in range(90)]
    made = [(i, 1, v) for i, v in enumerate(e)] + [(100 + i, 2, e[i % 2]) for i in range(60)] + [(500, 3, e[0])]
    return vectors.unit_vectors(spark.createDataFrame(made, "id long, letter int, embedding array<double>")).cache()


def cosines(rows):
    by = {}
    for r in rows.collect():
        by.setdefault(r["letter"], []).append(r["u"])
    return {k: (lambda c: c[np.triu_indices(len(c), 1)])(np.array(u) @ np.array(u).T) for k, u in by.items() if len(u) > 1}


@pytest.mark.parametrize("last", [1 << 16, 20, 0])
def test_quantiles_are_exact_whatever_a_task_may_order(rows, monkeypatch, last):
    monkeypatch.setattr(pair_scores, "LAST_VALUES", last)
    levels = [0.0, 0.5, 0.9, 0.999, 1.0]
    got = {(r["letter"], r["level"]): r["quantile"] for r in pair_scores.PairScores(rows, "id", "letter", 16).quantiles(levels, True).collect()}
    want = cosines(rows)
    want[None] = np.concatenate(list(want.values()))
    assert set(got) == {(k, x) for k in want for x in levels}
    for (k, x), q in got.items():
        assert q == pytest.approx(np.quantile(want[k], x), abs=1e-12)


def test_share_below(rows, spark):
    every = np.round(np.concatenate(list(cosines(rows).values())), 9)
    asked = [-2.0, float(every[5]), 0.3, 1.0, 2.0]
    scores = spark.createDataFrame([(s,) for s in [*asked, None]], "cos double")
    got = {r["cos"]: r["p"] for r in pair_scores.PairScores(rows, "id", "letter", 16).share_below(scores, "cos", "p").collect()}
    assert got == {s: pytest.approx((every < round(s, 9)).mean()) for s in asked} | {None: None}


def test_pairs_are_not_written(spark, sf, monkeypatch):
    """What is written does not hold the pairs: 500 rows have 12,270 of one label."""
    from sitewise.operators import ranks, settle

    def counted(df):
        out = settle.settle(df)
        sizes.append(out.count() if "n" not in out.columns else 0)
        return out

    sizes: list[int] = []
    for m in (ranks, pair_scores, vectors):
        monkeypatch.setattr(m, "settle", counted)
    assert registry.queries()["background_quantiles"](spark, sf).count() == 44
    assert max(sizes) <= 500
