"""Bits that rows get from similar queries: blocks reach a task once, pairs never."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sitewise.operators import vectors


def test_marks_by_strips_equal_all_pairs(spark, monkeypatch):
    """Cosines at a cutoff, equal and zero vectors, marks of two words, small blocks."""
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 40)
    monkeypatch.setattr(vectors, "STRIP_BLOCKS", 5)
    monkeypatch.setattr(vectors, "block_pairs", None)
    rng = random.Random(4)
    v = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(200)]
    v[3], v[10:40] = [0.0] * 4, [v[10]] * 30
    v[50], v[51] = [1.0, 0.0, 0.0, 0.0], [0.6, 0.8, 0.0, 0.0]  # 0.6 is a cutoff, and not above itself
    levels = [(0.6, [0b0101, 0b1]), (0.9, [0b1010, 0])]
    mark = lambda: [rng.getrandbits(4), rng.getrandbits(1)]
    asks, wants = {i: mark() for i in range(0, 200, 2)}, {i: mark() for i in range(200)}
    side = lambda m: vectors.unit_vectors(spark.createDataFrame([(i, v[i], x) for i, x in m.items()], "id long, embedding array<double>, marks array<long>")).repartition(3)
    asks[50], wants[51] = [0b1111, 1], [0b1111, 1]
    u = np.array(v) / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    cos = np.round(u @ u.T, 9)
    want = {}
    for j, w in wants.items():
        got = [0, 0]
        for i, m in asks.items():
            for cut, words in levels:
                if cos[i, j] > cut:
                    got = [g | a & b & c for g, a, b, c in zip(got, m, w, words)]
        if any(got):
            want[j] = got
    found = vectors.marked_reach(side(asks), side(wants), levels)
    assert {r["id"]: r["marks"] for r in found.collect()} == want and want
    assert found.where(F.exists("marks", lambda x: x < 0)).isEmpty()
