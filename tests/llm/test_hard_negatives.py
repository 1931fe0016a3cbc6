"""Operator 13 against brute force, with hostile rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitewise.llm import hard_negatives as hn

FIELDS = "vec_id long, embedding array<float>, label int, uid string, score string, q long"


def brute(rows, every=10, k=5, m=5, low=80):
    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    held = [(i, r[0], [math.floor(256 * x) for x in r[1]], r[2]) for i, r in enumerate(rows) if ok(r)]
    out = []
    for n, i, q, label in held:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, c)), j, m_, lab) for m_, j, c, lab in held if len(c) == len(q) and m_ != n]
        for p in sorted(s for s in scored if s[3] == label)[:k]:
            fits = sorted(s for s in scored if s[3] != label and -low * p[0] <= -100 * s[0] <= -100 * p[0])[:m]
            out += [(i, p[1], r + 1, s[1], -p[0], -s[0]) for r, s in enumerate(fits)]
    return Counter(out)


def rows_of(seed, n=400, dim=6):
    rng = random.Random(seed)
    vec = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) * rng.choice([1, 1, 4]) for _ in range(dim)]
    rows = [(i, vec(), rng.randrange(4)) for i in range(n)]
    rows += [(10, vec(), 1), (10, vec(), 1), (11, vec(), 2), (None, vec(), 1), (20, None, 1), (30, vec(), None), (40, [1.0, None], 1), (50, [float("nan")] * dim, 1), (60, [float("inf")] * dim, 2)]
    rows += [(i, [0.5, float(i % 3)], i % 2) for i in range(700, 760)] + [(770, [], 1), (771, [], 1), (772, [], 2)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "BUCKET_ROWS", 16)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 20)
    monkeypatch.setattr(hn, "CHUNK_ANCHORS", 7)
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], FIELDS).repartition(3)
    got = Counter(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows) and got


def test_hard_negatives_of_few_rows(spark):
    kind = "vec_id long, embedding array<double>, label int"
    mine = lambda rows: [tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()]
    assert mine([]) == []
    assert mine([(0, [1.0], 1)]) == mine([(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mine([(0, [1.0], 1), (1, [1.0], 1)]) == []
    # A negative score of the positive leaves an empty window.
    assert mine([(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]) == []
    # Both ends of the window count: 80 % and 100 % of 100 * 256.
    rows = [(0, [1.0], 1), (1, [100 / 256], 1), (2, [100 / 256], 2), (3, [80 / 256], 2), (4, [79 / 256], 2), (5, [101 / 256], 2)]
    assert mine(rows) == [(0, 1, 1, 2, 25600, 25600), (0, 1, 2, 3, 25600, 20480)]
    # Products beyond doubles are exact; beyond 2**61 they count as that.
    big = 2.0**30
    assert mine([(0, [big / 256, 1 / 256], 1), (1, [big / 256, 1 / 256], 1), (2, [big / 256, 0.0], 2)]) == [(0, 1, 1, 2, 2**60 + 1, 2**60)]
    assert mine([(0, [1e300], 1), (1, [1e300], 1), (2, [1e299], 2)]) == [(0, 1, 1, 2, 2**61, 2**61)]


def test_registered_query(spark, sf):
    from sitewise.llm.queries import QUERIES

    found = QUERIES["op13_hard_negatives"](spark, sf)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    changed = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    assert Counter(tuple(r) for r in found.collect()) == brute(changed, 100)
