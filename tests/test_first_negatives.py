"""Negative pairs by their hashes and draws, without the product of the sides."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sitewise.operators import sampling


def mixed(k, seed=0):
    return ((k * 48271 + seed * 7919 + 11) % 2147483647 * 69621 + 1) % 2147483647


def test_hashed_negatives(spark):
    rng = random.Random(5)
    left, right = rng.sample(range(100_000), 300), rng.sample(range(90_000), 200)
    for n, scale, seed, dense in ((10, 100_000, 0, False), (40, 1_000_003, 3, True), (50, 1000, 0, None)):
        pairs = [(a, b) for a in left for b in right]
        if dense is None:  # all but few are positive
            pos = rng.sample(pairs, len(pairs) - 30)
        else:  # as many of the first as would be asked for, and others
            pos = sorted(pairs, key=lambda x: (mixed(x[0] * scale + x[1], seed), x))[: 900 if dense else 5] + [(left[0], right[0])]
        pos = sorted(set(pos))
        own = lambda x: spark.createDataFrame([(r,) for r in x + x[:9]], "residue long")
        got = sampling.hashed_negatives(own(left), own(right), spark.createDataFrame(pos, "residue0 long, residue1 long"), "residue", scale, n, seed).collect()
        free = set(pairs) - set(pos)
        want = sorted((mixed(a * scale + b, seed), a * scale + b) for a, b in free)[:n]
        assert [(mixed(r["k"], seed), r["k"]) for r in got] == want
        assert all((r["residue0"], r["residue1"]) in free and r["k"] == r["residue0"] * scale + r["residue1"] for r in got)


def test_few_draws_among_many_positives(spark, monkeypatch):
    """As many draws as are needed are made, not one for each positive pair."""
    made = []
    was = sampling._numbers_between
    monkeypatch.setattr(sampling, "_numbers_between", lambda *a: (made.append(was(*a).count()), was(*a))[1])
    left = spark.createDataFrame([(e, r) for e in (1, 2) for r in range(200)], "e int, residue long")
    pos = spark.range(200 * 100).select(F.lit(1).alias("e"), F.expr("id div 100").alias("residue0"), (F.col("id") % 100).alias("residue1"))
    wanted = spark.createDataFrame([(1, 5), (2, 5)], "e int, wanted long")
    got = [tuple(r) for r in sampling.drawn_negatives(left, left, pos, wanted, ["residue"], ["e"]).collect()]
    assert sorted(r[0] for r in got) == [1] * 5 + [2] * 5 and all(e == 2 or b >= 100 for e, _, b in got)
    assert 0 < sum(made) < 200


def test_first_hashed(spark):
    rows = [(g, i) for g in ("a", "b") for i in range(3000 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i long")
    got = {tuple(r) for r in sampling.first_hashed(df, 7, F.col("i"), ["i"], ["g"], 2).collect()}
    assert got == {(g, i) for g in ("a", "b") for i in sorted((i for h, i in rows if h == g), key=lambda i: (mixed(i, 2), i))[:7]}
