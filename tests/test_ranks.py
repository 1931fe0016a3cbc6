"""Running sums, quantiles, folds and similarity joins that no task sees whole."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import calibrate, metrics, ranks, sampling, vectors


def values(n=3000, seed=3):
    rng = random.Random(seed)
    rows = [("a", rng.gauss(0, 1)) for _ in range(n)] + [("b", float(rng.randrange(5))) for _ in range(n)] + [("c", 7.0)]
    rows += [("d", rng.choice([1e-300, 1e300, -1e300, 1.0, 1.0 + 2**-52])) for _ in range(200)] + [("a", 1e9), ("e", None), ("e", float("nan")), (None, 1.0)]
    return rows


@pytest.mark.parametrize("few", [4096, 5])
def test_quantiles_equal_numpy(spark, few, monkeypatch):
    monkeypatch.setattr(ranks, "LAST_VALUES", few)
    monkeypatch.setattr(ranks, "BINS", 16)
    rows = values()
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    levels = [0.0, 0.25, 0.5, 0.99, 0.9999, 1.0]
    by = defaultdict(list)
    for k, v in rows:
        if k and v is not None and v == v:
            by[k].append(v)
    got = {(r["k"], r["level"]): r["quantile"] for r in ranks.quantiles(df, ["k"], "v", levels).collect()}
    want = {(k, x): np.quantile(v, x) for k, v in by.items() for x in levels}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert got[key] == pytest.approx(x, rel=1e-12, abs=1e-12), key
    every = {r["level"]: r["quantile"] for r in ranks.quantiles(df.where("k IN ('a', 'b')"), [], "v", levels).collect()}
    assert every == pytest.approx({x: np.quantile(by["a"] + by["b"], x) for x in levels})
    assert ranks.quantiles(df.limit(0), ["k"], "v", levels).count() == 0


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["big"] * 9 + ["x", "y", None]), i, rng.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v long")
    got = {r["i"]: (r["s"], r["total_s"]) for r in ranks.running(df, ["i"], ["k"], {"s": F.col("v")}, ranges=7).collect()}
    seen, total = Counter(), Counter()
    for k, _, v in rows:
        total[k] += v
    for k, i, v in rows:
        assert got[i] == (seen[k], total[k])
        seen[k] += v
    assert ranks.running(df.limit(0), ["i"], ["k"]).count() == 0


def test_ranges_hold_no_more_for_an_outlier_or_a_hot_key(spark):
    n = 100_000
    far = spark.range(n).select(F.lit("k").alias("k"), (F.rand(1) * 1e-6).alias("v")).unionAll(spark.createDataFrame([("k", 1e12)], "k string, v double"))
    for keys in ([], ["k"]):
        sizes = [r["count"] for r in ranks.dealt(far, keys, ["v"], 40).groupBy("_p").count().collect()]
        assert max(sizes) < 0.05 * n and sum(sizes) == n + 1


def test_percentiles_and_curves_without_keys(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(2), float(rng.randrange(40)) if i % 3 else rng.random() * 40) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, y int, s double")
    got = {r["i"]: r["percentile"] for r in calibrate.percentile_scores(df, df.where("y = 0"), "s", "s").collect()}
    low = [s for _, y, s in rows if y == 0]
    assert got == pytest.approx({i: sum(x < s for x in low) / len(low) for i, _, s in rows})
    pos = [s for _, y, s in rows if y == 1]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in low) / len(pos) / len(low)
    assert metrics.auroc(df, "y", "s").first()["auroc"] == pytest.approx(want)
    steps, tp, k = 0.0, 0, 0
    for s in sorted({x for *_, x in rows}, reverse=True):
        own = [y for _, y, x in rows if x == s]
        tp, k = tp + sum(own), k + len(own)
        steps += sum(own) / len(pos) * tp / k
    assert metrics.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx(steps)


def test_nested_folds(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "i long, y int")
    rows = sampling.nested_folds(df, "y", "i", 5, 4, held_back=30).collect()
    spare = {r["i"] for r in rows if r["role"] == "validation"}
    assert len(spare) == 70 and all(i % 10 == 0 for i in spare)
    for fold in range(5):
        own = [r for r in rows if r["outer"] == fold]
        assert len(own) == 1000 and {r["i"] for r in own if r["role"] == "validation"} == spare
        for y, n in ((1, 30), (0, 900)):
            test = [r for r in own if r["y"] == y and r["role"] == "test"]
            inner = Counter(r["inner"] for r in own if r["y"] == y and r["role"] == "train")
            assert len(test) == n // 5 and sum(inner.values()) == n - n // 5
            assert max(inner.values()) - min(inner.values()) <= 1 and len(inner) == 4
    tested = Counter(r["i"] for r in rows if r["role"] == "test")
    assert set(tested.values()) == {1} and len(tested) == 930


def cloud(n, seed=1, dim=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    x = centers[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dim))
    return [(i, int(i % 3), x[i].tolist()) for i in range(n)]


def test_block_pairs_are_left_out_only_where_nothing_is(spark):
    rows = cloud(600)
    df = vectors.unit_vectors(spark.createDataFrame([*rows, (900, None, [1.0] * 16), (901, 1, None), (902, 1, [1.0])], "id long, g int, e array<double>"), "e")
    u = np.array([np.array(e) / np.linalg.norm(e) for _, _, e in rows])
    cos = np.round(u @ u.T, 9)
    for cut in (0.95, 0.2, -2.0):
        got = {(r["a"], r["b"]) for r in vectors.similar_pairs(df, cut, "id", "g", block_rows=20).collect()}
        assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if i % 3 == j % 3 and cos[i, j] > cut}
    blocks = vectors._blocks(df.withColumn("_cut", F.lit(0.95)), "id", "g", 5, vectors._pivots(df, "g"))
    every = sum(n * n for n in Counter(r["grp"] for r in blocks.select("grp").collect()).values())
    assert vectors.block_pairs(blocks, blocks).count() < every / 3


def test_rows_are_copied_by_the_root_of_the_tasks(spark):
    """A row goes to one strip of the other side each, not to one block each."""
    copies = []
    for n in (400, 1600, 6400):
        left, right = (-(-n // 10), -(-n // 10))
        a, b = vectors.strips(left, right, 16)
        assert a * b >= 16 and a <= left and b <= right
        copies.append(a + b)
    assert copies == [8, 8, 20]  # blocks of the other side: 40, 160, 640
    a, b = vectors.strips(2, 100_000, 400)
    assert a <= 2 and a * b >= 400
    df = vectors.unit_vectors(spark.createDataFrame(cloud(640), "id long, g int, e array<double>"), "e")
    blocks = vectors._blocks(df.withColumn("_cut", F.lit(2.0)), "id", None, 10, vectors._pivots(df, None))
    plan = vectors.block_pairs(blocks, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
