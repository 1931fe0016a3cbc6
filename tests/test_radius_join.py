"""The ball join: every pair once, crowded cells shared by tasks."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from sitewise.operators import spatial


def test_equals_brute_force_at_edges_of_cells(spark):
    rng = random.Random(3)
    r = 0.1
    grid = [(0.05 * i, 0.05 * j, -0.05 * k) for i in range(-3, 4) for j in (-2, 0, 2) for k in (0, 1, 2)]
    rows = [*grid, *[tuple(rng.uniform(-0.3, 0.3) for _ in range(3)) for _ in range(150)], (1e5, 1e5, 1e5), (1e5 + 0.1, 1e5, 1e5), (0.0, 0.0, 0.0), (-0.0, 0.0, 0.0), (None, 0.0, 0.0), (float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame([(i, i % 2, *p) for i, p in enumerate(rows)], "i int, g int, x double, y double, z double")
    for strict, keys in ((False, []), (True, []), (False, ["g"])):
        want = Counter()
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if None in a or None in b or keys and i % 2 != j % 2:
                    continue
                d = ((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) ** 0.5
                want[i, j] += d < r if strict else d <= r
        got = Counter((x["i"], x["p_i"]) for x in spatial.radius_join(df, df, r, keys, strict).select("i", "p_i").collect())
        assert got == +want


def test_one_crowded_cell_is_shared_by_tasks(spark):
    rng = random.Random(4)
    rows = [(i, *[rng.uniform(0.01, 0.04) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x double, y double, z double").coalesce(1)
    tasks = spatial.radius_join(df, df, 0.1).groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 200 * 200
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 200 * 200 * 0.9
