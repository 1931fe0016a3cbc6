"""The quick rounding of doubles gives what ``F.round`` gives."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sitewise.functions import columns as C


def test_rounded_is_round(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 0.1234565, -0.1234565, 2.5e-6, 1.0000005, 999.9999995, 1000.0, 123456.7890125, 1e18, -1e300, float("nan"), float("inf"), None]
    values += [rng.uniform(-2, 2) for _ in range(3000)] + [(k + 0.5) / 1e6 for k in range(-1000, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(C.rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b")).where("NOT (a <=> b) OR cast(a AS string) <> cast(b AS string)")
    assert got.collect() == []
