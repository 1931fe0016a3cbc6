"""Connected components of a graph too large for one machine.

Alternating large-star and small-star steps: each replaces a vertex's links by
links to the smallest vertex near it, until every vertex links to the smallest
of its component. A step is one grouped minimum and one join, and its result is
written to the shared folder before the next, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns v and root (the smallest vertex of v's component), for every
    vertex of ``edges`` (columns a, b; direction, repeats and loops are of no
    account) that has a neighbour. Rows with a null end are ignored.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    stamp = _stamp(now)
    for _ in range(most_rounds):
        if stamp[0] == 0:
            break
        large = _star(now, large=True)
        small = materialize(_star(large, large=False))
        discard(now)
        now, after = small, _stamp(small)
        if after == stamp:
            break
        stamp = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select("v", F.col("u").alias("root"))


def _stamp(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set that the order of rows does not change."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("u", "v", F.lit(1)).cast("decimal(38,0)")).alias("g")).first()
    return r["n"], r["h"], r["g"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges v > u. Large: every larger neighbour of a vertex links
    to the least of its neighbourhood; small: every smaller one, and itself."""
    if large:
        around = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionAll(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
    else:
        around = edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
    least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    joined = around.join(least, "x")
    if large:
        out = joined.where(F.col("y") > F.col("x")).select(F.col("y").alias("v"), F.col("m").alias("u"))
    else:
        out = joined.where(F.col("y") != F.col("m")).select(F.col("y").alias("v"), F.col("m").alias("u")).unionAll(least.where(F.col("x") != F.col("m")).select(F.col("x").alias("v"), F.col("m").alias("u")))
    return out.where(F.col("v") != F.col("u")).distinct()
