"""Background statistics of similarity scores, and where a score lies in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .pair_scores import PairScores
from .settle import settle

# The p-values for which cutoffs are kept.
P_VALUES = [
    0.01, 0.009, 0.008, 0.007, 0.006, 0.005, 0.004, 0.003, 0.002, 0.001,
    0.0009, 0.0008, 0.0007, 0.0006, 0.0005, 0.0004, 0.0003, 0.0002, 0.0001,
    0.00009, 0.00008, 0.00007, 0.00006, 0.00005, 0.00004, 0.00003, 0.00002, 0.00001,
]


def quantile_cutoffs(scores: DataFrame, group: Sequence[str], score: str = "cos", p_values: Sequence[float] = P_VALUES, combined: bool = False) -> DataFrame:
    """The 1 - p quantiles of each group, linearly interpolated: group, p, cutoff.

    With ``combined``, the quantiles of all rows come too, with null groups. No
    task holds a group's scores.
    """
    rows = settle(scores.select(*group, score)) if combined else scores
    found = ranks.quantiles(rows, group, score, [1 - p for p in p_values])
    if combined:
        every = ranks.quantiles(rows, [], score, [1 - p for p in p_values])
        found = found.unionByName(every.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in group], "level", "quantile"))
    return _by_p(found, group, p_values)


def _by_p(found: DataFrame, group: Sequence[str], p_values: Sequence[float]) -> DataFrame:
    p = F.create_map(*[x for p in p_values for x in (F.lit(1 - p), F.lit(float(p)))])
    return found.select(*group, F.element_at(p, F.col("level")).alias("p"), F.col("quantile").alias("cutoff"))


def pair_cutoffs(pairs: PairScores, p_values: Sequence[float] = P_VALUES, combined: bool = False) -> DataFrame:
    """The same of all pairs of each group, which are never written."""
    return _by_p(pairs.quantiles([1 - p for p in p_values], combined), [pairs.group], p_values)


def moments(scores: DataFrame, group: Sequence[str], score: str = "cos", combined: bool = False) -> DataFrame:
    """Mean and population deviation of each group: group, mean, std, n."""
    aggs = [F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(score).alias("n")]
    return (scores.rollup(*group) if combined else scores.groupBy(*group)).agg(*aggs)


def cutoff_of(cutoffs: DataFrame, p: float, tolerance: float = 1e-12) -> DataFrame:
    """The rows of one p-value, which must be one of the grid's."""
    if not any(abs(p - x) <= tolerance for x in P_VALUES):
        raise ValueError(f"no cutoff is kept for p = {p}; choose one of {P_VALUES}")
    return cutoffs.where(F.abs(F.col("p") - F.lit(float(p))) <= tolerance)


def percentile_scores(scores: DataFrame, background: DataFrame, score: str = "cos", background_score: str = "cos", name: str = "percentile") -> DataFrame:
    """Adds the share of background values strictly below each score, exactly.

    Different values of both sides are ordered together, in ranges that a sample
    of them sets: an outlier takes no more room than any other value. Without a
    background the share is null.
    """
    own = scores.select(F.col(score).cast("double").alias("v")).distinct()
    both = own.select("v", F.lit(0).cast("long").alias("w")).unionAll(background.select(F.col(background_score).cast("double").alias("v"), F.lit(1).cast("long").alias("w")))
    ranked = ranks.running(both.where("v is not null").groupBy("v").agg(F.sum("w").alias("w")), ["v"], sums={"below": F.col("w")})
    ecdf = ranked.select(F.col("v").alias("_v"), F.try_divide(F.col("below").cast("double"), F.col("total_below")).alias(name))
    return scores.join(ecdf, F.col(score).cast("double") == F.col("_v"), "left").drop("_v")
