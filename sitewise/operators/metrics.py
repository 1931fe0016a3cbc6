"""Ranking and classification metrics, exact and without a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running


def _by_score(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives of each distinct score: one row per score, not per row."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))


def auroc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count one half; null if a class is missing."""
    below = running(_by_score(df, keys, label, score), ["s"], keys, {"below": F.col("n")})
    won = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0))
    return below.groupBy(*keys).agg(F.try_divide(won, F.sum("p") * F.sum("n").cast("double")).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of precision over steps of recall, scores falling, ties as one step."""
    steps = running(_by_score(df, keys, label, score), [F.desc("s")], keys, {"tp": F.col("p"), "all": F.col("p") + F.col("n")})
    precision = (F.col("tp") + F.col("p")) / (F.col("all") + F.col("p") + F.col("n"))
    return steps.groupBy(*keys).agg(F.sum(F.try_divide(F.col("p").cast("double"), F.col("total_tp")) * precision).alias("average_precision"))


def weighted_log_loss(df: DataFrame, label: str, logit: str, positive_weight: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy of logits, positives weighted; stable for large logits."""
    x, y = F.col(logit), F.col(label).cast("double")
    weight = 1 + (positive_weight - 1) * y
    softplus = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return df.groupBy(*keys).agg(F.avg((1 - y) * x + weight * softplus).alias("loss"))


def replicate_stats(df: DataFrame, run: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over runs of each run's mean."""
    per_run = df.groupBy(*run).agg(F.avg(value).alias("v"))
    return per_run.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n_runs"))


def best_step(df: DataFrame, keys: Sequence[str], step: str, value: str, largest: bool) -> DataFrame:
    """The first step with the best value."""
    v = -F.col(value) if largest else F.col(value)
    return df.groupBy(*keys).agg(F.min_by(step, F.struct(v, step)).alias("best_step"))


def right_closed_bins(df: DataFrame, value: str, edges: Sequence[float], others: Sequence[str] = ()) -> DataFrame:
    """Counts and means by bins (edge, next edge]; values outside have none."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        b = F.when((F.col(value) > edges[i]) & (F.col(value) <= edges[i + 1]), F.lit(i)).otherwise(b)
    aggs = [F.avg(c).alias(f"mean_{c}") for c in others]
    return df.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), *aggs)
