"""Aggregations: rollups, spreads, rates and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_filled(df: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(key, n) in a fixed set of keys; keys without rows count 0, others are left out."""
    keys = df.sparkSession.createDataFrame([(k,) for k in fixed], f"{key} string")
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def mean_filled(df: DataFrame, key: str, value: Column, fixed: list[str]) -> DataFrame:
    """(key, mean) in a fixed set of keys; 0 where a key has no rows."""
    keys = df.sparkSession.createDataFrame([(k,) for k in fixed], f"{key} string")
    m = df.groupBy(key).agg(F.avg(value).alias("mean"))
    return keys.join(m, key, "left").select(key, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def accuracy_rollup(df: DataFrame, model: str, seed: str, part: str, correct: Column) -> DataFrame:
    """Accuracy per (model, seed) and per (model, seed, part) in one pass by grouping sets."""
    g = df.withColumn("_c", F.when(correct, 100.0).otherwise(0.0))
    sets = [[F.col(model), F.col(seed), F.col(part)], [F.col(model), F.col(seed)]]
    return g.groupingSets(sets, F.col(model), F.col(seed), F.col(part)).agg(F.grouping(part).alias("overall"), F.count(F.lit(1)).alias("n"), F.avg("_c").alias("accuracy"))


def score_distribution(score: Column) -> list[Column]:
    """n, mean, population deviation, least, most and median of the valid scores."""
    return [
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("std"),
        F.min(score).alias("least"), F.max(score).alias("most"), F.percentile(score, F.lit(0.5)).alias("median"),
    ]


def win_rates(winner: Column) -> list[Column]:
    """Counts of left, right and invalid, and the left side's rate over all and over decided pairs."""
    left, right = F.count_if(winner == "left"), F.count_if(winner == "right")
    return [
        F.count(F.lit(1)).alias("n"), left.alias("left_wins"), right.alias("right_wins"), F.count_if(winner == "invalid").alias("invalid"),
        F.coalesce(F.try_divide(left, F.count(F.lit(1))), F.lit(0.0)).alias("left_rate_all"),
        F.coalesce(F.try_divide(left, left + right), F.lit(0.0)).alias("left_rate_decided"),
    ]


def winner(choice: Column, swapped: Column) -> Column:
    """left, right or invalid, from the judge's choice and whether the sides were swapped."""
    return F.when(choice == "1", F.when(swapped, "right").otherwise("left")).when(choice == "2", F.when(swapped, "left").otherwise("right")).otherwise("invalid")


def pivot_metric(df: DataFrame, keys: list[str], part: str, values: list[str], value: str) -> DataFrame:
    """One wide row per key with a column for every listed part."""
    return df.groupBy(*keys).pivot(part, values).agg(F.first(value, ignorenulls=True))
