"""Ranks, ensembles of ranks, thresholds and scalings over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.operators.aggregates import row_mean
from cyclora.operators.ordering import percentiles, with_rank


def mean_rank(df: DataFrame, metrics: list[str], out: str = "mean_rank", nulls_last: bool = True) -> DataFrame:
    """df with a rank for each metric (1 for the largest, ties share the mean) and their mean."""
    for m in metrics:
        df = with_rank(df, m, f"{m}_rank", "average", True, nulls_last)
    return df.withColumn(out, row_mean([f"{m}_rank" for m in metrics]))


def top_share(df: DataFrame, key: str, metrics: list[str], divisor: int = 5, at_least: int = 3) -> DataFrame:
    """(key, appearances): keys among the top 1/divisor (one at least) of at_least metrics; nulls count as 0, ties go to
    the smaller key."""
    from cyclora.operators.ordering import running

    n = df.count()
    quota = max(1, n // divisor)
    long = []
    for m in metrics:
        filled = df.select(key, F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("v"))
        ranked = running(filled, [F.desc("v"), F.asc(key)], {"rn": F.lit(1)})
        long.append(ranked.filter(F.col("rn") <= quota).select(key))
    both = reduce(DataFrame.unionByName, long)
    return both.groupBy(key).agg(F.count("*").alias("appearances")).filter(F.col("appearances") >= at_least)


def hub_flags(df: DataFrame, metrics: list[str], share: float = 0.95) -> DataFrame:
    """df with hub_<metric> (at or above the metric's percentile) and is_hub (any of them)."""
    for m in metrics:
        limit = percentiles(df, m, [share])[0]
        df = df.withColumn(f"hub_{m}", F.coalesce(F.col(m) >= F.lit(limit), F.lit(False)))
    return df.withColumn("is_hub", reduce(Column.__or__, [F.col(f"hub_{m}") for m in metrics]))


def z_scores(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """df with (x - mean) / sample deviation; null if that is 0 or unknown."""
    s = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(s)).withColumn(out, F.round(F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")), 6)).drop("_m", "_s")


def min_max(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """df with the value scaled to 0..1; 0 if all are equal."""
    s = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    scaled = F.when(F.col("_b") > F.col("_a"), (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.when(F.col(value).isNotNull(), 0.0))
    return df.join(F.broadcast(s)).withColumn(out, F.round(scaled, 6)).drop("_a", "_b")


def scope_ranks(df: DataFrame, scope: str, key: str, value: str, scopes: list[str]) -> DataFrame:
    """(key, value_<scope>, rank_<scope>): the value and its min-rank (1 for the largest) within each scope."""
    from pyspark.sql import Window

    ranked = df.withColumn("_r", F.rank().over(Window.partitionBy(scope).orderBy(F.desc_nulls_last(value))))
    return ranked.groupBy(key).agg(
        *[x for s in scopes for x in (F.max(F.when(F.col(scope) == s, F.col(value))).alias(f"value_{s}"), F.max(F.when(F.col(scope) == s, F.col("_r"))).cast("long").alias(f"rank_{s}"))]
    )
