"""Association of targets with mobile elements: by distance, by order on the circle, and pooled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.operators.circular import circular_vicinity
from cyclora.operators.intervals import nearest_distance


def by_distance(features: DataFrame, container: str, start: str, end: str, target: str, mobile: str, limit: float) -> DataFrame:
    """Target rows with min_dist_nt to the nearest mobile row of the container (infinite without any) and mge_assoc_A."""
    gaps = nearest_distance(features.filter(target), features.filter(mobile), container, start, end, start, end, "_d")
    far = F.coalesce(F.col("_d").cast("double"), F.lit(float("inf")))
    return gaps.withColumn("min_dist_nt", far).withColumn("mge_assoc_A", far <= limit).drop("_d")


def by_order(instances: DataFrame, container: str, order: list[str], target: str, mobile: str, reach: int = 2) -> DataFrame:
    """Target rows with directly_adjacent, sandwiched and mge_assoc_B (either)."""
    near = circular_vicinity(instances, container, order, mobile, reach).filter(target)
    return near.withColumn("mge_assoc_B", F.col("directly_adjacent") | F.col("sandwiched"))


def summary(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(label, a_total, a_assoc, a_rate, b_..., pool_...): rows for A and B, different keys for the pool, in which a key
    is associated if it is so either way."""
    both = a.select(label, *keys, F.col("mge_assoc_A").alias("a"), F.lit(None).cast("boolean").alias("b")).unionByName(
        b.select(label, *keys, F.lit(None).cast("boolean").alias("a"), F.col("mge_assoc_B").alias("b"))
    )
    each = both.groupBy(label, *keys).agg(
        F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if("a").alias("ka"), F.count_if("b").alias("kb"), F.bool_or(F.coalesce("a", "b")).alias("k")
    )
    rate = lambda k, n: F.round(F.when(n > 0, k / n).otherwise(0.0), 6)
    s = each.groupBy(label).agg(*[F.sum(c).alias(c) for c in ("na", "nb", "ka", "kb")], F.count("*").alias("n"), F.count_if("k").alias("k"))
    c = F.col
    return s.select(
        label,
        c("na").alias("a_total"),
        c("ka").alias("a_assoc"),
        rate(c("ka"), c("na")).alias("a_rate"),
        c("nb").alias("b_total"),
        c("kb").alias("b_assoc"),
        rate(c("kb"), c("nb")).alias("b_rate"),
        c("n").alias("pool_total"),
        c("k").alias("pool_assoc"),
        rate(c("k"), c("n")).alias("pool_rate"),
    )
