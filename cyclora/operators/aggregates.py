"""Histograms, pivots, weighted and conditional aggregates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, density: bool = False) -> DataFrame:
    """(bin, n) or (bin, density) of bins of one width, the last closed."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    if not density:
        return counts
    total = df.filter(F.col(value).between(low, high)).agg(F.count("*").alias("_t"))
    return counts.join(F.broadcast(total)).select("bin", F.round(F.col("n") / (F.col("_t") * width), 9).alias("density"))


def log_histogram(df: DataFrame, value: str, per_decade: int = 4) -> DataFrame:
    """(bin, n) of bins that are even in the logarithm; values of 0 and less are left out."""
    b = F.floor(F.log10(F.col(value)) * per_decade + 1e-9).cast("int")
    return df.filter(F.col(value) > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, key: str, column: str, values: list[str], total: str | None = None) -> DataFrame:
    """Counts of the key by the given values, one column for each, 0 where there are none."""
    out = df.groupBy(key).pivot(column, values).count().fillna(0)
    return out.withColumn(total, sum((F.col(f"`{v}`") for v in values), F.lit(0))) if total else out


def pivot_long(df: DataFrame, key: str, column: str, value: str, values: list, prefix: str) -> DataFrame:
    """A long table with one column for each of the given values."""
    out = df.groupBy(key).pivot(column, values).agg(F.first(value))
    return out.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null if the weights of known values sum to 0."""
    known = F.when(value.isNotNull(), weight)
    return F.sum(value * weight) / F.nullif(F.sum(known), F.lit(0).cast("double"))


def mean_and_std(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and sample deviation of columns, the deviation of a single value 0."""
    out = []
    for c in columns:
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias(f"{c}_std")]
    return df.groupBy(*keys).agg(*out)


def prevalence(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n, share): the share of all different items that have the key."""
    total = df.agg(F.count_distinct(item).alias("_t"))
    n = df.groupBy(key).agg(F.count_distinct(item).alias("n"))
    return n.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def row_mean(columns: list[str]) -> Column:
    """The mean of those columns that aren't null."""
    known = [F.col(c).isNotNull().cast("int") for c in columns]
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in map(F.col, columns)), F.lit(0.0)), sum(known, F.lit(0)))


def summary_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a text report of the counts by the given columns."""
    n = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    return n.select(F.concat(F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(": "), F.col("_n").cast("string")).alias("line"))
