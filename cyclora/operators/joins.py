"""Key maps, enrichment, fallbacks and alignment to fixed axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_map(df: DataFrame, key: str, value: str, order: list[str], keep: str = "last") -> DataFrame:
    """(key, value) with one value for each key: the last or first in the given order."""
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(key).agg(pick(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_v")).select(key, F.col("_v.v").alias(value))


def lookup(df: DataFrame, mapping: DataFrame, key: str, map_key: str, value: str, out: str, keep_original: bool = False) -> DataFrame:
    """df with `out`, the key's value in the mapping (each key once); null, or the key itself, where it is absent."""
    m = mapping.select(F.col(map_key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_found"))
    joined = df.join(m, df[key] == F.col("_k"), "left")
    new = F.when(F.col("_found"), F.col("_v")).otherwise(F.col(key)) if keep_original else F.col("_v")
    return joined.withColumn(out, new).select(*[c for c in df.columns if c != out], out)


def lookup_with_fallback(df: DataFrame, mapping: DataFrame, key: str, reduced: Column, map_key: str, value: str, out: str) -> DataFrame:
    """df with the value of its key, else of its reduced key."""
    m1 = mapping.select(F.col(map_key).alias("_k1"), F.col(value).alias("_v1"))
    m2 = mapping.select(F.col(map_key).alias("_k2"), F.col(value).alias("_v2"))
    x = df.withColumn("_r", reduced).join(m1, df[key] == F.col("_k1"), "left").join(m2, F.col("_r") == F.col("_k2"), "left")
    return x.withColumn(out, F.coalesce("_v1", "_v2")).select(*df.columns, out)


def star_join(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins of one base with tables of one row for each key."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def semi(df: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keep.select(*keys), keys, "left_semi")


def anti(df: DataFrame, drop: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in drop. Unlike NOT IN, nulls there drop nothing."""
    return df.join(drop.select(*keys), keys, "left_anti")


def align(df: DataFrame, axis: DataFrame, key: str, fills: dict[str, object]) -> DataFrame:
    """A row for each key of the axis, with missing columns filled."""
    return axis.select(key).distinct().join(df, key, "left").fillna(fills)


def fixed_axis(df: DataFrame, key: str, values: list, fills: dict[str, object]) -> DataFrame:
    """align, to a list of values."""
    kind = df.schema[key].dataType.simpleString()
    return align(df, df.sparkSession.createDataFrame([(v,) for v in values], f"{key} {kind}"), key, fills)


def union_wide(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)
