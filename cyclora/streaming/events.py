"""Streaming counterparts of batch operators, beyond what the batch catalogue needs: windowed counts with a watermark, and
sessions, over a stream of features or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total) of tumbling windows; rows later than the watermark are left out."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of rows without a gap."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def edge_counts(stream: DataFrame, src: str, dst: str) -> DataFrame:
    """Running weights of edges, for outputMode update or complete."""
    return stream.groupBy(src, dst).agg(F.count("*").alias("weight"))
