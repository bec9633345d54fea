"""Closed intervals within containers: overlaps, nearest, merging, complements, runs.

Intervals may come with start after end (the minus strand); `normalised` puts them right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.operators.ordering import ranged, scanned

def normalised(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumns({start: F.least(start, end), end: F.greatest(start, end)})


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(a: DataFrame, b: DataFrame, container: str, a_start: str, a_end: str, b_start: str, b_end: str, width: int = 3600, buffer: int = 0) -> DataFrame:
    """Pairs of a and b rows of a container that overlap, ends included, or come within buffer. Both sides are dealt into
    bins of the given width, so a container of many intervals is no single join key; a pair counts in the first bin that
    both have."""
    left = a.withColumn("_bin", _bins(F.col(a_start), F.col(a_end), width))
    right = b.withColumn("_bin", _bins(F.col(b_start) - buffer, F.col(b_end) + buffer, width))
    first = F.greatest(F.floor(F.col(a_start) / width), F.floor((F.col(b_start) - buffer) / width))
    hit = (F.col(a_start) <= F.col(b_end) + buffer) & (F.col(a_end) >= F.col(b_start) - buffer) & (F.col("_bin") == first)
    return left.join(right, [container, "_bin"]).filter(hit).drop("_bin")


def without_overlap(a: DataFrame, b: DataFrame, container: str, a_key: list[str], a_start: str, a_end: str, b_start: str, b_end: str, width: int = 3600, buffer: int = 0) -> DataFrame:
    """The rows of a that no row of b overlaps or comes within buffer of."""
    hit = overlap_join(a, b, container, a_start, a_end, b_start, b_end, width, buffer).select(*a_key).distinct()
    return a.join(hit, a_key, "left_anti")


def nearest_distance(a: DataFrame, b: DataFrame, container: str, a_start: str, a_end: str, b_start: str, b_end: str, out: str = "distance") -> DataFrame:
    """a with the gap to the nearest b of its container: 0 if they touch or overlap, null without any b. Both sides are laid out in one
    order: of the b that start by a's end the furthest end counts, of the later ones the first start. Containers of many
    intervals are spread over ranges."""
    left = a.withColumns({"_at": F.col(a_end), "_side": F.lit(1)})
    right = b.select(container, F.col(b_start).alias("_at"), F.lit(0).alias("_side"), F.col(b_start).alias("_bs"), F.col(b_end).alias("_be"))
    parts, order = ranged(left.unionByName(right, allowMissingColumns=True), [container], ["_at", "_side"]), ["_at", "_side"]
    both = scanned(scanned(parts, [container], order, {"_before": F.col("_be")}), [container], order, {"_after": F.col("_bs")}, down=True)
    back = F.when(F.col("_before").isNotNull(), F.greatest(F.lit(0), F.col(a_start) - F.col("_before")))
    ahead = F.when(F.col("_after").isNotNull(), F.col("_after") - F.col(a_end))
    return both.filter("_side = 1").withColumn(out, F.least(back, ahead)).select(*a.columns, out)


def nearest_coordinate(a: DataFrame, b: DataFrame, container: str, point: str, at: str, tie: str, tolerance: int | None = None) -> DataFrame:
    """a with near_at and near_id of the b of its container nearest to the point; of equally near ones the one before,
    with the smallest tie key; null beyond the tolerance. An as-of join from both sides, over ranges."""
    left = a.withColumns({"_at": F.col(point), "_side": F.lit(1)})
    firsts = b.groupBy(container, at).agg(F.min(tie).alias("_id"))
    right = firsts.select(container, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(at).alias("at"), F.col("_id").alias("id")).alias("_b"))
    parts, order = ranged(left.unionByName(right, allowMissingColumns=True), [container], ["_at", "_side"]), ["_at", "_side"]
    both = scanned(scanned(parts, [container], order, {"_p": F.col("_b")}), [container], order, {"_q": F.col("_b")}, down=True)
    x = both.filter("_side = 1")
    dp, dq = F.col(point) - F.col("_p.at"), F.col("_q.at") - F.col(point)
    best = F.when(F.col("_q").isNull() | (dp <= dq), F.col("_p")).otherwise(F.col("_q"))
    x = x.withColumn("_best", best)
    if tolerance is not None:
        x = x.withColumn("_best", F.when(F.abs(F.col("_best.at") - F.col(point)) <= tolerance, F.col("_best")))
    return x.select(*a.columns, F.col("_best.at").alias("near_at"), F.col("_best.id").alias("near_id"))


def pieces(df: DataFrame, key: str, start: str, end: str, out: str = "piece") -> DataFrame:
    """df with the first start of the stretch that each interval belongs to: between stretches no interval of the key
    crosses. Keys of many intervals are spread over ranges."""
    parts, order = ranged(df, [key], [start, end]), [start, end]
    fresh = F.when(F.col("_past").isNull() | (F.col(start) > F.col("_past")), F.col(start))
    marked = scanned(parts, [key], order, {"_past": F.col(end)}, past=True).withColumn("_fresh", fresh)
    return scanned(marked, [key], order, {out: F.col("_fresh")}).select(*df.columns, out)


def merge_intervals(df: DataFrame, container: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """(container, start, end, n): overlapping or touching intervals (or those within gap) as one."""
    reach = df.select(container, start, end).withColumn("_reach", F.col(end) + gap)
    return pieces(reach, container, start, "_reach", "_run").groupBy(container, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def complement(merged: DataFrame, container: str, start: str, end: str) -> DataFrame:
    """(container, start, end): what lies between merged intervals, ends not included in them."""
    w = Window.partitionBy(container).orderBy(start)
    gaps = merged.select(container, (F.col(end) + 1).alias("gap_start"), (F.lead(start).over(w) - 1).alias("gap_end"))
    return gaps.filter(F.col("gap_end") >= F.col("gap_start"))


def splice_out(df: DataFrame, cuts: DataFrame, key: str, text: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, text): strings without the merged spans (from 0, ends included) of `cuts`."""
    merged = merge_intervals(cuts, key, start, end, gap=1)
    spans = merged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b")))).alias("_cuts"))
    joined = df.select(key, text).join(spans, key, "left")
    none = F.coalesce("_cuts", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(none, lambda c: c["b"] + 1))
    ends = F.concat(F.transform(none, lambda c: c["a"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    return joined.select(key, F.array_join(pieces, "").alias(text))


def islands(df: DataFrame, container: str, position: str) -> DataFrame:
    """(container, run_start, run_end, n): runs of consecutive whole numbers."""
    each = df.select(container, position).distinct()
    base = F.col(position) - F.row_number().over(Window.partitionBy(container).orderBy(position))
    return each.withColumn("_base", base).groupBy(container, "_base").agg(F.min(position).alias("run_start"), F.max(position).alias("run_end"), F.count("*").alias("n")).drop("_base")
