"""Ordered features on circular containers: neighbours, adjacency graphs, vicinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclora.session import durable


def position_index(df: DataFrame, container: str, order: list[str], out: str = "idx") -> DataFrame:
    """The place of each feature in its container, from 0."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(container).orderBy(*order)) - 1)


def circular_neighbours(df: DataFrame, container: str, order: list[str], columns: list[str], left: str = "left_", right: str = "right_") -> DataFrame:
    """Each feature with the columns of the features before and after it, the last next to the first, and `n_in_container`.
    The ends are told by row number, so a null neighbour stays null."""
    w = Window.partitionBy(container)
    ordered = w.orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rn, n = F.row_number().over(ordered), F.count(F.lit(1)).over(w)
    new: dict[str, Column] = {"n_in_container": n}
    for c in columns:
        new[left + c] = F.when(rn == 1, F.last(c).over(whole)).otherwise(F.lag(c).over(ordered))
        new[right + c] = F.when(rn == n, F.first(c).over(whole)).otherwise(F.lead(c).over(ordered))
    return df.withColumns(new)


def circular_neighbours_split(df: DataFrame, container: str, order: list[str], columns: list[str], left: str = "left_", right: str = "right_") -> DataFrame:
    """circular_neighbours for containers that may hold a large share of all rows: features are dealt out by ranges of
    (container, order), so a container spreads over tasks. Rows at the edges of ranges get their neighbours from a list of
    edges, two for each range; where circles close, from each container's first and last feature."""
    keys = [container, *order]
    row = F.struct(F.col(container).alias("c"), F.struct(*columns).alias("v"))
    x = durable(df.repartitionByRange(*keys).withColumns({"_part": F.spark_partition_id(), "_row": row}))
    edges = x.groupBy("_part").agg(F.min_by("_row", F.struct(*keys)).alias("a"), F.max_by("_row", F.struct(*keys)).alias("b")).orderBy("_part").collect()
    kind = x.schema["_row"].dataType
    table = [(e["_part"], edges[i - 1]["b"] if i else None, edges[i + 1]["a"] if i + 1 < len(edges) else None) for i, e in enumerate(edges)]
    names = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", kind), T.StructField("_after", kind)])
    x = x.join(F.broadcast(df.sparkSession.createDataFrame(table, names)), "_part")
    w = Window.partitionBy("_part").orderBy(*keys)
    x = x.withColumns({"_l": F.coalesce(F.lag("_row").over(w), "_before"), "_r": F.coalesce(F.lead("_row").over(w), "_after")})
    ends = df.groupBy(container).agg(F.min_by(row, F.struct(*order)).alias("_first"), F.max_by(row, F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("n_in_container"))
    x = x.join(durable(ends), container)
    near = lambda at, wrap: F.when(F.col(f"{at}.c") == F.col(container), F.col(f"{at}.v")).otherwise(F.col(f"{wrap}.v"))
    x = x.withColumns({"_l": near("_l", "_last"), "_r": near("_r", "_first")})
    return x.select(*df.columns, "n_in_container", *[y for c in columns for y in (F.col(f"_l.{c}").alias(left + c), F.col(f"_r.{c}").alias(right + c))])


def orientation(left_strand: Column, right_strand: Column) -> Column:
    """PP, MM, PM, or MP for all else, null strands too."""
    return (
        F.when((left_strand == 1) & (right_strand == 1), "PP")
        .when((left_strand == -1) & (right_strand == -1), "MM")
        .when((left_strand == 1) & (right_strand == -1), "PM")
        .otherwise("MP")
    )


def adjacency_edges(df: DataFrame, container: str, order: list[str], token: str, strand: str, skip_singles: bool = False) -> DataFrame:
    """(domain1, domain2, orientation, weight): how often a token follows another. A lone feature follows itself unless
    skip_singles."""
    near = circular_neighbours(df, container, order, [token, strand])
    if skip_singles:
        near = near.filter("n_in_container > 1")
    return (
        near.select(F.col(token).alias("domain1"), F.col(f"right_{token}").alias("domain2"), orientation(F.col(strand), F.col(f"right_{strand}")).alias("orientation"))
        .groupBy("domain1", "domain2", "orientation")
        .agg(F.count("*").alias("weight"))
    )


def signed_edges(edges: DataFrame) -> DataFrame:
    """(domain1, domain2, signed_weight, total_weight): same-strand neighbours count up, others down."""
    sign = F.when(F.col("orientation").isin("PP", "MM"), F.col("weight")).otherwise(-F.col("weight"))
    return edges.groupBy("domain1", "domain2").agg(F.sum(sign).alias("signed_weight"), F.sum("weight").alias("total_weight"))


def node_attributes(df: DataFrame, container: str, token: str) -> DataFrame:
    """(label, plasmid_count, plasmids): the containers of each token, sorted and joined by semicolons."""
    pairs = df.select(F.col(token).alias("label"), F.col(container).cast("string").alias("c")).distinct()
    return pairs.groupBy("label").agg(F.count("c").alias("plasmid_count"), F.array_join(F.array_sort(F.collect_list("c")), ";").alias("plasmids"))


def circular_vicinity(df: DataFrame, container: str, order: list[str], flag: str, reach: int = 2) -> DataFrame:
    """Each feature with directly_adjacent (a flagged feature next to it) and sandwiched (flagged features within reach on
    both sides). Places wrap modulo the container's size, so in small containers a feature can be its own neighbour."""
    w = Window.partitionBy(container)
    up, down = w.orderBy(*order), w.orderBy(*[F.desc(c) for c in order])
    full = lambda o: o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    idx, n = F.row_number().over(up) - 1, F.count(F.lit(1)).over(w)
    new = {"_idx": idx, "_n": n}
    for k in range(1, reach + 1):
        new |= {f"_lag{k}": F.lag(flag, k).over(up), f"_lead{k}": F.lead(flag, k).over(up)}
        new |= {f"_head{k}": F.nth_value(flag, k).over(full(up)), f"_tail{k}": F.nth_value(flag, k).over(full(down))}
    x = df.withColumns(new)
    i, size = F.col("_idx"), F.col("_n")

    def among(prefix: str, place: Column) -> Column:
        out = F.lit(None)
        for k in range(1, reach + 1):
            out = F.when(place == k, F.col(f"{prefix}{k}")).otherwise(out)
        return out

    def before(k: int) -> Column:
        return F.when(i >= k, F.col(f"_lag{k}")).when(size >= k, among("_tail", k - i)).otherwise(among("_head", F.pmod(i - k, size) + 1))

    def after(k: int) -> Column:
        return F.when(i + k < size, F.col(f"_lead{k}")).when(size >= k, among("_head", i + k - size + 1)).otherwise(among("_head", F.pmod(i + k, size) + 1))

    def some(columns: list[Column]) -> Column:
        return F.coalesce(F.greatest(*[F.coalesce(c, F.lit(False)).cast("int") for c in columns], F.lit(0)) == 1, F.lit(False))

    left, right = some([before(k) for k in range(1, reach + 1)]), some([after(k) for k in range(1, reach + 1)])
    return x.select(*df.columns, some([before(1), after(1)]).alias("directly_adjacent"), (left & right).alias("sandwiched"))
