"""Global order without a single task: running sums, ranks and exact percentiles over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.session import durable


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (current row included) in the global order. Rows are dealt out by ranges of the order; what
    the driver gets is one sum for each partition."""
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("_part").collect()
    out, within = ranged, Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for k, c in sums.items():
        before, total = [], None
        for r in totals:
            before += [F.lit(r["_part"]), F.lit(total if total is not None else (0 if r[k] is None else type(r[k])(0)))]
            total = (r[k] or 0) + (total or 0)
        start = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
        out = out.withColumn(k, F.sum(c).over(within) + start)
    return out.drop("_part")


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df dealt out by ranges of the keys and the order, written, with the partition as `_part`: a key of many rows is spread
    over as many partitions as its rows fill."""
    return durable(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def scanned(parts: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], down: bool = False, past: bool = False) -> DataFrame:
    """parts (of `ranged`) with running extremes of the rows that share the keys: the largest value so far in the order, or with
    `down` the least from the end backwards; the row itself counts, or with `past` only the rows before it. Each partition runs over
    its own rows; what a key had in other partitions is carried over as one row a partition. Nulls don't count."""
    how, both = (F.min, F.least) if down else (F.max, F.greatest)
    key = F.struct(*keys)
    bounds = {r["_part"]: r for r in parts.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
    if not bounds:
        return parts.withColumns({k: F.lit(None).cast(parts.select(c.alias("x")).schema["x"].dataType) for k, c in values.items()})
    spark, kinds = parts.sparkSession, {f.name: f.dataType for f in parts.schema.fields}
    spelt = ", ".join(f"`{k}`: {kinds[k].simpleString()}" for k in keys)
    # the key at a partition's far edge goes on in the next ones
    edge = "lo" if down else "hi"
    edges = spark.createDataFrame([(p, r[edge]) for p, r in bounds.items()], f"_part int, _edge struct<{spelt}>")
    at_edge = parts.join(F.broadcast(edges), "_part").filter(key.eqNullSafe(F.col("_edge"))).groupBy("_part").agg(*[how(c).alias(k) for k, c in values.items()])
    sums = {r["_part"]: r for r in at_edge.collect()}
    pick = min if down else max
    carried, walk = [], sorted(bounds, reverse=down)
    for i, p in enumerate(walk):
        first, found = bounds[p]["hi" if down else "lo"], {}
        for q in reversed(walk[:i]):
            if bounds[q][edge] != first:
                break
            for k in values:
                v = sums[q][k] if q in sums else None
                found[k] = v if found.get(k) is None else found[k] if v is None else pick(v, found[k])
            if bounds[q]["hi" if down else "lo"] != first:
                break
        carried.append((p, first, *[found.get(k) for k in values]))
    types = parts.select(*[c.alias(k) for k, c in values.items()]).schema
    fields = ", ".join(f"`_in_{k}` {types[k].dataType.simpleString()}" for k in values)
    carry = spark.createDataFrame(carried, f"_part int, _first struct<{spelt}>, {fields}")
    within = Window.partitionBy("_part", *keys).orderBy(*[F.desc(c) if down else F.asc(c) for c in order])
    frame = within.rowsBetween(Window.unboundedPreceding, -1 if past else 0)
    own = parts.join(F.broadcast(carry), "_part")
    out = own.withColumns({k: both(how(c).over(frame), F.when(key.eqNullSafe(F.col("_first")), F.col(f"_in_{k}"))) for k, c in values.items()})
    return out.select(*parts.columns, *values)


def value_ranks(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """(value, ties, min_rank, avg_rank) of each different value that isn't null."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    order = [F.desc(value) if descending else F.asc(value)]
    out = running(counts, order, {"_upto": F.col("ties")})
    return out.select(value, "ties", (F.col("_upto") - F.col("ties") + 1).alias("min_rank"), (F.col("_upto") - (F.col("ties") - 1) / 2).alias("avg_rank"))


def with_rank(df: DataFrame, value: str, out: str, method: str = "average", descending: bool = False, nulls_last: bool = False) -> DataFrame:
    """df with the rank of a column over all rows: `average` or `min`. Nulls have no rank, or with nulls_last one after
    all others."""
    ranks = value_ranks(df, value, descending)
    pick = F.col("avg_rank" if method == "average" else "min_rank").cast("double")
    joined = df.join(ranks.select(value, pick.alias(out)), value, "left")
    if nulls_last:
        n = df.agg(F.count(value).alias("known"), F.sum(F.col(value).isNull().cast("long")).alias("missing")).first()
        last = n["known"] + 1 if method == "min" else n["known"] + (1 + (n["missing"] or 0)) / 2
        joined = joined.withColumn(out, F.coalesce(out, F.lit(float(last))))
    return joined.select(*df.columns, out)


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact, linearly interpolated percentiles of a column (nulls aside). A handful of rows reach the driver."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    upto = durable(running(counts, [F.asc(value)], {"upto": F.col("ties")}))
    n = upto.agg(F.max("upto")).first()[0]
    if not n:
        return [None] * len(shares)
    places = {s: divmod(s * (n - 1), 1) for s in shares}
    wanted = sorted({int(k) + d for k, f in places.values() for d in (0, 1) if int(k) + d < n})
    some = F.exists(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("ties")))
    rows = upto.filter(some).collect()
    at = {w: float(r[value]) for w in wanted for r in rows if r["upto"] - r["ties"] <= w < r["upto"]}
    return [at[int(k)] + f * (at[min(int(k) + 1, n - 1)] - at[int(k)]) for k, f in places.values()]
