"""Queries of ranks, thresholds, correlations and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclora.functions import numbers
from cyclora.operators import aggregates, ranking, stats
from cyclora.operators.ordering import percentiles, running, with_rank
from cyclora.plans.registry import query


@query("WIN-8 R5", "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS avg_rank FROM part")
def average_rank(t):
    return with_rank(t.part.select("p_partkey", "p_size"), "p_size", "avg_rank")


@query("WIN-8", "SELECT p_partkey, p_size, CAST(rank() OVER (ORDER BY p_size DESC) AS DOUBLE) AS min_rank FROM part")
def min_rank(t):
    return with_rank(t.part.select("p_partkey", "p_size"), "p_size", "min_rank", "min", descending=True)


_RANKED = """SELECT p_partkey, (rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 + rank() OVER (ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2) / 2 AS mean_rank FROM part"""


@query("WIN-9 PRJ-15", _RANKED)
def mean_rank_ensemble(t):
    x = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return ranking.mean_rank(x, ["p_size", "p_retailprice"]).select("p_partkey", "mean_rank")


_PCT = "(SELECT quantile_cont(p_size, 0.95) AS a, quantile_cont(p_retailprice, 0.95) AS b FROM part)"


@query("WIN-10 GRF-10 R4 PRJ-14", f"SELECT p_partkey, p_size >= a AS hub_size, p_retailprice >= b AS hub_price, p_size >= a OR p_retailprice >= b AS is_hub FROM part, {_PCT}")
def hub_flags(t):
    x = t.part.select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return ranking.hub_flags(x, ["size", "price"]).select("p_partkey", "hub_size", "hub_price", "is_hub")


@query("R4", "SELECT round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.01), 4) AS p01 FROM orders")
def exact_percentiles(t):
    p = percentiles(t.orders, "o_totalprice", [0.95, 0.5, 0.01])
    return t.spark.createDataFrame([tuple(p)], "p95 double, p50 double, p01 double").select(*[F.round(c, 4).alias(c) for c in ("p95", "p50", "p01")])


@query("WIN-11", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z FROM customer")
def z_scores(t):
    return ranking.z_scores(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")


@query("WIN-12", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer")
def min_max_scaled(t):
    return ranking.min_max(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")


@query("TOP-3", """WITH l AS (SELECT s_suppkey, unnest([s_acctbal, CAST(s_nationkey AS DOUBLE), CAST(s_suppkey % 13 AS DOUBLE)]) AS v, unnest(['a', 'b', 'c']) AS m FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY coalesce(v, 0) DESC, s_suppkey) AS rn, count(*) OVER (PARTITION BY m) AS n FROM l)
    SELECT s_suppkey, count(*) AS appearances FROM r WHERE rn <= greatest(1, n // 5) GROUP BY 1 HAVING count(*) >= 2""")
def top_share(t):
    x = t.supplier.select("s_suppkey", "s_acctbal", "s_nationkey", (F.col("s_suppkey") % 13).alias("m"))
    return ranking.top_share(x, "s_suppkey", ["s_acctbal", "s_nationkey", "m"], 5, 2)


@query("GRF-23", """WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC) AS rk FROM g)
    SELECT c_nationkey, max(n) FILTER (WHERE c_mktsegment = 'BUILDING') AS value_building, max(rk) FILTER (WHERE c_mktsegment = 'BUILDING') AS rank_building, max(n) FILTER (WHERE c_mktsegment = 'MACHINERY') AS value_machinery,
    max(rk) FILTER (WHERE c_mktsegment = 'MACHINERY') AS rank_machinery FROM r GROUP BY 1""")
def scope_ranks(t):
    g = t.customer.groupBy("c_nationkey", F.lower("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    return ranking.scope_ranks(g, "seg", "c_nationkey", "n", ["building", "machinery"])


_SPEAR = "SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)"


@query("STA-1", _SPEAR)
def spearman(t):
    n, rho, _ = stats.spearman(t.part, "p_size", "p_retailprice")
    return t.spark.createDataFrame([(n, None if rho is None else round(rho, 6))], "n long, rho double")


@query("STA-3", "SELECT CAST(count(*) AS BIGINT) AS n, round(corr(p_size, p_retailprice), 6) AS r FROM part")
def pearson(t):
    n, r, _ = stats.pearson(t.part, "p_size", "p_retailprice")
    return t.spark.createDataFrame([(n, None if r is None else round(r, 6))], "n long, r double")


@query("STA-1 STA-2 STA-4 JN-18")
def correlation_table(t):
    x = t.part.select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 17).cast("double").alias("cycle"))
    return stats.all_pairs(x, ["size", "price", "cycle"])


_P = "(SELECT c_custkey, (c_custkey * 7919 % 1009) / 1009.0 * ((c_custkey % 5 + 1) / 5.0) AS p FROM customer)"


@query("STA-4", f"""WITH r AS (SELECT c_custkey, p, row_number() OVER (ORDER BY p, c_custkey) AS i, count(*) OVER () AS m FROM {_P})
    SELECT c_custkey, round(least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""")
def benjamini_hochberg(t):
    k = F.col("c_custkey")
    x = t.customer.select("c_custkey", ((k * 7919 % 1009) / 1009.0 * ((k % 5 + 1) / 5.0)).alias("p"))
    return stats.benjamini_hochberg(x, "p", ["c_custkey"]).select("c_custkey", F.round("q", 9).alias("q"))


_ERFC = "(t * exp({} - x * x))".format("".join(f"{c} + t * (" for c in stats.ERFC[:-1]) + str(stats.ERFC[-1]) + ")" * (len(stats.ERFC) - 1))


@query("STA-5 STA-6", f"""WITH g AS (SELECT o_custkey, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS INT)) AS share FROM orders GROUP BY 1), k AS (SELECT o_custkey, CAST(n AS BIGINT) AS n, CAST(floor(n * round(share, 4)) AS BIGINT) AS hits, share FROM g WHERE n >= 5),
    r AS (SELECT o_custkey AS ref, n AS n2, hits AS k2 FROM k, (SELECT quantile_cont(share, 0.5) AS m FROM k) ORDER BY abs(share - m), o_custkey LIMIT 1),
    c AS (SELECT o_custkey, n, hits, CAST(ref AS VARCHAR) AS reference, CAST(n AS DOUBLE) AS n1, CAST(n2 AS DOUBLE) AS n2, CAST(n - hits + n2 - k2 AS DOUBLE) AS zeros, CAST(hits + k2 AS DOUBLE) AS ones, hits * (n2 - k2) + (hits * k2 + (n - hits) * (n2 - k2)) / 2 AS u FROM k, r),
    z AS (SELECT *, sqrt(greatest(0, n1 * n2 / 12 * (n1 + n2 + 1 - (zeros ** 3 - zeros + ones ** 3 - ones) / ((n1 + n2) * (n1 + n2 - 1))))) AS sd FROM c),
    x AS (SELECT *, CASE WHEN sd > 0 THEN greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd / sqrt(2) END AS x, 1 / (1 + x / 2) AS t FROM z)
    SELECT o_custkey, n, hits, reference, round(u, 6) AS u, round(CASE WHEN x IS NULL THEN 1 ELSE least(1, {_ERFC}) END, 6) AS p FROM x""")
def mann_whitney(t):
    x = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    return stats.mann_whitney_binary(x, "o_custkey", "n", "share", 5)


@query("STA-6", "SELECT c_custkey, c_acctbal FROM customer, (SELECT median(c_acctbal) AS m FROM customer) ORDER BY abs(c_acctbal - m), c_custkey LIMIT 1")
def nearest_to_median(t):
    return stats.nearest_to_median(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("STA-7", f"SELECT c_custkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM {_P}")
def significance_stars(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", stats.stars((k * 7919 % 1009) / 1009.0 * ((k % 5 + 1) / 5.0)).alias("stars"))


@query("STA-8 R3", "SELECT c_nationkey, round(CASE WHEN stddev_pop(c_acctbal) > 0 THEN (max(c_acctbal) - avg(c_acctbal)) / stddev_pop(c_acctbal) END, 6) AS z FROM customer GROUP BY 1")
def z_against_null(t):
    return t.customer.groupBy("c_nationkey").agg(F.round(stats.z_against_null(F.max("c_acctbal"), F.avg("c_acctbal"), F.stddev_pop("c_acctbal")), 6).alias("z"))


@query("MTH-5", "SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 6) AS intercept, round(regr_r2(o_totalprice, o_custkey), 6) AS r2 FROM orders")
def linear_fit(t):
    return stats.linear_fit(t.orders, "o_custkey", "o_totalprice")


@query("AGG-24", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean_discount FROM lineitem GROUP BY 1")
def weighted_mean(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(aggregates.weighted_mean(F.col("l_discount"), F.col("l_quantity").cast("double")), 6).alias("mean_discount"))


@query("WIN-17 WIN-18", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey * 7919 % 1511, c_custkey) AS rn FROM customer)
    SELECT CAST(size AS BIGINT) AS size, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM r JOIN (SELECT DISTINCT CAST(floor(round(pow(n, i / 4.0), 9)) AS BIGINT) AS size FROM (SELECT count(*) AS n FROM customer), range(0, 5) k(i)) s ON rn <= size GROUP BY 1""")
def prefix_batches(t):
    """Nested prefixes of one order, for geometric sizes; each row meets only the sizes above its place."""
    sizes = numbers.geometric_sizes(t.customer.count(), 5)
    k = F.col("c_custkey")
    r = running(t.customer.select("c_custkey", (k * 7919 % 1511).alias("h")), [F.asc("h"), F.asc("c_custkey")], {"rn": F.lit(1)})
    each = r.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s >= F.col("rn"))))
    return each.groupBy("size").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))
