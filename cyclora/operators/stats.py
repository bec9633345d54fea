"""Correlations, tests and their corrections."""

from __future__ import annotations

from itertools import combinations
from math import erfc, exp, lgamma, log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.operators.ordering import percentiles, running, with_rank


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    tiny, c, d, out = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)), 0.0
    out = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            c = 1 + up / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs, by Student's t."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return _beta_share((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def _corr(x: str, y: str):
    """Aggregate: the correlation of columns without nulls; null if one of them is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, min_n: int = 5) -> tuple[int, float | None, float | None]:
    """(n, rho, p) over the rows where both are known; ranks are taken among these."""
    both = df.select(x, y).dropna()
    ranked = with_rank(with_rank(both, x, "_rx"), y, "_ry")
    r = ranked.agg(F.count("*").alias("n"), _corr("_rx", "_ry").alias("rho")).first()
    rho = None if r["n"] < min_n or r["rho"] is None or r["rho"] != r["rho"] else r["rho"]
    return r["n"], rho, correlation_p(rho, r["n"])


def pearson(df: DataFrame, x: str, y: str) -> tuple[int, float | None, float | None]:
    r = df.select(x, y).dropna().agg(F.count("*").alias("n"), _corr(x, y).alias("r")).first()
    value = None if r["r"] is None or r["r"] != r["r"] else r["r"]
    return r["n"], value, correlation_p(value, r["n"])


def all_pairs(df: DataFrame, metrics: list[str], kind: str = "spearman", min_n: int = 5) -> DataFrame:
    """(metric_a, metric_b, n, rho, p, q): every pair of the metrics, with Benjamini-Hochberg q over the pairs. The pairs
    are few, a plan for each; the data stay where they are."""
    rows = []
    for a, b in combinations(metrics, 2):
        n, rho, p = spearman(df, a, b, min_n) if kind == "spearman" else pearson(df, a, b)
        rows.append((a, b, n, rho, p))
    out = df.sparkSession.createDataFrame(rows, "metric_a string, metric_b string, n long, rho double, p double")
    return benjamini_hochberg(out, "p", ["metric_a", "metric_b"])


def benjamini_hochberg(df: DataFrame, p: str, tie: list[str], out: str = "q") -> DataFrame:
    """df with the adjusted p-values; null p-values have none. p * m / rank, and from the largest down the least so far:
    the running minimum is taken within range partitions, then over those that follow."""
    known = df.filter(F.col(p).isNotNull())
    m = known.count()
    order = [F.asc(p), *[F.asc(c) for c in tie]]
    ranked = running(known, order, {"_i": F.lit(1)})
    raw = ranked.withColumn("_raw", F.col(p) * m / F.col("_i"))
    adjusted = _running_min_down(raw, "_raw", "_i").withColumn(out, F.least(F.lit(1.0), F.col("_least"))).drop("_i", "_raw", "_least")
    return adjusted.unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def _running_min_down(df: DataFrame, value: str, order: str) -> DataFrame:
    from pyspark.sql import Window

    from cyclora.session import durable

    cut = durable(df.repartitionByRange(F.asc(order)).withColumn("_part", F.spark_partition_id()))
    least = {r["_part"]: r["v"] for r in cut.groupBy("_part").agg(F.min(value).alias("v")).collect()}
    after, low = [], float("inf")
    for part in sorted(least, reverse=True):
        after += [F.lit(part), F.lit(low)]
        low = min(low, least[part])
    rest = F.create_map(*after)[F.col("_part")] if after else F.lit(float("inf"))
    w = Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_least", F.least(F.min(value).over(w), rest)).drop("_part")


def mann_whitney_binary(df: DataFrame, key: str, n: str, share: str, min_n: int = 1) -> DataFrame:
    """(key, n, hits, reference, u, p): each key's 0/1 values, int(n * share) of them ones, against those of the key whose
    share is nearest the median; two-sided, normal approximation with ties and continuity."""
    known = df.filter((F.col(n) >= min_n) & F.col(share).isNotNull()).select(key, F.col(n).cast("long").alias("n"), F.floor(F.col(n) * F.round(F.col(share), 4)).alias("hits"), share)
    middle = percentiles(known, share, [0.5])[0]
    if middle is None:
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, n long, hits long, reference string, u double, p double")
    ref = known.orderBy(F.abs(F.col(share) - middle), key).first()
    n2, k2 = F.lit(float(ref["n"])), F.lit(float(ref["hits"]))
    n1, k1 = F.col("n").cast("double"), F.col("hits").cast("double")
    zeros, ones, total = (n1 - k1) + (n2 - k2), k1 + k2, n1 + n2
    u = k1 * (n2 - k2) + (k1 * k2 + (n1 - k1) * (n2 - k2)) / 2
    ties = (zeros**3 - zeros + ones**3 - ones) / (total * (total - 1))
    sd = F.sqrt(F.greatest(n1 * n2 / 12 * (total + 1 - ties), F.lit(0.0)))
    z = F.when(sd > 0, F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd)
    tail = normal_tail(z)
    return known.select(key, "n", "hits", F.lit(str(ref[key])).alias("reference"), F.round(u, 6).alias("u"), F.round(F.when(z.isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 6).alias("p"))


#: Coefficients of the fit.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z):
    """P(Z > z), z not below 0, as a column: a Chebyshev fit of erfc whose error is under 1.2e-7 of the value everywhere."""
    x = z / sqrt(2)
    t = 1 / (1 + x / 2)
    power = F.lit(0.0)
    for c in reversed(ERFC):
        power = power * t + c
    return t * F.exp(power - x * x) / 2


def normal_tail_exact(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def stars(p):
    """*** below 0.001, ** below 0.01, * below 0.05, else ns."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def z_against_null(observed, mean, std):
    return F.when(std > 0, (observed - mean) / std)


def nearest_to_median(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The row whose value is nearest the median, ties by the smallest tie key."""
    middle = percentiles(df, value, [0.5])[0]
    return df.filter(F.col(value).isNotNull()).orderBy(F.abs(F.col(value) - F.lit(middle)), tie).limit(1)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))
