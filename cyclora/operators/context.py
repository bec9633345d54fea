"""Context statistics: entropies of neighbour pairs, duplication, background-relative values, cluster rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.operators.circular import circular_neighbours


def contexts(df: DataFrame, container: str, order: list[str], token: str) -> DataFrame:
    """Each feature with left and right, the tokens beside it on the circle; containers of one feature have none."""
    near = circular_neighbours(df, container, order, [token])
    return near.filter("n_in_container > 1").select(*df.columns, F.col(f"left_{token}").alias("left"), F.col(f"right_{token}").alias("right"))


def _shares(ctx: DataFrame, key: list[str], context: list[str]) -> DataFrame:
    """n_obs, n_contexts and entropy (bits) of each key, from counts by context."""
    counts = ctx.groupBy(*key, *context).agg(F.count("*").alias("_c"))
    # H = log2 N - sum(c log2 c) / N needs no total before the second grouping
    sums = counts.groupBy(*key).agg(F.sum("_c").alias("n_obs"), F.count("*").alias("n_contexts"), F.sum(F.col("_c") * F.log2("_c")).alias("_s"))
    bits = F.greatest(F.lit(0.0), F.log2("n_obs") - F.col("_s") / F.col("n_obs"))
    return sums.select(*key, "n_obs", "n_contexts", bits.alias("_h"))


def context_entropy(ctx: DataFrame, key: list[str], context: list[str] | None = None, variant: str = "score") -> DataFrame:
    """(key, n_obs, n_contexts, entropy, score). Variants: `score` is H/log2 K * K/N, null below two observations and 0 for
    one context; `plain` is H alone, null below two; `normalised` is H/log2 K and `per_copy` H/log2 N, 0 where undefined."""
    h = _shares(ctx, key, context or ["left", "right"])
    n, k, bits = F.col("n_obs"), F.col("n_contexts"), F.col("_h")
    if variant == "score":
        entropy = F.when(n <= 1, None).when(k <= 1, 0.0).otherwise(bits)
        score = F.when(n <= 1, None).when(k <= 1, 0.0).otherwise(bits / F.log2(k) * (k / n))
        digits = 6
    elif variant == "plain":
        entropy = score = F.when(n <= 1, None).otherwise(bits)
        digits = 6
    elif variant in ("normalised", "per_copy"):
        entropy = bits
        score = F.when((n <= 1) | (k <= 1), 0.0).otherwise(bits / F.log2(k if variant == "normalised" else n))
        digits = 5
    else:
        raise ValueError(variant)
    return h.select(*key, "n_obs", "n_contexts", F.round(entropy, digits).alias("entropy"), F.round(score, digits).alias("score"))


def duplication_rate(ctx: DataFrame, token: str, same: Column | None = None, same_right: Column | None = None, key: list[str] | None = None) -> DataFrame:
    """(key, duplication): the mean number of neighbours (0 to 2) that equal the token, or for which the conditions hold."""
    left = F.col("left") == F.col(token) if same is None else same
    right = F.col("right") == F.col(token) if same_right is None else same_right
    return ctx.groupBy(*(key or [token])).agg(F.round(F.avg(F.coalesce(left.cast("int"), F.lit(0)) + F.coalesce(right.cast("int"), F.lit(0))), 6).alias("duplication"))


def duplication_in_group(ctx: DataFrame, token: str, groups: DataFrame, group: str) -> DataFrame:
    """(group, duplication): neighbours that belong to the token's group. groups: (token, group), each token once."""
    g = groups.select(F.col(token).alias("_t"), F.col(group).alias("_g"))
    own = ctx.join(groups.select(token, group), token)
    own = own.join(g.withColumnsRenamed({"_t": "left", "_g": "_lg"}), "left", "left").join(g.withColumnsRenamed({"_t": "right", "_g": "_rg"}), "right", "left")
    return duplication_rate(own, token, F.col("_lg") == F.col(group), F.col("_rg") == F.col(group), [group])


def relative_entropy(scores: DataFrame, features: DataFrame, container: str, token: str, min_obs: int = 10, ratio: bool = False, min_background: int = 3) -> DataFrame:
    """(token, entropy, background, relative): the entropy less (or divided by) the mean entropy of the other tokens that
    share a container with it and have at least min_obs observations; null below min_background of them."""
    member = features.select(container, token).distinct()
    other = member.select(container, F.col(token).alias("_o"))
    # pairs of tokens, each once: their number is bounded by the tokens, not by the features
    pairs = member.join(other, container).filter(F.col(token) != F.col("_o")).select(token, "_o").distinct()
    known = scores.filter((F.col("n_obs") >= min_obs) & F.col("entropy").isNotNull()).select(F.col(token).alias("_o"), F.col("entropy").alias("_h"))
    back = pairs.join(known, "_o").groupBy(token).agg(F.avg("_h").alias("background"), F.count("*").alias("_n"))
    joined = scores.join(back, token, "left")
    enough = F.col("_n") >= min_background
    value = F.when(F.col("background") > 0, F.col("entropy") / F.col("background")) if ratio else F.col("entropy") - F.col("background")
    return joined.select(token, "entropy", F.round(F.when(enough, F.col("background")), 12).alias("background"), F.round(F.when(enough, value), 12).alias("relative"))


def cluster_entropy(ctx: DataFrame, token: str, container: str, cluster: str) -> DataFrame:
    """(token, cluster, n_obs, n_contexts, entropy, ratio, weight): within each cluster of containers; weight is the share
    of the cluster's containers that have the token."""
    h = context_entropy(ctx, [token, cluster])
    have = ctx.groupBy(token, cluster).agg(F.count_distinct(container).alias("_have"))
    size = ctx.groupBy(cluster).agg(F.count_distinct(container).alias("_size"))
    return h.join(have, [token, cluster]).join(size, cluster).select(
        token, cluster, "n_obs", "n_contexts", "entropy", F.round(F.col("n_contexts") / F.col("n_obs"), 6).alias("ratio"), F.round(F.col("_have") / F.col("_size"), 6).alias("weight")
    )


def cluster_rollup(by_cluster: DataFrame, token: str) -> DataFrame:
    """(token, n_clusters, mean, median, max and weighted mean of the entropy over clusters where it is known)."""
    known = F.col("entropy").isNotNull()
    return by_cluster.groupBy(token).agg(
        F.count("entropy").alias("n_clusters"),
        F.round(F.avg("entropy"), 12).alias("mean_entropy"),
        F.round(F.median("entropy"), 12).alias("median_entropy"),
        F.round(F.max("entropy"), 6).alias("max_entropy"),
        F.round(F.sum(F.col("entropy") * F.col("weight")) / F.nullif(F.sum(F.when(known, F.col("weight"))), F.lit(0.0)), 12).alias("weighted_entropy"),
    )


def context_ratio(ctx: DataFrame, token: str) -> DataFrame:
    """(token, copies, ratio): different contexts for each copy."""
    return ctx.groupBy(token).agg(F.count("*").alias("copies"), F.round(F.count_distinct("left", "right") / F.count("*"), 6).alias("ratio"))


def simpson(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, k, simpson, spread): 1 - sum p^2, and that over its most, 1 - 1/K (0 for one value)."""
    c = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    s = c.groupBy(key).agg(F.sum("_c").alias("n"), F.count("*").alias("k"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    d = 1 - F.col("_q") / (F.col("n") * F.col("n"))
    return s.select(key, "n", "k", F.round(d, 6).alias("simpson"), F.round(F.when(F.col("k") <= 1, 0.0).otherwise(d / (1 - 1 / F.col("k"))), 6).alias("spread"))


def column_entropy(df: DataFrame, group: str, aligned: str, conservation: bool = False) -> DataFrame:
    """(group, col, n, entropy) of aligned strings, all symbols counting; with conservation log2(5) - H, upper-cased and
    without N."""
    each = df.select(group, F.posexplode(F.split(F.col(aligned), "")).alias("col", "sym"))
    if conservation:  # cased symbol by symbol: some letters have capitals of two letters, which would shift the columns
        each = each.withColumn("sym", F.upper("sym")).filter("sym != 'N'")
    h = _shares(each, [group, "col"], ["sym"])
    out = F.log2(F.lit(5.0)) - F.col("_h") if conservation else F.col("_h")
    return h.select(group, F.col("col").cast("long").alias("col"), F.col("n_obs").alias("n"), F.round(out, 6).alias("conservation" if conservation else "entropy"))


def mean_of_related(scores: DataFrame, relation: DataFrame, item: str, parent: str, value: str, how: str = "mean") -> DataFrame:
    """(parent, value): a parent's mean (or max) over its different items."""
    pairs = relation.select(parent, item).distinct().join(scores.select(item, value), item)
    agg = F.avg(value) if how == "mean" else F.max(value)
    return pairs.groupBy(parent).agg(F.round(agg, 12).alias(value))
