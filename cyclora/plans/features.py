"""Queries of ordered features: adjacency, contexts, intervals, association."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclora.operators import association, circular, context, intervals
from cyclora.plans.proxies import CTX, ENT, FEATURES, NEAR, ORDER, features
from cyclora.plans.registry import query


def _ctx(t):
    return context.contexts(features(t), "container", ORDER, "token2")


@query("WIN-5 CTX-1 AGG-17 JSN-1", f"WITH {ENT} SELECT token2, n_obs, n_contexts, entropy, CASE WHEN n_obs <= 1 THEN NULL WHEN n_contexts <= 1 THEN 0 ELSE round(h / log2(n_contexts) * (n_contexts / n_obs), 6) END AS score FROM e")
def context_entropy(t):
    return context.context_entropy(_ctx(t), ["token2"])


@query("CTX-2", f"WITH {ENT} SELECT token2, n_obs, n_contexts, CASE WHEN n_obs <= 1 THEN NULL ELSE round(h, 6) END AS entropy, CASE WHEN n_obs <= 1 THEN NULL ELSE round(h, 6) END AS score FROM e")
def context_entropy_plain(t):
    return context.context_entropy(_ctx(t), ["token2"], variant="plain")


@query("CTX-3", f"WITH {ENT} SELECT token2, n_obs, n_contexts, round(h, 5) AS entropy, CASE WHEN n_obs <= 1 OR n_contexts <= 1 THEN 0 ELSE round(h / log2(n_contexts), 5) END AS score FROM e")
def context_entropy_normalised(t):
    return context.context_entropy(_ctx(t), ["token2"], variant="normalised")


@query("CTX-4", f"WITH {ENT} SELECT token2, n_obs, n_contexts, round(h, 5) AS entropy, CASE WHEN n_obs <= 1 OR n_contexts <= 1 THEN 0 ELSE round(h / log2(n_obs), 5) END AS score FROM e")
def context_entropy_per_copy(t):
    return context.context_entropy(_ctx(t), ["token2"], variant="per_copy")


@query("WIN-6 WIN-1", f"WITH {NEAR} SELECT container, sub, CAST(rn - 1 AS BIGINT) AS idx, left2 AS left_token, right2 AS right_token FROM nb")
def circular_neighbours(t):
    x = circular.position_index(circular.circular_neighbours(features(t), "container", ORDER, ["token2"]), "container", ORDER)
    return x.select("container", "sub", F.col("idx").cast("long").alias("idx"), F.col("left_token2").alias("left_token"), F.col("right_token2").alias("right_token"))


@query("WIN-1 WIN-3 WIN-5", f"WITH {NEAR} SELECT container, sub, n AS n_in_container, left2 AS left_token, right2 AS right_token FROM nb")
def circular_neighbours_split(t):
    x = circular.circular_neighbours_split(features(t), "container", ORDER, ["token2"])
    return x.select("container", "sub", "n_in_container", F.col("left_token2").alias("left_token"), F.col("right_token2").alias("right_token"))


@query("WIN-1 WIN-2 WIN-3 WIN-4 PRJ-7 AGG-1", f"""WITH {NEAR} SELECT token AS domain1, right1 AS domain2, CASE WHEN strand = 1 AND rstrand = 1 THEN 'PP' WHEN strand = -1 AND rstrand = -1 THEN 'MM'
    WHEN strand = 1 AND rstrand = -1 THEN 'PM' ELSE 'MP' END AS orientation, count(*) AS weight FROM nb GROUP BY ALL""")
def adjacency_edges(t):
    return circular.adjacency_edges(features(t), "container", ORDER, "token", "strand")


@query("PRJ-8 AGG-2", f"""WITH {NEAR} SELECT token AS domain1, right1 AS domain2, CAST(sum(CASE WHEN strand = rstrand THEN 1 ELSE -1 END) AS BIGINT) AS signed_weight, count(*) AS total_weight FROM nb GROUP BY ALL""")
def signed_edges(t):
    return circular.signed_edges(circular.adjacency_edges(features(t), "container", ORDER, "token", "strand"))


@query("AGG-12 STR-9 AGG-8", f"""WITH {FEATURES} SELECT token2 AS label, count(DISTINCT container) AS plasmid_count, string_agg(DISTINCT CAST(container AS VARCHAR), ';' ORDER BY CAST(container AS VARCHAR)) AS plasmids FROM f GROUP BY 1""")
def node_attributes(t):
    return circular.node_attributes(features(t), "container", "token2")


@query("WIN-7", f"""WITH {FEATURES}, i AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY pos, sub) - 1 AS idx, count(*) OVER (PARTITION BY container) AS n FROM f),
    m AS (SELECT a.sub, a.container, max(CASE WHEN k IN (-1, 1) AND b.token = 'error' THEN 1 ELSE 0 END) AS adj, max(CASE WHEN k < 0 AND b.token = 'error' THEN 1 ELSE 0 END) AS l,
        max(CASE WHEN k > 0 AND b.token = 'error' THEN 1 ELSE 0 END) AS r FROM i a, (VALUES (-2), (-1), (1), (2)) o(k), i b
        WHERE b.container = a.container AND b.idx = ((a.idx + k) % a.n + a.n) % a.n GROUP BY ALL)
    SELECT container, sub, adj = 1 AS directly_adjacent, l = 1 AND r = 1 AS sandwiched FROM m""")
def circular_vicinity(t):
    f = features(t).withColumn("mobile", F.col("token") == "error")
    return circular.circular_vicinity(f, "container", ORDER, "mobile").select("container", "sub", "directly_adjacent", "sandwiched")


@query("CTX-5", f"WITH {CTX} SELECT token2, round(avg(CAST(left2 = token2 AS INT) + CAST(right2 = token2 AS INT)), 6) AS duplication FROM c GROUP BY 1")
def duplication_rate(t):
    return context.duplication_rate(_ctx(t), "token2")


@query("CTX-6", f"""WITH {CTX} SELECT split_part(token2, '_', 1) AS grp, round(avg(CAST(split_part(left2, '_', 1) = split_part(token2, '_', 1) AS INT) + CAST(split_part(right2, '_', 1) = split_part(token2, '_', 1) AS INT)), 6) AS duplication FROM c GROUP BY 1""")
def duplication_in_group(t):
    groups = features(t).select("token2").distinct().withColumn("grp", F.split("token2", "_")[0])
    return context.duplication_in_group(_ctx(t), "token2", groups, "grp")


_BACK = f"""{ENT}, m AS (SELECT DISTINCT container, token2 FROM f), p AS (SELECT DISTINCT a.token2, b.token2 AS o FROM m a JOIN m b USING (container) WHERE a.token2 <> b.token2),
    b AS (SELECT p.token2, avg(e.entropy) AS bg, count(*) AS nb FROM p JOIN e ON e.token2 = p.o WHERE e.n_obs >= 10 AND e.entropy IS NOT NULL GROUP BY 1)"""


@query("CTX-8", f"WITH {_BACK} SELECT e.token2, entropy, CASE WHEN nb >= 3 THEN round(bg, 12) END AS background, CASE WHEN nb >= 3 THEN round(entropy - bg, 12) END AS relative FROM e LEFT JOIN b USING (token2)")
def relative_entropy(t):
    f = features(t)
    return context.relative_entropy(context.context_entropy(_ctx(t), ["token2"]), f, "container", "token2")


@query("CTX-9", f"WITH {_BACK} SELECT e.token2, entropy, CASE WHEN nb >= 3 THEN round(bg, 12) END AS background, CASE WHEN nb >= 3 AND bg > 0 THEN round(entropy / bg, 12) END AS relative FROM e LEFT JOIN b USING (token2)")
def relative_entropy_ratio(t):
    f = features(t)
    return context.relative_entropy(context.context_entropy(_ctx(t), ["token2"]), f, "container", "token2", ratio=True)


_CLUSTER = f"""{CTX}, k AS (SELECT *, container % 5 AS cluster FROM c), kk AS (SELECT token2, cluster, left2, right2, count(*) AS q FROM k GROUP BY ALL),
    h AS (SELECT token2, cluster, CAST(sum(q) AS BIGINT) AS n_obs, count(*) AS n_contexts, greatest(0, log2(sum(q)) - sum(q * log2(q)) / sum(q)) AS h FROM kk GROUP BY ALL),
    w AS (SELECT token2, cluster, count(DISTINCT container) AS have FROM k GROUP BY ALL), s AS (SELECT cluster, count(DISTINCT container) AS size FROM k GROUP BY 1),
    bc AS (SELECT token2, cluster, n_obs, n_contexts, CASE WHEN n_obs <= 1 THEN NULL WHEN n_contexts <= 1 THEN 0 ELSE round(h, 6) END AS entropy, round(n_contexts / n_obs, 6) AS ratio, round(have / size, 6) AS weight
        FROM h JOIN w USING (token2, cluster) JOIN s USING (cluster))"""


def _by_cluster(t):
    return context.cluster_entropy(_ctx(t).withColumn("cluster", F.col("container") % 5), "token2", "container", "cluster")


@query("CTX-10", f"WITH {_CLUSTER} SELECT * FROM bc")
def cluster_entropy(t):
    return _by_cluster(t)


@query("CTX-11 AGG-24 AGG-25", f"""WITH {_CLUSTER} SELECT token2, count(entropy) AS n_clusters, round(avg(entropy), 12) AS mean_entropy, round(median(entropy), 12) AS median_entropy, round(max(entropy), 6) AS max_entropy,
    round(sum(entropy * weight) / nullif(sum(weight) FILTER (WHERE entropy IS NOT NULL), 0), 12) AS weighted_entropy FROM bc GROUP BY 1""")
def cluster_rollup(t):
    return context.cluster_rollup(_by_cluster(t), "token2")


@query("AGG-22", f"""WITH {_CLUSTER} SELECT token2, {', '.join(f'max(entropy) FILTER (WHERE cluster = {k}) AS entropy_cluster_{k}' for k in range(5))} FROM bc GROUP BY 1""")
def cluster_columns(t):
    from cyclora.operators.aggregates import pivot_long

    return pivot_long(_by_cluster(t), "token2", "cluster", "entropy", list(range(5)), "entropy_cluster_")


@query("CTX-12", f"WITH {CTX} SELECT token2, count(*) AS copies, round(count(DISTINCT (left2, right2)) / count(*), 6) AS ratio FROM c GROUP BY 1")
def context_ratio(t):
    return context.context_ratio(_ctx(t), "token2")


@query("CTX-13", f"""WITH {_BACK}, d AS (SELECT token2, round(avg(CAST(left2 = token2 AS INT) + CAST(right2 = token2 AS INT)), 6) AS duplication FROM c GROUP BY 1)
    SELECT token2, round(CASE WHEN nb >= 3 THEN round(entropy - bg, 12) END + duplication, 9) AS combined FROM e LEFT JOIN b USING (token2) JOIN d USING (token2)""")
def combined_score(t):
    r = context.relative_entropy(context.context_entropy(_ctx(t), ["token2"]), features(t), "container", "token2")
    return r.join(context.duplication_rate(_ctx(t), "token2"), "token2").select("token2", F.round(F.col("relative") + F.col("duplication"), 9).alias("combined"))


@query("AGG-20", f"WITH {CTX}, d AS (SELECT DISTINCT container, token2, left2, right2 FROM c) SELECT token2, count(*) AS n FROM d GROUP BY 1")
def contexts_once(t):
    return _ctx(t).select("container", "token2", "left", "right").distinct().groupBy("token2").agg(F.count("*").alias("n"))


@query("CTX-14", """WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS q FROM customer GROUP BY ALL), s AS (SELECT c_nationkey, CAST(sum(q) AS BIGINT) AS n, count(*) AS k, 1 - sum(q * q) / (sum(q) * sum(q)) AS d FROM c GROUP BY 1)
    SELECT c_nationkey, n, k, round(d, 6) AS simpson, round(CASE WHEN k <= 1 THEN 0 ELSE d / (1 - 1 / k) END, 6) AS spread FROM s""")
def simpson_diversity(t):
    return context.simpson(t.customer, "c_nationkey", "c_mktsegment")


_ALIGNED = "a AS (SELECT lang, unnest(string_split(text, '')) AS sym, generate_subscripts(string_split(text, ''), 1) - 1 AS col FROM documents WHERE text <> '')"


@query("CTX-15", f"""WITH {_ALIGNED}, q AS (SELECT lang, col, sym, count(*) AS k FROM a GROUP BY ALL)
    SELECT lang, CAST(col AS BIGINT) AS col, CAST(sum(k) AS BIGINT) AS n, round(greatest(0, log2(sum(k)) - sum(k * log2(k)) / sum(k)), 6) AS entropy FROM q GROUP BY lang, col""")
def column_entropy(t):
    return context.column_entropy(t.documents.filter("text != ''").select("lang", F.col("text").alias("s")), "lang", "s")


@query("CTX-16", f"""WITH {_ALIGNED}, q AS (SELECT lang, col, upper(sym) AS sym, count(*) AS k FROM a WHERE upper(sym) <> 'N' GROUP BY ALL)
    SELECT lang, CAST(col AS BIGINT) AS col, CAST(sum(k) AS BIGINT) AS n, round(log2(5.0) - greatest(0, log2(sum(k)) - sum(k * log2(k)) / sum(k)), 6) AS conservation FROM q GROUP BY lang, col""")
def column_conservation(t):
    return context.column_entropy(t.documents.filter("text != ''").select("lang", F.col("text").alias("s")), "lang", "s", True)


@query("AGG-30", f"""WITH {ENT} SELECT container, round(max(entropy), 6) AS entropy FROM (SELECT DISTINCT container, token2 FROM f) JOIN e USING (token2) GROUP BY 1""")
def max_of_related(t):
    return context.mean_of_related(context.context_entropy(_ctx(t), ["token2"]), features(t), "token2", "container", "entropy", "max")


@query("AGG-29", f"""WITH {ENT} SELECT container, round(avg(entropy), 12) AS entropy FROM (SELECT DISTINCT container, token2 FROM f) JOIN e USING (token2) GROUP BY 1""")
def mean_of_related(t):
    return context.mean_of_related(context.context_entropy(_ctx(t), ["token2"]), features(t), "token2", "container", "entropy")


# --- intervals -----------------------------------------------------------------------------------------------------


@query("JN-13 JN-14", f"""WITH {FEATURES} SELECT q.container, q.sub, min(CASE WHEN m.sub IS NULL THEN NULL ELSE greatest(0, m.start - q.stop, q.start - m.stop) END) AS distance
    FROM f q LEFT JOIN f m ON q.container = m.container AND m.token = 'error' WHERE q.token = 'purchase' GROUP BY ALL""")
def nearest_interval(t):
    f = features(t)
    a, b = f.filter("token = 'purchase'"), f.filter("token = 'error'")
    return intervals.nearest_distance(a, b, "container", "start", "stop", "start", "stop").select("container", "sub", "distance")


@query("JN-10", f"""WITH {FEATURES} SELECT a.sub AS a_id, b.sub AS b_id FROM f a JOIN f b ON a.container = b.container AND a.token = 'purchase' AND b.token = 'error' AND a.start <= b.stop AND a.stop >= b.start""")
def interval_overlap(t):
    f = features(t)
    a = f.filter("token = 'purchase'").select("container", F.col("sub").alias("a_id"), F.col("start").alias("s1"), F.col("stop").alias("e1"))
    b = f.filter("token = 'error'").select("container", F.col("sub").alias("b_id"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    return intervals.overlap_join(a, b, "container", "s1", "e1", "s2", "e2").select("a_id", "b_id")


@query("JN-11 JN-12 SEQ-6", f"""WITH {FEATURES} SELECT a.container, a.sub FROM f a WHERE a.token = 'purchase' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.container = a.container AND b.token = 'error' AND a.start <= b.stop + 50 AND a.stop >= b.start - 50)""")
def interval_anti_overlap(t):
    f = features(t)
    a = f.filter("token = 'purchase'").select("container", "sub", "start", "stop")
    b = f.filter("token = 'error'").select("container", F.col("start").alias("s2"), F.col("stop").alias("e2"))
    return intervals.without_overlap(a, b, "container", ["container", "sub"], "start", "stop", "s2", "e2", buffer=50).select("container", "sub")


@query("JN-15", f"""WITH {FEATURES}, r AS (SELECT a.container, a.sub, b.start AS near_at, b.sub AS near_id, abs(b.start - a.start) AS d,
        row_number() OVER (PARTITION BY a.sub ORDER BY abs(b.start - a.start), b.start, b.sub) AS rn FROM f a JOIN f b ON a.container = b.container AND b.token = 'error' WHERE a.token = 'purchase')
    SELECT q.container, q.sub, CASE WHEN d <= 50000 THEN near_at END AS near_at, CASE WHEN d <= 50000 THEN near_id END AS near_id FROM (SELECT * FROM f WHERE token = 'purchase') q LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.sub = q.sub""")
def nearest_coordinate(t):
    f = features(t)
    a = f.filter("token = 'purchase'").select("container", "sub", F.col("start").alias("x"))
    b = f.filter("token = 'error'").select("container", F.col("start").alias("y"), F.col("sub").alias("id"))
    return intervals.nearest_coordinate(a, b, "container", "x", "y", "id", 50000).select("container", "sub", "near_at", "near_id")


_MERGED = f"""{FEATURES}, o AS (SELECT container, start, stop, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY container ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT container, start, stop, coalesce(start > max(stop) OVER (PARTITION BY container ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS brk FROM f)),
    mg AS (SELECT container, min(start) AS start, max(stop) AS stop, count(*) AS n FROM o GROUP BY container, run)"""


@query("WIN-14", f"WITH {_MERGED} SELECT * FROM mg")
def interval_merge(t):
    return intervals.merge_intervals(features(t), "container", "start", "stop")


@query("WIN-15", f"WITH {_MERGED}, l AS (SELECT container, stop + 1 AS gap_start, lead(start) OVER (PARTITION BY container ORDER BY start) - 1 AS gap_end FROM mg) SELECT * FROM l WHERE gap_end >= gap_start")
def interval_complement(t):
    return intervals.complement(intervals.merge_intervals(features(t), "container", "start", "stop"), "container", "start", "stop")


@query("WIN-13", """WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS base FROM d)
    SELECT l_suppkey, min(l_partkey) AS run_start, max(l_partkey) AS run_end, count(*) AS n FROM g GROUP BY l_suppkey, base""")
def islands(t):
    return intervals.islands(t.lineitem, "l_suppkey", "l_partkey")


@query("PRJ-6", f"WITH {FEATURES} SELECT sub, least(start, stop - 5000) AS lo, greatest(start, stop - 5000) AS hi FROM f")
def normalised_interval(t):
    x = features(t).select("sub", F.col("start").alias("lo"), (F.col("stop") - 5000).alias("hi"))
    return intervals.normalised(x, "lo", "hi")


# --- association ---------------------------------------------------------------------------------------------------


def _assoc(t):
    f = features(t)
    a = association.by_distance(f, "container", "start", "stop", "token = 'purchase'", "token = 'error'", 3600)
    b = association.by_order(f.withColumn("mobile", F.col("token") == "error"), "container", ORDER, "token = 'purchase'", "mobile")
    return a, b


_ASSOC = f"""{FEATURES}, a AS (SELECT q.token2, q.sub, coalesce(min(greatest(0, m.start - q.stop, q.start - m.stop)) FILTER (WHERE m.sub IS NOT NULL) <= 3600, false) AS x
        FROM f q LEFT JOIN f m ON q.container = m.container AND m.token = 'error' WHERE q.token = 'purchase' GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY container ORDER BY pos, sub) - 1 AS idx, count(*) OVER (PARTITION BY container) AS n FROM f),
    b AS (SELECT q.token2, q.sub, max(CASE WHEN k IN (-1, 1) AND b.token = 'error' THEN 1 ELSE 0 END) = 1 OR (max(CASE WHEN k < 0 AND b.token = 'error' THEN 1 ELSE 0 END) = 1
        AND max(CASE WHEN k > 0 AND b.token = 'error' THEN 1 ELSE 0 END) = 1) AS y FROM i q, (VALUES (-2), (-1), (1), (2)) o(k), i b
        WHERE q.token = 'purchase' AND b.container = q.container AND b.idx = ((q.idx + k) % q.n + q.n) % q.n GROUP BY ALL)"""


@query("ASC-1 ASC-2 AGG-26 AGG-6 AGG-7", f"""WITH {_ASSOC} SELECT token2, count(*) AS a_total, count_if(x) AS a_assoc, round(count_if(x) / count(*), 6) AS a_rate, count(*) AS b_total, count_if(y) AS b_assoc,
    round(count_if(y) / count(*), 6) AS b_rate, count(*) AS pool_total, count_if(x OR y) AS pool_assoc, round(count_if(x OR y) / count(*), 6) AS pool_rate FROM a JOIN b USING (token2, sub) GROUP BY 1""")
def association_summary(t):
    a, b = _assoc(t)
    return association.summary(a, b, ["sub"], "token2")


@query("WIN-7 SEQ-6", f"WITH {_ASSOC} SELECT sub, y AS mge_assoc_b FROM b")
def association_by_order(t):
    return _assoc(t)[1].select("sub", F.col("mge_assoc_B").alias("mge_assoc_b"))


@query("STM-1", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t):
    from cyclora.streaming.events import windowed_counts

    w = windowed_counts(t.events, "ts", "event_type", "value")
    return w.select(F.unix_timestamp(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
