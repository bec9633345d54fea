"""Queries of graphs, covers, clusters and selections without overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclora.functions.numbers import geometric_sizes
from cyclora.operators import best, clustering, communities, cover, density, graph, searches
from cyclora.operators.ordering import running
from cyclora.plans.proxies import FEATURES, GRAPH, NEAR, ORDER, container_edges, features, token_edges
from cyclora.plans.registry import query
from cyclora.session import Rounds, durable


@query("GRF-1 GRF-2", f"""WITH {GRAPH}, b AS (SELECT src AS node, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge)
    SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree, round(sum(i + o) / ((SELECT count(DISTINCT node) FROM b) - 1), 6) AS centrality FROM b GROUP BY 1""")
def graph_degrees(t):
    return graph.degrees(token_edges(t))


@query("GRF-3", f"WITH {GRAPH} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edge WHERE src <> dst")
def graph_undirected(t):
    return graph.undirected(token_edges(t))


#: Customers in blocks of twenty; each order is an edge to the customer one or two places on, within the block.
_SPARSE = "sp AS (SELECT DISTINCT o_custkey AS src, o_custkey - o_custkey % 20 + (o_custkey + 1 + o_orderkey % 2) % 20 AS dst FROM orders)"


def _sparse(t):
    k = F.col("o_custkey")
    return t.orders.select(k.alias("src"), (k - k % 20 + (k + 1 + F.col("o_orderkey") % 2) % 20).alias("dst")).distinct()


_COMP = f"""{_SPARSE}, u AS (SELECT src AS a, dst AS b FROM sp UNION SELECT dst, src FROM sp), reach(node, other) AS (SELECT a, a FROM u UNION SELECT node, u.b FROM reach JOIN u ON u.a = other),
    comp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""


@query("GRF-4", f"WITH RECURSIVE {_COMP} SELECT * FROM comp")
def graph_components(t):
    return graph.components(_sparse(t))


@query("GRF-4 GRF-9", f"""WITH RECURSIVE {_COMP}, big AS (SELECT component, count(*) AS k FROM comp GROUP BY 1 ORDER BY k DESC, component LIMIT 1), ln AS (SELECT node FROM comp JOIN big USING (component))
    SELECT sp.* FROM sp WHERE src IN (SELECT node FROM ln) AND dst IN (SELECT node FROM ln)""")
def graph_largest_component(t):
    e = _sparse(t)
    return graph.induced(e, graph.largest_component(e)[0])


@query("GRF-11", f"""WITH {GRAPH}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edge WHERE src <> dst), v AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
    d AS (SELECT a AS node, count(*) AS degree FROM v GROUP BY 1), tr AS (SELECT x.a AS node, count(*) AS n FROM v x JOIN v y ON x.a = y.a AND x.b < y.b JOIN u ON u.a = x.b AND u.b = y.b GROUP BY 1)
    SELECT node, degree, coalesce(n, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS coefficient FROM d LEFT JOIN tr USING (node)""")
def graph_clustering(t):
    return graph.clustering(token_edges(t))


@query("GRF-5", f"""WITH RECURSIVE {_SPARSE}, u AS (SELECT src AS a, dst AS b FROM sp WHERE src <> dst UNION SELECT dst, src FROM sp WHERE src <> dst), nd AS (SELECT src AS v FROM sp UNION SELECT dst FROM sp),
    walk(s, v, d, n) AS (SELECT v, v, 0, CAST(1 AS DOUBLE) FROM nd UNION ALL SELECT s, b, d + 1, sum(n) FROM walk JOIN u ON a = v WHERE d < 20 GROUP BY s, b, d + 1),
    far AS (SELECT s, v, min(d) AS d, arg_min(n, d) AS n FROM walk GROUP BY s, v),
    part AS (SELECT x.v AS node, sum(x.n * y.n / z.n) AS dep FROM far x JOIN far y ON y.s = x.v JOIN far z ON z.s = x.s AND z.v = y.v WHERE x.d + y.d = z.d AND x.v <> x.s AND x.v <> y.v GROUP BY 1)
    SELECT v AS node, round(coalesce(dep, 0) / ((SELECT count(*) FROM nd) - 1) / ((SELECT count(*) FROM nd) - 2), 6) AS betweenness FROM nd LEFT JOIN part ON node = v""")
def graph_betweenness(t):
    return searches.betweenness(_sparse(t))


@query("GRF-7", f"""WITH RECURSIVE {GRAPH}, u AS (SELECT src AS a, dst AS b FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst), walk(s, node, d) AS (SELECT DISTINCT a, a, 0 FROM u UNION SELECT s, u.b, d + 1 FROM walk JOIN u ON u.a = node WHERE d < 14),
    far AS (SELECT s, node, min(d) AS d FROM walk GROUP BY ALL) SELECT s AS node, round((count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(DISTINCT a) FROM u) - 1), 6) AS closeness FROM far GROUP BY 1""")
def graph_closeness(t):
    return searches.closeness(token_edges(t))


@query("GRF-6", f"""WITH RECURSIVE {GRAPH}, u AS (SELECT src AS a, dst AS b FROM edge WHERE src <> dst UNION SELECT dst, src FROM edge WHERE src <> dst), nd AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge), k AS (SELECT count(*) AS n FROM nd),
    p(i, node, x, moved) AS (SELECT 0, node, CAST(1 AS DOUBLE) / n, CAST(1e9 AS DOUBLE) FROM nd, k UNION ALL
        SELECT i, node, y, sum(abs(y - x)) OVER () FROM (SELECT i, node, x, v / sqrt(sum(v * v) OVER ()) AS y FROM (SELECT i + 1 AS i, node, sum(own) AS x, sum(v) AS v FROM
            (SELECT i, node, x AS own, x AS v FROM p, k WHERE moved >= n * 1e-6 AND i < 1000 UNION ALL SELECT i, b, 0, x FROM p JOIN u ON a = node, k WHERE moved >= n * 1e-6 AND i < 1000) GROUP BY ALL)))
    SELECT node, round(x, 4) AS eigenvector FROM p WHERE i = (SELECT max(i) FROM p)""")
def graph_eigenvector(t):
    return graph.eigenvector(token_edges(t))


@query("GRF-8", f"""WITH RECURSIVE {GRAPH}, nd AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge), k AS (SELECT count(*) AS n FROM nd),
    p(i, node, x, moved) AS (SELECT 0, node, CAST(1 AS DOUBLE) / n, CAST(1e9 AS DOUBLE) FROM nd, k UNION ALL
        SELECT i, node, y, sum(abs(y - x)) OVER () FROM (SELECT i, node, x, v / sum(v) OVER () AS y FROM (SELECT i, node, sum(own) AS x, sum(v) AS v FROM
            (SELECT i + 1 AS i, node, x AS own, 0 AS v FROM p, k WHERE moved >= n * 1e-8 AND i < 100
             UNION ALL SELECT i + 1, e.src, 0, s FROM (SELECT i, dst, sum(x) AS s FROM p JOIN edge ON src = node, k WHERE moved >= n * 1e-8 AND i < 100 GROUP BY ALL) a JOIN edge e ON e.dst = a.dst) GROUP BY ALL))),
    hub AS (SELECT node, x FROM p WHERE i = (SELECT max(i) FROM p)), au AS (SELECT dst AS node, sum(x) AS s FROM hub JOIN edge ON src = node GROUP BY 1)
    SELECT node, round(x, 6) AS hub, round(coalesce(s, 0) / (SELECT sum(s) FROM au), 6) AS authority FROM hub LEFT JOIN au USING (node)""")
def graph_hits(t):
    return graph.hits(token_edges(t))


@query("GRF-12 GRF-13 GRF-14")
def graph_small_world(t):
    """Against a hundred null graphs, a task each as long as they are small. Tokens go by number."""
    rounds, named = Rounds(t.spark), durable(token_edges(t))
    ids = searches.numbered(named)
    src, dst = (ids.select(F.col("node").alias(x), F.col("id").alias(f"_{x}")) for x in ("src", "dst"))
    e = rounds.write(named.join(src, "src").join(dst, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    own = searches.figures(e, []).first()
    c, length = (own["clustering"], own["path_length"]) if own else (None, None)
    null = rounds.write(graph.configuration_null(e, 100))
    cn, ln = searches.figures(null, ["rep"]).agg(F.avg("clustering"), F.avg("path_length")).first()
    lattice = graph.lattice_clustering(graph.nodes_of(e).count(), graph.undirected(e).count())
    s = graph.small_world(c or 0.0, length or 0.0, cn or 0.0, ln or 0.0, lattice)
    return rounds.done(t.spark.createDataFrame([(c, length, s["sigma"], s["omega"])], "clustering double, path_length double, sigma double, omega double"))


_CHAIN = "ch AS (SELECT DISTINCT o_custkey AS src, o_custkey + CASE WHEN o_custkey % 9 = 0 THEN 2 ELSE 1 END AS dst FROM orders)"


def _chain(t):
    step = F.when(F.col("o_custkey") % 9 == 0, 2).otherwise(1)
    return t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + step).alias("dst")).distinct()


@query("GRF-15", f"""WITH RECURSIVE {_CHAIN}, s AS (SELECT dst AS node FROM ch WHERE dst IN (SELECT src FROM ch GROUP BY 1 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 1),
    p(start, node, n) AS (SELECT src, dst, 2 FROM ch WHERE src NOT IN (SELECT node FROM s) AND dst IN (SELECT node FROM s) UNION ALL SELECT start, ch.dst, n + 1 FROM p JOIN ch ON ch.src = p.node WHERE p.node IN (SELECT node FROM s))
    SELECT start, node AS stop, CAST(n AS BIGINT) AS n_nodes FROM p WHERE node NOT IN (SELECT node FROM s)""")
def graph_unbranching_paths(t):
    return graph.unbranching_paths(_chain(t)).select("start", "stop", "n_nodes")


@query("GRF-16", f"""WITH RECURSIVE {_CHAIN}, s AS (SELECT dst AS node FROM ch WHERE dst IN (SELECT src FROM ch GROUP BY 1 HAVING count(*) = 1) GROUP BY 1 HAVING count(*) = 1),
    p(start, node, n) AS (SELECT src, dst, 2 FROM ch WHERE src NOT IN (SELECT node FROM s) AND dst IN (SELECT node FROM s) UNION ALL SELECT start, ch.dst, n + 1 FROM p JOIN ch ON ch.src = p.node WHERE p.node IN (SELECT node FROM s)),
    q AS (SELECT n FROM p WHERE node NOT IN (SELECT node FROM s)), nd AS (SELECT src AS v FROM ch UNION SELECT dst FROM ch)
    SELECT count(*) AS n_paths, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 6) AS mean_length, round(coalesce(sum(n - 2), 0) / (SELECT count(*) FROM nd), 6) AS coverage FROM q""")
def graph_path_stats(t):
    e = _chain(t)
    return graph.path_stats(graph.unbranching_paths(e), graph.nodes_of(e).count())


@query("GRF-17 GRF-20")
def graph_configuration_null(t):
    stats = graph.graph_stats(graph.configuration_null(token_edges(t), 100), ["rep"])
    return graph.null_summary(stats, ["node_number", "edge_number", "average_degree"])


@query("GRF-18", f"WITH {GRAPH} SELECT r.rep, (SELECT count(*) FROM edge) AS edge_number, CAST(0 AS BIGINT) AS loops FROM range(0, 50) r(rep)")
def graph_gnm_null(t):
    """What every replicate keeps: the number of edges, all different, and no self-loops."""
    null = graph.gnm_null(token_edges(t), 50)
    return null.groupBy("rep").agg(F.count_distinct("src", "dst").alias("edge_number"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))


@query("GRF-19", f"""WITH {GRAPH}, b AS (SELECT src AS v FROM edge UNION ALL SELECT dst FROM edge), d AS (SELECT v, count(*) AS k FROM b GROUP BY 1), n AS (SELECT count(*) AS n, sum(greatest(0, k - 2)) // 2 AS chords FROM d)
    SELECT r.rep, CAST(n AS BIGINT) AS node_number, CAST(n + least(chords, n * (n - 2)) AS BIGINT) AS edge_number, round(2 * (n + least(chords, n * (n - 2))) / n, 6) AS average_degree FROM range(0, 50) r(rep), n""")
def graph_recombination_null(t):
    return graph.graph_stats(graph.recombination_null(token_edges(t), 50), ["rep"])


@query("GRF-21 AGG-3", f"""WITH {NEAR}, ed AS (SELECT DISTINCT CAST(size AS BIGINT) AS size, token2 AS src, right2 AS dst FROM nb JOIN (VALUES (5), (25), (150)) s(size) ON container <= size),
    nd AS (SELECT size, src AS node FROM ed UNION SELECT size, dst FROM ed) SELECT size, n AS node_number, e AS edge_number, round(2 * e / n, 6) AS average_degree FROM (SELECT size, count(*) AS n FROM nd GROUP BY 1) JOIN (SELECT size, count(*) AS e FROM ed GROUP BY 1) USING (size)""")
def graph_stats_by_batch(t):
    from cyclora.operators.circular import circular_neighbours

    near = circular_neighbours(features(t), "container", ORDER, ["token2"])
    sizes = F.explode(F.filter(F.array(*[F.lit(s).cast("long") for s in (5, 25, 150)]), lambda s: s >= F.col("container")))
    e = near.select(sizes.alias("size"), F.col("token2").alias("src"), F.col("right_token2").alias("dst")).distinct()
    return graph.graph_stats(e, ["size"])


@query("GRF-21 AGG-3 WIN-18", """WITH x AS (SELECT user_id AS container, event_type || json_extract_string(props, '$.k') AS token3, ts, event_id FROM events),
    ed AS (SELECT DISTINCT container, token3 AS src, coalesce(lead(token3) OVER w, first_value(token3) OVER w) AS dst FROM x WINDOW w AS (PARTITION BY container ORDER BY ts, event_id)),
    c AS (SELECT DISTINCT container FROM x), pl AS (SELECT run, container, row_number() OVER (PARTITION BY run ORDER BY (container * 7919 + run * 104729) % 15013, container) AS place FROM c, range(0, 10) r(run)),
    sz AS (SELECT DISTINCT CAST(floor(round(pow(n, i / 99.0), 9)) AS BIGINT) AS size FROM (SELECT count(*) AS n FROM c), range(0, 100) k(i)),
    e AS (SELECT run, src, dst, min(place) AS place FROM ed JOIN pl USING (container) GROUP BY ALL), nd AS (SELECT run, node, min(place) AS place FROM (SELECT run, src AS node, place FROM e UNION ALL SELECT run, dst, place FROM e) GROUP BY ALL),
    ec AS (SELECT run, size, count(*) AS en FROM e JOIN sz ON place <= size GROUP BY ALL), nc AS (SELECT run, size, count(*) AS nn FROM nd JOIN sz ON place <= size GROUP BY ALL)
    SELECT size, round(avg(nn), 6) AS node_number_mean, round(avg(en), 6) AS edge_number_mean, round(avg(2 * en / nn), 6) AS average_degree_mean, round(stddev_samp(en), 6) AS edge_number_std FROM ec JOIN nc USING (run, size) GROUP BY 1""")
def graph_stats_over_runs(t):
    """Means over ten orders of the containers, for a hundred geometric sizes."""
    e = durable(container_edges(t).distinct())
    sizes = geometric_sizes(e.select("container").distinct().count(), 100)
    draw = (F.col("container") * 7919 + F.col("run") * 104729) % 15013
    s = graph.stats_by_batch(e, "container", durable(graph.shuffles(e, "container", 10, draw=draw)), sizes)
    means = [F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("node_number", "edge_number", "average_degree")]
    return s.groupBy("size").agg(*means, F.round(F.stddev_samp("edge_number"), 6).alias("edge_number_std"))


@query("GRF-22", f"""WITH {GRAPH}, b AS (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge), d AS (SELECT node, count(*) AS degree FROM b GROUP BY 1), q AS (SELECT quantile_cont(degree, 0.99) + 2 AS lim FROM d)
    SELECT CAST(least(degree, floor(lim)) AS BIGINT) AS bin, count(*) AS n FROM d, q GROUP BY 1""")
def graph_degree_histogram(t):
    from cyclora.operators.ordering import percentiles

    d = graph.degrees(token_edges(t))
    limit = percentiles(d, "degree", [0.99])[0] + 2
    return d.groupBy(F.least(F.col("degree"), F.floor(F.lit(limit))).alias("bin")).agg(F.count("*").alias("n"))


@query("GRF-24", f"WITH {GRAPH} SELECT regexp_replace(src, '[0-9]+$', '') AS a, regexp_replace(dst, '[0-9]+$', '') AS b, count(*) AS weight FROM edge GROUP BY ALL")
def class_weights(t):
    of = lambda c: F.regexp_replace(c, "[0-9]+$", "")
    return token_edges(t).groupBy(of("src").alias("a"), of("dst").alias("b")).agg(F.count("*").alias("weight"))


@query("CLU-4 CLU-5")
def graph_communities(t):
    e = _sparse(t)
    return graph.modularity(e, communities.communities(e))


# --- covers and candidates -------------------------------------------------------------------------------------------


def _members(t):
    return t.lineitem.select("l_suppkey", "l_partkey").distinct()


def _cover_sql(members: str) -> str:
    """Greedy covers as recursion over bit strings; members: (scope, l_suppkey, l_partkey), parts below 200,000."""
    return f"""WITH RECURSIVE m AS (SELECT DISTINCT * FROM ({members})), s AS (SELECT scope, l_suppkey, count(*) AS n, bitstring_agg(l_partkey, 0, 199999) AS b FROM m GROUP BY ALL),
    g(scope, step, l_suppkey, gain, cov) AS (SELECT DISTINCT scope, 0, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), bitstring('0', 200000) FROM s UNION ALL
        SELECT scope, step, l_suppkey, gain, cov FROM (SELECT s.scope, step + 1 AS step, s.l_suppkey, CAST(bit_count(b & ~cov) AS BIGINT) AS gain, cov | b AS cov, n FROM g JOIN s ON s.scope = g.scope WHERE bit_count(b & ~cov) > 0)
        QUALIFY row_number() OVER (PARTITION BY scope ORDER BY gain DESC, n DESC, l_suppkey) = 1)"""


_BY_BRAND = "SELECT p_brand AS scope, l_suppkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'all', l_suppkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IS NOT NULL"


def _by_brand(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("scope"), "l_suppkey", "l_partkey")


@query("SEQ-15", f"{_cover_sql(_BY_BRAND)} SELECT scope, step, l_suppkey, gain FROM g WHERE step > 0")
def cover_by_scope(t):
    return cover.cover_by_scope(_by_brand(t), "scope", "l_suppkey", "l_partkey")


@query("SEQ-15", f"""{_cover_sql(_BY_BRAND)}, c AS (SELECT * FROM g WHERE step > 0), have AS (SELECT scope, count(DISTINCT l_partkey) AS n_elements, count(DISTINCT l_suppkey) AS n_sets FROM m GROUP BY 1)
    SELECT scope, any_value(n_elements) AS n_elements, any_value(n_sets) AS n_sets, count(*) AS n_picked, round(max(gain) / any_value(n_elements), 6) AS first_share, CAST(count_if(l_suppkey IN (SELECT l_suppkey FROM c WHERE scope = 'all')) AS BIGINT) AS in_whole FROM c JOIN have USING (scope) GROUP BY 1""")
def cross_scope_summary(t):
    m = durable(_by_brand(t).distinct())
    return cover.cross_scope_summary(m, cover.cover_by_scope(m, "scope", "l_suppkey", "l_partkey"), "scope", "l_suppkey", "l_partkey")


@query("SEQ-12", f"{_cover_sql("SELECT 'all' AS scope, l_suppkey, l_partkey FROM lineitem")} SELECT step, l_suppkey, gain FROM g WHERE step > 0")
def greedy_cover(t):
    return cover.greedy_cover(_members(t), "l_suppkey", "l_partkey")


_RANKS = "(SELECT l_suppkey, row_number() OVER (ORDER BY count(DISTINCT l_partkey) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1)"


@query("WIN-16", f"""WITH r AS {_RANKS}, f AS (SELECT l_partkey, min(rank) AS rank FROM lineitem JOIN r USING (l_suppkey) GROUP BY 1), n AS (SELECT rank, count(*) AS n FROM f GROUP BY 1)
    SELECT rank, coalesce(n, 0) AS new, CAST(sum(coalesce(n, 0)) OVER (ORDER BY rank) AS BIGINT) AS covered FROM r LEFT JOIN n USING (rank)""")
def coverage_curve(t):
    m = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    sized = cover.set_table(m, "l_suppkey", "l_partkey")
    ranks = running(sized, [F.desc("n"), F.asc("l_suppkey")], {"rank": F.lit(1)}).select("l_suppkey", "rank")
    return cover.coverage_curve(m, ranks, "l_suppkey", "l_partkey", "rank")


#: Sets taken away because they were picked, and sets never there, leave the same covers.
@query("SEQ-13", f"{_cover_sql("SELECT 'all' AS scope, l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 10 <> 0")} SELECT step, l_suppkey, gain FROM g WHERE step > 0")
def cover_fixpoint(t):
    c, _ = cover.cover_to_fixpoint(_members(t), "l_suppkey", "l_partkey", lambda x: x.filter("l_suppkey % 10 = 0"), by_key=True)
    return c


@query("SEQ-14 STM-2")
def cover_growth(t):
    m = _members(t).withColumn("grp", F.col("l_partkey") % 50)
    return cover.growth_simulation(m, "grp", "l_suppkey", "l_partkey", 10, list(range(1, 101)))


@query("SEQ-7", "SELECT c_nationkey, c_mktsegment, 'guide_' || lpad(CAST(row_number() OVER (ORDER BY c_nationkey, c_mktsegment) AS VARCHAR), 6, '0') AS key_id FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def numbered_keys(t):
    from cyclora.functions.sequence import numbered_keys as numbered

    return numbered(t.customer, ["c_nationkey", "c_mktsegment"], "guide_")


@query("SEQ-10 AGG-11", """SELECT p_partkey, coalesce(n_hits, 0) AS n_hits, coalesce(n_high, 0) AS n_high, coalesce(n_containers, 0) AS n_containers, coalesce(min_mismatch, 999) AS min_mismatch, worst, coalesce(n_high, 0) = 0 AS is_clean FROM part LEFT JOIN
    (SELECT l_partkey AS p_partkey, count(*) AS n_hits, count_if(l_linenumber < 2) AS n_high, count(DISTINCT l_suppkey) AS n_containers, min(l_linenumber) AS min_mismatch, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS worst FROM lineitem WHERE l_quantity >= 48 GROUP BY 1) USING (p_partkey)""")
def off_target_summary(t):
    hits = t.lineitem.filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("mm"), "l_suppkey")
    return cover.off_target_summary(t.part.select("p_partkey"), hits, "p_partkey", "mm", "l_suppkey")


@query("SEQ-11", """SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey) = 1""")
def lost_elements(t):
    x = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity")
    return cover.lost_elements(x, x.filter("l_quantity >= 45"), "l_partkey", [F.desc("l_quantity"), F.asc("l_suppkey")])


@query("AGG-14", f"""WITH RECURSIVE {FEATURES}, r AS (SELECT container, sub, start, stop, value, row_number() OVER (PARTITION BY container ORDER BY value DESC, sub) AS rn FROM f),
    g(container, rn, kept, taken) AS (SELECT DISTINCT container, CAST(0 AS BIGINT), false, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) FROM r UNION ALL
        SELECT container, rn, free, CASE WHEN free THEN list_append(taken, {{'a': start, 'b': stop}}) ELSE taken END FROM
            (SELECT r.container, r.rn, r.start, r.stop, g.taken, len(list_filter(g.taken, lambda x: x.a <= r.stop AND x.b >= r.start)) = 0 AS free FROM g JOIN r ON r.container = g.container AND r.rn = g.rn + 1))
    SELECT r.container, sub, start, stop, value FROM g JOIN r USING (container, rn) WHERE kept""")
def non_overlapping_hits(t):
    f = features(t).select("container", "sub", "start", "stop", "value")
    return best.non_overlapping(f, "container", "start", "stop", "value", ["sub"])


@query("AGG-14")
def non_overlapping_hits_exact(t):
    f = features(t).select("container", "sub", "start", "stop", "value")
    return best.non_overlapping(f, "container", "start", "stop", "value", ["sub"], exact=True)


@query("SEQ-2 SEQ-9", """SELECT p_partkey, coalesce(o.shift, d.shift) AS shift, regexp_matches(p_type, d.pattern) AS fits FROM part JOIN (VALUES ('Brand#11', 1, 'PROMO'), ('Brand#12', 2, 'ECON|SMALL')) d(brand, shift, pattern) ON brand = p_brand
    LEFT JOIN (VALUES ('Brand#11', 10, 7)) o(brand, size, shift) ON o.brand = p_brand AND o.size = p_size""")
def context_adjusted_window(t):
    d = t.spark.createDataFrame([("Brand#11", 1, "PROMO"), ("Brand#12", 2, "ECON|SMALL")], "p_brand string, base int, pattern string")
    o = t.spark.createDataFrame([("Brand#11", 10, 7)], "p_brand string, p_size int, shift int")
    x = t.part.join(F.broadcast(d), "p_brand").join(F.broadcast(o), ["p_brand", "p_size"], "left")
    return x.select("p_partkey", F.coalesce("shift", "base").alias("shift"), F.regexp_like("p_type", F.col("pattern")).alias("fits"))


# --- clusters --------------------------------------------------------------------------------------------------------

_SETS = "m AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS t FROM lineitem)"


@query("CLU-1", f"""WITH {_SETS}, n AS (SELECT c, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM m a JOIN m b USING (t) WHERE a.c < b.c GROUP BY ALL)
    SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM p JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE k / (x.n + y.n - k) >= 0.5""")
def jaccard_pairs(t):
    m = t.lineitem.select("l_orderkey", "l_suppkey")
    return clustering.jaccard_pairs(m, "l_orderkey", "l_suppkey", 0.5)


@query("CLU-2", f"""WITH RECURSIVE {_SETS}, n AS (SELECT c, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM m a JOIN m b USING (t) WHERE a.c < b.c GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE k / (x.n + y.n - k) >= 0.5), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    lab(i, node, low, moved) AS (SELECT 0, a, a, true FROM (SELECT DISTINCT a FROM u) UNION ALL
        SELECT i, node, new, bool_or(new < low) OVER () FROM (SELECT i, node, max(own) AS low, min(l) AS new FROM
            (SELECT i + 1 AS i, node, low AS own, low AS l FROM lab WHERE moved UNION ALL SELECT i + 1, b, NULL, low FROM lab JOIN u ON a = node WHERE moved) GROUP BY ALL)),
    comp AS (SELECT node, low FROM lab WHERE i = (SELECT max(i) FROM lab)), big AS (SELECT low, row_number() OVER (ORDER BY count(*) DESC, low) - 1 AS cluster FROM comp GROUP BY 1 HAVING count(*) >= 3)
    SELECT l_orderkey, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN comp ON node = l_orderkey LEFT JOIN big USING (low)""")
def threshold_clusters(t):
    m = t.lineitem.select("l_orderkey", "l_suppkey")
    return clustering.threshold_clusters(m, "l_orderkey", "l_suppkey", 0.5, 3)


_REACH = f"""{_SETS}, n AS (SELECT c, count(*) AS n FROM m GROUP BY 1), j AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM m a JOIN m b USING (t) WHERE a.c < b.c GROUP BY ALL),
    p AS (SELECT a, b, round(1 - round(k / (x.n + y.n - k), 6), 6) AS d FROM j JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE k / (x.n + y.n - k) >= 0.5),
    u AS (SELECT a AS v, b AS o, d FROM p UNION ALL SELECT b, a, d FROM p), core AS (SELECT v, max(d) AS core FROM (SELECT v, d, row_number() OVER (PARTITION BY v ORDER BY d, o) AS r FROM u) WHERE r <= 3 GROUP BY 1 HAVING count(*) = 3),
    e AS (SELECT a, b, greatest(d, x.core, y.core) AS w FROM p JOIN core x ON x.v = a JOIN core y ON y.v = b)"""


def _far(t):
    """Pairs of different sets, and the orders of each set."""
    of, links = clustering.jaccard_classes(t.lineitem.select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", 0.5)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(1 - F.col("jaccard"), 6).alias("d")), of


@query("CLU-2", f"""WITH RECURSIVE {_REACH}, lv AS (SELECT DISTINCT w AS lvl FROM e), nd AS (SELECT a AS v FROM e UNION SELECT b FROM e), f AS (SELECT lvl, a, b FROM lv JOIN e ON w <= lvl UNION ALL SELECT lvl, b, a FROM lv JOIN e ON w <= lvl),
    lab(i, lvl, node, low, moved) AS (SELECT 0, lvl, v, v, true FROM lv, nd UNION ALL
        SELECT i, lvl, node, new, bool_or(new < low) OVER () FROM (SELECT i, lvl, node, max(own) AS low, min(l) AS new FROM
            (SELECT i + 1 AS i, lvl, node, low AS own, low AS l FROM lab WHERE moved UNION ALL SELECT i + 1, f.lvl, b, NULL, low FROM lab JOIN f ON f.lvl = lab.lvl AND a = node WHERE moved) GROUP BY ALL)),
    k AS (SELECT lvl, count(DISTINCT low) AS k FROM lab WHERE i = (SELECT max(i) FROM lab) GROUP BY 1), s AS (SELECT lvl, coalesce(lag(k) OVER (ORDER BY lvl), (SELECT count(*) FROM nd)) - k AS joined FROM k)
    SELECT CAST(sum(joined) AS BIGINT) AS n_edges, round(sum(lvl * joined), 4) AS weight FROM s""")
def spanning_forest(t):
    """As many edges of a weight as there are fewer components when it is let in."""
    pairs, copies = _far(t)
    forest = density.spanning_forest(density.mutual_reachability(pairs, 3, copies))
    return forest.agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 4).alias("weight"))


@query("CLU-2")
def density_clusters(t):
    pairs, copies = _far(t)
    return density.density_clusters(pairs, 3, 5, copies).withColumnRenamed("node", "l_orderkey")


@query("CLU-3", """WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_nationkey * 7.0 - 90 AS la, s_suppkey * 3.6 - 180 AS lo FROM supplier),
    d AS (SELECT a.id AS i, b.id AS j FROM p a, p b WHERE 2 * 6371 * asin(sqrt(least(1, pow(sin((radians(b.la) - radians(a.la)) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 1500),
    c AS (SELECT i FROM d GROUP BY 1 HAVING count(*) >= 5), u AS (SELECT i, j FROM d WHERE i IN (SELECT i FROM c) AND j IN (SELECT i FROM c)),
    reach(i, j) AS (SELECT i, i FROM c UNION SELECT reach.i, u.j FROM reach JOIN u ON u.i = reach.j), k AS (SELECT i, min(j) AS comp FROM reach GROUP BY 1),
    e AS (SELECT d.i, min(comp) AS comp FROM d JOIN k ON k.i = d.j GROUP BY 1)
    SELECT p.id AS s_suppkey, coalesce(k.comp, e.comp, -1) AS cluster FROM p LEFT JOIN k ON k.i = p.id LEFT JOIN e ON e.i = p.id""")
def dbscan_sphere(t):
    p = t.supplier.select("s_suppkey", (F.col("s_nationkey") * 7.0 - 90).alias("la"), (F.col("s_suppkey") * 3.6 - 180).alias("lo"))
    return clustering.dbscan_sphere(p, "s_suppkey", "la", "lo", 1500.0, 5)

