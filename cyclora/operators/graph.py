"""Graphs as edge tables: degrees, components, centralities, clustering, paths, null models, communities.

All are joins and aggregates over edge tables of any size; searches from many sources are in `searches.py`, communities in
`communities.py`. Null models draw on hashes of (seed, replicate, edge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.operators.ordering import running
from cyclora.session import durable


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree, centrality) over different (src, dst); a self-loop counts in both."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    n = d.agg(F.count("*").alias("_n"))
    share = F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0)
    return d.join(F.broadcast(n)).withColumn("centrality", F.round(share, 6)).drop("_n")


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) with src < dst, each pair once, no self-loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src != dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component. Large and small stars in turn, with a checkpoint each
    round; only minima are grouped, so hubs are no burden. Lone self-loops are components of themselves."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
            out = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            least = pairs.groupBy("src").agg(F.min("dst").alias("m"))
            out = pairs.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
        return out.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src != dst").distinct()

    now = durable(undirected(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if told == seen:
            break
        seen, now = told, durable(star(star(now, True), False))
    return nodes_of(edges).join(now.withColumnsRenamed({"src": "node", "dst": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(edges: DataFrame) -> tuple[DataFrame, float]:
    """(nodes, share of all nodes) of the largest component; of equally large ones that with the smallest node."""
    c = durable(components(edges))
    n = c.count()
    best = c.groupBy("component").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "component").first()
    if best is None:
        return c.select("node"), 0.0
    return c.filter(F.col("component") == F.lit(best["component"])).select("node"), best["k"] / n


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(edges.columns)


def clustering(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, degree, triangles, coefficient) of the undirected graphs that the keys tell apart. Each triangle is found
    once, from its node of least degree, so hubs do not pair up all their neighbours."""
    keys = keys or []
    lower, upper = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    e = durable(edges.select(*keys, lower, upper).filter("src != dst").distinct())
    ends = e.select(*keys, "src", "dst").unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    deg = durable(ends.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    d1, d2 = deg.withColumnsRenamed({"node": "src", "degree": "da"}), deg.withColumnsRenamed({"node": "dst", "degree": "db"})
    x = e.join(d1, [*keys, "src"]).join(d2, [*keys, "dst"])
    low = F.when(F.struct("da", "src") < F.struct("db", "dst"), F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))).otherwise(F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    up = durable(x.select(*keys, low.alias("p")).select(*keys, "p.a", "p.b"))
    wedge = up.join(up.withColumnRenamed("b", "c"), [*keys, "a"]).filter("b < c")
    tri = wedge.join(e.withColumnsRenamed({"src": "b", "dst": "c"}), [*keys, "b", "c"])
    t = tri.select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("triangles"))
    k = F.col("degree")
    return deg.join(t, [*keys, "node"], "left").select(
        *keys, "node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.round(F.when(k > 1, 2 * F.coalesce("triangles", F.lit(0)) / (k * (k - 1))).otherwise(0.0), 6).alias("coefficient")
    )


def _power(edges: DataFrame, step, start: DataFrame, rounds: int, tolerance: float) -> tuple[DataFrame, bool]:
    """Repeats x -> step(x), each round written, until no node moves on average by more than the tolerance; and whether that
    came about within the rounds."""
    x, n = durable(start), start.count()
    for _ in range(rounds):
        new = durable(step(x))
        moved = new.join(x.withColumnsRenamed({"value": "old"}), "node").agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        x = new
        if moved < n * tolerance:
            return x, True
    return x, n == 0


def _scaled(sums: DataFrame, norm: str) -> DataFrame:
    whole = sums.agg((F.sqrt(F.sum(F.col("value") * F.col("value"))) if norm == "length" else F.sum("value")).alias("_s"))
    return sums.join(F.broadcast(whole)).select("node", F.when(F.col("_s") > 0, F.col("value") / F.col("_s")).otherwise(0.0).alias("value"))


def eigenvector(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(node, eigenvector) of the undirected graph by power iteration on A + I; if it does not settle within the rounds, each
    node's degree over the largest one."""
    e = undirected(edges)
    both = durable(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    nodes = nodes_of(edges)
    n = nodes.count()

    def step(x: DataFrame) -> DataFrame:
        sent = both.join(x, F.col("src") == x.node).select(F.col("dst").alias("node"), "value")
        return _scaled(sent.unionByName(x).groupBy("node").agg(F.sum("value").alias("value")), "length")

    x, settled = _power(edges, step, nodes.withColumn("value", F.lit(1.0 / max(1, n))), rounds, tolerance)
    if not settled:
        degree = nodes.join(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "node", "left").withColumn("d", F.coalesce("d", F.lit(0)))
        most = degree.agg(F.greatest(F.max("d"), F.lit(1)).alias("most"))
        x = degree.join(F.broadcast(most)).select("node", (F.col("d") / F.col("most")).alias("value"))  # one row
    return x.select("node", F.round("value", 4).alias("eigenvector"))


def hits(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """(node, hub, authority), each summing to 1; 0 for nodes without edges of that kind."""
    e = durable(edges.select("src", "dst").distinct())
    nodes = nodes_of(e)
    n = max(1, nodes.count())

    def authority(hub: DataFrame) -> DataFrame:
        return e.join(hub, e.src == hub.node).groupBy(F.col("dst").alias("node")).agg(F.sum("value").alias("value"))

    def step(hub: DataFrame) -> DataFrame:
        a = authority(hub)
        h = e.join(a, e.dst == a.node).groupBy(F.col("src").alias("node")).agg(F.sum("value").alias("value"))
        return _scaled(nodes.join(h, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("value")), "sum")

    hub, _ = _power(e, step, nodes.withColumn("value", F.lit(1.0 / n)), rounds, tolerance)
    a = _scaled(authority(hub), "sum").withColumnRenamed("value", "a")
    return hub.join(a, "node", "left").select("node", F.round("value", 6).alias("hub"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("authority"))


def _chains(e: DataFrame) -> DataFrame:
    """(node, head, at): for each node of one predecessor and one successor the first such node of its chain and its place behind
    that. Nodes jump over their predecessors with doubled reach, until none moves any more."""
    ins, outs = e.groupBy("dst").agg(F.count("*").alias("i")), e.groupBy("src").agg(F.count("*").alias("o"))
    simple = durable(ins.filter("i = 1").join(outs.filter("o = 1"), ins.dst == outs.src).select(F.col("src").alias("node")))
    # each simple node points to its predecessor if that is simple too; its head is the first of its chain
    back = e.join(simple, e.dst == simple.node).select(F.col("dst").alias("node"), F.col("src").alias("before"))
    inner = simple.withColumnRenamed("node", "before").withColumn("s", F.lit(True))
    chain = durable(back.join(inner, "before", "left").select("node", F.when(F.col("s"), F.col("before")).otherwise(F.col("node")).alias("head"), F.when(F.col("s"), 1).otherwise(0).cast("long").alias("at")))
    for _ in range(max(1, simple.count()).bit_length() + 1):  # a cycle never comes to rest
        to = chain.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("at").alias("_a"))
        jumped = durable(chain.join(to, "head").select("node", F.col("_h").alias("head"), (F.col("at") + F.col("_a")).alias("at"), (F.col("_a") > 0).alias("moved")))
        chain = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break
    # chains with a head of their own (a head whose place is 0) end in a node that is not simple or closes the chain
    return durable(chain.join(chain.filter("node = head and at = 0").select("head"), "head", "left_semi"))


def unbranching_paths(edges: DataFrame) -> DataFrame:
    """(start, head, stop, n_nodes): maximal paths whose inner nodes have one predecessor and one successor. They begin at nodes
    that are not so, and include the node at which they end; pure cycles are not reported. A path is one row however long it is;
    `path_nodes` has its nodes as rows."""
    e = durable(edges.select("src", "dst").distinct())
    last = _chains(e).groupBy("head").agg(F.max_by("node", "at").alias("end"), F.count("*").alias("_n"))
    start = e.withColumnsRenamed({"dst": "head", "src": "start"})
    stop = e.withColumnsRenamed({"src": "end", "dst": "stop"})
    return last.join(start, "head").join(stop, "end").select("start", "head", "stop", (F.col("_n") + 2).alias("n_nodes"))


def path_nodes(edges: DataFrame) -> DataFrame:
    """(head, at, node): the inner nodes of the paths of `unbranching_paths`, in order from 0."""
    return _chains(durable(edges.select("src", "dst").distinct())).select("head", "at", "node")


def path_stats(paths: DataFrame, n_nodes: int) -> DataFrame:
    inner = F.sum(F.col("n_nodes") - 2)
    return paths.agg(
        F.count("*").alias("n_paths"),
        F.max("n_nodes").alias("longest"),
        F.round(F.avg("n_nodes"), 6).alias("mean_length"),
        F.round(F.coalesce(inner, F.lit(0)) / max(1, n_nodes), 6).alias("coverage"),
    )


def graph_stats(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_number, edge_number, average_degree) of the graphs that the keys tell apart; 2e/n."""
    e = edges.groupBy(*keys).agg(F.count("*").alias("edge_number"))
    n = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy(*keys).agg(F.count("*").alias("node_number"))
    return n.join(e, keys).select(*keys, "node_number", "edge_number", F.round(2 * F.col("edge_number") / F.col("node_number"), 6).alias("average_degree"))


def shuffles(containers: DataFrame, container: str, runs: int, seed: int = 42, draw: Column | None = None) -> DataFrame:
    """(run, container, place): the containers in a random order for each run, places from 1. draw: what to order by
    (a column of `run` and the container) in place of a hash."""
    x = containers.select(container).distinct().withColumn("run", _replicates(runs))
    x = x.withColumn("_r", _random(seed, F.col("run"), F.col(container)) if draw is None else draw)
    placed = running(x, [F.asc(c) for c in ("run", "_r", container)], {"place": F.lit(1)})
    begin = placed.groupBy("run").agg(F.min("place").alias("_b"))
    return placed.join(F.broadcast(begin), "run").select("run", container, (F.col("place") - F.col("_b") + 1).alias("place"))  # a row a run


def stats_by_batch(edges: DataFrame, container: str, places: DataFrame, sizes: list[int]) -> DataFrame:
    """(run, size, node_number, edge_number, average_degree) of the graph of the first `size` containers in each run's order.
    edges: (container, src, dst). An edge or node counts from the first container that brings it, so it is met once a run
    and not once a size."""
    x = durable(edges.select(container, "src", "dst").distinct().join(places, container).groupBy("run", "src", "dst").agg(F.min("place").alias("place")))
    nodes = x.select("run", "place", F.explode(F.array("src", "dst")).alias("node")).groupBy("run", "node").agg(F.min("place").alias("place"))
    stops = F.array(*[F.lit(s).cast("long") for s in sizes])

    def counted(rows: DataFrame, name: str) -> DataFrame:
        first = F.get(F.filter(stops, lambda s: s >= F.col("place")), F.lit(0))
        return rows.groupBy("run", first.alias("size")).agg(F.count("*").alias(name))

    axis = places.select("run").distinct().withColumn("size", F.explode(stops))
    up_to = Window.partitionBy("run").orderBy("size")  # as many rows as sizes
    both = axis.join(counted(nodes, "n"), ["run", "size"], "left").join(counted(x, "e"), ["run", "size"], "left")
    grown = both.select("run", "size", *[F.coalesce(F.sum(c).over(up_to), F.lit(0)).alias(name) for c, name in (("n", "node_number"), ("e", "edge_number"))])
    return grown.withColumn("average_degree", F.when(F.col("node_number") > 0, 2 * F.col("edge_number") / F.col("node_number")).otherwise(0.0))


# --- null models ---------------------------------------------------------------------------------------------------


def _random(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def configuration_null(edges: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, src, dst): in and out degrees kept as stubs, matched at random; parallel edges collapse, self-loops go."""
    own = durable(running(edges.select("src", "dst").distinct(), [F.asc("src"), F.asc("dst")], {"p": F.lit(1).cast("long")}))
    e, m = own.withColumn("rep", _replicates(replicates)), own.count()
    # every replicate has as many stubs, so places in the order of all replicates pair stubs of the same one
    drawn = e.select("rep", _random(seed, F.col("rep"), F.col("src"), F.col("dst")).alias("_r"), "p", "dst")
    a = e.select((F.col("rep") * m + F.col("p")).alias("k"), "rep", "src")
    b = running(drawn, [F.asc(c) for c in ("rep", "_r", "p")], {"k": F.lit(1)}).select("k", "dst")
    # the planner takes the replicates for as small as the one graph they come from: it must not broadcast them
    return a.hint("merge").join(b.hint("merge"), "k").filter("src != dst").select("rep", "src", "dst").distinct()


def _numbered(edges: DataFrame) -> DataFrame:
    """(node, id): the nodes in order, from 0."""
    return durable(running(nodes_of(edges), [F.asc("node")], {"id": F.lit(1)}).withColumn("id", F.col("id") - 1))


def _named(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    a, b = ids.withColumnsRenamed({"id": "a", "node": "src"}), ids.withColumnsRenamed({"id": "b", "node": "dst"})
    return pairs.join(a, "a").join(b, "b").select("rep", "src", "dst")


def _random_pairs(spark, n: int, need: int, replicates: int, seed: int, avoid: Column | None = None, barred: int = 0) -> DataFrame:
    """(rep, a, b): so many different pairs of numbers below n that aren't equal, nor avoided, for each replicate: the first of
    a row of hashed draws, or where they are a good part of all pairs, the first of all pairs by a hash. barred: how many pairs are
    avoided. Draws are ranked over ranges of all replicates' draws."""
    free = n * (n - 1) - barred
    need = min(need, free)
    few = 4 * need < free
    k = spark.range(2 * need + 64 if few else n * n).withColumnRenamed("id", "k").withColumn("rep", _replicates(replicates))
    number = lambda s: F.pmod(_random(s, F.col("rep"), F.col("k")), F.lit(n))
    drawn = [number(seed), number(seed + 1), F.col("k")] if few else [F.floor(F.col("k") / n), F.col("k") % n, _random(seed, F.col("rep"), F.col("k"))]
    pairs = k.select("rep", *[c.alias(x) for c, x in zip(drawn, ("a", "b", "k"), strict=True)]).filter("a != b")
    pairs = pairs if avoid is None else pairs.filter(~avoid)
    pairs = pairs.groupBy("rep", "a", "b").agg(F.min("k").alias("k")) if few else pairs
    first = running(pairs, [F.asc(c) for c in ("rep", "k", "a", "b")], {"place": F.lit(1)})
    begin = first.groupBy("rep").agg(F.min("place").alias("begin"))
    return first.join(F.broadcast(begin), "rep").filter(F.col("place") - F.col("begin") < need).select("rep", "a", "b")  # a row a replicate


def gnm_null(edges: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, src, dst): graphs of the same nodes and number of edges, without self-loops, all equally likely."""
    own = durable(edges.select("src", "dst").distinct())
    ids = _numbered(own)
    n, m = ids.count(), own.count()
    return _named(_random_pairs(edges.sparkSession, max(1, n), m if n > 1 else 0, replicates, seed), ids)


def recombination_null(edges: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(rep, src, dst): a ring through all nodes, and random chords beside it: each takes two of the budget, which is what
    the nodes' degrees have beyond the ring's two, summed up."""
    spark, ids = edges.sparkSession, _numbered(edges)
    n = ids.count()
    spare = degrees(edges).agg(F.sum(F.greatest(F.lit(0), F.col("degree") - 2))).first()[0] or 0
    after = F.pmod(F.col("a") + 1, F.lit(max(1, n)))
    ring = ids.filter(F.lit(n > 1)).select(F.col("id").alias("a")).withColumn("b", after).withColumn("rep", _replicates(replicates))
    chords = _random_pairs(spark, max(1, n), int(spare) // 2 if n > 1 else 0, replicates, seed, F.col("b") == after, n)
    return _named(ring.select("rep", "a", "b").unionByName(chords), ids)


def null_summary(stats: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation over replicates."""
    return stats.agg(*[x for c in columns for x in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))])


def lattice_clustering(n: int, m: int) -> float:
    """The clustering coefficient of a ring lattice of n nodes and about m edges: 3(k-2) / 4(k-1) for k neighbours."""
    k = max(2, round(m / n)) if n else 2
    k += k % 2
    return 3 * (k - 2) / (4 * (k - 1))


def small_world(c: float, length: float, c_null: float, length_null: float, c_lattice: float) -> dict[str, float | None]:
    sigma = (c / c_null) / (length / length_null) if c_null > 0 and length_null > 0 and length > 0 else None
    omega = length_null / length - c / c_lattice if length > 0 and c_lattice > 0 else None
    return {"sigma": sigma, "omega": omega}


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(communities, modularity, largest_share, median_size) of a division of the undirected graph."""
    e = undirected(edges)
    m = membership.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    k = membership.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    x = e.join(m, "src").join(k, "dst")
    inner = x.agg(F.count("*").alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    volume = x.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), F.max("n").alias("_big"), F.sum("n").alias("_all"), F.median("n").alias("median_size"))
    q = F.when(F.col("m") > 0, F.col("inside") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m")))
    return sizes.join(F.broadcast(inner)).join(F.broadcast(volume)).select("communities", F.round(q, 6).alias("modularity"), F.round(F.col("_big") / F.col("_all"), 6).alias("largest_share"), "median_size")
