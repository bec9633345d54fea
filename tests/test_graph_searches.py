"""Searches and communities over edge tables against plain ones in Python."""

import random
from collections import defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cyclora.operators import communities, graph, searches


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def near_of(pairs, directed):
    near = defaultdict(set)
    for a, b in pairs:
        near[a], near[b] = near[a], near[b]
        if a != b:
            near[a].add(b)
            if not directed:
                near[b].add(a)
    return near


def search(near, s):
    """Levels, ways and the order in which nodes are met."""
    far, ways, order, queue = {s: 0}, defaultdict(int, {s: 1}), [], deque([s])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in near[v]:
            if w not in far:
                far[w] = far[v] + 1
                queue.append(w)
            if far[w] == far[v] + 1:
                ways[w] += ways[v]
    return far, ways, order


def slow_betweenness(pairs, directed):
    """By counting, for each pair of nodes, the shortest ways through each third."""
    near = near_of(pairs, directed)
    found = {s: search(near, s) for s in near}
    n, out = len(near), dict.fromkeys(near, 0.0)
    for s in near:
        far, ways, _ = found[s]
        for t in far:
            for v in far:
                if v not in (s, t) and t in found[v][0] and far[v] + found[v][0][t] == far[t]:
                    out[v] += ways[v] * found[v][1][t] / ways[t]
    return {v: round(x / ((n - 1) * (n - 2)), 6) if n > 2 else 0.0 for v, x in out.items()}


def some(seed, n=30, m=45):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(9)] + [(200, 200)]


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("most", [searches.MOST_STATES, 500])
def test_betweenness(spark, directed, most):
    pairs = some(1)
    got = {r.node: r.betweenness for r in searches.betweenness(edges(spark, pairs), directed, most).collect()}
    want = slow_betweenness(pairs, directed)
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=2e-6) for v in want)


@pytest.mark.parametrize("directed", [False, True])
def test_closeness(spark, directed):
    pairs = some(2, 70, 110)  # more sources than a long has bits
    near = near_of([(b, a) for a, b in pairs] if directed else pairs, directed)
    got = {r.node: r.closeness for r in searches.closeness(edges(spark, pairs), directed).collect()}
    assert got.keys() == near.keys()
    for s in near:
        far = search(near, s)[0]
        total, k = sum(far.values()), len(far) - 1
        assert got[s] == pytest.approx(k / total * k / (len(near) - 1) if total else 0.0, abs=1e-6)


def test_path_lengths_of_several_graphs(spark):
    graphs = {0: some(3), 1: some(4, 40, 90), 2: [(1, 1)]}
    rows = [(rep, a, b) for rep, pairs in graphs.items() for a, b in pairs]
    got = {r.rep: r.path_length for r in searches.path_lengths(spark.createDataFrame(rows, "rep long, src long, dst long"), ["rep"]).collect()}
    for rep, pairs in graphs.items():
        near = near_of(pairs, False)
        each = [d for s in near for d in search(near, s)[0].values() if d]
        assert got[rep] == (pytest.approx(sum(each) / len(each)) if each else None)
    assert searches.path_lengths(edges(spark, []), []).first()[0] is None
    one, two = (searches.path_lengths(edges(spark, some(5, 60, 100)).repartition(k), [], sources=20).first()[0] for k in (1, 3))
    assert one == two


def test_clustering_of_several_graphs(spark):
    graphs = {0: some(6, 14, 50), 1: some(7, 14, 60)}
    rows = [(rep, a, b) for rep, pairs in graphs.items() for a, b in pairs]
    both = graph.clustering(spark.createDataFrame(rows, "rep long, src long, dst long"), ["rep"])
    for rep, pairs in graphs.items():
        alone = graph.clustering(edges(spark, pairs))
        assert sorted(map(tuple, both.filter(F.col("rep") == rep).drop("rep").collect())) == sorted(map(tuple, alone.collect()))


def modularity(pairs, label):
    e = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    m, volume = len(e), defaultdict(int)
    for a, b in e:
        volume[label[a]] += 1
        volume[label[b]] += 1
    return sum(label[a] == label[b] for a, b in e) / m - sum(x * x for x in volume.values()) / (4 * m * m)


def serial(pairs, seed=0):
    """Modularity of moves in turn over nodes, then over communities, until none gains."""
    e = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    nodes = sorted({x for p in e for x in p})
    label, draw = {v: v for v in nodes}, random.Random(seed)
    weight = defaultdict(lambda: defaultdict(float))
    for a, b in e:
        weight[a][b] += 1
        weight[b][a] += 1
    loops, group = defaultdict(float), {v: v for v in nodes}
    while True:
        k = {v: sum(weight[v].values()) + loops[v] for v in set(group.values())}
        own, volume, any_moved = {v: v for v in k}, dict(k), False
        for _ in range(20):
            moved, order = False, sorted(k)
            draw.shuffle(order)
            for v in order:
                to = defaultdict(float)
                for w, x in weight[v].items():
                    to[own[w]] += x
                volume[own[v]] -= k[v]
                score = lambda c: to[c] - k[v] * volume[c] / (2 * len(e))  # noqa: E731, B023
                best = max(sorted(set(to) | {own[v]}), key=score)
                if score(best) > score(own[v]) + 1e-9:
                    own[v], moved, any_moved = best, True, True
                volume[own[v]] += k[v]
            if not moved:
                break
        group = {v: own[g] for v, g in group.items()}
        if not any_moved:
            return modularity(pairs, group)
        merged, more = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for v in k:
            more[own[v]] += loops[v]
            for w, x in weight[v].items():
                if own[v] == own[w]:
                    more[own[v]] += x
                else:
                    merged[own[v]][own[w]] += x
        weight, loops = merged, more


def planted(seed, groups=6, size=12, inner=0.5, outer=0.03):
    draw = random.Random(seed)
    return [p for p in combinations(range(groups * size), 2) if draw.random() < (inner if p[0] // size == p[1] // size else outer)]


@pytest.mark.parametrize("pairs", [planted(1), some(8, 60, 90)])
def test_communities(spark, pairs):
    e = edges(spark, pairs)
    found = communities.communities(e)
    label = {r.node: r.community for r in found.collect()}
    assert label.keys() == {x for p in pairs for x in p}
    assert modularity(pairs, label) >= sorted(serial(pairs, s) for s in range(3))[1] - 0.01
    assert graph.modularity(e, found).first().modularity == pytest.approx(modularity(pairs, label), abs=1e-6)
    near = near_of([p for p in pairs if label[p[0]] == label[p[1]]], False)
    for v, c in label.items():  # connected, and named by the smallest
        assert c in search(near, v)[0] and c == min(search(near, v)[0])


def test_communities_of_two_cliques(spark):
    pairs = [*combinations(range(6), 2), *combinations(range(10, 16), 2), (0, 10), (77, 77)]
    e = edges(spark, pairs)
    label = {r.node: r.community for r in communities.communities(e).collect()}
    assert label == {i: 0 for i in range(6)} | {i: 10 for i in range(10, 16)} | {77: 77}


def test_communities_of_nothing(spark):
    assert communities.communities(edges(spark, [])).count() == 0
    assert [tuple(r) for r in communities.communities(edges(spark, [(5, 5)])).collect()] == [(5, 5)]


def test_betweenness_of_many_small_components_is_one_batch(spark, monkeypatch):
    """Forty rings of five: a source reaches five nodes, not two hundred."""
    edges = spark.createDataFrame([(5 * c + i, 5 * c + (i + 1) % 5) for c in range(40) for i in range(5)], "src long, dst long")
    calls, own = [], searches.dependencies
    monkeypatch.setattr(searches, "dependencies", lambda *a: calls.append(1) or own(*a))
    got = searches.betweenness(edges, most_states=2000).collect()
    assert len(calls) == 1 and len(got) == 200
    assert {r.betweenness for r in got} == {round(2 / (199 * 198), 6)}


def test_null_graphs_are_not_broadcast(spark):
    e = spark.createDataFrame([(f"a{i}", f"b{(i * 7) % 50}") for i in range(200)], "src string, dst string")
    plan = graph.configuration_null(e, 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_random_graphs_that_are_nearly_full(spark):
    """No more draws than there are pairs, and all pairs where all are asked for."""
    class Counted:
        def range(self, n):
            self.n = n
            return spark.range(n)

    counted = Counted()
    for need in (800, 870):
        got = graph._random_pairs(counted, 30, need, 3, 1).collect()
        assert counted.n <= 30 * 30 and len(got) == len({(r.rep, r.a, r.b) for r in got}) == 3 * need
        assert all(r.a != r.b and 0 <= min(r.a, r.b) and max(r.a, r.b) < 30 for r in got)
