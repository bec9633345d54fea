"""Operators against small models, hand-made cases and invariants."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclora.operators import best, circular, clustering, context, cover, graph, searches, intervals, ordering, stats


def ring(n):
    return [(i, (i + 1) % n) for i in range(n)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def values(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# --- circles ---------------------------------------------------------------------------------------------------------


def circle_rows():
    rng = random.Random(3)
    rows, k = [], 0
    for c in range(30):
        for i in range(rng.choice([1, 2, 3, 4, 7])):
            rows.append((c, i // 2, k, rng.choice("abc"), rng.choice([1, -1, None]), rng.random() < 0.3))
            k += 1
    return rows


@pytest.fixture(scope="module")
def circles(spark):
    return spark.createDataFrame(circle_rows(), "c long, pos long, id long, token string, strand int, flag boolean")


def on_circle():
    by = {}
    for r in circle_rows():
        by.setdefault(r[0], []).append(r)
    return by


def test_vicinity_in_small_circles(circles):
    got = values(circular.circular_vicinity(circles, "c", ["pos", "id"], "flag"), "id", "directly_adjacent", "sandwiched")
    for rows in on_circle().values():
        n = len(rows)
        for i, r in enumerate(rows):
            f = {k: rows[(i + k) % n][5] for k in (-2, -1, 1, 2)}
            assert got[r[2]] == (f[-1] or f[1], (f[-1] or f[-2]) and (f[1] or f[2])), (n, i)


def test_split_containers_have_the_same_neighbours(spark, circles):
    hot = spark.createDataFrame([(99, i // 3, 1000 + i, "xyz"[i % 3], None if i % 5 == 0 else 1, True) for i in range(300)], circles.schema)
    rows = circles.unionByName(hot)
    one, two = (f(rows, "c", ["pos", "id"], ["token", "strand"]) for f in (circular.circular_neighbours, circular.circular_neighbours_split))
    assert sorted(map(str, one.select(two.columns).collect())) == sorted(map(str, two.collect()))


def test_null_strands_are_neighbours(circles):
    want = {}
    for rows in on_circle().values():
        for a, b in zip(rows, rows[1:] + rows[:1]):
            o = {(1, 1): "PP", (-1, -1): "MM", (1, -1): "PM"}.get((a[4], b[4]), "MP")
            want[a[3], b[3], o] = want.get((a[3], b[3], o), 0) + 1
    e = circular.adjacency_edges(circles, "c", ["pos", "id"], "token", "strand")
    assert {(r.domain1, r.domain2, r.orientation): r.weight for r in e.collect()} == want
    s = circular.signed_edges(e).collect()
    assert sum(r.total_weight for r in s) == len(circle_rows()) and all(abs(r.signed_weight) <= r.total_weight for r in s)


def test_lone_features(spark):
    d = spark.createDataFrame([(1, 1, "a", 1)], "c long, pos long, token string, strand int")
    assert circular.adjacency_edges(d, "c", ["pos"], "token", "strand").count() == 1
    assert circular.adjacency_edges(d, "c", ["pos"], "token", "strand", skip_singles=True).count() == 0
    assert context.contexts(d, "c", ["pos"], "token").count() == 0


def test_entropy_branches(spark):
    rows = [("same", "a", "b")] * 4 + [("all", str(i), "b") for i in range(8)] + [("one", "a", "b")]
    e = values(context.context_entropy(spark.createDataFrame(rows, "k string, left string, right string"), ["k"]), "k", "entropy", "score")
    assert e == {"same": (0.0, 0.0), "all": (3.0, 1.0), "one": (None, None)}


# --- intervals -------------------------------------------------------------------------------------------------------


def random_intervals(seed, n=120):
    rng = random.Random(seed)
    return [(i, rng.randrange(6), s, s + rng.randrange(25)) for i in range(n) for s in [rng.randrange(300)]]


def test_nearest_overlap_and_anti(spark):
    a, b = random_intervals(1), [(i, c % 5, s, e) for i, c, s, e in random_intervals(2, 40)]
    da = spark.createDataFrame(a, "a long, c long, s long, e long")
    db = spark.createDataFrame(b, "b long, c long, s2 long, e2 long")
    gap = values(intervals.nearest_distance(da, db, "c", "s", "e", "s2", "e2"), "a", "distance")
    for i, c, s, e in a:
        assert gap[i] == min((max(0, y - e, s - z) for _, d, y, z in b if d == c), default=None)
    for width, buffer in ((7, 0), (50, 9)):
        want = {(i, j) for i, c, s, e in a for j, d, y, z in b if c == d and s <= z + buffer and e >= y - buffer}
        got = [(r.a, r.b) for r in intervals.overlap_join(da, db, "c", "s", "e", "s2", "e2", width, buffer).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        free = {r.a for r in intervals.without_overlap(da, db, "c", ["a"], "s", "e", "s2", "e2", width, buffer).collect()}
        assert free == {i for i, *_ in a} - {i for i, _ in want}


def test_nearest_coordinate(spark):
    a, b = random_intervals(5), [(i, c % 5, s // 9 * 9, 0) for i, c, s, _ in random_intervals(6, 60)]
    da = spark.createDataFrame([(i, c, s) for i, c, s, _ in a], "a long, c long, x long")
    db = spark.createDataFrame([(i, c, s) for i, c, s, _ in b], "b long, c long, y long")
    got = values(intervals.nearest_coordinate(da, db, "c", "x", "y", "b", 6), "a", "near_at", "near_id")
    for i, c, x, _ in a:
        best_ = min(((abs(y - x), y, j) for j, d, y, _ in b if d == c), default=None)
        assert got[i] == ((best_[1], best_[2]) if best_ and best_[0] <= 6 else (None, None))


def test_merge_and_complement_partition_the_line(spark):
    rows = random_intervals(7)
    d = spark.createDataFrame(rows, "i long, c long, s long, e long")
    merged = intervals.merge_intervals(d, "c", "s", "e")
    inside, outside = {}, {}
    for r in merged.collect():
        inside.setdefault(r.c, []).extend(range(r.s, r.e + 1))
    for r in intervals.complement(merged, "c", "s", "e").collect():
        outside.setdefault(r.c, []).extend(range(r.gap_start, r.gap_end + 1))
    for c, got in inside.items():
        want = {p for _, d, s, e in rows if d == c for p in range(s, e + 1)}
        assert len(got) == len(set(got)) and set(got) == want
        assert not want & set(outside.get(c, [])) and want | set(outside.get(c, [])) == set(range(min(want), max(want) + 1))


def test_splicing(spark):
    d = spark.createDataFrame([("x", "0123456789"), ("y", "abc"), ("z", "")], "k string, t string")
    cuts = spark.createDataFrame([("x", 0, 1), ("x", 2, 3), ("x", 8, 9), ("x", 3, 4)], "k string, start long, end long")
    assert values(intervals.splice_out(d, cuts, "k", "t"), "k", "t") == {"x": "567", "y": "abc", "z": ""}


# --- order and statistics --------------------------------------------------------------------------------------------


def test_ranks_and_percentiles(spark):
    rng = random.Random(9)
    x = [rng.choice([None, *range(12)]) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(x)), "i long, v long")
    known = sorted(v for v in x if v is not None)
    got = values(ordering.with_rank(d, "v", "r"), "i", "r")
    for i, v in enumerate(x):
        assert got[i] == (None if v is None else known.index(v) + 1 + (known.count(v) - 1) / 2)
    last = values(ordering.with_rank(d, "v", "r", "min", nulls_last=True), "i", "r")
    assert {last[i] for i, v in enumerate(x) if v is None} == {len(known) + 1}
    assert ordering.percentiles(d, "v", [0, 0.31, 0.5, 0.95, 1]) == pytest.approx([float(np.percentile(known, q)) for q in (0, 31, 50, 95, 100)])
    assert ordering.percentiles(d.filter("v > 99"), "v", [0.5]) == [None]


def test_known_tests_of_significance(spark):
    p = [0.01, 0.04, 0.03, None, 0.04, 0.8]
    q = values(stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", ["i"]), "i", "q")
    assert q[3] is None and [q[i] for i in (0, 1, 2, 4, 5)] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.8])
    assert stats.correlation_p(0.5, 10) == pytest.approx(0.14111, abs=1e-5)
    assert stats.correlation_p(0.9, 30) == pytest.approx(1.5e-11, rel=0.2)
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "x double, y double")
    assert stats.spearman(flat, "x", "y")[1] is None
    up = spark.createDataFrame([(float(i), float(i**3)) for i in range(9)] + [(None, 1.0)], "x double, y double")
    assert stats.spearman(up, "x", "y") == (9, pytest.approx(1.0), 0.0)


def test_rank_sum_of_binary_values(spark):
    d = spark.createDataFrame([("a", 20, 0.1), ("b", 20, 0.5), ("c", 20, 0.9)], "k string, n long, s double")
    r = {x.k: x for x in stats.mann_whitney_binary(d, "k", "n", "s").collect()}
    assert r["a"].reference == "b" and r["b"].u == 200 and r["b"].p == 1.0
    assert r["a"].p == pytest.approx(r["c"].p) and 0.001 < r["a"].p < 0.02


# --- best rows and covers --------------------------------------------------------------------------------------------


def test_hits_without_overlap(spark):
    rng = random.Random(11)
    rows = [(k, i, s, s + rng.randrange(6), rng.randrange(1, 20)) for k in range(12) for i in range(9) for s in [rng.randrange(20)]]
    d = spark.createDataFrame(rows, "k long, i long, s long, e long, w long")
    greedy, exact = {}, {}
    for out, flag in ((greedy, False), (exact, True)):
        for r in best.non_overlapping(d, "k", "s", "e", "w", ["i"], flag).collect():
            out.setdefault(r.k, []).append((r.s, r.e, r.w, r.i))
    free = lambda x: all(a[1] < b[0] or b[1] < a[0] for a, b in combinations(x, 2))
    for k in range(12):
        own = [(s, e, w, i) for key, i, s, e, w in rows if key == k]
        kept = []
        for x in sorted(own, key=lambda x: (-x[2], x[3])):
            if free([*kept, x]):
                kept.append(x)
        assert sorted(greedy[k]) == sorted(kept) and free(exact[k])
        assert sum(x[2] for x in exact[k]) == max(sum(x[2] for x in c) for n in range(10) for c in combinations(own, n) if free(c))


def test_cover_is_greedy_and_complete(spark):
    rng = random.Random(12)
    members = sorted({(rng.randrange(15), rng.randrange(40)) for _ in range(120)})
    d = spark.createDataFrame(members, "k long, e long")
    left, want = {e for _, e in members}, []
    holds = {k: {e for j, e in members if j == k} for k, _ in members}
    while left:
        k = min(holds, key=lambda k: (-len(holds[k] & left), -len(holds[k]), k))
        want.append((len(want) + 1, k, len(holds[k] & left)))
        left -= holds[k]
    got = cover.greedy_cover(d, "k", "e")
    assert [tuple(r) for r in got.orderBy("step").collect()] == want
    curve = cover.coverage_curve(d, got.select("k", "step"), "k", "e", "step").orderBy("step").collect()
    assert [r.new for r in curve] == [g for *_, g in want] and curve[-1].covered == len({e for _, e in members})


def test_covers_of_scopes(spark):
    rng = random.Random(21)
    rows = sorted({(rng.choice("xyz"), rng.randrange(12), rng.randrange(30)) for _ in range(150)})
    d = spark.createDataFrame([*rows, rows[0], (None, 1, 2), ("x", None, 3)], "s string, k long, e long")
    got = cover.cover_by_scope(d, "s", "k", "e")
    for scope in ("x", "y", "z", "all"):
        own = spark.createDataFrame([r[1:] for r in rows if scope in ("all", r[0])], "k long, e long")
        one = cover.greedy_cover(own, "k", "e").orderBy("step").collect()
        assert [tuple(r) for r in got.filter(F.col("s") == scope).orderBy("step").select("step", "k", "gain").collect()] == [tuple(r) for r in one]
    assert got.select("s").distinct().count() == 4
    whole = {r.k for r in got.filter("s = 'all'").collect()}
    for r in cover.cross_scope_summary(d, got, "s", "k", "e").collect():
        own, picks = [x for x in rows if r.s in ("all", x[0])], got.filter(F.col("s") == r.s).orderBy("step").collect()
        assert (r.n_elements, r.n_sets, r.n_picked) == (len({x[2] for x in own}), len({x[1] for x in own}), len(picks))
        assert r.first_share == round(picks[0].gain / r.n_elements, 6) and r.in_whole == len(whole & {p.k for p in picks})
    assert cover.cover_by_scope(d.limit(0), "s", "k", "e").count() == 0


def test_fixpoint_leaves_bad_sets_out(spark):
    d = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (2, 2), (2, 3)], "k long, e long")
    c, left = cover.cover_to_fixpoint(d, "k", "e", lambda x: x.filter("k = 0"))
    assert {r.k for r in c.collect()} == {1, 2} and left.filter("k = 0").count() == 0


# --- graphs ----------------------------------------------------------------------------------------------------------


def test_centralities_of_known_graphs(spark):
    star = edges(spark, [(0, i) for i in range(1, 6)])
    assert values(searches.betweenness(star), "node", "betweenness") == {0: 1.0} | dict.fromkeys(range(1, 6), 0.0)
    assert values(searches.closeness(star), "node", "closeness") == {0: 1.0} | dict.fromkeys(range(1, 6), round(5 / 9, 6))
    assert set(values(searches.betweenness(edges(spark, ring(6))), "node", "betweenness").values()) == {0.2}
    path = edges(spark, [(0, 1), (1, 2), (2, 3)])
    assert values(searches.betweenness(path), "node", "betweenness") == {0: 0.0, 1: round(2 / 3, 6), 2: round(2 / 3, 6), 3: 0.0}
    assert searches.path_lengths(path, []).first()[0] == pytest.approx(10 / 6)
    e = values(graph.eigenvector(star), "node", "eigenvector")
    assert e[0] == pytest.approx(2**-0.5, abs=2e-4) and e[1] == pytest.approx(10**-0.5, abs=2e-4)
    h = values(graph.hits(star, rounds=10), "node", "hub", "authority")
    assert h[0] == (1.0, 0.0) and h[3] == (0.0, 0.2)


def test_components_of_random_graphs(spark):
    rng = random.Random(13)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(70)] + [(999, 999)]
    label = {n: n for p in pairs for n in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert values(graph.components(edges(spark, pairs)), "node", "component") == label
    nodes, share = graph.largest_component(edges(spark, pairs))
    assert nodes.count() == max(list(label.values()).count(x) for x in label.values()) == round(share * len(label))


def test_triangles(spark):
    rng = random.Random(14)
    pairs = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(45)}
    got = values(graph.clustering(edges(spark, [p if rng.random() < 0.5 else p[::-1] for p in sorted(pairs)])), "node", "degree", "triangles")
    for n in {x for p in pairs for x in p}:
        near = {a + b - n for a, b in pairs if n in (a, b)}
        assert got[n] == (len(near), sum(tuple(sorted(x)) in pairs for x in combinations(near, 2)))


def test_paths(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 9), (9, 4), (4, 0), *[(a + 50, b + 50) for a, b in ring(3)], *[(a + 70, b + 70) for a, b in ring(4)], (90, 91), (91, 90)]
    got = sorted((r.start, r.head, r.stop, r.n_nodes) for r in graph.unbranching_paths(edges(spark, pairs)).collect())
    assert got == [(0, 1, 4, 5), (0, 9, 4, 3)]
    inner = sorted(map(tuple, graph.path_nodes(edges(spark, pairs)).collect()))
    assert inner == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (9, 0, 9)]
    long = [(i, i + 1) for i in range(700)]
    assert [tuple(r) for r in graph.unbranching_paths(edges(spark, long)).collect()] == [(0, 1, 700, 701)]
    s = graph.path_stats(graph.unbranching_paths(edges(spark, pairs)), 6).first()
    assert (s.n_paths, s.longest, s.mean_length, s.coverage) == (2, 5, 4.0, round(4 / 6, 6))


def test_null_models_keep_what_they_should(spark):
    rng = random.Random(15)
    pairs = sorted({tuple(rng.sample(range(25), 2)) for _ in range(80)})
    e = edges(spark, pairs)
    for r in graph.gnm_null(e, 3).groupBy("rep").agg(F.count("*").alias("m"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).collect():
        assert (r.m, r.loops) == (len(pairs), 0)
    c = graph.configuration_null(e, 4)
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, graph.configuration_null(e.repartition(3), 4).collect()))
    most = {n: sum(a == n for a, _ in pairs) for p in pairs for n in p}
    for r in c.groupBy("rep", "src").count().collect():
        assert r["count"] <= most[r.src]
    for r in graph.recombination_null(e, 2).groupBy("rep").agg(F.count("*").alias("m")).collect():
        n, budget = len(most), sum(max(0, sum(x in p for p in pairs) - 2) for x in most)
        assert r.m == n + budget // 2


def test_statistics_of_growing_batches(spark):
    rng = random.Random(22)
    rows = [(rng.randrange(9), rng.randrange(6), rng.randrange(6)) for _ in range(60)]
    e = spark.createDataFrame(rows, "c long, src long, dst long")
    places = graph.shuffles(e, "c", 3)
    at = {(r.run, r.c): r.place for r in places.collect()}
    n = len({c for c, *_ in rows})
    assert all(sorted(p for (run, _), p in at.items() if run == k) == list(range(1, n + 1)) for k in range(3))
    assert at == {(r.run, r.c): r.place for r in graph.shuffles(e, "c", 3).collect()}
    got = {(r.run, r.size): (r.node_number, r.edge_number, r.average_degree) for r in graph.stats_by_batch(e, "c", places, [1, 4, n]).collect()}
    for run in range(3):
        for size in (1, 4, n):
            pairs = {(a, b) for c, a, b in rows if at[run, c] <= size}
            nodes = {x for p in pairs for x in p}
            assert got[run, size] == (len(nodes), len(pairs), pytest.approx(2 * len(pairs) / len(nodes)))
    assert graph.stats_by_batch(e.limit(0), "c", graph.shuffles(e.limit(0), "c", 3), [1]).count() == 0


def test_what_does_not_settle_falls_back_to_degrees(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 2), (2, 3)])
    assert values(graph.eigenvector(e, rounds=1), "node", "eigenvector") == {0: 0.6667, 1: 0.6667, 2: 1.0, 3: 0.3333}


# --- clusters --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_jaccard_pairs(spark, least):
    rng = random.Random(16)
    sets = {i: frozenset(rng.sample(range(14), rng.randrange(1, 7))) for i in range(60)}
    d = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "c long, t long")
    got = {(r.a, r.b) for r in clustering.jaccard_pairs(d, "c", "t", least).collect()}
    assert got == {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-9}


def test_dbscan_everywhere(spark):
    rng = random.Random(17)
    centres = [(0, 179.8), (60, 10), (-45, -179.9), (89.5, 0), (89.6, 180), (10, 10)]
    p = [(i, max(-90.0, min(90.0, la + rng.gauss(0, 1.5))), (lo + rng.gauss(0, 2) + 540) % 360 - 180) for i in range(160) for la, lo in [rng.choice(centres)]]
    p += [(200 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(300 + i, 5.0, 5.0) for i in range(4)]

    def km(a, b):
        x, y = np.radians(a), np.radians(b)
        return 2 * 6371 * np.arcsin(np.sqrt(min(1, np.sin((y[0] - x[0]) / 2) ** 2 + np.cos(x[0]) * np.cos(y[0]) * np.sin((y[1] - x[1]) / 2) ** 2)))

    near = {i: {j for j, c, d in p if km((a, b), (c, d)) <= 300} for i, a, b in p}
    core = {i for i in near if len(near[i]) >= 5}
    got = values(clustering.dbscan_sphere(spark.createDataFrame(p, "i long, la double, lo double"), "i", "la", "lo", 300, 5), "i", "cluster")
    assert {i for i, c in got.items() if c == -1} == {i for i in near if not near[i] & core}
    for i in core:
        assert all(got[i] == got[j] for j in near[i] & core)
    assert len({got[i] for i in core}) > 3


def test_similar_pairs_of_copies_and_large_sets(spark):
    """Copies are one representative, and sets of more than 64 tokens are joined to their candidates."""
    draw = random.Random(7)
    sets = {c: set(draw.sample(range(100), draw.choice([1, 1, 2, 3, 70, 80]))) for c in range(60)} | {c: set(range(75)) for c in range(60, 66)}
    d = spark.createDataFrame([(c, t) for c, s in sets.items() for t in s], "c long, t long")
    of, links = clustering.jaccard_classes(d, "c", "t", 0.5)
    reps = {r.node: r.rep for r in of.collect()}
    assert reps == {c: min(x for x in sets if sets[x] == s) for c, s in sets.items()}
    found = {(min(r.a, r.b), max(r.a, r.b)): r.jaccard for r in links.collect()}
    like = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert found == {(a, b): j for (a, b), j in like.items() if reps[a] == a and reps[b] == b}
    assert {(r.a, r.b): r.jaccard for r in clustering.jaccard_pairs(d, "c", "t", 0.5).collect()} == like


def test_threshold_clusters_count_copies(spark):
    sets = {1: "a", 2: "a", 3: "a", 4: "bc", 5: "bcd", 6: "x", 7: "y", 8: "y"}
    d = spark.createDataFrame([(c, t) for c, s in sets.items() for t in s], "c long, t string")
    got = {r.c: r.cluster for r in clustering.threshold_clusters(d, "c", "t", 0.5, 2).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: -1, 7: 2, 8: 2}


def test_dbscan_of_spots_on_the_edge(spark):
    """Many places a hair apart, at distances a hair under and over the limit, and whole turns away, against all pairs."""
    import math
    import random

    draw, step = random.Random(4), 300 / 6371.0 * 180 / math.pi  # degrees on the equator that make 300 km
    p = [(k, draw.choice([0.0, 1e-7, 20.0]), a * step + draw.choice([0.0, 1e-7, -1e-7, 360.0]) * draw.randrange(3)) for k, a in enumerate(draw.choices([0, 1, 2, 5, 7, 8], k=60))]

    def near(x, y):
        u = math.sin(math.radians(y[1] - x[1]) / 2) ** 2 + math.cos(math.radians(x[1])) * math.cos(math.radians(y[1])) * math.sin(math.radians(y[2] - x[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, u))) <= 300

    around = {x[0]: [y[0] for y in p if near(x, y)] for x in p}
    core = {k for k, v in around.items() if len(v) >= 8}
    label = {k: k for k in core}
    for _ in p:
        label = {k: min(label[j] for j in around[k] if j in core) for k in core}
    want = {k: label[k] if k in core else min((label[j] for j in around[k] if j in core), default=-1) for k in around}
    got = clustering.dbscan_sphere(spark.createDataFrame(p, "i long, la double, lo double"), "i", "la", "lo", 300, 8).collect()
    assert {r.i: r.cluster for r in got} == want
