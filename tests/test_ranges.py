"""Scans over ranges, nearest neighbours and pieces against slow versions, with keys that fill many partitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cyclora.operators import best, intervals, ordering, stats


@pytest.fixture(scope="module")
def many(spark):
    """More partitions than keys."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed, n=400, most=900):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    out = []
    for i in range(n):
        a = draw.randrange(most)
        out.append((draw.choice(keys), a, a + draw.randrange(12), draw.randrange(50), i))
    return out


SCHEMA = "k string, a long, z long, v long, id long"


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("past", [False, True])
def test_running_extremes(spark, many, down, past):
    rows = [(k, a, z, v if v > 5 else None, i) for k, a, z, v, i in rows_of(1)]
    parts = ordering.ranged(spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "id"])
    assert len({(r._part) for r in parts.select("_part", "k").filter("k = 'hot'").distinct().collect()}) > 4
    got = {r.id: r.x for r in ordering.scanned(parts, ["k"], ["a", "id"], {"x": F.col("v")}, down, past).collect()}
    for k, a, _, v, i in rows:
        near = [y for q, b, _, y, j in rows if q == k and y is not None and ((b, j) > (a, i) if down else (b, j) < (a, i))]
        near += [v] if not past and v is not None else []
        assert got[i] == ((min if down else max)(near) if near else None)


def test_running_extremes_of_nothing(spark):
    parts = ordering.ranged(spark.createDataFrame([], SCHEMA), ["k"], ["a"])
    assert ordering.scanned(parts, ["k"], ["a"], {"x": F.col("v")}).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_nearest_as_by_all_pairs(spark, many, seed):
    a, b = rows_of(seed, 300), rows_of(seed + 50, 150)
    a = [r for r in a if r[0]]
    one, two = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = {r.id: r.distance for r in intervals.nearest_distance(one, two, "k", "a", "z", "a", "z").collect()}
    point = {r.id: (r.near_at, r.near_id) for r in intervals.nearest_coordinate(one, two, "k", "a", "a", "id", 9).collect()}
    for k, x, z, _, i in a:
        gaps = [max(0, p - z, x - q) for c, p, q, _, _ in b if c == k]
        assert got[i] == (min(gaps) if gaps else None)
        near = min(((abs(p - x), p, j) for c, p, _, _, j in b if c == k), default=None)
        assert point[i] == (near[1:] if near and near[0] <= 9 else (None, None))


def slow_greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        if all(r[0] != q[0] or r[2] < q[1] or q[2] < r[1] for q in kept):
            kept.append(r)
    return {r[4] for r in kept}


def best_total(rows):
    """The best total of one key's hits, by trying ends in order."""
    total = {}
    ordered = sorted(rows, key=lambda r: r[2])
    best_to = [0] * (len(ordered) + 1)
    for i, r in enumerate(ordered, 1):
        before = sum(q[2] < r[1] for q in ordered)
        best_to[i] = max(best_to[i - 1], r[3] + best_to[before])
    return best_to[-1] if ordered else total


@pytest.mark.parametrize("most", [60, 3000])
def test_hits_without_overlap(spark, many, monkeypatch, most):
    """Crowded containers that are one piece, and roomy ones of many."""
    rows = rows_of(7, 400, most)
    df = spark.createDataFrame(rows, SCHEMA)
    greedy = best.non_overlapping(df, "k", "a", "z", "v", ["id"])
    assert greedy.columns == df.columns and {r.id for r in greedy.collect()} == slow_greedy(rows)
    exact = best.non_overlapping(df, "k", "a", "z", "v", ["id"], exact=True).collect()
    for k in {r[0] for r in rows}:
        own = sorted(((r.a, r.z, r.v) for r in exact if r.k == k))
        assert all(x[1] < y[0] for x, y in zip(own, own[1:]))
        assert sum(x[2] for x in own) == best_total([r for r in rows if r[0] == k])


def test_blocks_of_taken_intervals():
    taken, plain, draw = best._Taken(4), [], random.Random(2)
    for _ in range(3000):
        a = draw.randrange(-5000, 5000)
        z = a + draw.randrange(20)
        crossed = any(p <= z and q >= a for p, q in plain)
        assert taken.overlaps(a, z) == crossed
        if not crossed:
            taken.add(a, z)
            plain.append((a, z))


def test_pieces_of_a_hot_key_spread(spark, many):
    rows = [("hot", 10 * i, 10 * i + 5, 1, i) for i in range(500)]
    cut = intervals.pieces(spark.createDataFrame(rows, SCHEMA), "k", "a", "z")
    assert cut.select("piece").distinct().count() == 500


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_looks_ahead_to_the_end(spark):
    """Spark works such a frame out anew for every row."""
    df = spark.createDataFrame(rows_of(3), SCHEMA).filter("k is not null")
    p = spark.createDataFrame([(i, i / 100) for i in range(50)], "id long, p double")
    for out in (intervals.nearest_distance(df, df, "k", "a", "z", "a", "z"), intervals.nearest_coordinate(df, df, "k", "a", "a", "id"), intervals.merge_intervals(df, "k", "a", "z"), stats.benjamini_hochberg(p, "p", ["id"])):
        assert not re.search(r"currentrow\$\(\), unboundedfollowing", plan(out))
