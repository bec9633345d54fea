"""Queries without a SQL twin read whole tables: ids beyond any fixed prefix are in their results."""

from pyspark.sql import functions as F

from cyclora.operators import cover
from cyclora.plans import catalog


def lineitem(spark, folder, rows):
    """rows: order, supplier, part, quantity."""
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_clusters_of_all_orders(spark, tmp_path):
    rows = [(o, s, 1, 1.0) for o in (1, 5000, 5001, 5002) for s in (7, 8)] + [(9000, 9, 1, 1.0)]
    got = {(r.l_orderkey, r.cluster) for r in catalog.QUERIES["threshold_clusters"](spark, lineitem(spark, tmp_path, rows)).collect()}
    assert got == {(1, 0), (5000, 0), (5001, 0), (5002, 0), (9000, -1)}


def test_covers_of_all_members(spark, tmp_path):
    folder = lineitem(spark, tmp_path, [(1, 100 + s, 1000 + s, 1.0) for s in range(27)])
    got = catalog.QUERIES["greedy_cover"](spark, folder).collect()
    assert {r.l_suppkey for r in got} == {100 + s for s in range(27)}
    growth = catalog.QUERIES["cover_growth"](spark, folder).collect()
    assert len({r.seed for r in growth}) == 10 and {r.chosen for r in growth if r.step == 27} == {27}


def test_fixpoint_is_reached_after_many_rounds(spark):
    members = spark.createDataFrame([(k, 0) for k in range(13)], "k long, e long")
    c, left = cover.cover_to_fixpoint(members, "k", "e", lambda x: x.filter(F.col("k") < 12))
    assert [r.k for r in c.collect()] == [12] and left.count() == 1
