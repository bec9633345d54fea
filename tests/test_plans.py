"""What the plans must look like, whatever the data."""

import re

import pytest
from pyspark.sql import functions as F

from cyclora.operators import best
from cyclora.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", 3000)
    p = plan(catalog.QUERIES["conjunctive_filter"](spark, sf))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity" in p and "PushedFilters: [" in p
    read = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
    assert "l_orderkey" in read and "l_shipdate" not in read and "l_tax" not in read


def test_best_rows_are_cut_down_before_the_shuffle(spark, sf):
    p = plan(best.best_row(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey"], [F.desc("l_extendedprice")]))
    assert p.count("WindowGroupLimit") == 2


#: One task or all pairs would show as these.
ALONE = ["context_entropy", "adjacency_edges", "relative_entropy", "nearest_interval", "interval_overlap", "association_summary", "best_hit", "two_tier_rescue", "set_intersections", "jaccard_pairs", "simpson_diversity", "coverage_curve", "average_rank"]


@pytest.mark.parametrize("name", ALONE)
def test_neither_pairs_of_all_rows_nor_one_task_for_all(name, spark, sf):
    p = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert not re.search(r"Window.*\n.*Sort.*\n.*SinglePartition", p)


@pytest.mark.parametrize("name", ["context_entropy", "circular_vicinity", "motif_hits", "translations", "category_classifier", "column_entropy"])
def test_feature_operators_stay_in_the_jvm(name, spark, sf):
    assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, sf)))
