"""Queries of projections, filters, joins, aggregates, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cyclora.functions import classify, numbers, sequence, text
from cyclora.operators import aggregates, best, joins
from cyclora.plans.proxies import FEATURES, features
from cyclora.plans.registry import query

# --- sources, projections, filters -----------------------------------------------------------------------------------


@query("SRC-1 PRJ-5", "SELECT r_regionkey AS region, r_name AS name FROM region")
def parquet_scan(t):
    from cyclora.sources.readers import parquet

    return parquet(t.spark, f"{t.folder}/region.parquet").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))


@query("SRC-5 SRC-6 JN-7 FLT-3", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filtered_copy(t):
    keep = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi(t.orders.select("o_orderkey", "o_custkey"), keep, ["o_custkey"])


@query("JN-8 FLT-4", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(t):
    return joins.anti(t.customer.select("c_custkey"), t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("JN-9", """SELECT count(*) AS n FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_linenumber = a.l_linenumber)""")
def signature_anti_join(t):
    keys = ["l_suppkey", "l_partkey", "l_linenumber"]
    return joins.anti(t.lineitem, t.lineitem.filter("l_returnflag = 'R'"), keys).agg(F.count("*").alias("n"))


@query("PRJ-1 PRJ-2 ARR-1 PRJ-3", """SELECT p_partkey, string_split(p_name, ' ')[-1] AS last_part, string_split(p_name, ' ')[-2] AS second_last, CAST(p_size AS DOUBLE) AS size,
    CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#12' THEN 'twelve' ELSE p_brand END AS brand FROM part""")
def derived_fields(t):
    names = t.spark.createDataFrame([("Brand#11", "eleven"), ("Brand#12", "twelve")], "b string, v string")
    x = t.part.select("p_partkey", text.last_field(F.col("p_name"), " ").alias("last_part"), text.field_from_end(F.col("p_name"), 2, " ").alias("second_last"), F.col("p_size").cast("double").alias("size"), "p_brand")
    return joins.lookup(x, names, "p_brand", "b", "v", "brand", keep_original=True).drop("p_brand")


@query("PRJ-9 PRJ-10 PRJ-13 MTH-6", """SELECT event_id, CASE WHEN value < 20 THEN 'HIGH' ELSE 'MEDIUM' END AS tier, value / 100 * (1 - 0.25) * coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE value / 200 END, 0.5) AS score,
    CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5 ELSE 0.1 END AS rating FROM events""")
def candidate_scores(t):
    v = F.col("value")
    cons = F.when(F.col("event_type") != "click", v / 200)
    return t.events.select("event_id", numbers.tier(v, 20).alias("tier"), numbers.candidate_score(v / 100, F.lit(0.25), cons).alias("score"), numbers.ordinal(F.col("event_type"), {"click": 1.0, "view": 0.5}, 0.1).alias("rating"))


@query("PRJ-11", """SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'open' WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'closed' ELSE 'none' END AS reason FROM customer""")
def reason_codes(t):
    a = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("a", F.lit(True))
    b = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("b", F.lit(True))
    return joins.star_join(t.customer.select("c_custkey"), [a, b], "c_custkey").select("c_custkey", F.when(F.col("a"), "open").when(F.col("b"), "closed").otherwise("none").alias("reason"))


@query("FLT-1 FLT-2 FLT-8", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount >= 0.07 AND l_linenumber <= l_quantity - 44 AND l_returnflag IS NOT NULL")
def conjunctive_filter(t):
    return t.lineitem.filter("l_quantity >= 45 and l_discount >= 0.07 and l_linenumber <= l_quantity - 44").filter(F.col("l_returnflag").isNotNull()).select("l_orderkey", "l_partkey", "l_quantity")


@query("FLT-5 FLT-6 FLT-12", "SELECT p_partkey FROM part WHERE p_type LIKE '%CONOM%' OR lower(p_name) LIKE '%red%' OR p_brand IN ('Brand#13')")
def substring_filter(t):
    name = classify.contains_any(F.col("p_name"), ["RED"], True)
    return t.part.filter(classify.in_list_or_contains(F.col("p_type"), [], ["CONOM"]) | name | F.coalesce(F.col("p_brand").isin("Brand#13"), F.lit(False))).select("p_partkey")


@query("FLT-7", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'PROMO|MEDI')")
def pattern_list_filter(t):
    return t.part.filter(F.col("p_type").rlike(classify.literal_pattern(["PROMO", "MEDI"]))).select("p_partkey")


@query("FLT-9 FLT-14", "SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 0 THEN 1 END IS NOT NULL OR CASE WHEN c_nationkey < 5 THEN 1 END IS NOT NULL) AND NOT regexp_matches(c_mktsegment, 'BUILD|AUTO')")
def drop_all_missing(t):
    x = t.customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, 1).alias("a"), F.when(F.col("c_nationkey") < 5, 1).alias("b"))
    return x.dropna(how="all", subset=["a", "b"]).filter(~F.col("c_mktsegment").rlike("BUILD|AUTO")).select("c_custkey")


@query("FLT-13", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def groups_above_size(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


#: Names of features and accessions, made of the parts' columns.
_NAMED = """nm AS (SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'IS' || CAST(p_size AS VARCHAR) || ' ' || p_name WHEN 1 THEN 'Phage ' || p_name || ' capsid' WHEN 2 THEN 'Invertase of ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' sugar' ELSE '' END
    WHEN 3 THEN 'Trb' || substr(p_brand, 7, 1) WHEN 4 THEN 'Efflux_' || p_type WHEN 5 THEN 'Rep_' || CAST(p_size AS VARCHAR) WHEN 6 THEN 'DDE_Tnp_1' WHEN 7 THEN 'Beta-lactamase' WHEN 8 THEN p_name END AS name, 'PF' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '.3' AS acc FROM part)"""


def _named(t):
    size = F.col("p_size").cast("string")
    kinds = [F.concat(F.lit("IS"), size, F.lit(" "), "p_name"), F.concat(F.lit("Phage "), "p_name", F.lit(" capsid")), F.concat(F.lit("Invertase of "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " sugar").otherwise("")),
        F.concat(F.lit("Trb"), F.substring("p_brand", 7, 1)), F.concat(F.lit("Efflux_"), "p_type"), F.concat(F.lit("Rep_"), size), F.lit("DDE_Tnp_1"), F.lit("Beta-lactamase"), F.col("p_name")]
    name = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        name = F.when(F.col("p_size") % 10 == i, kind).otherwise(name)
    return t.part.select("p_partkey", name.alias("name"), F.concat(F.lit("PF"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(".3")).alias("acc"))


def _listed(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_LOOK = r"invertase(?!.*sugar)"  # DuckDB's patterns cannot look ahead
_MOBILE = "|".join(f"(?:{x})" for x in classify.MOBILE_PATTERNS if x != _LOOK)
_CATEGORY = " ".join(f"WHEN list_bool_or([contains(lower(name), p) FOR p IN {'[' + _listed(parts)[1:-1] + ']'}]) THEN '{label}'" for label, parts in classify.CATEGORIES.items())


@query("FLT-10", f"""WITH {_NAMED} SELECT p_partkey, coalesce(split_part(acc, '.', 1) IN {_listed(classify.MOBILE_ACCESSIONS)}, false) OR coalesce(name IN {_listed(classify.MOBILE_NAMES)}, false)
    OR coalesce(regexp_matches(name, '(?i){_MOBILE}') OR regexp_matches(name, '(?i)invertase') AND NOT regexp_matches(name, '(?i)invertase.*sugar'), false) AS mobile FROM nm""")
def mobile_classifier(t):
    return _named(t).select("p_partkey", classify.is_mobile(F.col("name"), F.col("acc")).alias("mobile"))


@query("FLT-11", f"WITH {_NAMED} SELECT p_partkey, CASE WHEN name = 'Beta-lactamase' THEN 'Beta-lactamase' {_CATEGORY} ELSE 'Other/Unknown' END AS category FROM nm")
def category_classifier(t):
    c = classify.category(F.col("name"), F.coalesce(F.col("name") == "Beta-lactamase", F.lit(False)), "Beta-lactamase")
    return _named(t).select("p_partkey", c.alias("category"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("JN-1 JN-3", "SELECT l_orderkey, l_linenumber, l_quantity, n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey) WHERE n > 2")
def composite_join(t):
    n = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return t.lineitem.join(n, ["l_partkey", "l_suppkey"]).filter("n > 2").select("l_orderkey", "l_linenumber", "l_quantity", "n")


@query("JN-2 JN-5", """SELECT c_custkey, n_orders, total, n_name FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (c_custkey)
    LEFT JOIN (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN nation ON c_nationkey = n_nationkey""")
def star_join(t):
    by = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"))
    x = joins.star_join(t.customer, [by.agg(F.count("*").alias("n_orders")), by.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))], "c_custkey")
    return x.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_orders", "total", "n_name")


@query("JN-4", """SELECT count(*) AS n, count(m) AS found FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_tax) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b USING (l_orderkey, l_partkey, l_suppkey, l_linenumber)""")
def four_key_join(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    b = t.lineitem.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.max("l_tax").alias("m"))
    return t.lineitem.join(b, keys, "left").agg(F.count("*").alias("n"), F.count("m").alias("found"))


@query("JN-6 PRJ-4", "SELECT c_custkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def two_hop_lookup(t):
    x = joins.lookup(t.customer.select("c_custkey", "c_nationkey"), t.nation, "c_nationkey", "n_nationkey", "n_regionkey", "region")
    return joins.lookup(x, t.region, "region", "r_regionkey", "r_name", "r_name").select("c_custkey", "r_name")


@query("JN-6", "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1")
def last_wins_map(t):
    return joins.key_map(t.orders, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query("JN-16 JN-17", "SELECT s.seg AS c_mktsegment, coalesce(n, 0) AS n FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) s(seg) LEFT JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) ON c_mktsegment = seg")
def fixed_axis(t):
    n = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return joins.fixed_axis(n, "c_mktsegment", ["BUILDING", "MACHINERY", "NONE"], {"n": 0})


@query("JN-19", "SELECT c_custkey AS key, c_name AS name, NULL AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_wide(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return joins.union_wide(a, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("JN-20", """SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) a ON a.c_custkey = o_custkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON b.c_custkey = o_custkey - 1""")
def fallback_lookup(t):
    m = t.customer.filter("c_custkey % 2 = 0")
    return joins.lookup_with_fallback(t.orders.select("o_orderkey", "o_custkey"), m, "o_custkey", F.col("o_custkey") - 1, "c_custkey", "c_name", "name").drop("o_custkey")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("AGG-3 AGG-4 AGG-27", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean_price, round(stddev_samp(p_retailprice), 4) AS sd_price, round(avg(p_size), 6) AS mean_size FROM part GROUP BY 1")
def group_mean_std(t):
    return t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("mean_price"), F.round(F.stddev_samp("p_retailprice"), 4).alias("sd_price"), F.round(F.avg("p_size"), 6).alias("mean_size"))


@query("AGG-5", "SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 6) AS c_acctbal_mean, round(coalesce(stddev_samp(c_acctbal), 0), 6) AS c_acctbal_std FROM customer GROUP BY ALL")
def mean_std_flat(t):
    return aggregates.mean_and_std(t.customer, ["c_nationkey", "c_mktsegment"], ["c_acctbal"])


@query("AGG-9 AGG-10 AGG-11", """SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'R') AS n_returned, count(DISTINCT l_partkey) AS n_parts, min(l_quantity) AS min_quantity,
    arg_min(l_partkey, (l_quantity, l_partkey)) AS worst FROM lineitem GROUP BY 1""")
def mixed_aggregate(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.count_distinct("l_partkey").alias("n_parts"), F.min("l_quantity").alias("min_quantity"), F.min_by("l_partkey", F.struct("l_quantity", "l_partkey")).alias("worst")
    )


@query("AGG-13", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def collected_list(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ";").alias("orders"))


_BEST = "ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity"


@query("AGG-15 FLT-1", f"SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_quantity >= 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey {_BEST}) = 1")
def best_hit(t):
    order = [F.desc("l_extendedprice"), *map(F.asc, ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))]
    return best.best_row(t.lineitem.filter("l_quantity >= 10"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SET-7", f"""WITH s AS (SELECT l_orderkey, l_partkey, l_extendedprice, 'strict' AS tier FROM lineitem WHERE l_quantity >= 40 AND l_discount >= 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey {_BEST}) = 1),
    r AS (SELECT l_orderkey, l_partkey, l_extendedprice, 'relaxed' AS tier FROM lineitem a WHERE l_quantity >= 10 AND NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = a.l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey {_BEST}) = 1)
    SELECT * FROM s UNION ALL SELECT * FROM r""")
def two_tier_rescue(t):
    order = [F.desc("l_extendedprice"), *map(F.asc, ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))]
    strict = (F.col("l_quantity") >= 40) & (F.col("l_discount") >= 0.05)
    return best.two_tier_rescue(t.lineitem, ["l_orderkey"], strict, F.col("l_quantity") >= 10, order).select("l_orderkey", "l_partkey", "l_extendedprice", "tier")


@query("AGG-16", "SELECT user_id, arg_min(CASE WHEN value > 50 THEN value END, (ts, event_id)) FILTER (WHERE value > 50) AS v, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def first_known(t):
    x = t.events.select("user_id", "ts", "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("v"))
    return best.first_known(x, ["user_id"], ["v", "event_type"], ["ts", "event_id"])


@query("AGG-18", "SELECT CAST(least(floor(p_retailprice / 100), 24) AS INT) AS bin, count(*) AS n FROM part WHERE p_retailprice BETWEEN 0 AND 2500 GROUP BY 1")
def histogram(t):
    return aggregates.histogram(t.part, "p_retailprice", 0.0, 2500.0, 25)


@query("AGG-18", "SELECT CAST(least(floor(p_size / 10.0), 4) AS INT) AS bin, round(count(*) / ((SELECT count(*) FROM part WHERE p_size BETWEEN 0 AND 50) * 10.0), 9) AS density FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY 1")
def histogram_density(t):
    return aggregates.histogram(t.part, "p_size", 0.0, 50.0, 5, density=True)


@query("AGG-18", "SELECT CAST(floor(log10(o_totalprice) * 4 + 1e-9) AS INT) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def histogram_log(t):
    return aggregates.log_histogram(t.orders, "o_totalprice")


@query("AGG-19", f"SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("AGG-19 SEQ-20", "SELECT c_nationkey, c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1")
def keep_first(t):
    return best.keep_first(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])


@query("AGG-21 AGG-23", """SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) AS total FROM orders GROUP BY 1""")
def pivot_counts(t):
    return aggregates.pivot_counts(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "total").withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("AGG-28", "SELECT event_type, count(DISTINCT user_id) AS n, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 6) AS share FROM events GROUP BY 1")
def prevalence(t):
    return aggregates.prevalence(t.events, "event_type", "user_id")


@query("AGG-31", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) % 7 AS INT) AS part FROM part")
def strided_parts(t):
    return best.strided_parts(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 7).select("p_partkey", "part")


@query("AGG-32", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 300 AS INT) AS chunk FROM part")
def fixed_chunks(t):
    return best.chunks(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 300).select("p_partkey", "chunk")


@query("SNK-6", "SELECT c_mktsegment || ' / ' || CAST(c_nationkey AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) AS line FROM customer GROUP BY c_mktsegment, c_nationkey")
def summary_text(t):
    return aggregates.summary_text(t.customer, ["c_mktsegment", "c_nationkey"])


@query("TOP-1 TOP-2 TOP-4", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


# --- sets ------------------------------------------------------------------------------------------------------------


@query("SET-1 SET-2 SET-6", "SELECT l_partkey FROM lineitem WHERE l_quantity = 50 UNION SELECT l_partkey FROM lineitem WHERE l_discount = 0.1")
def union_distinct(t):
    li = t.lineitem
    return li.filter("l_quantity = 50").select("l_partkey").union(li.filter("l_discount = 0.1").select("l_partkey")).distinct()


@query("SET-3", """SELECT key, name FROM (SELECT 0 AS s, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier) QUALIFY row_number() OVER (PARTITION BY key ORDER BY s, name) = 1""")
def union_keep_first(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return best.union_keep_first([a, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))], ["key"], ["name"])


@query("SET-4", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.1)")
def set_difference(t):
    li = t.lineitem
    return li.filter("l_quantity = 50").select("l_partkey").distinct().join(li.filter("l_discount = 0.1").select("l_partkey"), "l_partkey", "left_anti")


@query("SET-5", """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM s a JOIN s b USING (l_partkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def set_intersections(t):
    s = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    x, y = s.withColumnRenamed("l_suppkey", "a"), s.withColumnRenamed("l_suppkey", "b")
    return x.join(y, "l_partkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("STR-1 STR-2 STR-8 STR-23 STR-24 STR-25", """SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS digit, string_split(p_name, ' ')[1] AS head, translate(p_name, ' ae', '') AS cut, lower(trim(p_type)) AS low,
    regexp_replace(p_brand, '[^A-Za-z0-9_.\\-]', '_', 'g') AS safe FROM part""")
def name_cleaning(t):
    c = F.col
    return t.part.select("p_partkey", F.regexp_extract(c("p_brand"), "#([0-9])", 1).alias("digit"), text.first_token(c("p_name")).alias("head"), text.without_chars(c("p_name"), " ae").alias("cut"), F.lower(F.trim("p_type")).alias("low"), text.safe_file_name(c("p_brand")).alias("safe"))


@query("STR-3 STR-4 STR-5 STR-6 STR-7", r"""WITH n AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'blaTEM-' || CAST(p_size AS VARCHAR) WHEN 1 THEN 'OXA-' || CAST(p_size AS VARCHAR) || 'a' WHEN 2 THEN 'mecR1' WHEN 3 THEN 'CTX-M-' || CAST(p_partkey AS VARCHAR)
        WHEN 4 THEN 'bla' || p_type || '-x' WHEN 5 THEN p_brand || '-2-3' ELSE p_name END AS name FROM part), c AS (SELECT *, regexp_replace(name, '-\d+[a-z]?$', '') AS cut, regexp_extract(name, '^(.+?)-\d+[a-z]?$', 1) AS head FROM n)
    SELECT p_partkey, CASE WHEN contains(name, '-') THEN regexp_replace(name, '-[^-]*$', '') ELSE '' END AS dash, CASE WHEN cut = '' THEN name ELSE cut END AS stripped,
    CASE WHEN name = 'mecR1' THEN 'mecR' WHEN regexp_matches(name, '^bla[A-Z]') THEN substr(name, 4) WHEN regexp_matches(head, '^[A-Za-z][A-Za-z0-9\-]*[A-Za-z]$|^[A-Za-z]+$') THEN head ELSE trim(name) END AS family,
    coalesce(nullif(regexp_extract(name, '^bla([A-Za-z]+-[A-Za-z]+|[A-Za-z]+)', 1), ''), name) AS node, coalesce(nullif(regexp_extract(name, '^bla(.*)$', 1), ''), 'x') AS rest FROM c""")
def family_rules(t):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    kinds = [F.concat(F.lit("blaTEM-"), size), F.concat(F.lit("OXA-"), size, F.lit("a")), F.lit("mecR1"), F.concat(F.lit("CTX-M-"), key), F.concat(F.lit("bla"), "p_type", F.lit("-x")), F.concat("p_brand", F.lit("-2-3"))]
    name = F.col("p_name")
    for i, kind in enumerate(kinds):
        name = F.when(F.col("p_size") % 7 == i, kind).otherwise(name)
    n = F.col("name")
    x = t.part.select("p_partkey", name.alias("name"))
    return x.select("p_partkey", text.drop_last_dash(n).alias("dash"), text.strip_number_suffix(n).alias("stripped"), text.family(n, {"mecR1": "mecR"}).alias("family"), text.node_family(n, {}).alias("node"), text.without_prefix(n, "bla", F.lit("x")).alias("rest"))


@query("STR-10 STR-22", "SELECT n_nationkey, r_name || ';' || n_name AS lineage, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE r_name || '; ' || n_name END AS joined FROM nation JOIN region ON n_regionkey = r_regionkey")
def lineages(t):
    x = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("n_nationkey", text.lineage([F.col("r_name"), F.col("n_name")]).alias("lineage"), text.joined_or_empty(F.when(F.col("n_nationkey") % 3 != 0, F.array("r_name", "n_name"))).alias("joined"))


_BASES = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC')"


def _bases(t):
    """The letters of every whole text, as bases."""
    s = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return t.documents.select("doc_id", F.translate(F.upper(s), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTAC").alias("s"))


@query("STR-11 STR-13 STR-19", f"""SELECT doc_id, translate(reverse(s), 'ACGT', 'TGCA') AS rc, substr(s, 1, CAST(length(s) - length(s) % 3 AS INT)) AS codons, substr(s, 4, 9) AS plus, translate(reverse(substr(s, 7, 9)), 'ACGT', 'TGCA') AS minus
    FROM (SELECT doc_id, {_BASES} AS s FROM documents)""")
def complements(t):
    s = F.col("s")
    cut = lambda strand, a: sequence.cut_feature(s, F.lit(a), F.lit(a + 5), F.lit(strand))
    return _bases(t).select("doc_id", sequence.reverse_complement(s).alias("rc"), sequence.whole_codons(s).alias("codons"), cut(1, 4).alias("plus"), cut(-1, 10).alias("minus"))


@query("STR-12 STR-14", f"""WITH b AS (SELECT doc_id, {_BASES} AS s FROM documents), c AS (SELECT doc_id, s, i, substr(s, CAST(3 * i + 1 AS INT), 3) AS codon FROM (SELECT doc_id, s, unnest(range(0, length(s) // 3)) AS i FROM b)),
    p AS (SELECT doc_id, string_agg(substr('{sequence.AMINO_ACIDS}', CAST(16 * (instr('TCAG', substr(codon, 1, 1)) - 1) + 4 * (instr('TCAG', substr(codon, 2, 1)) - 1) + instr('TCAG', substr(codon, 3, 1)) AS INT), 1), '' ORDER BY i) AS protein FROM c GROUP BY 1)
    SELECT doc_id, coalesce(protein, '') AS protein, string_split(coalesce(protein, ''), '*')[1] AS to_stop, length(s) % 3 = 0 AND instr(coalesce(protein, ''), '*') IN (0, length(coalesce(protein, ''))) AS complete FROM b LEFT JOIN p USING (doc_id)""")
def translations(t):
    s = F.col("s")
    return _bases(t).select("doc_id", sequence.translate(s).alias("protein"), sequence.translate(s, to_stop=True).alias("to_stop"), sequence.is_complete_orf(s).alias("complete"))


@query("STR-15 STR-16 SEQ-1", f"""WITH b AS (SELECT doc_id, {_BASES} AS s FROM documents), d AS (SELECT doc_id, '+' AS strand, s FROM b UNION ALL SELECT doc_id, '-', translate(reverse(s), 'ACGT', 'TGCA') FROM b),
    c AS (SELECT doc_id, strand, s, string_split_regex(s, '[ACGT]GG') AS pieces FROM d), e AS (SELECT doc_id, strand, length(s) AS n, len(pieces) AS m, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM c),
    h AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, strand ORDER BY k) + 3 * (k - 1) AS i FROM e)
    SELECT doc_id, strand, CAST(CASE WHEN strand = '+' THEN i ELSE n - i - 3 END AS INT) AS pos, substr(s, CAST(i - 3 AS INT), 4) AS win FROM (SELECT doc_id, strand, n, i FROM h WHERE k < m AND i >= 4) JOIN d USING (doc_id, strand)""")
def motif_hits(t):
    return sequence.motif_hits(_bases(t), "doc_id", "s", "NGG", 4).select("doc_id", "strand", F.col("at").alias("pos"), F.col("window").alias("win"))


#: Hits of the motif in whole texts: h(doc_id, strand, n, i, hit_at), hit_at in plus coordinates.
_HITS = f"""b AS (SELECT doc_id, {_BASES} AS s FROM documents), d AS (SELECT doc_id, '+' AS strand, s FROM b UNION ALL SELECT doc_id, '-', translate(reverse(s), 'ACGT', 'TGCA') FROM b),
    c AS (SELECT doc_id, strand, s, string_split_regex(s, '[ACGT]GG') AS pieces FROM d), e AS (SELECT doc_id, strand, length(s) AS n, len(pieces) AS m, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM c),
    i AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, strand ORDER BY k) + 3 * (k - 1) AS i FROM e), h AS (SELECT doc_id, strand, n, CAST(i AS BIGINT) AS i, CAST(CASE WHEN strand = '+' THEN i ELSE n - i - 3 END AS BIGINT) AS hit_at FROM i WHERE k < m)"""


@query("STR-17 STR-18", f"""WITH {_HITS}, f AS (SELECT doc_id, strand, min(hit_at) AS hit_at FROM h GROUP BY ALL)
    SELECT doc_id, strand, CAST(hit_at AS INT) AS hit_at, CASE WHEN hit_at >= 8 THEN CASE WHEN strand = '+' THEN substr(s, CAST(hit_at - 7 AS INT), 8) ELSE '' END ELSE '' END AS before_plus,
    CASE WHEN strand = '+' THEN CASE WHEN hit_at + 8 <= length(s) THEN substr(s, CAST(hit_at + 4 AS INT), 5) ELSE '' END ELSE CASE WHEN hit_at >= 5 THEN translate(reverse(substr(s, CAST(hit_at - 4 AS INT), 5)), 'ACGT', 'TGCA') ELSE '' END END AS after_hit,
    regexp_matches(CASE WHEN strand = '+' THEN substr(s, CAST(hit_at + 1 AS INT), 3) ELSE translate(reverse(substr(s, CAST(hit_at + 1 AS INT), 3)), 'ACGT', 'TGCA') END, '^[AG]GG$') AS fits FROM f JOIN b USING (doc_id)""")
def flanks(t):
    """Of each document's first hit on each strand: what stands beside it."""
    b = _bases(t)
    first = sequence.motif_hits(b, "doc_id", "s", "NGG").groupBy("doc_id", "strand").agg(F.min("at").alias("at"))
    x, s, side = first.join(b, "doc_id"), F.col("s"), F.when(F.col("strand") == "+", "plus").otherwise("minus")
    start, end = F.col("at") + 1, F.col("at") + 3
    own = F.substring(s, start, F.lit(3))
    fits = sequence.full_match(F.when(F.col("strand") == "+", own).otherwise(sequence.reverse_complement(own)), "RGG")
    before = F.when(F.col("strand") == "+", sequence.flank(s, start, end, side, 8, before=True)).otherwise("")
    return x.select("doc_id", "strand", F.col("at").alias("hit_at"), before.alias("before_plus"), sequence.flank(s, start, end, side, 5).alias("after_hit"), fits.alias("fits"))


@query("STR-21", """WITH a AS (SELECT page_id, unnest(string_split(replace(url, '/', '-'), '')) AS sym, generate_subscripts(string_split(replace(url, '/', '-'), ''), 1) - 1 AS col FROM pages WHERE url <> '')
    SELECT page_id, CAST(col AS BIGINT) AS col, CAST(row_number() OVER (PARTITION BY page_id ORDER BY col) - 1 AS BIGINT) AS idx FROM a WHERE sym <> '-'""")
def alignment_positions(t):
    x = t.pages.filter("url != ''").select("page_id", F.replace("url", F.lit("/"), F.lit("-")).alias("s"))
    return sequence.alignment_positions(x, "page_id", "s")


@query("STR-20", f"""WITH b AS (SELECT doc_id, {_BASES} AS s FROM documents), c AS (SELECT doc_id, i, substr(s, CAST(3 * i + 1 AS INT), 3) AS x, translate(reverse(substr(s, CAST(length(s) - 3 * i - 2 AS INT), 3)), 'ACGT', 'TGCA') AS y FROM (SELECT doc_id, s, unnest(range(0, length(s) // 3)) AS i FROM b))
    SELECT doc_id, count(*) AS n_changes, CAST(min(i) AS INT) AS first_at, CAST(max(i) AS INT) AS last_at FROM c WHERE x <> y GROUP BY 1""")
def codon_changes(t):
    s = F.col("s")
    x = _bases(t).select("doc_id", F.explode(sequence.codon_changes(s, sequence.reverse_complement(s))).alias("c"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_changes"), F.min("c.at").alias("first_at"), F.max("c.at").alias("last_at"))


@query("ARR-3", """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_orderkey, a.l_suppkey AS a, b.l_suppkey AS b, c.l_suppkey AS c FROM s a JOIN s b USING (l_orderkey) JOIN s c USING (l_orderkey)
    WHERE a.l_suppkey < b.l_suppkey AND b.l_suppkey < c.l_suppkey""")
def supplier_triples(t):
    x = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    return x.select("l_orderkey", F.explode(sequence.combinations(F.col("s"), 3)).alias("t")).select("l_orderkey", *[F.col("t")[i].alias(n) for i, n in enumerate("abc")])


@query("MTH-2", """SELECT s_suppkey, n_nationkey, round(2 * 6371 * asin(sqrt(least(1, pow(sin((radians(n_nationkey * 7 - 90) - radians(s_nationkey * 7 - 90)) / 2), 2) + cos(radians(s_nationkey * 7 - 90)) * cos(radians(n_nationkey * 7 - 90))
    * pow(sin(radians(n_nationkey * 3.0 - s_suppkey * 3.6) / 2), 2)))), 3) AS km FROM supplier JOIN nation ON n_nationkey = s_suppkey % 25""")
def haversine(t):
    x = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_suppkey") % 25)
    la, lo = F.col("s_nationkey") * 7 - 90, F.col("s_suppkey") * 3.6
    return x.select("s_suppkey", "n_nationkey", F.round(numbers.haversine_km(la, lo, F.col("n_nationkey") * 7 - 90, F.col("n_nationkey") * 3.0), 3).alias("km"))


@query("MTH-1 MTH-3 MTH-4", """SELECT n_nationkey, round(n_regionkey / (CAST(n_nationkey + 2 AS DOUBLE) * (n_nationkey + 1)), 9) AS density, round(2.0 * n_regionkey / (n_nationkey + 2), 9) AS degree,
    round(CASE WHEN n_regionkey <> 0 AND n_nationkey <> 0 THEN abs(n_regionkey / n_nationkey) * sqrt(pow(0.5 / n_regionkey, 2) + pow(0.25 / n_nationkey, 2)) END, 9) AS err FROM nation""")
def graph_formulas(t):
    a, b = F.col("n_regionkey").cast("double"), F.col("n_nationkey").cast("double")
    return t.nation.select("n_nationkey", F.round(numbers.density(b + 2, a), 9).alias("density"), F.round(numbers.average_degree(b + 2, a), 9).alias("degree"), F.round(numbers.ratio_error(a, F.lit(0.5), b, F.lit(0.25)), 9).alias("err"))


@query("ARR-2", "SELECT n_nationkey, CAST(i AS INT) AS pos FROM nation, range(0, 30) r(i) WHERE i BETWEEN n_nationkey AND n_nationkey + n_regionkey")
def range_expansion(t):
    return t.nation.select("n_nationkey", F.explode(F.sequence(F.col("n_nationkey").cast("int"), (F.col("n_nationkey") + F.col("n_regionkey")).cast("int"))).alias("pos"))


@query("ARR-4 ARR-5", """SELECT vec_id, len(list_filter(embedding[33:], lambda x: x <= 0.0)) / 32 AS share, CAST(1 + vec_id % 3 AS INT) AS parsed FROM embeddings""")
def tail_share(t):
    written = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 3).cast("int")), lambda i: F.concat(F.lit("'x"), i.cast("string"), F.lit("'"))), ", "), F.lit("]"))
    parsed = F.size(text.list_literal(written))
    return t.embeddings.select("vec_id", text.tail_share(F.col("embedding"), F.lit(32), 0.0).alias("share"), parsed.alias("parsed"))


@query("MAP-1 MAP-2 JSN-1", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS high, coalesce(json_extract_string(props, '$.none'), '-') AS missing FROM events")
def json_map(t):
    m = F.from_json("props", "map<string,bigint>")
    x = t.events.select("event_id", "props", m.alias("m"), text.any_value(m, lambda v: v > 50).alias("high"))
    return x.select("event_id", F.explode("m").alias("key", "v"), "high", F.coalesce(F.get_json_object("props", "$.none"), F.lit("-")).alias("missing"))


@query("PRJ-2 SRC-8", "SELECT event_id, 'NZ_CP' || CAST(user_id AS VCHAR) || '.1' AS container, event_id AS start, event_id + 9 AS stop FROM events".replace("VCHAR", "VARCHAR"))
def identifier_parts(t):
    pid = F.concat(F.lit("NZ_CP"), F.col("user_id").cast("string"), F.lit(".1_"), F.col("event_id").cast("string"), F.lit("_"), (F.col("event_id") + 9).cast("string"))
    return t.events.select("event_id", pid.alias("pid")).select("event_id", *[c.alias(k) for k, c in text.pid_parts(F.col("pid")).items()])


@query("PRJ-12 PRJ-14 PRJ-15", f"WITH {FEATURES} SELECT sub, round(value / 10, 6) AS value_share, round(strand / 10, 6) AS strand_share, value > 60 OR strand < 0 AS any_flag, round((value + strand) / 2, 6) AS mean FROM f")
def bulk_columns(t):
    f = features(t)
    shares = [F.round(F.col(c) / 10, 6).alias(f"{c}_share") for c in ("value", "strand")]
    return f.select("sub", *shares, ((F.col("value") > 60) | (F.col("strand") < 0)).alias("any_flag"), F.round(aggregates.row_mean(["value", "strand"]), 6).alias("mean"))


#: Editors: their window within a guide's twenty bases, the change they make, and the codons that it is to end in.
_EDITORS = [("C to T", 4, 8, "C", "T", ["TAA", "TAG", "TGA"]), ("A to G", 4, 7, "A", "G", ["GTG", "ACG"])]
_EDITORS_SQL = ", ".join(f"('{n}', {a}, {z}, '{x}', '{y}', {c})" for n, a, z, x, y, c in _EDITORS)


@query("SEQ-1 SEQ-3 SEQ-4 SEQ-5 SEQ-9", f"""WITH {_HITS}, ed AS (SELECT * FROM (VALUES {_EDITORS_SQL}) v(editor, low, high, old, new, codons)),
    g AS (SELECT h.doc_id, strand, hit_at, substr(CASE WHEN strand = '+' THEN s ELSE translate(reverse(s), 'ACGT', 'TGCA') END, CAST(i - 19 AS INT), 20) AS guide, s FROM h JOIN b USING (doc_id) WHERE i >= 22),
    w AS (SELECT *, unnest(range(low, high + 1)) AS site FROM g, ed), p AS (SELECT *, CASE WHEN strand = '+' THEN hit_at - 20 + site - 1 ELSE hit_at + 3 + 20 - site END AS pos FROM w WHERE substr(guide, CAST(site AS INT), 1) = old),
    q AS (SELECT *, substr(s, CAST(pos - pos % 3 + 1 AS INT), 3) AS codon, CASE WHEN strand = '+' THEN new ELSE translate(new, 'ACGT', 'TGCA') END AS put FROM p),
    r AS (SELECT *, substr(codon, 1, CAST(pos % 3 AS INT)) || put || substr(codon, CAST(pos % 3 + 2 AS INT), 3) AS changed FROM q WHERE length(codon) = 3)
    SELECT doc_id, strand, CAST(hit_at AS INT) AS hit_at, editor, CAST(site AS INT) AS site, CAST(pos AS INT) AS pos, guide, codon, changed, array_to_string(list_filter(range(low, high + 1), lambda j: j <> site AND substr(guide, CAST(j AS INT), 1) = old), ',') AS others FROM r WHERE list_contains(codons, changed)""")
def candidate_sites(t):
    editors = t.spark.createDataFrame(_EDITORS, "editor string, low int, high int, old string, new string, codons array<string>")
    return sequence.candidate_sites(_bases(t), "doc_id", "s", "NGG", editors).withColumnRenamed("at", "hit_at")


@query("SEQ-8", f"""WITH b AS (SELECT doc_id, {_BASES} AS s FROM documents), k AS (SELECT DISTINCT doc_id, substr(s, CAST(i + 1 AS INT), 24) AS kmer FROM (SELECT doc_id, s, unnest(range(0, length(s) - 23)) AS i FROM b))
    SELECT q.doc_id AS a, t.doc_id AS b, count(*) AS shared FROM k q JOIN k t USING (kmer) WHERE q.doc_id % 20 = 0 GROUP BY ALL HAVING count(*) >= 10""")
def shared_kmers(t):
    """Queries against all rows: every twentieth document is a query."""
    b = _bases(t)
    q = b.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "a")
    return sequence.shared_kmers(q, b.withColumnRenamed("doc_id", "b"), "a", "b", "s", 24, 10)


@query("SEQ-18")
def alignment_map(t):
    """Each url beside the next page's, whole."""
    b = t.pages.select("page_id", "url")
    pairs = b.withColumn("next", F.col("page_id") + 1).join(b.select(F.col("page_id").alias("next"), F.col("url").alias("url2")), "next")
    return sequence.alignment_map(pairs.select("page_id", F.col("url").alias("a"), F.col("url2").alias("b")), "page_id", "a", "b")
