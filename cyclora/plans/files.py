"""Queries of readers and writers: tables go out to the shared folder in some form and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cyclora.functions import text
from cyclora.operators.graph import nodes_of
from cyclora.plans.registry import query
from cyclora.session import shared_folder
from cyclora.sources import readers, sinks


def _new(t) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("SRC-2 SRC-7 SNK-1 SNK-8", "SELECT c_custkey, c_name || ', ' || c_mktsegment AS label, c_acctbal FROM customer")
def csv_round_trip(t):
    at = _new(t)
    sinks.csv(t.customer.select("c_custkey", F.concat_ws(", ", "c_name", "c_mktsegment").alias("label"), "c_acctbal"), at)
    return readers.delimited(t.spark, at, "c_custkey long, label string, c_acctbal double")


@query("SRC-3 SRC-4", "SELECT p_partkey, p_brand, p_size FROM part")
def headerless_table(t):
    at = _new(t)
    t.part.select("p_partkey", "p_brand", "p_size").write.option("sep", "\t").csv(at)
    return readers.headerless(t.spark, at, "p_partkey long, p_brand string, p_size int")


@query("SRC-8 PRJ-1", "SELECT 'tok' || CAST(event_id % 5 AS VARCHAR) AS target_name, 'C' || CAST(user_id AS VARCHAR) AS plasmid, event_id AS start, event_id + 30 AS stop, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS strand, value AS full_score, 'a b ' || event_type AS description FROM events")
def domain_table(t):
    at, e = _new(t), F.col("event_id")
    a, b = F.when(e % 2 == 0, e).otherwise(e + 30), F.when(e % 2 == 0, e + 30).otherwise(e)
    pid = F.concat(F.lit("C"), F.col("user_id").cast("string"), F.lit("_"), a.cast("string"), F.lit("_"), b.cast("string"))
    fields = [F.concat(F.lit("tok"), (e % 5).cast("string")), F.lit("PF1.1"), F.lit("9"), pid, F.lit("-"), F.lit("8"), F.lit("1e-9"), F.col("value").cast("string"), *[F.lit("1")] * 14, F.concat(F.lit("a b "), F.col("event_type"))]
    t.events.select(F.concat_ws("  ", *fields).alias("value")).write.text(at)
    return readers.domain_table(t.spark, at).select("target_name", "plasmid", "start", "stop", "strand", "full_score", "description")


@query("SRC-9 SRC-10 SRC-11 SNK-4", "SELECT CAST(p_partkey AS VARCHAR) AS id, upper(replace(p_type, ' ', '')) AS sequence FROM part")
def fasta_round_trip(t):
    at = _new(t)
    sinks.fasta(t.part.select(F.col("p_partkey").cast("string").alias("id"), F.upper(F.replace("p_type", F.lit(" "), F.lit(""))).alias("s")), at, "id", "s")
    return readers.fasta(t.spark, at).select("id", "sequence")


@query("SRC-12", "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def fasta_ids(t):
    at = _new(t)
    sinks.fasta(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("s")), at, "id", "s")
    return readers.fasta_ids(t.spark, at)


@query("SRC-13", "SELECT table_name FROM (VALUES ('nation'), ('region'), ('supplier')) v(table_name)")
def directory_listing(t):
    return readers.directory(t.spark, t.folder, r"^(nation|region|supplier)\.parquet$", {"table_name": "string"}).select("table_name")


@query("SRC-14 MAP-1 MAP-2", """SELECT CAST(p_partkey AS VARCHAR) AS key, 'A' || CAST(p_partkey AS VARCHAR) AS accession, p_name AS name, CASE WHEN p_size > 25 THEN least(p_type, p_brand) || ';' || greatest(p_type, p_brand) ELSE p_type END AS categories,
    CAST(p_size % 2 AS INTEGER) AS n_sequences FROM part""")
def ontology_scan(t):
    """A JSON object for each brand, with an entry for each part."""
    at = _new(t)
    called = lambda c: F.struct(F.col(c).alias("category_aro_name"))
    categories = F.when(F.col("p_size") > 25, F.create_map(F.lit("a"), called("p_type"), F.lit("b"), called("p_brand"))).otherwise(F.create_map(F.lit("a"), called("p_type")))
    protein = F.struct(F.struct(F.lit("P").alias("accession"), F.col("p_type").alias("sequence")).alias("protein_sequence"))
    sequences = F.when(F.col("p_size") % 2 == 1, F.struct(F.create_map(F.lit("5"), protein).alias("sequence")))
    key = F.col("p_partkey").cast("string")
    model = F.struct(F.concat(F.lit("A"), key).alias("ARO_accession"), F.col("p_name").alias("ARO_name"), categories.alias("ARO_category"), sequences.alias("model_sequences"))
    entries = t.part.select("p_brand", F.struct(key.alias("key"), model.alias("value")).alias("entry"))
    objects = entries.groupBy("p_brand").agg(F.to_json(F.map_from_entries(F.collect_list("entry"))).alias("value"))
    objects.write.partitionBy("p_brand").text(at)
    o = readers.ontology(t.spark, at)
    return o.select("key", "accession", "name", text.joined_or_empty(F.col("categories"), ";").alias("categories"), F.size("sequences").alias("n_sequences"))


@query("SRC-15 SNK-2 SNK-3 SNK-5", "SELECT n_nationkey AS src, n_regionkey AS dst, 4 AS batch FROM nation WHERE n_regionkey = 4")
def latest_batch(t):
    at = _new(t)
    e = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.col("n_regionkey").alias("batch"))
    sinks.parquet(e, at, ["batch"])
    return readers.latest_batch(t.spark.read.parquet(at), "batch").select("src", "dst", "batch")


@query("SRC-15 SNK-3", """SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST(n_regionkey AS VARCHAR) AS dst, n_name || ' & <"' || CAST(n_regionkey AS VARCHAR) || '">' AS label, 10 AS batch FROM nation""")
def graph_documents(t):
    """Two GraphML documents, of which the one with the larger number comes back."""
    at = _new(t)
    e = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.concat("n_name", F.lit(' & <"'), F.col("n_regionkey").cast("string"), F.lit('">')).alias("label"))
    for number, part in ((9, e.filter("dst = 0")), (10, e)):
        sinks.graph_xml_file(nodes_of(part), part, f"{at}/{number}_network.graphml")
    return readers.latest_graph(t.spark, at, "_network.graphml", ["label"]).select("src", "dst", "label", F.col("batch").cast("int").alias("batch"))


@query("SRC-19", "SELECT n_nationkey, length(n_name) AS v FROM nation")
def cached_lookup(t):
    at = _new(t)
    names = t.nation.select("n_nationkey", "n_name")
    compute = lambda missing: missing.join(names, "n_nationkey").select("n_nationkey", F.length("n_name").cast("long").alias("v"))
    readers.cached_lookup(t.spark, t.nation.filter("n_regionkey = 1").select("n_nationkey"), at, "n_nationkey", compute)
    return readers.cached_lookup(t.spark, t.nation.select("n_nationkey"), at, "n_nationkey", compute)
