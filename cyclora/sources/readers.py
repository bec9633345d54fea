"""Readers: Parquet, delimited text, domain tables, FASTA, nested JSON, directory listings, batches, GraphML."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora import schemas


def parquet(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """One table from files, folders or globs."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


def delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Text with quoted fields, so a comma within quotes is no separator; a line of another form fails."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST").option("quote", '"').option("escape", '"').csv(path)


def headerless(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t") -> DataFrame:
    return delimited(spark, path, schema, sep, False)


def filtered_copy(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is kept: what a chunked filter would write, in one scan."""
    return df.join(keep.select(key).distinct(), key, "left_semi")


def domain_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whitespace-aligned domain hits: 22 fields and a description that may hold blanks; comment lines are left out. The
    identifier's container, start and stop, normalised so that start <= stop, come with it."""
    from cyclora.functions.text import pid_parts

    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+", 23)
    names = [x.split()[:2] for x in schemas.FEATURE_HIT.split(",")]
    out = lines.select(*[F.get(parts, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)])
    pid = pid_parts(F.col("query_name"))
    low, high = F.least(pid["start"], pid["stop"]), F.greatest(pid["start"], pid["stop"])
    strand = F.when(pid["start"] <= pid["stop"], 1).when(pid["start"] > pid["stop"], -1)
    return out.withColumns({"plasmid": pid["container"], "start": low, "stop": high, "strand": strand})


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, description, sequence) of FASTA records, wrapped or not. Records are cut at lines that begin with `>`, so a
    file is split among tasks between records."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.replace(F.col("value"), F.lit("\r"), F.lit("")), "^>", "")
    x = raw.select(text.alias("t")).filter(F.trim("t") != "")
    head = F.substring_index("t", "\n", 1)
    body = F.when(F.col("t").contains("\n"), F.regexp_replace(F.expr("substring(t, length(substring_index(t, '\n', 1)) + 2)"), r"\s", "")).otherwise("")
    return x.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("sequence"))


def fasta_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).filter(F.col("value").startswith(">"))
    return lines.select(F.regexp_extract("value", r"^>(\S*)", 1).alias("id"))


def labelled_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, value) of two-line records whose second line is a value, such as a strand."""
    return fasta(spark, path).select("id", F.col("sequence").alias("value"))


def directory(spark: SparkSession, path: str, pattern: str, columns: dict[str, str]) -> DataFrame:
    """File names as a table: `columns` names the pattern's groups and their types. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    hit = files.withColumn("_n", name).filter(F.col("_n").rlike(pattern))
    return hit.select(F.col("_n").alias("file"), *[F.regexp_extract("_n", pattern, i + 1).cast(kind).alias(c) for i, (c, kind) in enumerate(columns.items())])


def ontology(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(key, accession, name, description, categories, sequences): a JSON object of models, one a row; entries that are no
    objects are skipped."""
    raw = spark.read.option("wholetext", True).text(path)
    # values stay text first, so that an entry of another form does not spoil the object
    entries = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "json")).filter(F.ltrim("json").startswith("{"))
    one = schemas.ONTOLOGY.strip().removeprefix("map<string,").strip()[:-1]
    x = entries.select("key", F.from_json("json", one).alias("m")).filter(F.col("m").isNotNull())
    categories = F.array_sort(F.transform(F.coalesce(F.map_values("m.ARO_category"), F.array()), lambda c: c["category_aro_name"]))
    sequences = F.transform(F.coalesce(F.map_values("m.model_sequences.sequence"), F.array()), lambda s: s["protein_sequence"])
    return x.select("key", F.col("m.ARO_accession").alias("accession"), F.col("m.ARO_name").alias("name"), F.coalesce("m.ARO_description", F.lit("")).alias("description"), categories.alias("categories"), sequences.alias("sequences"))


def latest_batch(edges: DataFrame, batch: str) -> DataFrame:
    """The edges of the largest batch number; partition pruning makes it one folder."""
    last = edges.agg(F.max(batch)).first()[0]
    return edges.filter(F.col(batch) == F.lit(last))


def graph_xml(spark: SparkSession, path: str, attributes: list[str]) -> DataFrame:
    """(id, src, dst, attributes) of the edges of GraphML documents; data that an edge lacks is null."""
    shape = "_id string, _source string, _target string, data array<struct<_key: string, _VALUE: string>>"
    x = spark.read.format("xml").option("rowTag", "edge").option("ignoreSurroundingSpaces", False).schema(shape).load(path)
    value = lambda a: F.get(F.filter("data", lambda d: d["_key"] == a), F.lit(0))["_VALUE"]
    return x.select(F.col("_id").alias("id"), F.col("_source").alias("src"), F.col("_target").alias("dst"), *[value(a).alias(a) for a in attributes])


def latest_graph(spark: SparkSession, folder: str, suffix: str, attributes: list[str]) -> DataFrame:
    """The edges of the GraphML document `<number><suffix>` in a folder whose number is the largest, with it as `batch`;
    contents of the others are not read."""
    names = spark.read.format("binaryFile").load(f"{folder}/*{suffix}").select(F.regexp_extract("path", r"/(\d+)" + re.escape(suffix), 1).cast("long").alias("n"))
    last = names.agg(F.max("n")).first()[0]
    if last is None:
        raise FileNotFoundError(f"{folder}/*{suffix}")
    return graph_xml(spark, f"{folder}/{last}{suffix}", attributes).withColumn("batch", F.lit(last))


def cached_lookup(spark: SparkSession, wanted: DataFrame, cache_path: str, key: str, compute) -> DataFrame:
    """Wanted keys with their values from a Parquet cache; missing ones are computed and added to it."""
    try:
        have = spark.read.parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = None
    missing = wanted.select(key).distinct() if have is None else wanted.select(key).distinct().join(have, key, "left_anti")
    compute(missing).write.mode("append").parquet(cache_path)
    return wanted.join(spark.read.parquet(cache_path), key, "left")
