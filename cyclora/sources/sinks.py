"""Writers: delimited text, Parquet, FASTA, graphs, reports. All but graph_xml write in parallel."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def fasta(df: DataFrame, path: str, key: str, sequence: str, per_record: bool = False) -> None:
    """Records `>key` and sequence; with per_record a folder for each key."""
    rows = df.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(sequence)).alias("value"), *([F.col(key).alias("record")] if per_record else []))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("record") if per_record else writer).text(path)


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, edges with ids."""
    parquet(nodes, f"{path}/nodes")
    parquet(edges.withColumn("id", F.sha2(F.concat_ws("\t", *[F.col(c).cast("string") for c in edges.columns]), 256)), f"{path}/edges")


def graph_xml(nodes: DataFrame, edges: DataFrame, most: int = 1_000_000) -> str:
    """A small graph as GraphML text; larger ones than `most` edges raise ValueError."""
    if edges.count() > most or nodes.count() > most:
        raise ValueError(f"more than {most} edges or nodes; write graph_tables")
    attributes = [c for c in edges.columns if c not in ("src", "dst")]
    out = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    out += [f'<key id={quoteattr(a)} for="edge" attr.name={quoteattr(a)} attr.type="string"/>' for a in attributes]
    out.append('<graph edgedefault="directed">')
    out += [f"<node id={quoteattr(str(r['node']))}/>" for r in nodes.select("node").orderBy("node").collect()]
    for i, r in enumerate(edges.orderBy("src", "dst").collect()):
        data = "".join(f"<data key={quoteattr(a)}>{escape(str(r[a]))}</data>" for a in attributes)
        out.append(f'<edge id="e{i}" source={quoteattr(str(r["src"]))} target={quoteattr(str(r["dst"]))}>{data}</edge>')
    return "\n".join([*out, "</graph>", "</graphml>"])


def graph_xml_file(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as one GraphML document. A document is one file, so one task sorts and writes its lines; nothing passes the
    driver. Edges get ids; their other columns become data, nulls none."""
    attributes = [c for c in edges.columns if c not in ("src", "dst")]

    def safe(c):
        out = F.col(c).cast("string")
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
        return out

    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id={quoteattr(a)} for="edge" attr.name={quoteattr(a)} attr.type="string"/>' for a in attributes]
    frame = [(0, f"{i:06d}", x) for i, x in enumerate([*head, '<graph edgedefault="directed">'])] + [(3, "0", "</graph>"), (3, "1", "</graphml>")]
    identity = F.sha2(F.to_json(F.struct(*edges.columns)), 256)
    data = [F.coalesce(F.concat(F.lit(f"<data key={quoteattr(a)}>"), safe(a), F.lit("</data>")), F.lit("")) for a in attributes]
    line = F.concat(F.lit('<edge id="e'), identity, F.lit('" source="'), safe("src"), F.lit('" target="'), safe("dst"), F.lit('">'), *data, F.lit("</edge>"))
    lines = spark.createDataFrame(frame, "part int, at string, value string")
    lines = lines.unionByName(nodes.select(F.lit(1).alias("part"), F.col("node").cast("string").alias("at"), F.concat(F.lit('<node id="'), safe("node"), F.lit('"/>')).alias("value")))
    lines = lines.unionByName(edges.select(F.lit(2).alias("part"), identity.alias("at"), line.alias("value")))
    lines.repartition(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def report(lines: DataFrame, path: str) -> None:
    lines.select("line").orderBy("line").coalesce(1).write.mode("overwrite").text(path)
