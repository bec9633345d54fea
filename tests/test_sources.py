"""Readers and writers, the name rules, and the driver's entry points."""

import importlib.util
import json

import pytest
from pyspark.sql import functions as F

from cyclora import schemas
from cyclora.functions import sequence, text
from cyclora.functions.numbers import geometric_sizes
from cyclora.sources import readers, sinks
from cyclora.streaming import events


def test_domain_table(spark, tmp_path):
    a = "Tok PF1.2 100 NZ_CP1.1_900_100 - 90 1e-5 30.1 0.1 1 2 1e-6 1e-7 29 0.2 1 50 5 60 4 61 0.9 a long description here"
    (tmp_path / "x.txt").write_text(f"# head\n{a}\n\n{a.replace('_900_100', '_7_8')}\n#end")
    r, s = readers.domain_table(spark, str(tmp_path / "x.txt")).orderBy(F.desc("stop")).collect()
    assert (r.target_name, r.description, r.tlen, r.full_e_value, r.ali_to, r.acc) == ("Tok", "a long description here", 100, 1e-5, 60, 0.9)
    assert (r.plasmid, r.start, r.stop, r.strand, s.start, s.strand) == ("NZ_CP1.1", 100, 900, -1, 7, 1)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x some words\nACGT\nAC\n>empty\n>y\nGG\r\nTT")
    rows = {r.id: (r.description, r.sequence) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"x": ("some words", "ACGTAC"), "empty": ("", ""), "y": ("", "GGTT")}
    assert sorted(r.id for r in readers.fasta_ids(spark, str(tmp_path / "a.fa")).collect()) == ["empty", "x", "y"]
    d = spark.createDataFrame([("p", "AAA"), ("q", "CC")], "k string, s string")
    sinks.fasta(d, str(tmp_path / "out"), "k", "s")
    assert {(r.id, r.sequence) for r in readers.fasta(spark, str(tmp_path / "out")).collect()} == {("p", "AAA"), ("q", "CC")}
    (tmp_path / "s.txt").write_text(">g1\nplus\n>g2\nminus\n")
    assert {tuple(r) for r in readers.labelled_pairs(spark, str(tmp_path / "s.txt")).collect()} == {("g1", "plus"), ("g2", "minus")}


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a, b"\n2,c\n')
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "a.csv"), "id int, name string").collect()] == [(1, "a, b"), (2, "c")]
    (tmp_path / "h.tsv").write_text("q\ts\t99.5\t10\t11\t12\t0.1\t50\t88\n")
    assert readers.headerless(spark, str(tmp_path / "h.tsv"), schemas.SIMILARITY_HIT).first().pident == 99.5
    (tmp_path / "bad.csv").write_text("id,name\nx,y\n")
    with pytest.raises(Exception, match="MALFORMED|BAD"):
        readers.delimited(spark, str(tmp_path / "bad.csv"), "id int, name string").collect()


def test_ontology_skips_what_is_no_object(spark, tmp_path):
    model = {"ARO_accession": "3", "ARO_name": "n", "model_id": "1", "ARO_category": {"9": {"category_aro_name": "cat", "category_aro_class_name": "c"}}, "model_sequences": {"sequence": {"5": {"protein_sequence": {"accession": "P", "sequence": "MK"}}}}}
    (tmp_path / "o.json").write_text(json.dumps({"1": model, "_version": "3.2", "_n": 7, "2": {"ARO_accession": "4"}}))
    rows = {r.key: r for r in readers.ontology(spark, str(tmp_path / "o.json")).collect()}
    assert rows.keys() == {"1", "2"} and rows["1"].categories == ["cat"] and rows["1"].sequences[0].sequence == "MK" and rows["2"].categories == []


def test_directories_batches_and_caches(spark, tmp_path):
    for n in ("A_1_2_x.fa", "B_C_30_40_y.fa", "other.txt"):
        (tmp_path / n).write_text("z")
    got = {tuple(r)[1:] for r in readers.directory(spark, str(tmp_path), text.PID_FILE, {"c": "string", "a": "long", "b": "long", "g": "string"}).collect()}
    assert got == {("A", 1, 2, "x"), ("B_C", 30, 40, "y")}
    e = spark.createDataFrame([(2, "a"), (10, "b")], "batch int, src string")
    assert readers.latest_batch(e, "batch").first().src == "b"
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.withColumn("v", F.length("k"))

    want = spark.createDataFrame([("a",), ("bb",)], "k string")
    for _ in range(2):
        assert {(r.k, r.v) for r in readers.cached_lookup(spark, want, str(tmp_path / "cache"), "k", compute).collect()} == {("a", 1), ("bb", 2)}
    assert calls == [2, 0]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "id int, t string")
    sinks.csv(d, str(tmp_path / "c"))
    assert {tuple(r) for r in readers.delimited(spark, str(tmp_path / "c"), "id int, t string").collect()} == {(1, 'a "q", b'), (2, None)}
    sinks.parquet(d, str(tmp_path / "p"), ["id"])
    sinks.append(d.select("t", "id"), str(tmp_path / "q"))
    sinks.append(d.select("t", "id"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    nodes, e = spark.createDataFrame([("a",), ("b&",)], "node string"), spark.createDataFrame([("a", "b&", 3)], "src string, dst string, weight int")
    xml = sinks.graph_xml(nodes, e)
    assert '<node id="b&amp;"/>' in xml and '<data key="weight">3</data>' in xml
    sinks.graph_tables(nodes, e, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).columns == ["src", "dst", "weight", "id"]
    sinks.report(spark.createDataFrame([("b: 1",), ("a: 2",)], "line string"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a: 2", "b: 1"]


def test_graph_documents(spark, tmp_path):
    rows = [("a", "b&", ' x <"y"> & \n z'), ("b&", "a", None), ("a", "b&", ""), ("a", "ä\u4e2d", "1")]
    e = spark.createDataFrame(rows, "src string, dst string, label string")
    nodes = e.selectExpr("explode(array(src, dst)) AS node").distinct()
    for n in (9, 10):
        sinks.graph_xml_file(nodes, e.filter(f"{n} = 10 or src = 'a'"), str(tmp_path / f"{n}_g.graphml"))
    got = readers.latest_graph(spark, str(tmp_path), "_g.graphml", ["label"]).collect()
    blank = lambda x: x or None  # noqa: E731  an empty element and none read alike
    assert sorted((r.src, r.dst, str(blank(r.label))) for r in got) == sorted((a, b, str(blank(c))) for a, b, c in rows)
    assert {r.batch for r in got} == {10} and len({r.id for r in got}) == len(rows)
    import xml.etree.ElementTree as xml

    (part,) = (tmp_path / "10_g.graphml").glob("part-*")
    root = xml.fromstring(part.read_text())
    assert [x.tag.split("}")[1] for x in root] == ["key", "graph"] and len(root[1]) == 3 + len(rows)


def test_sequences(spark):
    d = spark.createDataFrame([("x", "GGNGGGGTCAGG"), ("y", "")], "k string, s string")
    assert d.select(sequence.reverse_complement(F.col("s")).alias("r")).first().r == "CCTGACCCCNCC"
    hits = {(r.k, r.strand, r["at"]) for r in sequence.motif_hits(d, "k", "s", "GGG").collect()}
    assert hits == {("x", "+", 3)}
    one = spark.createDataFrame([("ATGAAATAG",), ("AUGTAGAAA",), ("ATGA",), (None,)], "s string")
    rows = one.select(sequence.translate(F.col("s")).alias("p"), sequence.translate(F.col("s"), to_stop=True).alias("t"), sequence.is_complete_orf(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("MK*", "MK", True), ("M*K", "M", False), ("M", "M", False), (None, None, None)]
    assert geometric_sizes(1) == [1] and geometric_sizes(1000, 4) == [1, 10, 100, 1000] and geometric_sizes(0) == []


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.edge_counts(stream, "user_id", "event_type").writeStream.outputMode("complete").format("memory").queryName("edge_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("edge_counts").collect()}
    assert got == {tuple(r) for r in events.edge_counts(table, "user_id", "event_type").collect()}
    assert events.windowed_counts(table, "ts", "event_type", "value").agg(F.sum("n")).first()[0] == table.count()


def test_entry_points(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("cyclora.llm", "corpus_pipeline")) else found(n, *a))
    assert entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())


def test_alignment_is_the_best_one():
    import random
    from functools import cache

    def score(a, b, placed):
        total, i, j = 0.0, 0, 0
        for x, y in [*[(i, y) for i, y in enumerate(placed) if y >= 0], (len(a), len(b))]:
            gaps = [(x - i), (y - j)]
            for n in gaps:
                if n:
                    total += -10 - 0.5 * (n - 1)
            if x < len(a):
                total += 2 if a[x] == b[y] else -1
            i, j = x + 1, y + 1
        return total

    def best(a, b):
        @cache
        def go(i, j, last):
            if i == len(a) and j == len(b):
                return 0.0
            out = []
            if i < len(a) and j < len(b):
                out.append((2 if a[i] == b[j] else -1) + go(i + 1, j + 1, 0))
            if i < len(a):
                out.append((-0.5 if last == 1 else -10) + go(i + 1, j, 1))
            if j < len(b):
                out.append((-0.5 if last == 2 else -10) + go(i, j + 1, 2))
            return max(out)

        return go(0, 0, 0)

    rng = random.Random(21)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(9))) for _ in range(2))
        assert score(a, b, sequence.align(a, b)) == pytest.approx(best(a, b)), (a, b)
    assert sequence.align("ACGT", "ACGT") == [0, 1, 2, 3] and sequence.align("", "AC") == []
