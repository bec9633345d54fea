"""Line dedup by overlapping three-line windows.

A document's lines that are not blank (cut at line feeds, blanks at either end aside) make overlapping windows of three.
Windows are hashed from their lines' hashes to 128 bits and counted over all documents. Of each repeated window the first
occurrence, by document id and position, stays; every later one is covered, and the covered lines of a document, merged,
are removed with the blank lines between them. A later occurrence that overlaps its own first one covers only what is
beyond it. Documents of fewer than three such lines have no window and stay as they are; a document whose lines all go
stays with an empty text.

The windows are written once. A hot window is one row in the table of repeated windows, whose heads are found before the
shuffle; that table is written before it is joined, so that both sides of the join are plain shuffles and Spark can split a
hot window's rows. Texts are shuffled once, to the spans that they lose.

Nulls: a null text stays null. Rows of one id and text are one document and change alike. A null id sorts first. Extra
columns are kept; where one has the name of a report column, the report's is named n_lines_2 and so on. Empty tables give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import durable, free, text_key

SIZE = 3


def windows(docs: DataFrame, doc_id: str, text: str, size: int = SIZE) -> DataFrame:
    """A row per window: id, key, first and last (line numbers), w1 and w2 (its hash)."""
    lines = F.split(F.col(text), "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    kept = F.filter(numbered, lambda x: x["line"] != "")
    hashed = F.transform(kept, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))
    rows = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), hashed.alias("h")).filter(F.size("h") >= size)
    own = lambda i, name: [F.get("h", i + k)[name] for k in range(size)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("h") - size),
        lambda i: F.struct(
            F.get("h", i)["at"].alias("first"), F.get("h", i + (size - 1))["at"].alias("last"), F.xxhash64(*own(i, "a")).alias("w1"), F.xxhash64(*own(i, "b")).alias("w2")
        ),
    )
    return rows.select("id", "key", F.explode(each).alias("w")).select("id", "key", "w.*")


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """A row per document that loses lines: id, key, spans (of line numbers, both ends in)."""
    each = durable(windows(docs, doc_id, text, size))
    place = F.struct("id", "key", "first", "last")
    repeated = each.groupBy("w1", "w2").agg(F.min(place).alias("head"), F.max(place).alias("end")).filter("head != end").select("w1", "w2", "head")
    later = each.join(durable(repeated), ["w1", "w2"]).filter(place != F.col("head"))
    same = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    start = F.when(same, F.greatest("first", F.col("head.last") + 1)).otherwise(F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set(F.struct(start.alias("a"), F.col("last").alias("b"))).alias("spans"))


def without(text: Column, spans: Column) -> Column:
    """The text without the lines in the spans; its cost is in proportion to the lines, whatever the spans."""
    lines = F.split(text, "\n", -1)
    gone = F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, report: bool = False) -> DataFrame:
    """docs with the covered lines gone from the text; with report also n_lines and n_removed."""
    names = [free(docs.columns, n) for n in ("_line_id", "_line_key", "_line_spans", "n_lines", "n_removed")]
    line_id, line_key, line_spans, n_lines, n_removed = names
    gone = covered(docs, doc_id, text, size).select(F.col("id").alias(line_id), F.col("key").alias(line_key), F.col("spans").alias(line_spans))
    same = F.col(doc_id).eqNullSafe(F.col(line_id)) & (text_key(F.col(text)) == F.col(line_key))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left")
    new = F.when(F.col(line_spans).isNotNull(), without(F.col(text), F.col(line_spans))).otherwise(F.col(text))
    if not report:
        return joined.withColumn(text, new).select(docs.columns)
    count = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(x, "\n", -1))).cast("bigint")
    out = joined.withColumn(n_lines, count(F.col(text))).withColumn(text, new)
    return out.withColumn(n_removed, F.col(n_lines) - count(F.col(text))).select(*docs.columns, n_lines, n_removed)


#: The same in SQL, for DuckDB.
ORACLE_SQL = """
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
    ), k AS (SELECT doc_id, pos, trim(line) AS line FROM l WHERE trim(line) <> ''),
    w AS (
        SELECT doc_id, pos AS a, lead(pos, 2) OVER o AS b, line AS x, lead(line) OVER o AS y, lead(line, 2) OVER o AS z
        FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
    ), r AS (
        SELECT *, first_value(doc_id) OVER o AS head_id, first_value(b) OVER o AS head_b, row_number() OVER o AS n
        FROM w WHERE b IS NOT NULL WINDOW o AS (PARTITION BY x, y, z ORDER BY doc_id, a)
    ), c AS (SELECT doc_id, CASE WHEN doc_id = head_id THEN greatest(a, head_b + 1) ELSE a END AS a, b FROM r WHERE n > 1),
    kept AS (SELECT doc_id, pos, line FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND l.pos BETWEEN c.a AND c.b)),
    j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM kept GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
        CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
        CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END
            - CASE WHEN coalesce(j.text, '') = '' THEN 0 ELSE j.n END AS BIGINT) AS n_removed
    FROM documents d LEFT JOIN j USING (doc_id)"""
