"""Benchmark decontamination: one Aho-Corasick automaton over the words of all benchmark windows.

The benchmark's items are normalised to words and cut into windows of 13 words (a shorter item is one window). The
automaton's symbols are word numbers, so it has a node for each word of a window and not for each letter. Each document
is scanned once; matches come as word positions, which are mapped back to offsets in the original text.

The automaton is the one thing broadcast. Its size is bounded: items are streamed to the driver in order, and at
`max_windows` windows, within an item if need be, they make up one automaton. A benchmark beyond that takes several
automata, each scanned against all documents, and the hits of a document are merged. The result is the same either way,
but that `contaminated_spans` gives a run in pieces if an item is split.

Nulls: a null or empty text has no words and no hits. Items without words match nothing; repeated item ids count once;
a null item id is written `null`. Rows with equal doc_id and text get equal values. Empty tables give no rows, or
documents without hits. Other columns of the inputs are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import free, ship, text_key, words_of

WINDOW = 13
#: About 40 MB of automaton.
MAX_WINDOWS = 60_000
#: A document is contaminated if at least this share (1/20) of its words is hit.
SHARE = 20

_HIT = "array<struct<first:bigint,n_words:int,item:string>>"


#: The numbers of the benchmark's words, and the automaton over them: nothing that needs this package to be read again.
Matcher = tuple[dict[bytes, int], ahocorasick.Automaton]


def matcher(items: list[tuple[str, list[bytes]]], window: int) -> Matcher:
    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for name, words in items:
        ids = tuple(number.setdefault(w, len(number) + 1) for w in words)
        for i in range(max(1, len(ids) - window + 1)):
            owners.setdefault(ids[i : i + window], set()).add(name)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, names in owners.items():
        automaton.add_word(key, (len(key), tuple(sorted(names))))
    automaton.make_automaton()
    return number, automaton


def windows_in(known: Matcher, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, words, items) of all windows that occur; overlapping ones too."""
    get, automaton = known[0].get, known[1]
    ids = tuple([get(w, 0) for w in words])
    return [(end - n + 1, n, names) for end, (n, names) in automaton.iter(ids)] if ids else []


def matchers(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_windows: int) -> Iterator[Matcher]:
    items, left = [], max_windows
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = words_of(row.t)
        while words:
            items.append(("null" if row.i is None else row.i, words[: left + window - 1]))
            n = max(1, len(items[-1][1]) - window + 1)
            words, left = words[n:] if len(words) > n + window - 1 else [], left - n
            if not left:
                yield matcher(items, window)
                items, left = [], max_windows
    if items:
        yield matcher(items, window)


def _covered(hits: list[tuple[int, int]], n: int) -> int:
    """How many of n words lie in any of the (first, length) spans."""
    edge = np.zeros(n + 1, np.int32)
    for first, size in hits:
        edge[first] += 1
        edge[first + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _report(n: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    hit = _covered(spans, n) if spans else 0
    return {
        "n_words": n,
        "n_hit": hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
        "contaminated": hit > 0 and SHARE * hit >= n,
    }


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = [spark.sparkContext.broadcast(m) for m in matchers(benchmark, item_id, item_text, window, max_windows)]
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    if len(parts) <= 1:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for value in batch.column(1):
                    words = words_of(value.as_py())
                    found = windows_in(parts[0].value, words) if parts else []
                    out.append(_report(len(words), [x[:2] for x in found], {i for x in found for i in x[2]}))
                yield _table(batch.column(0), out)

        return docs.mapInArrow(scan, schema)

    def scan_part(part):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for value in batch.column(1):
                    words = words_of(value.as_py())
                    found = windows_in(part.value, words)
                    out.append((len(words), [{"first": a, "n_words": b, "item": i} for a, b, c in found for i in c]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array([x for x, _ in out], pa.int64()),
                        pa.array(
                            [x for _, x in out],
                            pa.list_(pa.struct([("first", pa.int64()), ("n_words", pa.int32()), ("item", pa.string())])),
                        ),
                    ],
                    ["doc_id", "key", "n", "hits"],
                )

        return scan

    keyed = docs.withColumn("key", text_key(F.col("text")))
    hits = None
    for part in parts:
        one = keyed.mapInArrow(scan_part(part), f"doc_id {kind}, key bigint, n bigint, hits {_HIT}")
        hits = one if hits is None else hits.unionByName(one)
    # one row for each part, document and copy of the document; equal rows come together, so each is kept part times
    merged = hits.groupBy("doc_id", "key", "n").agg(
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
        (F.count("*") / len(parts)).cast("int").alias("copies"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append(_report(n, [(x["first"], x["n_words"]) for x in found], {x["item"] for x in found}))
            yield _table(batch.column(0), out)

    one_each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return one_each.select("doc_id", "n", "hits").mapInArrow(judge, schema)


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents that are not contaminated, with all their columns. One automaton filters the rows as they pass;
    several need the merged hits, joined by id and text."""
    dirty_id, dirty_key = free(docs.columns, "_dirty_id"), free(docs.columns, "_dirty_key")
    spark, at = docs.sparkSession, docs.columns.index(text)
    parts = [spark.sparkContext.broadcast(m) for m in matchers(benchmark, item_id, item_text, window, max_windows)]
    if not parts:
        return docs
    if len(parts) == 1:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = []
                for value in batch.column(at):
                    words = words_of(value.as_py())
                    hit = _covered([x[:2] for x in windows_in(parts[0].value, words)], len(words))
                    clean.append(not (hit > 0 and SHARE * hit >= len(words)))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return docs.mapInArrow(scan, docs.schema)
    keyed = docs.select(F.struct(F.col(doc_id).alias("i"), text_key(F.col(text)).alias("k")).alias("doc_id"), F.col(text).alias("text"))
    dirty = decontaminate(keyed, benchmark, "doc_id", "text", item_id, item_text, window, max_windows).filter("contaminated")
    dirty = dirty.select(F.col("doc_id.i").alias(dirty_id), F.col("doc_id.k").alias(dirty_key)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(dirty_id)) & (text_key(F.col(text)) == F.col(dirty_key))
    return docs.join(dirty, same, "left_anti")


def _table(ids: pa.Array, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"items_sha256": pa.string(), "contaminated": pa.bool_()}
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    columns = [pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *names])


#: The same in SQL, for DuckDB: every window of every document against every item's windows.
_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
    item AS (
        SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') AS win
        FROM b, range(0, greatest(1, len(w) - {WINDOW - 1})) r(i) WHERE len(w) > 0 AND i <= len(w) - least(len(w), {WINDOW})
    ), sizes AS (SELECT DISTINCT n FROM item),
    place AS (
        SELECT doc_id, i AS pos, s.n, array_to_string(w[i + 1 : i + s.n], ' ') AS win FROM d, sizes s, range(0, len(w)) r(i) WHERE i + s.n <= len(w)
    ), hit AS (SELECT doc_id, pos, n, item_id FROM place JOIN item USING (n, win)),
    word AS (SELECT DISTINCT doc_id, pos + k AS pos FROM (SELECT DISTINCT doc_id, pos, n FROM hit), range(0, {WINDOW}) r(k) WHERE k < n),
    n_hit AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """A row per item and occurring run: doc_id, item_id, first_char, end_char (offsets in the original text), passage.
    Overlapping windows of an item make one run."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, item_id string, first_char bigint, end_char bigint, passage string"
    out = spark.createDataFrame([], schema)
    for m in matchers(benchmark, item_id, item_text, window, max_windows):
        part = spark.sparkContext.broadcast(m)

        def scan(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for i, value in enumerate(batch.column(1)):
                    body = value.as_py()
                    found = windows_in(part.value, words_of(body))
                    if not found:
                        continue
                    at = [w.span() for w in _WORD.finditer(body)]
                    runs: dict[str, list[list[int]]] = {}
                    for first, n, names in sorted(found):
                        for name in names:
                            mine = runs.setdefault(name, [])
                            if mine and first <= mine[-1][1]:
                                mine[-1][1] = max(mine[-1][1], first + n)
                            else:
                                mine.append([first, first + n])
                    for name, spans in sorted(runs.items()):
                        rows += [(i, name, at[a][0], at[b - 1][1], body[at[a][0] : at[b - 1][1]]) for a, b in spans]
                columns = list(zip(*rows)) if rows else [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], pa.string()),
                        pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.int64()),
                        pa.array(columns[4], pa.string()),
                    ],
                    ["doc_id", "item_id", "first_char", "end_char", "passage"],
                )

        out = out.unionByName(docs.mapInArrow(scan, schema))
    return out


ship(__name__)
