"""License scan by an exact set-similarity join.

Templates are license phrases, notices and texts; blocks are windows of a document's words. For templates of up to c
words (c = 4, 16, 64, 256) the windows are 2c words long and begin at every c-th word, so an occurrence lies whole in one
of them. A block meets a template if it holds at least the threshold's share of the template's different words.

The join is exact and has the usual filters. Template words are put in one global order, rarest first, by their counts in
all documents. A block that meets a template has one of the template's first |T| - need + 1 words (prefix filter): other
windows are never formed. A block with fewer template words than any template needs is dropped (length filter), and so is
a pair whose first shared word stands too late in either order to leave enough (positional filter). What is left is
verified. Only constants are broadcast: the templates do not grow with the data.

Base phrases must also stand word by word; each of their places is counted in the window in which it begins.

All steps are DataFrame functions. Nulls: a null text is empty. Rows with equal doc_id and text get equal values, each the
ones it would get alone; a null id is an id like others. Templates are never missed in repeated or very long texts. Empty tables give no rows. Columns of
the input other than the two named are not read.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import LOWER, UPPER, WORD, WORD_ANY_CASE, ascii_lower, text_key

CLASSES = (4, 16, 64, 256)
THRESHOLD = 0.8


class Template(NamedTuple):
    label: str
    text: str
    #: Its words must stand consecutively.
    phrase: bool = False
    threshold: float = THRESHOLD

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def size(self) -> int:
        return len(set(self.words))

    @property
    def need(self) -> int:
        return ceil((1.0 if self.phrase else self.threshold) * self.size - 1e-9)

    @property
    def span(self) -> int:
        return next(c for c in CLASSES if len(self.words) <= c)


#: The contract's phrases, and the wording of common notices and licenses as lower-case words.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", threshold=1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", threshold=1.0),
    Template("all-rights-reserved", "all rights reserved", threshold=1.0),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", threshold=0.9),
    Template("apache-notice", "licensed under the apache license version 2 0", threshold=1.0),
    Template("mit-notice", "released under the mit license", threshold=1.0),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer",
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"
        " that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "apache-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you"
        " may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in"
        " writing software distributed under the license is distributed on an as is basis",
    ),
    Template(
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    Template(
        "mpl-text",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
        " with this file you can obtain one at https mozilla org mpl 2 0",
    ),
)


def word_counts(docs: DataFrame, text: str, words: list[str]) -> dict[str, int]:
    """How often each of the words stands in all documents. One number for each word reaches the driver."""
    each = docs.select(F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(WORD), F.lit(0))).alias("word"))
    counted = each.filter(F.col("word").isin(words)).groupBy("word").count().collect()
    return dict.fromkeys(words, 0) | {r["word"]: r["count"] for r in counted}


def global_order(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> list[str]:
    """All template words, rarest first."""
    counts = word_counts(docs, text, sorted({w for t in templates for w in t.words}))
    return sorted(counts, key=lambda w: (counts[w], w))


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _by_span(values: dict[int, list[str]]) -> Column:
    out = None
    for c, words in values.items():
        out = F.when(F.col("span") == c, _array(words)) if out is None else out.when(F.col("span") == c, _array(words))
    return out


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row per block and template that meet: doc_id, text_key, block_word (where the block begins), block (its words),
    template (its number), label, phrase, containment, span, places (where in the block a phrase begins, if it is one)."""
    order = global_order(docs, text, templates)
    rank = {w: i for i, w in enumerate(order)}
    index, prefix, vocabulary, least = [], {}, {}, {}
    for k, t in enumerate(templates):
        words = sorted(set(t.words), key=rank.get)
        index += [(t.span, w, i, k, t.label, t.phrase, len(words), t.need, words) for i, w in enumerate(words[: len(words) - t.need + 1])]
        prefix[t.span] = prefix.get(t.span, set()) | set(words[: len(words) - t.need + 1])
        vocabulary[t.span] = sorted({*vocabulary.get(t.span, ()), *words}, key=rank.get)
        least[t.span] = min(least.get(t.span, t.need), t.need)
    within = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
    either = "|".join(sorted({w for ws in prefix.values() for w in ws}))
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(f"(?i)(?<!{within})(?:{either})(?!{within})"))
    some = some.select("doc_id", text_key(F.col("text")).alias("text_key"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("words"))

    def blocks(c: int) -> Column:
        at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(sorted(prefix[c])), F.floor(i / c).cast("int"))))
        starts = F.filter(F.array_distinct(F.concat(at, F.transform(at, lambda x: x - 1))), lambda x: x >= 0)
        return F.transform(
            starts, lambda x: F.struct(F.lit(c).alias("span"), (x * c).cast("bigint").alias("block_word"), F.slice(F.col("words"), x * c + 1, F.lit(2 * c)).alias("block"))
        )

    each = some.select("doc_id", "text_key", F.explode(F.concat(*[blocks(c) for c in sorted(prefix)])).alias("b")).select("doc_id", "text_key", "b.*")
    each = each.withColumn("own", F.array_intersect(_by_span(vocabulary), "block"))
    few = None
    for c, n in least.items():
        few = F.when(F.col("span") == c, F.lit(n)) if few is None else few.when(F.col("span") == c, F.lit(n))
    each = each.filter(F.size("own") >= few)  # length filter
    probe = each.select("*", F.posexplode("own").alias("at", "word"))
    schema = "span int, word string, place int, template int, label string, phrase boolean, size int, need int, template_words array<string>"
    entries = F.broadcast(docs.sparkSession.createDataFrame(index, schema))
    pairs = probe.join(entries, ["span", "word"])
    pairs = pairs.filter(F.least(F.col("size") - F.col("place"), F.size("own") - F.col("at")) >= F.col("need"))  # positional filter
    shared = F.array_intersect("template_words", "own")
    pairs = pairs.withColumn("shared", shared).filter((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("need")))
    places = F.array().cast("array<int>")
    for k, t in enumerate(templates):
        if t.phrase:
            n = len(t.words)
            stands = F.transform("block", lambda w, i: F.when((i < F.col("span")) & (F.slice(F.col("block"), i + 1, F.lit(n)) == _array(t.words)), i))
            places = F.when(F.col("template") == k, F.array_compact(stands)).otherwise(places)
    return pairs.select("doc_id", "text_key", "block_word", "block", "template", "label", "phrase", (F.size("shared") / F.col("size")).alias("containment"), "span", places.alias("places"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
    containment)."""
    found = matches(docs, doc_id, text, templates).filter(~F.col("phrase") | (F.size("places") > 0))
    found = found.dropDuplicates(["doc_id", "text_key", "span", "block_word", "template"])  # a repeated row's blocks
    by = found.groupBy("doc_id", "text_key").agg(
        F.sum(F.size("places")).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("block_word") + F.array_min("places"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("block_word") + F.array_max("places"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("containment").alias("score"),
    )
    by = by.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_ANY_CASE)), F.lit(0)).cast("bigint")
    all_docs = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), n_words.alias("n_words"))
    out = all_docs.join(by, all_docs.doc_id.eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same by brute force, for DuckDB: every window against every template."""
    rows = ", ".join(
        f"({k}, '{t.label}', {str(t.phrase).lower()}, {t.span}, {t.size}, {t.need}, '{w}')" for k, t in enumerate(templates) for w in sorted(set(t.words))
    )
    phrases = " UNION ALL ".join(
        f"SELECT d.row_id, '{t.label}' AS label, i AS pos FROM d, range(0, len(d.w) - {len(t.words) - 1}) r(i) WHERE "
        + " AND ".join(f"d.w[i + {j + 1}] = '{w}'" for j, w in enumerate(t.words))
        for t in templates
        if t.phrase
    )
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
    ), places AS ({phrases}),
    n AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
    t(template, label, phrase, span, size, need, word) AS (VALUES {rows}),
    m AS (
        SELECT n.row_id, t.template, t.label, t.size, n.pos // t.span - o.i AS win, count(DISTINCT n.word) AS shared
        FROM n JOIN t ON t.word = n.word AND NOT t.phrase, range(0, 2) o(i)
        WHERE n.pos // t.span - o.i >= 0
        GROUP BY ALL HAVING count(DISTINCT n.word) >= any_value(t.need)
    ), l AS (
        SELECT row_id, label, shared / size AS part, false AS base FROM m
        UNION ALL SELECT row_id, label, 1.0, true FROM places
    ), labelled AS (
        SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, max(part) AS score
        FROM l GROUP BY row_id
    ), counted AS (SELECT row_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY row_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
        CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM d LEFT JOIN labelled USING (row_id) LEFT JOIN counted USING (row_id)"""
