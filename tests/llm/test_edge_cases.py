"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cyclora.llm import decontamination, html_text, language, licenses, lines, media, mixing, near_copies, quality, simhash, url_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, size string"
LONG = "mit license words go on and on. " * 20_000
TEXTS = [None, "", " ", "\n\n", "a", "one line", "A\nB\nC\nD", "A\nB\nC\nD", LONG, "über straße Ünï 语言 " * 40, "x y z MIT   License", None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", len(t or ""), 1.0, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], rows[0]]  # repeated rows
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "mit license words go"), (2, None), (3, ""), (None, "one line"), (1, "mit license words go")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else i % 2, None) for i in range(12)] + [(None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def n(docs):
    return len(TEXTS) + 3 if docs else 0


OPERATORS = {
    "mix_report": lambda d, b, l: mixing.mix_report(d),
    "licenses": lambda d, b, l: licenses.scan(d),
    "decontaminate": lambda d, b, l: decontamination.decontaminate(d, b),
    "decontaminate_parts": lambda d, b, l: decontamination.decontaminate(d, b, max_windows=1),
    "lines": lambda d, b, l: lines.dedup_lines(d, report=True),
    "quality": lambda d, b, l: quality.score(d, quality.train(d, l)),
    "language": lambda d, b, l: language.identify(d, language.learn(d)),
    "simhash": lambda d, b, l: simhash.near_duplicates(d),
    "html": lambda d, b, l: html_text.main_text(d, "doc_id", "source", "text"),
    "media": lambda d, b, l: media.text_film_digests(d),
    "films": lambda d, b, l: media.text_films(d),
    "urls": lambda d, b, l: url_rules.judge(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(name, docs, benchmark, labels):
    out = OPERATORS[name](docs, benchmark, labels)
    ids = sorted((r[0] is None, r[0]) for r in out.select("page_id" if "page_id" in out.columns else "doc_id").collect())
    assert ids == sorted((r[0] is None, r[0]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, none, spark):
    b = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](none, b, labels).collect() == []


def test_empty_benchmark_and_labels(docs, spark):
    b = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not decontamination.decontaminate(docs, b).filter("n_hit > 0 or contaminated").collect()
    assert decontamination.keep_clean(docs, b).count() == docs.count()
    assert {r.score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}


def test_documents_keep_their_columns(docs, benchmark, labels, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        assert [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert out.columns == [*docs.columns, "copy"]
    out.collect()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[s[0] for s in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(stage, none, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert stage[1](spark, none, str(tmp_path)).collect() == []


def test_documents_of_null_and_shared_ids_stay_apart(spark):
    texts = [f"{w} alone tells of {w} things in {w} places and no other" for w in "amber birch cedar daisy elder".split()]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (None, texts[4])]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(set(rows[:6]), key=str)


def test_clashing_columns(docs, benchmark):
    names = "copy _mix_id _mix_key _mix_source _mix_n _line_id _line_key _line_spans n_lines n_removed _near_key _kept_id _kept_key _dirty_id _dirty_key".split()
    more = docs.withColumns({name: F.lit(7) for name in names})
    plain = lambda df: sorted(map(str, df.select(docs.columns).collect()))
    for work in (
        mixing.mix,
        lines.dedup_lines,
        lambda d: lines.dedup_lines(d, report=True),
        simhash.one_of_each,
        near_copies.one_of_each,
        lambda d: decontamination.keep_clean(d, benchmark),
        lambda d: decontamination.keep_clean(d, benchmark, max_windows=1),
    ):
        out = work(more)
        assert out.columns[: len(more.columns)] == more.columns and plain(out) == plain(work(docs))
        assert all(set(r) == {7} for r in out.select(names).collect())
    assert mixing.mix(more).columns[-1] == "copy_2" and lines.dedup_lines(more, report=True).columns[-2:] == ["n_lines_2", "n_removed_2"]


ROW_BY_ROW = ["licenses", "decontaminate", "decontaminate_parts", "language", "simhash", "html", "media", "urls"]


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_repeated_rows_get_what_one_row_gets(name, docs, benchmark, labels):
    many, once = (OPERATORS[name](d, benchmark, labels) for d in (docs, docs.distinct()))
    if "feature" in many.columns:
        many, once = (d.withColumn("feature", F.col("feature").cast("string")) for d in (many, once))
    assert set(map(str, many.collect())) == set(map(str, once.collect()))


def test_values_of_repeated_rows(spark, benchmark):
    d = spark.createDataFrame([(1, "MIT license here")] * 3 + [(None, "MIT license here, mit license")] * 2, "doc_id long, text string")
    assert sorted((r.n_base, r.n_words, r.first_word, r.last_word) for r in licenses.scan(d).collect()) == [(1, 3, 0, 0)] * 3 + [(2, 5, 0, 3)] * 2
    d = spark.createDataFrame([(1, "one line and more")] * 2, "doc_id long, text string")
    assert [(r.n_hit, r.n_items) for r in decontamination.decontaminate(d, benchmark).collect()] == [(2, 1)] * 2
    d = spark.createDataFrame([(1, "a\nb\nc\nd")] * 2 + [(2, "x\na\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(d).collect()) == [(1, "a\nb\nc\nd")] * 2 + [(2, "x")]
    d = spark.createDataFrame([(1, "w w w", "a")] * 4 + [(2, "w w", "b")], "doc_id long, text string, source string")
    assert len({(r.copies, r.taken) for r in mixing.mix_report(d).filter("doc_id = 1").collect()}) == 1


def test_labels_that_contradict_each_other(spark):
    good, bad = "A plain line of words.\nAnd another one here.", "!!! BUY | NOW | !!!\n||| !!!"
    d = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(60)], "doc_id long, text string")
    right = [(i, i % 2) for i in range(60)]
    torn = [(i, 1 - i % 2) for i in range(0, 20)]
    a, b = (
        {r.doc_id: r.score for r in quality.score(d, quality.train(d, spark.createDataFrame(rows, "doc_id long, quality int"))).collect()}
        for rows in (right[20:], right + right[30:] + torn)
    )
    assert a == b and all((s > 0.5) == bool(i % 2) for i, s in a.items())


def test_long_documents_teach(spark):
    good, bad = "A plain line of words.\n" * 400, "!!! BUY | NOW | !!!\n" * 400
    d = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)], "doc_id long, text string")
    field = quality.train(d, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in quality.score(d, field).collect())


def test_an_item_split_over_automata(spark):
    item = " ".join(f"w{i}" for i in range(200))
    b = spark.createDataFrame([(1, item), (2, "w5 w6 w7")], "item_id long, text string")
    d = spark.createDataFrame([(1, item), (2, " ".join(f"w{i}" for i in range(50, 70))), (3, "w5 w6 w7"), (4, "w1 w3")], "doc_id long, text string")
    assert len(list(decontamination.matchers(b, "item_id", "text", 13, 25))) == 8
    assert sorted(decontamination.decontaminate(d, b, max_windows=25).collect()) == sorted(decontamination.decontaminate(d, b).collect())


def test_clips_of_unreadable_files(spark):
    media_rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"RIFF\0\0\0\0AVI ")), (None, bytearray(b"junk" * 10))], "media_id long, content binary")
    rows = media.clips(media_rows).collect()
    assert len(rows) == 4 and all(r.error for r in rows)
