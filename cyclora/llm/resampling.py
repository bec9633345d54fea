"""Importance resampling towards a target corpus, by bucketed word counts.

Features are words (runs of 1 word), hashed into buckets. Each batch of documents becomes postings (bucket, document, count),
which are shuffled by place: a group of buckets, and one of `PARTS` shares of the documents, so that a bucket that every
document has is dealt over many tasks. Where a place's postings lie, its buckets are summed; buckets of both corpora then
meet, and each bucket's gain, the log ratio of its smoothed shares, goes back to the places. There postings become
contributions (count times gain), summed by document within the task first and over tasks then: no task holds a bucket, a
document's postings or a corpus.

A document's weight is the floored mean of gains over its features. With Gumbel noise of a hash of its id the highest scores
are a sample without replacement by weight; ranks run over ranges of the score (`ordering.running`).

Gains hold one number a bucket, bounded by the parameter `buckets`; nothing else is handed to all tasks. What reaches the
driver is a count and a sum for each range of scores.

Nulls: a null text has no words, a null id counts as an empty one in the hash and comes last among ties. Rows of equal id and
text are counted each, and each may be drawn. Empty documents: no rows; an empty target counts as a corpus without features.
Other columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cyclora.llm.common import durable, ship, text_key, words_of
from cyclora.operators.ordering import running

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Buckets are dealt into so many groups, documents into so many shares; a place is one of both.
GROUPS, PARTS = 16, 128
#: Postings that a task hands on at once.
AT_ONCE = 100_000


class Buckets(dict):
    """The bucket of each word met so far."""

    def __init__(self, n: int, most: int = 1_000_000):
        super().__init__()
        self.n, self.most = n, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = crc32(word) % self.n
        return out


def postings(docs: DataFrame, buckets: int, places: bool) -> DataFrame:
    """(place, bucket, doc_id, key, n) of docs (doc_id, key, text): a document's words in a bucket. A row of bucket -1 for each
    document says how many words and, as place, how often it occurs in the batch; equal rows of a batch are counted as one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["place", "bucket", "doc_id", "key", "n", "copies"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_pylist()
            times = Counter(zip(ids.to_pylist(), keys))
            own: list[tuple[int, ...]] = []
            rows: list[int] = []
            for i, (key, text) in enumerate(zip(keys, batch.column(2))):
                copies = times.pop((ids[i].as_py(), key), 0)
                if not copies:
                    continue
                part = key % PARTS * GROUPS
                words = words_of(text.as_py())
                own.append((part, -1, key, len(words) * copies, copies))
                own += [(part + b % GROUPS, b, key, n * copies, 0) for b, n in Counter(map(of.__getitem__, words)).items()]
                rows += [i] * (len(own) - len(rows))
                if len(own) >= AT_ONCE:
                    yield made(own, ids.take(pa.array(rows)))
                    own, rows = [], []
            if own:
                yield made(own, ids.take(pa.array(rows)))

    def made(own: list[tuple[int, ...]], ids: pa.Array) -> pa.RecordBatch:
        place, bucket, key, n, copies = zip(*own)
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(bucket, pa.int32()), ids, pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(copies, pa.int64())], names)

    out = docs.select("doc_id", "key", "text").mapInArrow(scan, f"place int, bucket int, doc_id {kind}, key bigint, n bigint, copies bigint")
    return out.repartition("place") if places else out


def gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(place, gains): for each place the gains of its group's buckets in order. own: postings dealt by place."""


    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)  # bucket -1, of whole documents, is the last
        for batch in batches:
            np.add.at(total, batch.column(1).to_numpy(), batch.column(4).to_numpy())
        met = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    # all columns go in, so that the shuffle is the one that contributions read, too
    s, t = (x.mapInArrow(summed, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias(k)) for x, k in ((own, "s"), (target, "t")))
    whole = Window.partitionBy(F.lit(0))  # over one row a bucket
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", zero("s").alias("s"), zero("t").alias("t"))
    share = lambda c: (F.col(c) + 1).cast("double")
    ratio = share("t") * (F.sum("s").over(whole) + buckets) / (share("s") * (F.sum("t").over(whole) + buckets))
    each = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    listed = each.groupBy((F.col("bucket") % GROUPS).alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    return listed.select("group", "gains", parts).select((F.col("part") * GROUPS + F.col("group")).alias("place"), "gains")


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, key, copies, n_features, weight): a row for each different pair of id and text."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    target = target.select(F.lit(0).alias("doc_id"), text_key(F.col(target_text)).alias("key"), F.col(target_text).cast("string").alias("text"))
    own = postings(docs, buckets, True)
    found = own.join(gains(own, postings(target, buckets, False), buckets).hint("shuffle_hash"), "place", "left")
    gain = F.get("gains", F.floor(F.col("bucket") / GROUPS).cast("int"))
    each = found.select("doc_id", "key", "copies", F.when(F.col("bucket") < 0, F.col("n")).otherwise(0).alias("n"), F.when(F.col("bucket") >= 0, F.col("n") * gain).otherwise(0).alias("gain"))
    sums = each.groupBy("doc_id", "key").agg(*[F.sum(c).alias(c) for c in ("copies", "n", "gain")])
    mean = F.floor(F.col("gain") / F.nullif("n", F.lit(0)))
    return sums.select("doc_id", "key", "copies", (F.col("n") / F.col("copies")).cast("long").alias("n_features"), F.coalesce(mean, F.lit(0)).alias("weight"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """A row per document: doc_id, n_features, weight, score, rank (from 1 for the drawn ones, else null)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = durable(weights(docs, target, doc_id, text, target_text, buckets).withColumn("score", F.col("weight") + noise))
    long_ones = F.col("n_features") >= min_words
    drawn = (scored.filter(long_ones).agg(F.sum("copies")).first()[0] or 0) * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")]
    ranked = running(scored.filter(long_ones), order, {"upto": F.col("copies")})
    each = F.explode(F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto"))).alias("rank")
    rows = ranked.select("doc_id", "n_features", "weight", "score", each).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~long_ones).select("doc_id", "n_features", "weight", "score", F.explode(F.array_repeat(F.lit(None).cast("long"), F.col("copies").cast("int"))).alias("rank"))
    return rows.unionByName(rest)


def oracle_sql() -> str:
    """The same in DuckDB's SQL; CRC-32 byte by byte through its table of 256, which the polynomial gives."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
    WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, {step} AS v FROM range(0, 256) r(i))),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents), b AS (SELECT {words("text")} AS w FROM benchmark),
    dw AS (SELECT rid, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
    voc AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
    bytes AS (SELECT word, list_transform(range(0, CAST(octet_length(encode(word)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS y FROM voc),
    bk AS (SELECT word, xor(list_reduce(y, lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM bytes, tab),
    s AS (SELECT bucket, count(*) AS n FROM dw JOIN bk USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM bw JOIN bk USING (word) GROUP BY 1),
    g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM dw) + {BUCKETS}) / (CAST(s.n + 1 AS DOUBLE) * ((SELECT count(*) FROM bw) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
    m AS (SELECT rid, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN bk USING (word) JOIN g USING (bucket) GROUP BY 1),
    x AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (rid)),
    y AS (SELECT rid, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
    z AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= {MIN_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {PERCENT} // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (rid)"""



ship(__name__)
