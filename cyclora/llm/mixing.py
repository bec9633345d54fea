"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words, and each of its documents the same expected number of copies, target / size of the
source, at most `most` = 3. The whole part is taken; the fraction is rounded dependently: two fractional documents pass
words between each other, in a random direction of mean zero, until one of them is whole. That keeps each document's
expected copies and, at every step, the source's sum of words, so that a source ends within one document of its target.

Pairs meet in a reduction tree. Documents are dealt into leaves of about `LEAF` by a hash of their ids, so a hot source
is spread over all leaves; each leaf leaves one fractional document for each source, `FAN` leaves' remainders meet in the
next level, and so on up to one for each source, which is rounded by itself. A task holds one leaf, or FAN remainders.
Randomness is a hash of seed, id and level, so reruns and recomputed tasks agree.

Nulls: a null text has no words; a null source is a source, sorted last. Rows of one id, source and text are one item,
and each of them is taken equally often. A source without words has target 0 and is taken whole-part times (0 times).
Empty tables give no rows. If there is a column `copy` already, the mix names its own copy_2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import NOT_SPACE, durable, free, ship, text_key

MOST, LEAF, FAN, SEED = 3, 2_000, 64, 20_240_101
WEIGHTS = (1, 2, 3)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame) -> DataFrame:
    """The sources (each once) with their rank from 0, by code point, null last. Sorted in ranges: no task has them all."""
    nulls, parts = F.col("source").isNull(), int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = durable(sources.repartitionByRange(parts, nulls, "source").sortWithinPartitions(nulls, "source").withColumn("_at", F.monotonically_increasing_id()))
    # the id is the partition's number, shifted, and the row's within it
    part = F.shiftright("_at", 33)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # a number for each partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before[r["_part"]], total = total, total + r["_n"]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    return cut.withColumn("_rank", (start[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_at")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above `most` times its source's words; what is
    above is shared among the others by weight, until none is."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    known = durable(ranked(sums).withColumn("_weight", F.get(w, (F.col("_rank") % len(weights)).cast("int"))).drop("_rank"))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("source_size") * float(most)
    level, held = 0.0, -1
    while True:  # each turn fills at least one more source to its limit, or ends
        above = F.col("_weight") * level > full if level else F.lit(False)
        r = known.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, full).otherwise(0.0)).alias("full"), F.sum(F.when(~above, F.col("_weight")).otherwise(0.0)).alias("w")).first()
        if r.n == held or not r.w:
            break
        held, level = r.n, (total - r.full) / r.w
    return known.select("source", "source_size", F.least(F.col("_weight") * level, full).alias("target"))


def _meet(rows: Iterator[pd.DataFrame], group: list[str], last: bool) -> Iterator[pd.DataFrame]:
    """Pairs the rows of each group, which follow one another. Gives each back with the fraction it ends with."""
    now = kept = None  # the group, and its fractional row: (batch, place in it, fraction, words, draw)

    for batch in rows:
        frac, mass, draw = batch["frac"].to_list(), batch["mass"].to_list(), batch["draw"].to_list()
        ended: list[tuple[pd.DataFrame, int, float]] = []
        for i, key in enumerate(zip(*[batch[g].to_list() for g in group])):
            q, b = frac[i], mass[i]
            if key != now:
                if kept:
                    ended.append(_left(kept, last))
                now, kept = key, None
            if not 0 < q < 1 or not b:  # whole, or without words to pass on
                ended.append((batch, i, float(draw[i] < q) if 0 < q < 1 else q))
                continue
            if kept is None:
                kept = (batch, i, q, b, draw[i])
                continue
            other, place, p, a, d = kept
            gain, loss = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
            if draw[i] * (gain + loss) < loss:
                p, q = (1.0, q - gain / b) if a * (1 - p) <= b * q else (p + gain / a, 0.0)
            else:
                p, q = (0.0, q + loss / b) if a * p <= b * (1 - q) else (p - loss / a, 1.0)
            if 0 < q < 1:
                ended.append((other, place, p))
                kept = (batch, i, q, b, draw[i])
            else:
                ended.append((batch, i, q))
                kept = (other, place, p, a, d)
        yield from _given(ended, batch)
    if kept:
        yield from _given([_left(kept, last)], None)


def _left(kept: tuple, last: bool) -> tuple[pd.DataFrame, int, float]:
    """What a group leaves over; in the last turn it is rounded by lower bits of its draw, which no pairing has used."""
    batch, i, p, _, draw = kept
    return batch, i, float(draw * (1 << 26) % 1 < p) if last else p


def _given(ended: list[tuple[pd.DataFrame, int, float]], batch: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
    own = [(i, p) for other, i, p in ended if other is batch]
    if own:
        yield batch.iloc[[i for i, _ in own]].assign(frac=[p for _, p in own])
    for other, i, p in ended:
        if other is not batch:
            yield other.iloc[[i]].assign(frac=p)


def rounded(items: DataFrame, seed: int = SEED, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """items: id columns, source, mass (words) and frac; each with its fraction rounded to 0 or 1."""
    n = items.count()
    leaves = max(1, -(-n // leaf))
    ids = [c for c in items.columns if c not in ("mass", "frac")]
    rows = items.withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(leaves)).cast("bigint"))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, turn = [], 0
    # The turn's random numbers, 53 bits of a hash. The last turn must round, so it takes a hash of its own.
    draw = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *ids), 11) / float(1 << 53)
    while True:
        last = leaves == 1
        dealt = rows.withColumn("draw", draw(turn)).repartition(min(parts, leaves) if not turn else parts, "leaf", *([] if not turn else ["source"]))
        dealt = dealt.sortWithinPartitions("leaf", "source", F.desc("mass"), *ids)
        out = durable(dealt.mapInPandas(lambda b, last=last: _meet(b, ["leaf", "source"], last), dealt.schema))
        whole = (F.col("frac") <= 0) | (F.col("frac") >= 1)
        done.append(out.filter(whole))
        if last:
            break
        leaves, turn = -(-leaves // fan), turn + 1
        rows = out.filter(~whole).drop("draw").withColumn("leaf", F.floor(F.col("leaf") / fan).cast("bigint"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.drop("leaf", "draw")


def decisions(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """A row per item: doc_id, text_key, source, n_rows, size, source_size, target, copies."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size"))
    items = durable(sized.groupBy("doc_id", "text_key", "source", "size").agg(F.count("*").alias("n_rows")))
    aims = durable(targets(items.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, most))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    all_items = items.join(aims, items.source.eqNullSafe(aims.source)).drop(aims.source).withColumn("_rate", rate)
    all_items = all_items.withColumn("_base", F.floor("_rate").cast("int"))
    chosen = rounded(
        all_items.select("doc_id", "text_key", "source", (F.col("size") * F.col("n_rows")).cast("double").alias("mass"), (F.col("_rate") - F.col("_base")).alias("frac")), seed
    ).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("source").alias("_source"), F.col("frac").cast("int").alias("_more"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = all_items.join(chosen, same)
    return joined.select("doc_id", "text_key", "source", "n_rows", "size", "source_size", "target", (F.col("_base") + F.col("_more")).alias("copies"))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken."""
    each = decisions(docs, doc_id, source, text).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with `copy` (or copy_2, if there is one) from 1."""
    own_id, own_key, own_source, n, copy = [free(docs.columns, name) for name in ("_mix_id", "_mix_key", "_mix_source", "_mix_n", "copy")]
    taken = decisions(docs, doc_id, source, text, weights, most, seed).filter("copies > 0")
    taken = durable(taken.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("source").alias(own_source), F.col("copies").alias(n)))
    same = F.col(doc_id).eqNullSafe(F.col(own_id)) & (text_key(F.col(text)) == F.col(own_key)) & F.col(source).cast("string").eqNullSafe(F.col(own_source))
    out = docs.join(taken.hint("shuffle_hash"), same)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns, copy)


ship(__name__)
