"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: a text's words (ASCII letters lower-cased) form shingles of three words; a fingerprint bit is set if it is
set in over half of the shingles' XXH64 hashes. Fingerprints that differ in at most `budget` = 2 bits are linked.

The join: two fingerprints within two bits agree in at least one of three blocks of bits. So there are three tries, each
with another block on top, and the top block may be walked without error: its value is the key by which fingerprints are
dealt out. Below, node pairs are walked together, level by level; a pair carries the bits that differed so far and is
dropped once they exceed the budget. A subtrie of over `most` fingerprints is dealt out anew by thirds of its remaining
bits, again without loss, until all are small: a few bits left hold few different fingerprints.

A task gives back a spanning forest of the links it found and not all pairs; components then come from alternating star
contractions over the forests. Copies share a fingerprint and are one node throughout.

Nulls: a null or blank text has fingerprint zero and is linked like any other. Null ids are passed over when the
smallest id is taken; a component of null ids has a null id. Repeated rows give repeated rows. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import durable, free, ship, small, text_key, utf8

SEED, SHINGLE, BUDGET = 42, 3, 2
#: The most fingerprints that one subtrie brings to a task, and node pairs that it walks at once.
MOST, PAIRS = 20_000, 1_000_000
#: Subtries with so many free bits or fewer are not dealt out further: they hold at most 64 fingerprints.
FEW_BITS = 6


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included, in text order; one for a text of fewer words, none without words."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, ">i8")
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, SEED), ">i8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]), ">i8")


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.uint32) > len(hashes)).tobytes()


def fingerprint(text: str | None, size: int = SHINGLE) -> bytes:
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, fp (the fingerprint as a signed long)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join([fingerprint(x.as_py()) for x in batch.column(1)])
            values = pa.array(np.frombuffer(fps, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(scan, f"doc_id {kind}, fp bigint")


def thirds(mask: int) -> list[int]:
    """The mask with each third of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = len(free)
    cuts = [free[: n // 3], free[n // 3 : 2 * n // 3], free[2 * n // 3 :]]
    return [mask | sum(1 << b for b in cut) for cut in cuts]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def on_top(values: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprints with the mask's bits moved to the top: a trie's paths."""
    order = [63 - b for b in range(63, -1, -1) if mask >> b & 1] + [63 - b for b in range(63, -1, -1) if not mask >> b & 1]
    bits = np.unpackbits(values.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return np.frombuffer(np.packbits(bits[:, order], axis=1).tobytes(), ">u8").astype(np.uint64)


class Forest:
    """Labels of nodes, the smallest index of those linked."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (further := label[label]).tobytes() != label.tobytes():
                label[:] = further


def trie_links(path: np.ndarray, depth: int, budget: int, pairs: int = PAIRS) -> np.ndarray:
    """Labels of sorted, different trie paths: those linked within the subtries of the given depth share one. Walks node
    pairs (ranges of paths) level by level with the count of differing bits."""
    n = len(path)
    forest = Forest(n)
    shift = np.uint64(64 - depth)
    top = path >> shift
    cut = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    some = hi - lo > 1
    lo, hi = lo[some], hi[some]
    todo = [(depth, np.stack((lo, hi, lo, hi, np.zeros_like(lo))))] if len(lo) else []
    ones: dict[int, np.ndarray] = {}
    while todo:
        d, at = todo.pop()
        if at.shape[1] > pairs:
            half = at.shape[1] // 2
            todo += [(d, at[:, :half]), (d, at[:, half:])]
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((path >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)))
        count = ones[d]
        a, b, c, e, err = at
        m, k = b - (count[b] - count[a]), e - (count[e] - count[c])  # where each node's one-branch begins
        same = a == c
        apart = ~same
        below = np.concatenate(
            (
                np.stack((a, m, c, k, err)),
                np.stack((m, b, k, e, err)),
                np.stack((a, m, k, e, err + 1)),
                np.stack((m, b, c, k, err + 1))[:, apart],
            ),
            axis=1,
        )
        a, b, c, e, err = below
        keep = (b > a) & (e > c) & (err <= budget) & ((a != c) | (b - a > 1))
        below = below[:, keep]
        a, b, c, e, err = below
        leaf = (b - a == 1) & (e - c == 1)
        if leaf.any():
            x, y = a[leaf], c[leaf]
            near = np.bitwise_count(path[x] ^ path[y]) <= budget
            forest.link(x[near], y[near])
            below = below[:, ~leaf]
        if below.shape[1]:
            todo.append((d + 1, below))
    return forest.label


def subtrie_links(masks: np.ndarray, values: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges (fingerprint, its label's fingerprint) of the subtries in a task."""
    for mask in np.unique(masks):
        own = np.unique(values[masks == mask]).astype(np.uint64)
        m = int(mask) & (1 << 64) - 1
        path = on_top(own, m)
        order = np.argsort(path)
        own, path = own[order], path[order]
        label = trie_links(path, m.bit_count(), budget)
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield own[moved].astype(np.int64), own[label[moved]].astype(np.int64)


def links(fps: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """Forest edges (u, v) with which all fingerprints (fp, each once) within the budget are connected."""
    spark = fps.sparkSession
    if budget > 2:
        raise ValueError("three blocks allow two differing bits")

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        each = F.explode(F.array(*[F.lit(signed(m)).cast("bigint") for m in masks]))
        return rows.select("fp", each.alias("mask")).withColumn("bucket", F.expr("fp & mask"))

    masks = thirds(0)
    rows, settled = dealt(fps, masks), []
    while True:
        over = (F.col("count") > most) & (F.bit_count("mask") < 64 - FEW_BITS)
        large = durable(rows.groupBy("mask", "bucket").count().filter(over).select("mask", "bucket"))
        if large.isEmpty():
            settled.append(rows)
            break
        settled.append(rows.join(large, ["mask", "bucket"], "left_anti"))
        rows, deeper = durable(rows.join(large, ["mask", "bucket"], "left_semi")), []
        masks = sorted({m for old in masks for m in thirds(old)})
        for old in {r.mask for r in large.select("mask").distinct().collect()}:  # at most 3, 9, 27, ... masks
            old_mask = old & (1 << 64) - 1
            deeper.append(dealt(rows.filter(F.col("mask") == old), thirds(old_mask)))
        rows = deeper[0]
        for more in deeper[1:]:
            rows = rows.unionByName(more)
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(b["mask"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if kept:
            for u, v in subtrie_links(np.concatenate([m for m, _ in kept]), np.concatenate([f for _, f in kept]), budget):
                yield pd.DataFrame({"u": u, "v": v})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * fps.count() // 250_000)
    return rows.repartition(parts, "mask", "bucket").mapInPandas(walk, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches. Alternates large and small stars; what is
    grouped is a minimum for each node, so a node of many edges is no burden."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = durable(edges.filter("u != v").distinct())
    seen = None
    while (told := mark(now)) != seen:
        seen = told
        now = durable(star(star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    prints = durable(fingerprints(docs, doc_id, text))
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), budget))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = durable(placed)
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(heads, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def place(doc_id: str, text: str) -> Column:
    """What tells documents apart, in the order in which one is kept: null ids come last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents but for those at the places `gone`, with all their columns; of the rows at each place in `repeated` one.
    Both hold places once, as `doc`, and are written already."""
    near_key, other_id, other_key = [free(docs.columns, name) for name in ("_near_key", "_other_id", "_other_key")]
    keyed = docs.withColumn(near_key, text_key(F.col(text)))

    def at(places: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        there = places.select(F.col("doc.id").alias(other_id), F.col("doc.key").alias(other_key))
        same = F.col(doc_id).eqNullSafe(F.col(other_id)) & (F.col(near_key) == F.col(other_key))
        return rows.join(small(there), same, how)

    kept = keyed if gone.isEmpty() else at(gone, "left_anti", keyed)
    if not repeated.isEmpty():
        one = at(repeated, "left_semi", kept).dropDuplicates([doc_id, near_key])
        kept = at(repeated, "left_anti", kept).unionByName(one)
    return kept.drop(near_key)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id, then the smallest key of its
    text, stays, with all its columns. Rows of one id and text are one document, of which one row stays."""
    near = near_duplicates(docs.select(place(doc_id, text).alias("doc_id"), F.col(text).alias("text")), budget=budget)
    each = durable(near.groupBy(F.col("doc_id").alias("doc"), "component_id").agg(F.count("*").alias("n")))
    return without(docs, each.filter("doc != component_id").select("doc"), each.filter("doc = component_id and n > 1").select("doc"), doc_id, text)


ship(__name__)
