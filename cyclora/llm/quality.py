"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's potential is linear in its own features and those of the lines before and after it;
neighbouring labels are tied by a transition table. Forward-backward gives each line's marginal, and a document's score
is the mean of its lines' marginals, weighted by length. Lines take their document's label in training, which maximises
the penalised likelihood by Adam over whole sequences.

Training takes at most `SAMPLE` labelled rows, those whose ids hash lowest, and of a longer document `SAMPLE_LINES` lines in
a row, from a place drawn by a hash of its text; both are parameters. Only the features of these lines reach the driver, at
most SAMPLE x SAMPLE_LINES x FEATURES floats. All documents are scored, over their whole texts.

Nulls: a null text is the empty text: one line without words, scored like any other. Labels that are null, or whose
document is missing, teach nothing, nor do those of a document that has both labels; a repeated label counts once; without any usable label every score is 0.5. Repeated rows get equal scores; ids
that are null are in no fold and count as not held out. Other columns are never inputs and pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import ship, text_key, utf8

FEATURES = 16
SAMPLE, SAMPLE_LINES = 6_000, 128
THRESHOLD, FOLDS = 0.3, 5

#: Kinds of bytes: upper-case, digit, bar, exclamation mark, full stop, other punctuation, beyond ASCII, the rest.
_KIND = bytes(
    ord("U") if 65 <= b <= 90
    else ord("D") if 48 <= b <= 57
    else ord("B") if b == 124
    else ord("X") if b == 33
    else ord("S") if b == 46
    else ord("N") if b >= 128
    else ord("P") if 33 <= b <= 126 and not 97 <= b <= 122
    else ord(" ")
    for b in range(256)
)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, lengths) of a text's lines."""
    seen: set[bytes] = set()
    rows, sizes = [], []
    for line in utf8(text).split(b"\n"):
        words, n = line.split(), len(line)
        k = len(words)
        sizes.append(n + 1)
        if not k:
            rows.append((1.0,) + (0.0,) * (FEATURES - 1))
            continue
        kind = line.translate(_KIND)
        count = kind.count
        again = line in seen
        seen.add(line)
        distinct = len(set(words))
        rows.append(
            (
                0.0,
                log1p(n) / 8,
                log1p(k) / 6,
                distinct / k,
                sum([a == b for a, b in pairwise(words)]) / k,
                log1p(distinct) / 6,
                count(b"U") / n,
                count(b"D") / n,
                count(b"B") / k,
                count(b"X") / k,
                count(b"S") / k,
                count(b"P") / k,
                count(b"N") / n,
                n / k / 10,
                log1p(max(map(len, words))) / 4,
                float(again),
            )
        )
    return np.array(rows, np.float32), np.array(sizes, np.float64)


def neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after in its document, and a constant. first: where documents
    begin among the lines."""
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[np.append(first[1:], len(x)) - 1] = 0
    return np.concatenate((x, x * x, before, after, np.ones((len(x), 1), x.dtype)), axis=1)


class Field:
    """A chain of two labels: the weights of a line's being good, and the transition table's logarithms."""

    def __init__(self, weight: np.ndarray, step: np.ndarray):
        self.weight, self.step = weight, step

    def marginals(self, x: np.ndarray, size: np.ndarray, want_pairs: bool = False):
        """P(good) of each line; with want_pairs the expected transitions too. size: the documents' lines."""
        odds = np.clip(x @ self.weight, -30, 30)
        good = 1 / (1 + np.exp(-odds))
        e = np.stack((1 - good, good), axis=1)
        move = np.exp(self.step)
        order = np.argsort(-size, kind="stable")
        first = (np.cumsum(size) - size)[order]
        size = size[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # documents with more than t lines
        a, b = e.copy(), np.ones_like(e)
        for t in range(longest):
            at = first[: active[t]] + t
            if t:
                a[at] *= a[at - 1] @ move
            a[at] /= a[at].sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            b[at] = (b[at + 1] * e[at + 1]) @ move.T
            b[at] /= b[at].sum(axis=1, keepdims=True)
        p = a * b
        p /= p.sum(axis=1, keepdims=True)
        if not want_pairs:
            return p[:, 1]
        inner = np.ones(len(x), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        joint = a[at - 1][:, :, None] * move[None] * (e[at] * b[at])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return p[:, 1], joint.sum(axis=0), at

    @staticmethod
    def fit(x: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 250, rate: float = 0.08, ridge: float = 3e-3) -> Field:
        y = np.repeat(label, size).astype(np.float64)
        field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
        known = [field.weight, field.step]
        mean, square = [np.zeros_like(k) for k in known], [np.zeros_like(k) for k in known]
        # each document weighs the same, and each of its lines
        weight = np.repeat(1.0 / size, size) / len(size)
        seen = np.zeros((2, 2))
        for turn in range(1, rounds + 1):
            p, expected, at = field.marginals(x, size, True)
            if turn == 1:
                np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1.0)
            slopes = [x.T @ ((y - p) * weight) - ridge * field.weight / 10, (seen - expected) / len(x) - ridge * field.step]
            for k, g, m, s in zip(known, slopes, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                k += rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-9)
        return field

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The length-weighted mean marginal of each text."""
        parts = [line_features(t) for t in texts]
        size = np.array([len(p) for p, _ in parts])
        first = np.cumsum(size) - size
        x = neighbours(np.concatenate([p for p, _ in parts]), first)
        length = np.concatenate([n for _, n in parts])
        good = self.marginals(x, size)
        return np.add.reduceat(good * length, first) / np.add.reduceat(length, first)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = FOLDS,
    sample: int = SAMPLE,
    sample_lines: int = SAMPLE_LINES,
) -> Field | None:
    """The field, learnt from labelled rows outside fold 0; None if there are none."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter((fold(F.col("doc_id"), folds) != 0) & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("y").alias("least")).filter("y = least").drop("least")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("y", "text", F.struct(F.xxhash64("doc_id"), "doc_id", text_key(F.col("text"))).alias("place"))
    kind = rows.schema["place"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                body = value.as_py()
                x, _ = line_features(body)
                if len(x) > sample_lines:
                    at = crc32(utf8(body)) % (len(x) - sample_lines + 1)
                    x = x[at : at + sample_lines]
                out.append((len(x), x.tobytes()))
            columns = zip(*out) if out else ((), ())
            found = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], ["y", "place", "n", "x"])

    found = rows.mapInArrow(lines, f"y int, place {kind}, n bigint, x binary").orderBy("place").limit(sample).select("y", "n", "x").collect()
    if len({r.y for r in found}) < 2:
        return None
    size = np.array([r.n for r in found])
    x = np.frombuffer(b"".join([bytes(r.x) for r in found]), np.float32).reshape(-1, FEATURES)
    return Field.fit(neighbours(x, np.cumsum(size) - size), size, np.array([r.y for r in found]))


def _scores(field: Field | None, texts: list[str | None]) -> np.ndarray:
    return field.scores(texts) if field else np.full(len(texts), 0.5)


STEP = 512


def score(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                found = _scores(field, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    held = F.coalesce(fold(F.col(doc_id), folds) == 0, F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, field: Field | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                batch = whole.slice(i, STEP)
                yield batch.filter(pa.array(_scores(field, batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(scan, docs.schema)


ship(__name__)
