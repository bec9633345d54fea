"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed against it from left to right into phrases, each
the longest match that the automaton has; phrases times the bits of a pointer into the language's text (log2 of its
length), for each letter of the text, estimate the cross entropy. The language of the least wins; ties go to the name
that sorts first.

The automata are learnt from a bounded sample: for each language the `SAMPLE_DOCS` documents whose ids hash lowest, the
middle `SAMPLE_CHARS` characters of each (parameters). With many languages the share of each is cut so that all tables
together stay under `TABLE_BYTES`, the bound on what is broadcast: with an alphabet of 60 that is some 4,100 letters each
for 100 languages, 410 for 1,000.

All documents are predicted over their whole texts. A text is cut into blocks and all blocks of a batch are parsed side by
side, each from the state in which the `GUESS` letters before it leave an automaton that starts afresh. Where the block
before ends in another state, the block is parsed again from that one, until all agree: the phrases are those of one parse
from end to end.

Nulls: a null text, or one without a letter (of Unicode category L), is `und` with score 0; so is every text if no document is labelled. Null
languages teach nothing. Repeated rows get equal predictions. Ids that are null are not held out. No column but the text
is read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.llm.common import ship, utf8

SAMPLE_DOCS, SAMPLE_CHARS, TABLE_BYTES = 96, 240, 200_000_000
FOLDS, HELD = 4, 2
BLOCK, GUESS, LANES = 512, 96, 16_384
UNKNOWN = "und"

#: Letters and bytes beyond ASCII stay, all else is a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Number signs are word characters too, but no letters."""
    return bool(text) and any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def letters(text: str) -> bytes:
    """Lower-cased letters with single blanks between words, and one before and after."""
    return b" " + b" ".join(utf8(text.lower()).translate(_LETTERS).split()) + b" "


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start. A path from it exists for the substrings of data and no others."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


_ENDS = 1 << 30


class Parser:
    """Tables of all languages over one alphabet. A table's entry is the next row's offset, with a bit set where the
    phrase so far had to end."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.width = len(used) + 2  # and the letters of no language, and the filling of blocks
        self.symbol = np.full(256, len(used), np.uint8)
        self.symbol[used] = np.arange(len(used))
        self.tables, self.bits = [], []
        for name in self.names:
            step = suffix_automaton(self.symbol[np.frombuffer(samples[name], np.uint8)].tobytes())
            lone = len(step)  # the state of a phrase that is one letter the language lacks
            table = np.full((lone + 1, self.width), -1, np.int32)
            for state, out in enumerate(step):
                table[state, list(out)] = list(out.values())
            start = np.where(table[0] >= 0, table[0], lone) * self.width
            table = np.where(table >= 0, table * self.width, start | _ENDS)
            table[0] = start  # no phrase is open yet
            table[:, -1] = np.arange(lone + 1) * self.width
            self.tables.append(table.astype(np.int32).ravel())
            self.bits.append(log2(max(2, len(samples[name]))))

    def plain(self) -> dict:
        """The parser as arrays and lists, which can be read again without this package."""
        return vars(self)

    @classmethod
    def of(cls, plain: dict) -> Parser:
        parser = cls.__new__(cls)
        vars(parser).update(plain)
        return parser

    def _run(self, table: np.ndarray, blocks: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end within each block (a row), and the state at its end, from a state before it."""
        ends, left = np.zeros(len(blocks), np.int64), np.empty(len(blocks), np.int32)
        for k in range(0, len(blocks), LANES):
            columns = np.ascontiguousarray(blocks[k : k + LANES].T)
            now, at = state[k : k + LANES].copy(), np.empty(columns.shape[1], np.int64)
            got, count = np.empty_like(now), np.zeros_like(now)
            for row in columns:
                np.add(now, row, out=at)
                np.take(table, at, out=got, mode="clip")
                count += got >> 30
                np.bitwise_and(got, _ENDS - 1, out=now)
            ends[k : k + LANES], left[k : k + LANES] = count, now
        return ends, left

    def phrases(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language. blocks: the texts' blocks, one below the other; first: where texts begin."""
        begins = np.zeros(len(blocks), bool)
        begins[first] = True
        inner = np.flatnonzero(~begins)
        last = np.append(first[1:], len(blocks)) - 1
        out = np.empty((len(self.tables), len(first)), np.int64)
        for mine, table in zip(out, self.tables):
            start = np.zeros(len(blocks), np.int32)
            start[inner] = self._run(table, blocks[inner - 1, -GUESS:], start[inner])[1]
            ends, left = self._run(table, blocks, start)
            while len(wrong := inner[left[inner - 1] != start[inner]]):
                start[wrong] = left[wrong - 1]
                ends[wrong], left[wrong] = self._run(table, blocks[wrong], start[wrong])
            mine[:] = np.add.reduceat(ends, first) + (left[last] > 0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded, known = [], []
        answer: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.names:
            return answer
        fill = self.width - 1
        for i, text in enumerate(texts):
            if has_letter(text):
                raw = np.frombuffer(letters(text), np.uint8)
                whole = np.full(-(-len(raw) // BLOCK) * BLOCK, fill, np.uint8)
                whole[: len(raw)] = self.symbol[raw]
                coded.append(whole.reshape(-1, BLOCK))
                known.append(i)
        if not known:
            return answer
        first = np.cumsum([0, *map(len, coded[:-1])])
        total = self.phrases(np.concatenate(coded), first).astype(float)
        cost = total * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        for j, i in enumerate(known):
            least = cost[best[j], j]
            second = min((c for l, c in enumerate(cost[:, j]) if l != best[j]), default=None)
            sure = 1.0 if second is None else 0.0 if second <= 0 else 1 - least / second
            answer[i] = (self.names[best[j]], float(sure))
        return answer


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Parser:
    """The parser, from labelled documents outside the held-out fold."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    lowest = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("k", F.row_number().over(lowest)).filter(F.col("k") <= sample_docs)
    middle = F.expr(f"substring(text, greatest(1, int(length(text) / 2) - {sample_chars // 2}), {sample_chars})")
    rows = known.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    samples: dict[str, list[bytes]] = {}
    for r in rows.select("doc_id", "lang", middle.alias("t")).orderBy("lang", "doc_id", "t").toLocalIterator():
        mine = samples.setdefault(r.lang, [])
        if r.t and len(mine) < sample_docs and (data := letters(r.t)).strip():
            mine.append(data)
    width = len(set(b"".join(x for v in samples.values() for x in v))) + 2
    most = TABLE_BYTES // max(1, len(samples)) // (8 * width)  # a letter makes two states at most
    joined = {k: b"".join(v)[:most] for k, v in samples.items() if v}
    return Parser(joined)


def identify(docs: DataFrame, parser: Parser, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (how much better the best language parses than the next)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(parser.plain())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Parser.of(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                found = own.predict(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


ship(__name__)
