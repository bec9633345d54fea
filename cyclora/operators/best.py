"""Best rows of groups: best hits, rescue in two tiers, deduplication, hits without overlap."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cyclora.operators.intervals import pieces
from cyclora.session import ship


#: Hits without overlap are chosen for pieces of about so many rows together.
PIECES_AT_ONCE = 50_000


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark cuts groups down before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def two_tier_rescue(df: DataFrame, keys: list[str], strict: Column, relaxed: Column, order: list[Column]) -> DataFrame:
    """The best row of each key among those that pass the strict test; for keys without any, among the relaxed. `tier`
    tells which. One pass: strict rows sort before relaxed ones."""
    tiered = df.withColumn("tier", F.when(strict, "strict").when(relaxed, "relaxed")).filter("tier is not null")
    return best_row(tiered, keys, [F.desc("tier"), *order])


def first_known(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The first value that isn't null of each column, in the given order, for each group."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return best_row(df, keys, [F.asc(c) for c in order])


def union_keep_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of several tables; of each key the first table's row."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return best_row(out, keys, [F.asc("_source"), *[F.asc(c) for c in order]]).drop("_source")


class _Taken:
    """Disjoint intervals in order, in blocks, so that to add one moves few."""

    def __init__(self, most: int = 512):
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.firsts: list[int] = [0]
        self.most = most

    def _block(self, at: int) -> int:
        return max(0, bisect_right(self.firsts, at) - 1)

    def overlaps(self, start: int, end: int) -> bool:
        """Whether the last interval that begins by `end` reaches `start`."""
        i = self._block(end)
        k = bisect_right(self.blocks[i], end, key=itemgetter(0))
        return k > 0 and self.blocks[i][k - 1][1] >= start

    def add(self, start: int, end: int) -> None:
        i = self._block(start)
        block = self.blocks[i]
        insort(block, (start, end))
        self.firsts[i] = block[0][0]
        if len(block) > self.most:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.firsts[i : i + 1] = [block[0][0], block[half][0]]


def _greedy(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which intervals stay when each, in order, is taken if it overlaps none taken before."""
    taken, keep = _Taken(), np.zeros(len(start), bool)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        if not taken.overlaps(a, b):
            taken.add(a, b)
            keep[i] = True
    return keep


def _exact(start: np.ndarray, end: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which intervals make up the best total score without overlap (weighted interval scheduling)."""
    order = np.lexsort((start, end))
    s, e, w = start[order], end[order], score[order]
    before = np.searchsorted(e, s, side="left")
    best = np.zeros(len(s) + 1)
    take = np.zeros(len(s), bool)
    for i in range(len(s)):
        with_it = w[i] + best[before[i]]
        take[i] = with_it > best[i]
        best[i + 1] = max(best[i], with_it)
    keep, i = np.zeros(len(s), bool), len(s) - 1
    while i >= 0:
        if take[i]:
            keep[order[i]] = True
            i = before[i] - 1
        else:
            i -= 1
    return keep


def non_overlapping(df: DataFrame, key: str, start: str, end: str, score: str, tie: list[str], exact: bool = False) -> DataFrame:
    """The hits of each key without overlaps: greedily by score (ties by the tie columns), or the best total. A key is cut where
    no hit crosses, and the pieces are solved apart: a choice within one bars nothing in another, and the best total is
    the sum of the pieces' best."""
    piece, group = "_piece", "_group"
    cut = pieces(df, key, start, end, piece)
    groups = max(cut.sparkSession.sparkContext.defaultParallelism, -(-cut.count() // PIECES_AT_ONCE))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, *tie], ascending=[False] + [True] * len(tie), kind="stable").reset_index(drop=True)
        # the group's pieces one behind the other, so that no two of them overlap
        code = pdf.groupby([key, piece], dropna=False).ngroup().to_numpy()
        a, b = (pdf[c].to_numpy() - pdf[piece].to_numpy() for c in (start, end))
        room = pd.Series(b).groupby(code).max().to_numpy() + 1
        shift = (np.cumsum(room) - room)[code]
        chosen = _exact(a + shift, b + shift, pdf[score].to_numpy()) if exact else _greedy(a + shift, b + shift)
        return pdf[chosen].drop(columns=[piece, group])

    return cut.withColumn(group, F.pmod(F.xxhash64(key, piece), F.lit(groups))).groupBy(group).applyInPandas(select, df.schema)


def strided_parts(df: DataFrame, order: list[str], parts: int, out: str = "part") -> DataFrame:
    """df dealt out in turn, in the given order, to the given number of parts."""
    from cyclora.operators.ordering import running

    x = running(df, [F.asc(c) for c in order], {"_rn": F.lit(1)})
    return x.withColumn(out, F.pmod(F.col("_rn") - 1, F.lit(parts)).cast("int")).drop("_rn")


def chunks(df: DataFrame, order: list[str], size: int, out: str = "chunk") -> DataFrame:
    """df in consecutive chunks of a size."""
    from cyclora.operators.ordering import running

    x = running(df, [F.asc(c) for c in order], {"_rn": F.lit(1)})
    return x.withColumn(out, F.floor((F.col("_rn") - 1) / size).cast("int")).drop("_rn")


def batches(frames: Iterator[DataFrame]) -> DataFrame:
    frames = iter(frames)
    out = next(frames)
    for f in frames:
        out = out.unionByName(f)
    return out


ship(__name__)
