"""Whitening of embeddings: principal axes of the different vectors, scaled to unit variance.

Entries become whole numbers, x = floor(scale * entry). The fit list holds each different vector once; it is written, and
one aggregation gives its size and the sums of all dimensions, another the upper triangle of the covariance: a generated SQL
expression for each pair of dimensions sums their centred products. LAPACK's symmetric solver decomposes the dims x dims
matrix, the only thing besides the sums that reaches the driver. All rows are then projected batch by batch.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors shorter than the longest
that is left (they lack entries). Equal rows give equal rows each. A component without variance (its eigenvalue within
rounding of zero: the list is flat that way, or one vector alone) has nothing to scale by: its `whitened` is null and it does not enter
`identity_error`, which is null if no component has variance. With fewer dimensions than components each dimension gives one. A `deviation` that no long holds is
null. Entries so large that floor(scale * entry) leaves the longs count as non-finite. Empty tables give no rows. Other columns
are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import durable, ship

SCALE, COMPONENTS = 256, 4
_LONG = 2**63


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The vector's entries as longs; null if an entry is null or not finite."""
    x = F.transform(vector, lambda c: c.cast("double") * scale)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)), F.transform(x, lambda c: F.floor(c)))


class Axes(NamedTuple):
    n: int
    sums: list[int]
    axes: np.ndarray  # components x dimensions, unit rows
    values: np.ndarray  # eigenvalues, falling
    trace: float
    most: int  # the largest entry, without its sign

    def scaled(self, k: int) -> np.ndarray | None:
        """The axis over the root of its eigenvalue; None without variance."""
        small = 64 * np.finfo(float).eps * max(1.0, self.trace)
        return self.axes[k] / np.sqrt(self.values[k]) if self.values[k] > small else None


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of the vectors x of fit, divisor n: each pair of dimensions is an expression of one aggregation."""
    d = len(sums)
    centred = fit.select(*[(F.col("x")[i].cast("double") - F.lit(sums[i] / n)).alias(f"c{i}") for i in range(d)])
    row = centred.agg(*[F.expr(f"sum(c{i} * c{j}) AS p{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = row[f"p{i}_{j}"] / n
    return out


def fit_axes(fit: DataFrame, components: int = COMPONENTS) -> Axes | None:
    """The axes of a list of different vectors x of one size; None if it is empty."""
    size = fit.select(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    row = fit.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]).first()
    sums = [int(row[f"s{i}"]) for i in range(size)]
    v = covariance(fit, row["n"], sums)
    values, vectors = np.linalg.eigh(v)
    k = min(components, size)
    return Axes(row["n"], sums, vectors.T[::-1][:k].copy(), values[::-1][:k].copy(), float(np.trace(v)), row["most"])


def project(rows: DataFrame, axes: Axes, keep: list[str]) -> DataFrame:
    """rows with x as `whitened`, an array of the components, and `deviation`."""
    n, d = axes.n, len(axes.sums)
    mean = np.array([s / n for s in axes.sums])
    scaled = [axes.scaled(k) for k in range(len(axes.values))]
    fits = d * (n * axes.most + max(map(abs, axes.sums), default=0)) ** 2 < _LONG
    small = np.array(axes.sums, np.int64) if fits else None
    large = np.array(axes.sums, object)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if small is not None:
                far = ((x * n - small) ** 2).sum(axis=1).tolist()
            else:
                far = [f if (f := int(sum((n * int(v) - s) ** 2 for v, s in zip(r, large)))) < _LONG else None for r in x]
            c = x.astype(float) - mean
            found = [(c * w).sum(axis=1) if w is not None else None for w in scaled]
            lists = pa.ListArray.from_arrays(
                pa.array(range(0, len(x) * len(scaled) + 1, max(1, len(scaled))), pa.int32()),
                pa.array([None if f is None else float(f[i]) for i in range(len(x)) for f in found], pa.float64()),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(far, pa.int64())], [*keep, "whitened", "deviation"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "x").mapInArrow(scan, ", ".join([*kinds, "whitened array<double>", "deviation bigint"]))


def identity_error(fit: DataFrame, axes: Axes) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, at most."""
    live = [k for k in range(len(axes.values)) if axes.scaled(k) is not None]
    if not live:
        return None
    done = project(fit, axes, []).select(*[F.col("whitened")[k].alias(f"w{k}") for k in live])
    row = done.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"v{a}_{b}") for a in live for b in live if a <= b]).first()
    return max(abs(row[f"v{a}_{b}"] - (a == b)) for a in live for b in live if a <= b)


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """A row for each row left and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = table.select(F.col(vec_id).alias("vec_id"), whole(F.col(vector), scale).alias("x")).filter("x is not null")
    size = rows.select(F.max(F.size("x"))).first()[0] or 0
    rows = rows.filter(F.size("x") == size)
    fit = durable(rows.select("x").distinct())
    axes = fit_axes(fit, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if axes is None:
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fit, axes)
    shares = F.array(*[F.lit(max(0.0, float(e)) / axes.trace if axes.trace > 0 else 0.0) for e in axes.values])
    each = project(rows, axes, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(axes.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))



ship(__name__)
