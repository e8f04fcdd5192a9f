"""Whitening of embeddings by a tall-skinny QR: no covariance matrix is formed.

The fit list, each distinct vector of scaled integers once, is centred with exact integer sums. Each partition folds its
centred rows into one triangular factor; factors are stacked and factored anew in a tree, ``FAN_IN`` at a time, until one
is left. Its singular values are those of the whole centred list, and its right vectors, over the deviations, whiten.
What meets in a task or on the driver is a few matrices of dimension by dimension, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SCALE = 256
COMPONENTS = 4
#: Factors that a step of the tree stacks.
FAN_IN = 16
#: Rows that are stacked below a factor at once.
ROWS = 4096
_MOST = (1 << 63) - 1


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, as bigint; a value beyond bigint becomes its nearest end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are, and are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, ended by zeros where they are shorter than ``dim``."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as int64 where that holds it, else as Python's integers."""
    reach = int(np.abs(x.astype(object) if x.min(initial=0) == -_MOST - 1 else x).max(initial=0))
    if n * reach + max(map(abs, sums), default=0) <= _MOST:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def square_sums(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where a long does not hold it."""
    reach = int(np.abs(y).max(initial=0))
    if y.dtype != object and reach * reach * y.shape[1] <= _MOST:
        return (y * y).sum(axis=1).tolist()
    found = (y.astype(object) ** 2).sum(axis=1)
    return [int(v) if v <= _MOST else None for v in found]


def fold(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``factor`` with ``rows`` below it."""
    return np.linalg.qr(rows if factor is None else np.vstack((factor, rows)), mode="r")


def _of_partitions(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], list[tuple]], schema: str) -> DataFrame:
    """``work``'s rows for each partition that has rows."""
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    arrow = [{"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = work(batches)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True)], names=list(names))

    return df.mapInArrow(run, schema)


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows of the fit list, and their sum in each dimension. Halves of 32 bits are summed apart, so that a partition's
    sums hold in 64 bits; the sums of partitions are decimals."""

    def work(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        n, high, low = 0, np.zeros(dim, dtype=np.int64), np.zeros(dim, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        return [(-1, n, 0), *((i, int(h), int(v)) for i, (h, v) in enumerate(zip(high, low, strict=True)))]

    parts = _of_partitions(fit, work, "dim int, high bigint, low bigint")
    wide = parts.groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = {r["dim"]: (int(r["high"]), int(r["low"])) for r in wide.collect()}  # one row a dimension
    return found[-1][0], [(found[i][0] << 32) + found[i][1] for i in range(dim)]


def _column_sums(fit: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """The sum over the fit list of ``work``'s ``width`` columns."""

    def sums(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        total = np.zeros(width)
        for b in batches:
            total += work(_matrix(b.column(0), dim)).sum(axis=0)
        return list(enumerate(total.tolist()))

    found = _of_partitions(fit, sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(width)
    for r in found.collect():  # one row a column
        out[r["at"]] = r["v"]
    return out


def tall_qr(fit: DataFrame, n: int, sums: list[int], fan_in: int = FAN_IN) -> np.ndarray:
    """The triangular factor of the centred rows of ``fit`` (one column, lists of bigint)."""
    dim = len(sums)

    def leaves(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        factor = None
        for b in batches:
            x = _matrix(b.column(0), dim)
            for i in range(0, len(x), ROWS):
                factor = fold(factor, deviations(x[i : i + ROWS], n, sums).astype(float) / n)
        return [] if factor is None else [(TaskContext.get().partitionId(), factor.tobytes())]

    def merge(table: pa.Table) -> pa.Table:
        factor = None
        for at, raw in sorted(zip(table["i"].to_pylist(), table["r"].to_pylist(), strict=True)):
            factor = fold(factor, np.frombuffer(raw).reshape(-1, dim))
        return pa.table({"i": pa.array([at // fan_in], pa.int64()), "r": pa.array([factor.tobytes()], pa.binary())})

    factors = materialize(_of_partitions(fit, leaves, "i bigint, r binary"), "whiten-factors")
    last = factors.agg(F.max("i")).first()[0]
    while last:
        last //= fan_in
        factors = materialize(factors.groupBy(F.expr(f"i div {fan_in}")).applyInArrow(merge, "i bigint, r binary"), "whiten-factors")
    return np.frombuffer(factors.first()["r"]).reshape(-1, dim)


@dataclass
class Whitening:
    """What was fitted: size and exact sums of the fit list, unit vectors as columns by falling variance, all variances,
    and the largest entry by which the whitened list's covariance differs from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance is NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            centred = deviations(x, self.n, self.sums).astype(float) / self.n
            return np.where(self.variances > 0, centred @ self.vectors / np.sqrt(self.variances), np.nan)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits on ``fit``, one column of distinct bigint lists, written to where it can be read again; None if it has no
    rows or only empty ones. Variances that double precision cannot tell from 0 are 0."""
    dim = fit.agg(F.max(F.size(fit.columns[0]))).first()[0]
    if not dim:
        return None
    n, sums = _exact_sums(fit, dim)
    _, deviation, right = np.linalg.svd(tall_qr(fit, n, sums), full_matrices=False)
    k = min(components, dim)
    variance = np.zeros(dim)
    variance[: len(deviation)] = deviation**2 / n
    variance[variance <= variance[0] * (np.finfo(float).eps * dim) ** 2] = 0
    vectors = np.zeros((dim, k))
    vectors[:, : min(k, len(right))] = right[:k].T
    # either sign is right: the largest entry is made positive
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    made = Whitening(n, sums, vectors, variance[:k], float(variance.sum()))
    whole = variance[:k] > 0
    means = _column_sums(fit, k, lambda x: np.nan_to_num(made.project(x)), dim) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = np.nan_to_num(made.project(x)) - means
        return (w[:, :, None] * w[:, None, :]).reshape(len(x), k * k)

    covariance = _column_sums(fit, k * k, products, dim).reshape(k, k) / n
    made.identity_error = float(np.abs(covariance - np.eye(k))[np.ix_(whole, whole)].max(initial=0.0))
    return made


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries go; null and repeated ids are rows like any others, and
    repeated vectors weigh once in the fit. A vector that is shorter than the longest ends in zeros. ``deviation`` is null
    where a long does not hold it. A component without variance (fewer distinct vectors than components, or equal ones)
    has null ``whitened``; there are as many components as dimensions at most. A table without usable rows, or with
    empty vectors only, gives no rows.
    """
    kept = vectors.filter(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), scaled(F.col(vector), scale).alias("x"))
    schema = T.StructType([kept.schema["vec_id"]]).add("component", "integer").add("n", "long").add("deviation", "long")
    for c in ("whitened", "explained", "identity_error"):
        schema = schema.add(c, "double")
    made = fit_whitening(materialize(kept.select("x").distinct(), "whiten-fit"), components)
    if made is None:
        return kept.sparkSession.createDataFrame([], schema)
    dim, k = made.vectors.shape
    explained = [v / made.trace if made.trace else 0.0 for v in made.variances.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            each = np.repeat(np.arange(len(x)), k)
            white = made.project(x).ravel()
            far = pa.array(square_sums(deviations(x, made.n, made.sums)), pa.int64())
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, made.n, dtype=np.int64)),
                    far.take(pa.array(each)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(explained, m), pa.float64()),
                    pa.array(np.full(m * k, made.identity_error)),
                ],
                names=schema.names,
            )

    return kept.mapInArrow(run, schema)
