"""Operator 13: whitening of embeddings, with the covariance put together by polarisation.

Entries become integers x, so every sum is exact. ``fit`` takes each distinct vector once and needs two
passes over them: the sums of each dimension, then the squares of z = n*x - S (the centred values) of
each dimension and of each sum of two dimensions. As (a + b)^2 = a^2 + b^2 + 2ab, half of what the
variance of a sum exceeds both variances by is their covariance. Only these d(d+1)/2 sums reach the driver, whatever the
number of rows; ``eigh`` runs there. ``whiten`` projects rows, and ``identity_error`` measures the
covariance of what it makes.

Distinct vectors are counted before the shuffle in each task, so copies are dealt once a task. A task
holds one batch of rows and one sum for each pair of dimensions.

Nulls: rows whose vector is null or empty, or holds null, infinite, not-a-number entries or such that 64 times
them exceeds 2**52, are left out. Vectors of another length than the most frequent one (of like counts the longest) are left
out, as they have no common covariance. A null vec_id is kept. Repeated rows are whitened each. A component without variance
(fewer distinct vectors than dimensions, constant entries) has null values and no part in
``identity_error``. An empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import written

SCALE, SHIFT = 64, 1_000_000
#: Integers up to this are exact as doubles, so a scaled entry's floor is.
EXACT = float(1 << 52)
COMPONENTS = 16
#: Rows of one batch of sums; products of two 24-bit limbs times this stay below 2**63.
ROWS = 2048
_LIMB = 24
#: A sum goes through Spark as two numbers, so it may have 62 digits.
_HALF = 10**24
_DECIMAL = pa.decimal128(38, 0)


def _usable(vector: Column) -> Column:
    c = lambda e: e.cast("double")
    good = F.forall(vector, lambda e: F.coalesce(~F.isnan(c(e)) & (F.abs(c(e)) * SCALE <= EXACT), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def integers(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, x (array of long) of the rows that can be used."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("v")).where(_usable(F.col("v")))
    rows = rows.select("vec_id", F.transform("v", lambda e: F.floor(e.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


@dataclass(frozen=True)
class Model:
    """n distinct vectors with sums S; axes (one column a component, by falling eigenvalue), their variances, the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace else 0.0 for e in self.variances]

    @property
    def live(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.variances > self.trace * len(self.sums) * np.finfo(float).eps


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, as 64-bit integers or, where those don't hold it, as Python's."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    y = x - whole
    if len(y) and (int(np.abs(y).max()) + 1) * n >= 1 << 61:
        return y.astype(object) * n - rest
    return y * np.int64(n) - rest


def squares(u: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each column (Python integers), for 2,048 rows at most."""
    if u.dtype == object or not len(u):
        return (u.astype(object) ** 2).sum(0)
    most = int(np.abs(u).max())
    if most < 1 << 25:
        return np.einsum("ij,ij->j", u, u).astype(object)
    limbs = [u & ((1 << _LIMB) - 1), (u >> _LIMB) & ((1 << _LIMB) - 1), u >> 2 * _LIMB]
    out = 0
    for p in range(3):
        for q in range(p, 3):
            out = out + (np.einsum("ij,ij->j", limbs[p], limbs[q]).astype(object) << (_LIMB * (p + q) + (p < q)))
    return out


def _batches(batches, d: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.slice(at, ROWS).column("x"), d)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, DataFrame]:
    """The model of the distinct vectors of ``integers``, and these (a written table); None if there are no rows."""
    seen = written(rows.select("x").distinct(), "whitening")
    sums = seen.select(F.posexplode("x").alias("k", "e")).groupBy("k").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("k").collect()
    if not sums:
        return None, seen
    n, d, s = sums[0]["n"], len(sums), [r["s"] for r in sums]

    def run(batches):
        total = [np.zeros(d - i, object) for i in range(d)]
        for x in _batches(batches, d):
            z = centred(x, n, s)
            for i in range(d):
                total[i] += squares(np.column_stack([z[:, i], z[:, i, None] + z[:, i + 1 :]]))
        flat = np.concatenate(total)
        places = [pa.array(np.concatenate(k), pa.int32()) for k in ([np.full(d - i, i) for i in range(d)], [np.arange(i, d) for i in range(d)])]
        halves = [pa.array(map(Decimal, k), _DECIMAL) for k in (flat // _HALF, flat % _HALF)]
        yield pa.RecordBatch.from_arrays([*places, *halves], ["i", "j", "high", "low"])

    # (i, i) holds the squares of a dimension, (i, j) those of the sum of two
    parts = seen.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    square = {(r["i"], r["j"]): int(r["high"]) * _HALF + int(r["low"]) for r in found}
    cov = np.empty((d, d))
    for (i, j), total in square.items():
        cross = total if i == j else (total - square[i, i] - square[j, j]) // 2
        cov[i, j] = cov[j, i] = cross / n**3
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    trace = sum(square[i, i] for i in range(d)) / n**3
    return Model(n, s, axes * signs, np.maximum(values, 0), trace), seen


def _values(z: np.ndarray, model: Model) -> np.ndarray:
    live = model.live
    out = np.full((len(z), len(live)), np.nan)
    out[:, live] = (z / model.n).astype(float) @ (model.axes[:, live] / np.sqrt(model.variances[live]))
    return out


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation, whitened (one value a component) of ``integers``.

    deviation is the sum of squares of n*x - S, exact; null if it has more than 38 digits.
    """
    d = len(model.sums)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = centred(_matrix(part.column("x"), d), model.n, model.sums)
                w = _values(z, model)
                flat = pa.array(w.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
                # a row's squares are summed in slices of columns, as the limbs allow for 2,048 terms
                far = sum(squares(z[:, k : k + ROWS].T) for k in range(0, d, ROWS))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([Decimal(k) if k < 10**38 else None for k in map(int, far)], _DECIMAL), lists], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(seen: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened covariance of the distinct vectors minus the identity.

    Values are projections of n*x - S, whose exact mean is zero, so they are centred as they are.
    """
    d, live = len(model.sums), model.live
    k = int(live.sum())

    def run(batches):
        total = np.zeros((k, k))
        for x in _batches(batches, d):
            w = _values(centred(x, model.n, model.sums), model)[:, live]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["k", "total"])

    if not k:
        return 0.0
    found = seen.mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    cov = np.zeros(k * k)
    for r in found:
        cov[r["k"]] = r["total"] / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())
