"""Whitening of vectors: leading principal components by matrix-free block subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import usable

#: Components are scaled by this, shifted and floored.
SCALE, SHIFT = 1024, 100_000
#: Whole numbers end here: a larger component counts as this.
LIMIT = 1 << 52
#: Components that are made, vectors of a block beside them, and columns that the search space holds at most.
COMPONENTS, GUARD, BASIS = 8, 16, 144
#: Residuals that certify a component, as a share of the largest eigenvalue; passes at most.
TOLERANCE, PASSES = 1e-13, 200
#: An eigenvalue under this share of all variance is rounding, and no component.
RANK = 1e-11


@dataclass(frozen=True)
class Whitening:
    """Of n vectors with these sums: eigenvectors (dim x k), eigenvalues from the largest, all variance, and what certifies them."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    def explained(self) -> np.ndarray:
        return self.values / self.trace if len(self.values) else self.values


def _whole(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``dim`` finite components, and those as whole numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), dim)  # null components become NaN
    sound = np.isfinite(x).all(axis=1)
    x = np.clip(np.floor(SCALE * x[sound]) + SHIFT, -LIMIT, LIMIT)
    return at[sound], x.astype(np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n; by way of n * x - S where 64 bits hold that, which rounds once."""
    if float(np.abs(x).max(initial=0)) * n < 2.0**61 and float(np.abs(sums).max(initial=0)) < 2.0**61:
        return (n * x - sums) / n
    return x - sums / n


def _added(vectors: DataFrame, vector: str, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of an array made of each batch of them, flat. Each task sends its own sum; the driver gets one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            _, x = _whole(b.column(0), dim)
            if len(x):
                made = of(x).reshape(-1)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    kind = "long" if of(np.zeros((1, dim), dtype=np.int64)).dtype == np.int64 else "double"
    rows = vectors.select(F.col(f"`{vector}`")).mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r.at for r in rows), default=-1) + 1, dtype=np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r.at] = r.value
    return out


def _orthonormal(y: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``y`` has beside the columns of ``against``."""
    size = np.linalg.norm(y, axis=0)
    y = y[:, size > 0] / size[size > 0]
    for _ in range(2):
        y = y - against @ (against.T @ y)
        q, r = np.linalg.qr(y)
        y = q[:, np.abs(np.diag(r)) > 1e-10 if _ == 0 else slice(None)]
    return y


def fit(vectors: DataFrame, k: int = COMPONENTS, vector: str = "embedding", seed: int = 11) -> Whitening:
    """Means and the ``k`` leading components of all usable vectors of the commonest length.

    Each Spark pass multiplies the covariance with one block of k + GUARD vectors, X'(XQ) on centred rows, and never
    makes it. The block is orthonormalised (QR) against the blocks before it; Rayleigh-Ritz over all of them
    gives the components, and their residuals the next block. Done when the residuals certify all k components, or the
    blocks span the whole space. At BASIS columns the best ones are kept and the rest goes. A pass sends dim x block
    numbers from each task, added up on the way.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do those of another length
    than the commonest (of equals the longest). Rows that repeat count each. Fewer components than ``k`` where the rank
    is lower; none without vectors. Other columns do not matter.
    """
    lengths = vectors.where(usable(vector)).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return Whitening(0, np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    dim, n = top.dim, top.n
    sums = _added(vectors, vector, dim, lambda x: x.sum(axis=0))
    block = min(dim, k + GUARD)
    basis, image, trace, passes = np.zeros((dim, 0)), np.zeros((dim, 0)), 0.0, 0
    new = _orthonormal(np.random.default_rng(seed).standard_normal((dim, block)), basis)
    while True:
        def product(x: np.ndarray, q: np.ndarray = new) -> np.ndarray:
            c = _centred(x, n, sums)
            return np.append((c.T @ (c @ q)).reshape(-1), (c * c).sum())

        sent = _added(vectors, vector, dim, product) / n
        passes += 1
        trace = float(sent[-1])
        basis, image = np.hstack([basis, new]), np.hstack([image, sent[:-1].reshape(dim, -1)])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, mapped = basis @ turn, image @ turn
        error = mapped - ritz * values
        residuals = np.linalg.norm(error[:, :k], axis=0)
        new = _orthonormal(error[:, :block], basis)[:, : dim - basis.shape[1]]
        if residuals.max(initial=0) <= TOLERANCE * max(values[0], 0) or basis.shape[1] + new.shape[1] > dim or not new.shape[1] or passes >= PASSES:
            break
        if basis.shape[1] + new.shape[1] > max(BASIS, 3 * block):
            basis, image = ritz[:, : 2 * block], mapped[:, : 2 * block]
    held = np.flatnonzero(values[:k] > RANK * trace)
    found = ritz[:, held]
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(len(held))] < 0, -1.0, 1.0)
    return Whitening(n, sums, found, values[held], trace, residuals[held], passes)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over components of (n * x - S)^2, exact; what 64 bits cannot hold counts as the nearest that they can."""
    most = float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0))
    if most < 2.0**61:
        d = n * x - sums
        if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
            return (d * d).sum(axis=1)
    d = n * x.astype(object) - sums.astype(object)
    return np.array([min(int(v), (1 << 63) - 1) for v in (d * d).sum(axis=1)], dtype=np.int64)


def transform(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, deviation, whitened``: of each vector that took part in the fit, or is like those, its squared distance from the mean in
    whole numbers (times n^2) and its component scores, each of variance 1 over the fit.

    Other rows are left out. A null key stays null; rows that repeat are each given. Other columns do not matter.
    """
    dim, kind = len(model.sums), vectors.schema[key].dataType.simpleString()
    told = vectors.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors / np.sqrt(model.values)))  # dim x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, to = told.value
        for b in batches:
            at, x = _whole(b.column(1), dim)
            if len(at):
                scores = _centred(x, n, sums) @ to
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * scores.shape[1], pa.array(scores.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(_deviations(x, n, sums)), lists], names=["key", "deviation", "whitened"])

    made = vectors.select(F.col(f"`{key}`"), F.col(f"`{vector}`")).mapInArrow(run, f"key {kind}, deviation long, whitened array<double>")
    return made.withColumnRenamed("key", key)


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """How far the covariance of the whitened vectors of the fit is from the identity, in its worst entry: two passes, centred first."""
    dim, k, to = len(model.sums), len(model.values), model.vectors / np.sqrt(model.values)
    if not k:
        return 0.0
    mean = _added(vectors, vector, dim, lambda x: (_centred(x, model.n, model.sums) @ to).sum(axis=0)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, model.n, model.sums) @ to - mean
        return w.T @ w

    return float(np.abs(_added(vectors, vector, dim, products).reshape(k, k) / model.n - np.eye(k)).max())


def digest(embeddings: DataFrame) -> DataFrame:
    """Component by component, with what the fit says of it."""
    model = fit(embeddings)
    worst = identity_error(embeddings, model)
    shares = F.array(*[F.lit(float(s)) for s in model.explained()]).cast("array<double>")
    opened = transform(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "score"))
    return opened.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("score").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(worst).alias("identity_error"))
