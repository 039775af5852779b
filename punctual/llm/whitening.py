"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become whole numbers ``floor(64 * c) + 1000000``. X holds them, less the mean of each dimension, a row per
vector. The bidiagonalisation alternates products Xv and Xᵀu over all rows, in Spark tasks over blocks of rows; the
driver holds only matrices of one column of length ``dim`` per step.

* **Centring** is exact: with sums S, ``n * x - S`` is a whole number, and only its quotient by n is rounded.
* **Full reorthogonalisation** on both sides in each step. A left vector has an entry per row of X and is never
  stored: as it lies in the range of X, ``u = X p``, its ``p`` is kept, and tasks make all earlier left vectors of
  their own rows anew. So tasks hold no state between steps, a lost executor costs a block's products, and nothing
  is shuffled or joined.
* **Components** come from the SVD of the bidiagonal matrix. The steps end when the wanted ones have converged to
  double precision *and* another block of steps, begun with a random vector orthogonal to all before, finds nothing
  larger; so equal eigenvalues are found as often as they occur. At most ``dim`` steps are taken, then the result is complete.

Vectors that are null, empty, of another length than the most frequent one, with null, NaN or infinite entries, or with
an entry of 2**44 or more in size take no part and give no row. Repeated rows count and return as often as they occur. Tables without a vector give no rows,
and directions without variance (all, where vectors are equal) give no component. Equal eigenvalues: any orthogonal basis,
the same for all rows. Further columns of any name stay inside ``row``. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from punctual.llm.common import stored
from punctual.llm.vectors import dense, dimension

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
#: Entries below this in size: sums over a block of rows then fit 64 bits.
LARGEST = 2.0**44
#: Bytes of a block of rows, as whole numbers of 64 bits.
BLOCK = 1 << 20
#: From this many partial sums on, they are added in Spark first.
WIDE = 512
#: Singular values below this share of the largest are none.
ZERO = 1e-10
#: Residual, as a share of the largest singular value, at which a component has converged.
CONVERGED = 1e-14
SEED = 11


@dataclass(frozen=True)
class Whitening:
    """``whole`` and ``rest``: floor and remainder of the sums of x - SHIFT divided by n; ``components``: a column each."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over the dimensions of (n * x - S) ** 2."""
        if not len(x):
            return []
        off = x - self.whole
        if (self.n * (int(np.abs(off).max()) + 1)) ** 2 * x.shape[1] < 2**63:
            return ((self.n * off - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]


def _whole(values: np.ndarray) -> np.ndarray:
    """x - SHIFT."""
    return np.floor(SCALE * values).astype(np.int64)


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    places, values = dense(column, dim)
    small = (np.abs(values) < LARGEST).all(axis=1)
    return places[small], _whole(values[small])


def _blocks(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = max(1, BLOCK // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _rows(batch.column(0), dim)
            parts = [x[at : at + size] for at in range(0, len(x), size)]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([p.tobytes() for p in parts], pa.binary()),
                    "n": pa.array([len(p) for p in parts], pa.int64()),
                    "sums": pa.array([p.sum(axis=0).tolist() for p in parts], pa.list_(pa.int64())),
                }
            )

    return pack


def _total(blocks: DataFrame, files: int, width: int, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of a vector of length ``width``. A task sends one vector; those of many files are added in Spark first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            for block in batch.column(0):
                out += of_block(np.frombuffer(block.as_buffer(), np.int64))
        yield pa.RecordBatch.from_pydict({"part": pa.array([out.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            for part in batch.column(0):
                out += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_pydict({"part": pa.array([out.tobytes()], pa.binary())})

    parts = blocks.select("block").mapInArrow(partial, "part binary")
    if files > WIDE:
        parts = parts.repartition(math.isqrt(files)).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r["part"]) for r in parts.collect()], axis=0)


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonal_components(
    dim: int, wanted: int, product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of a matrix X of ``dim`` columns, up to ``wanted``.

    ``product(q, P)`` gives ``(XP)ᵀXq``, ``|Xq|²`` and ``XᵀXq``.
    """
    rng = np.random.default_rng(SEED)
    right = np.zeros((dim, 0))  # v, orthonormal
    left = np.zeros((dim, 0))  # p: the left vectors are X p, orthonormal or zero
    back = np.zeros((dim, 0))  # Xᵀ X p
    alphas: list[float] = []
    betas: list[float] = []
    largest, began = 0.0, 0
    v, beta = rng.standard_normal(dim), 0.0
    v /= np.linalg.norm(v)
    while True:
        right = np.column_stack([right, v])
        q = v - beta * left[:, -1] if beta else v
        along, square, w = product(q, left)
        q, w = q - left @ along, w - back @ along
        alpha = math.sqrt(max(0.0, square - float(along @ along)))
        largest = max(largest, alpha)
        if alpha <= ZERO * largest:
            # Xv adds nothing to the left side: the row of this step is zero.
            alpha, q, w = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            q, w = q / alpha, w / alpha
        left, back = np.column_stack([left, q]), np.column_stack([back, w])
        alphas.append(alpha)
        steps = len(alphas)
        small = np.diag(alphas) + np.diag(betas, 1)
        rotated_left, values, rotated_right = np.linalg.svd(small)
        if steps == dim:
            break
        rest = _orthogonal(w - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        largest = max(largest, beta)
        if beta <= ZERO * largest:
            beta = 0.0
        ends = beta * np.abs(rotated_left[-1]) <= CONVERGED * largest
        if ends[:wanted].all():
            # Which of the wanted ones lie in the present block of steps.
            share = (rotated_right[:wanted, began:] ** 2).sum(axis=1)
            ours = (rotated_right[:, began:] ** 2).sum(axis=1) > 0.5
            if began and not (share > 0.5).any() and ends[np.argmax(ours)]:
                break
            if steps >= wanted or beta == 0.0:
                began, beta = steps, 0.0
        if beta == 0.0:
            rest = _orthogonal(rng.standard_normal(dim), right)
        betas.append(beta)
        v = rest / np.linalg.norm(rest)
    kept = [k for k in range(min(wanted, len(values))) if values[k] > ZERO * max(largest, 1e-300)]
    return values[kept], right @ rotated_right[kept].T


def fit(vectors: DataFrame, vector: Column, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors; None if there is none."""
    dim = dimension(vectors, vector)
    if not dim:
        return None
    blocks = stored(vectors.select(vector.alias("v")).mapInArrow(_blocks(dim), "block binary, n long, sums array<long>"))
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    files = len(blocks.inputFiles())
    exact = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    sums = {r["pos"]: int(r["s"]) for r in exact.collect()}
    whole = np.array([sums[k] // n for k in range(dim)])
    rest = np.array([sums[k] % n for k in range(dim)])

    def centred(block: np.ndarray) -> np.ndarray:
        return (block.reshape(-1, dim) - whole) - rest / n

    def product(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        k = p.shape[1]

        def of_block(block: np.ndarray) -> np.ndarray:
            x = centred(block)
            u = x @ q
            return np.concatenate([(x @ p).T @ u, [u @ u], x.T @ u])

        out = _total(blocks, files, k + 1 + dim, of_block)
        return out[:k], float(out[k]), out[k + 1 :]

    trace = float(_total(blocks, files, 1, lambda b: np.array([(centred(b) ** 2).sum()]))[0]) / n
    values, vectors_ = bidiagonal_components(dim, min(components, dim), product) if trace else (np.zeros(0), np.zeros((dim, 0)))
    eigenvalues = values**2 / n
    k = len(eigenvalues)

    def moments(block: np.ndarray) -> np.ndarray:
        z = centred(block) @ vectors_ / np.sqrt(eigenvalues)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    out = _total(blocks, files, k * k + k, moments) / n
    covariance = out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :])
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return Whitening(n, whole, rest, vectors_, eigenvalues, trace, error)


def whiten(vectors: DataFrame, vector: Column, model: Whitening | None) -> DataFrame:
    """``row`` (all columns), ``deviation`` and ``whitened`` (an entry per component) of each vector that takes part."""
    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns]) if vectors.columns else F.struct()
    rows = vectors.select(row.alias("row"), vector.alias("v"))
    schema = T.StructType(
        [rows.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, scaled = len(model.whole), model.components / np.sqrt(model.eigenvalues)
        for batch in batches:
            places, x = _rows(batch.column(1), dim)
            z = model.centred(x) @ scaled
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places)),
                    pa.array(model.deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(z.ravel())),
                ],
                names=["row", "deviation", "whitened"],
            )

    return rows.mapInArrow(apply, schema)
