"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, x = floor(64 c) + 1000000, and are packed into blocks of rows, as deviations from that offset in
the smallest integer type that holds them; count and sums are exact.  Everything that is multiplied is centred first.

A block of orthonormal vectors Q, somewhat wider than the number of components, is moved toward the largest eigenvectors of
the covariance V.  A pass over the rows gives VQ = sum of (x - mean) ((x - mean) Q) / n: each task adds up its own blocks'
share, Spark adds the tasks' shares, and only the d x q sum comes to the driver.  A filter of degree m takes m passes by the
three-term recurrence of the Chebyshev polynomials, scaled to the interval of unwanted eigenvalues, which it damps while it
lifts those above; m is at most DEGREE, and less where a component far above the others would drown them.  Then QR, and Rayleigh-Ritz in the space found: with VQ from one more pass, QᵀVQ's eigenvectors give the
components' next estimate.  The interval's upper end is the smallest Ritz value, its lower end comes from Lanczos steps that
ride along as one more column of the passes.  Leading components
that are done are set aside and kept out of the next filters.  The rounds end when the residuals |Vy - ey| of all components are certified:
below TIGHT times the largest eigenvalue, or as small as rounding lets them be (no longer halved by a round).  A block as
wide as the vectors is certified by its first pass.

A last pass takes the covariance of the whitened rows, whose distance from the identity is the identity error.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are those whose
length is not the most frequent one (the greater of equals), since no covariance holds both; vectors that repeat count each
time; components beyond the vectors' length or without variance (eigenvalue below 1e-12 of the largest) do not exist, as there
is nothing to divide by; a single vector, equal vectors or an empty table give no rows; eigenvalues that tie give any
orthonormal basis of their space; a null vec_id stays null.  A deviation that no long holds is null.  Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

OFFSET, SCALE = 1_000_000, 64
COMPONENTS = 32
ROWS, BLOCK_BYTES = 4096, 1_000_000  # rows of a block, at most; bytes of a block of 16-bit numbers, about
DEGREE, LANCZOS, ROUNDS = 10, 12, 60
TIGHT = 1e-14  # of the largest eigenvalue: about what rounding leaves of a residual
LOCK = 1e-14  # of the largest eigenvalue: the residual of a component that is done
RANGE = 18.0  # natural logarithm of the most that a filter lifts one component over another: beyond, digits of the lower one go
LEAST = 1e-12  # of the largest eigenvalue: variance that is none
KINDS = ("<i2", "<i4", "<i8")


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, y array<long>) with y = floor(64 c), and the vectors' length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()  # one row
    d = sizes[0]["d"] if sizes else 0
    rows = rows.where(F.size("v") == d)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).cast("array<long>").alias("y")), d


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """Rows in blocks: (ids array<long>, kind, data binary, n, sums array<decimal>), data being n x d numbers of that kind and
    sums their exact sums by dimension."""
    most = max(1, min(ROWS, BLOCK_BYTES // (2 * max(1, d))))
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("data", pa.binary()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            y = np.concatenate([b.column(1).flatten().to_numpy() for b in held]).reshape(-1, d)
            kind = next(k for k in KINDS if k == KINDS[-1] or (np.iinfo(k).min <= y.min() and y.max() <= np.iinfo(k).max))
            one = pa.array([0, len(y)], pa.int32())
            sums = y.astype(np.int64 if kind != KINDS[-1] else object).sum(axis=0).tolist()
            return pa.record_batch([pa.ListArray.from_arrays(one, ids), pa.array([kind]), pa.array([y.astype(kind).tobytes()], pa.binary()), pa.array([len(y)], pa.int64()), pa.array([list(map(Decimal, sums))], pa.list_(pa.decimal128(38)))], schema=schema)

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, most - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == most:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return rows.mapInArrow(run, "ids array<long>, kind string, data binary, n long, sums array<decimal(38,0)>")


class Blocks:
    """Packed rows in a written table, their number and exact sums, and passes over them."""

    def __init__(self, table: DataFrame, d: int):
        self.table, self.d = table, d
        one = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(d))).first()
        self.n, self.sums = int(one["n"]), [int(one[f"s{j}"] or 0) for j in range(d)]

    def centre(self) -> Callable[[str, bytes], np.ndarray]:
        """A function from a block to its centred rows, exact up to the last rounding: whole numbers are subtracted first, in 80
        bits where 64 might not hold the difference."""
        n, sums, d = self.n, self.sums, self.d
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n / n for s in sums])
        return lambda kind, data: (np.frombuffer(data, kind).reshape(-1, d).astype(np.longdouble if kind == KINDS[-1] else np.int64) - whole).astype(float) - rest

    def total(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of ``share`` of their centred rows: summed in tasks, then by Spark, cell by cell."""
        centre, cells = self.centre(), int(np.prod(shape))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for b in batches:
                for kind, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    part = share(centre(kind, data.as_buffer()))
                    own = part if own is None else own + part
            if own is not None:
                yield pa.record_batch([pa.array(np.arange(cells), pa.int32()), pa.array(own.ravel())], names=["cell", "x"])

        parts = self.table.select("kind", "data").mapInArrow(run, "cell int, x double")
        got = parts.groupBy("cell").agg(F.sum("x").alias("x")).toPandas()  # d x q cells
        out = np.zeros(cells)
        out[got["cell"].to_numpy()] = got["x"].to_numpy()
        return out.reshape(shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ: one pass."""
        return self.total(lambda x: x.T @ (x @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.array([(x * x).sum()]), (1,))[0]) / self.n


class Lanczos:
    """Steps of the Lanczos recurrence, one vector of a pass each; a bound below the smallest eigenvalue."""

    def __init__(self, d: int, rng: np.random.Generator, steps: int):
        v = rng.standard_normal(d)
        self.basis, self.alpha, self.beta, self.left = [v / np.linalg.norm(v)], [], [], min(steps, d)

    def next(self) -> np.ndarray | None:
        return self.basis[-1] if self.left else None

    def take(self, w: np.ndarray) -> None:
        self.alpha.append(float(self.basis[-1] @ w))
        for _ in range(2):
            for b in self.basis:
                w = w - (b @ w) * b
        size = float(np.linalg.norm(w))
        self.beta.append(size)
        self.left = self.left - 1 if size > 1e-10 * max(1.0, abs(self.alpha[0])) else 0
        if self.left:
            self.basis.append(w / size)

    def floor(self) -> float:
        if not self.alpha:
            return 0.0
        k = len(self.alpha)
        t = np.diag(self.alpha) + np.diag(self.beta[: k - 1], 1) + np.diag(self.beta[: k - 1], -1)
        e, y = np.linalg.eigh(t)
        return max(0.0, float(e[0] - self.beta[-1] * abs(y[-1, 0])))


def components(times: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, d x k eigenvectors, residuals) of the largest eigenvalues of the operator ``times`` (a d x q block in, V
    times it out), falling."""
    k = min(k, d)
    width = min(d, k + max(8, k // 2))
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    lanczos = Lanczos(d, rng, LANCZOS if width < d else 0)

    def apply(x: np.ndarray) -> np.ndarray:
        rider = lanczos.next()
        if rider is None:
            return times(x)
        both = times(np.column_stack([x, rider]))
        lanczos.take(both[:, -1])
        return both[:, :-1]

    before = np.inf
    for _ in range(ROUNDS):
        vq = apply(q)
        small = q.T @ vq
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        left = np.linalg.norm(vq - q * e, axis=0)[:k]
        worst, top = float(left.max()), max(float(e[0]), 0.0)
        if worst <= TIGHT * top or width == d or (worst <= 1e-12 * top and worst > before / 2):
            break
        before = worst
        # leading components that are done stay as they are, and are kept out of the others' filter
        done = int(np.argmax(np.r_[left > LOCK * top, True]))
        fixed, q, vq, e = q[:, :done], q[:, done:], vq[:, done:], e[done:]
        others = lambda x: x - fixed @ (fixed.T @ x)
        low, high = min(lanczos.floor(), 0.999 * e[-1]), float(e[-1])
        middle, half = (high + low) / 2, max((high - low) / 2, 1e-3 * max(high, 1e-300))
        # the recurrence t' = 2 (V - middle) t / half - t'', scaled so that the largest eigenvalue's factor stays 1
        reach = max((float(e[0]) - middle) / half, 1.0)
        degree = int(np.clip(RANGE / max(np.arccosh(reach), 1e-9), 1, DEGREE))
        sigma = 1 / reach
        old, new = q, others((vq - middle * q) * (sigma / half))
        for _ in range(degree - 1):
            after = 1 / (2 * reach - sigma)
            old, new = new, others((apply(new) - middle * new) * (2 * after / half) - (sigma * after) * old)
            sigma = after
        q = np.linalg.qr(np.linalg.qr(np.column_stack([fixed, new]))[0])[0]
    else:
        raise ArithmeticError(f"residual {worst:.3g} of {top:.3g} is not certified after {ROUNDS} rounds")
    return e[:k], q[:, :k], left


def _exact_deviation(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n y - S)^2 of each row, exact; None where no long holds it."""
    far = max(int(abs(y).max()) * n + max(map(abs, sums)) if y.size else 0, 1)
    if far * far * y.shape[1] < 2**63:
        d = n * y - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    rows = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in y.tolist()]
    return [r if r < 2**63 else None for r in rows]


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error) of every row that is fit: its
    projections on the first k components, each divided by the root of its eigenvalue."""
    spark = vectors.sparkSession
    rows, d = whole_numbers(vectors, id_col, vector_col)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    packed = Blocks(materialize(blocks(rows, d)), d)
    e, q, _ = components(packed.times, d, k)
    kept = e > LEAST * max(float(e[0]), 0.0)
    if not kept.any():
        return spark.createDataFrame([], schema)
    share = (e[kept] / packed.trace()).tolist()
    to = q[:, kept] / np.sqrt(e[kept])
    size = to.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ to
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    m = packed.total(moments, (size, size + 1)) / packed.n
    error = float(np.abs(m[:, :size] - np.outer(m[:, size], m[:, size]) - np.eye(size)).max())
    centre, n, sums = packed.centre(), packed.n, packed.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, kind, data in zip(b.column(0), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = data.as_buffer()
                w = centre(kind, raw) @ to
                y = np.frombuffer(raw, kind).reshape(-1, d).astype(np.int64)
                at = pa.array(np.arange(len(w) + 1) * size, pa.int32())
                every = [ids.values, pa.array(np.full(len(w), n)), pa.array(_exact_deviation(y, n, sums), pa.int64()), pa.ListArray.from_arrays(at, pa.array(w.ravel())), pa.ListArray.from_arrays(at, pa.array(np.tile(share, len(w)))), pa.array(np.full(len(w), error))]
                yield pa.record_batch(every, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.table.select("ids", "kind", "data").mapInArrow(run, schema)
