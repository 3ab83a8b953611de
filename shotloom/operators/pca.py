"""Principal components of imputed channel vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import any_present, impute_mean


def stack(samples: DataFrame) -> DataFrame:
    """(shot_id, t_idx, values): every time of every shot as a row, missing channels imputed; times without any channel
    are left out."""
    return samples.where(any_present(F.col("values"))).select("shot_id", "t_idx", impute_mean(F.col("values")).alias("values"))


def centred(rows: DataFrame) -> DataFrame:
    data = rows.withColumn("_raw", array_to_vector("values"))
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=False).fit(data).transform(data).drop("_raw")


def fit(rows: DataFrame, k: int = 5) -> tuple[DataFrame, PCAModel]:
    data = centred(rows)
    return data, PCA(k=k, inputCol="features", outputCol="scores").fit(data)


def explained_variance(model: PCAModel, spark) -> DataFrame:
    """(component, ratio, cumulative)."""
    return variance_table(spark, model.explainedVariance)


def variance_table(spark, ratios) -> DataFrame:
    rows = [(i + 1, float(v)) for i, v in enumerate(ratios)]
    return spark.createDataFrame(rows, "component int, ratio double").withColumn("cumulative", F.sum("ratio").over(Window.partitionBy(F.lit(0)).orderBy("component")))


def reconstruction_error(rows: DataFrame, k: int = 5) -> DataFrame:
    """(shot_id, t_idx, error): root mean square of what k components leave of each row.

    The components are orthonormal, so what is left is the centred length less the length of the scores."""
    data, model = fit(rows, k)
    scored = model.transform(data).select("shot_id", "t_idx", vector_to_array("features").alias("x"), vector_to_array("scores").alias("s"))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)
    return scored.select("shot_id", "t_idx", F.sqrt(F.greatest(F.lit(0.0), square("x") - square("s")) / F.size("x")).alias("error"))


def reconstruct(rows: DataFrame, k: int = 5) -> DataFrame:
    """(shot_id, t_idx, restored): rows rebuilt from their k scores."""
    data, model = fit(rows, k)
    mean = [float(v) for v in rows.agg(*(F.avg(F.get("values", F.lit(i))).alias(str(i)) for i in range(model.pc.numRows))).first()]
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    pc = constant(model.pc.toArray().tolist(), "array<array<double>>")  # channels x k
    scored = model.transform(data).select("shot_id", "t_idx", vector_to_array("scores").alias("s"))
    dot = lambda w: F.aggregate(F.zip_with(w, "s", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return scored.select("shot_id", "t_idx", F.zip_with(F.transform(pc, dot), constant(mean, "array<double>"), lambda x, m: x + m).alias("restored"))


def trace(rows: DataFrame, k: int) -> DataFrame:
    """(trace, components, ratio): sum of the sample variances of k components' scores, k, and the share of the variance that the
    model says they explain."""
    data, model = fit(rows, k)
    scores = model.transform(data).select(vector_to_array("scores").alias("s"))
    total = reduce(lambda a, b: a + b, (F.var_samp(F.get("s", F.lit(j))) for j in range(k)))
    return scores.agg(total.alias("trace"), F.lit(k).cast("long").alias("components"), F.lit(float(sum(model.explainedVariance))).alias("ratio"))


class Components(NamedTuple):
    mean: np.ndarray
    axes: np.ndarray  # channels x k, orthonormal
    ratios: np.ndarray  # shares of the whole variance, falling
    passes: int


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("values")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(rows: DataFrame, width: int, make) -> np.ndarray:
    """Sums over all rows of make(matrix of a batch), a table of ``width`` columns: each task adds up its own rows, Spark adds
    the tasks' tables line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = make(_matrix(b))
                total = part if total is None else total + part
        if total is not None:
            columns = [pa.array(np.arange(len(total))), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(width))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", *(f"s{j}" for j in range(width))])

    names = [f"s{j}" for j in range(width)]
    parts = rows.select("values").mapInArrow(run, ", ".join(["i long", *(f"{c} double" for c in names)]))
    table = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("i").toPandas()  # channels x width numbers
    return table[names].to_numpy()


def block_fit(rows: DataFrame, k: int = 5, extra: int = 5, blocks: int = 12, tolerance: float = 1e-12, most_passes: int = 500, seed: int = 0) -> Components:
    """The k leading components of wide vectors (column values, as from stack; written, since each pass reads it) by block Krylov
    iteration.

    A pass sends a block of k + extra directions to the tasks and sums VQ there (V the covariance), so nothing of the size
    channels x channels is ever made.  The driver holds ``blocks`` blocks at most; a full basis restarts from its leading Ritz
    vectors.  It ends when each of the k residuals is below ``tolerance`` of the largest eigenvalue; an empty table
    gives no components; one row, or channels without variance, give shares of 0.  An error is raised if ``most_passes`` do not suffice."""
    first = _sums(rows, 3, lambda x: np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], float(len(x)))], axis=1))
    if not len(first):
        return Components(np.empty(0), np.empty((0, 0)), np.empty(0), 1)
    n = first[0, 2]
    mean, d = first[:, 0] / n, len(first)
    k = min(k, d)
    size = min(k + extra, d)
    total = float(_sums(rows, 1, lambda x: ((x - mean) ** 2).sum(0)[:, None]).sum())
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((d, size)))[0]
    if total == 0.0:
        return Components(mean, block[:, :k], np.zeros(k), 2)
    basis = image = np.empty((d, 0))
    for passes in range(3, most_passes + 1):
        q = block

        def product(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ q)

        basis, image = np.hstack([basis, q]), np.hstack([image, _sums(rows, q.shape[1], product)])
        inner = basis.T @ image
        values, small = np.linalg.eigh((inner + inner.T) / 2)
        values, small = values[::-1], small[:, ::-1]
        axes, pulled = basis @ small[:, :size], image @ small[:, :size]
        left = pulled - axes * values[:size]
        if (np.linalg.norm(left[:, :k], axis=0) <= tolerance * values[0]).all() or basis.shape[1] >= d:
            return Components(mean, axes[:, :k], np.maximum(values[:k], 0.0) / total, passes)
        if basis.shape[1] + size > blocks * size:
            basis, image = axes, pulled
        block = left
        for _ in range(2):  # twice is enough against rounding
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        block = block[:, : d - basis.shape[1]]
    raise ValueError(f"components not settled after {most_passes} passes")
