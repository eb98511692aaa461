"""Vector expressions. For many vectors against a bounded set of others use :func:`against`, which multiplies blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Sums of floats depend on their order in single precision, so every sum is taken in double."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def normalize(v: Column, eps: float = 1e-8) -> Column:
    """``v / (|v| + eps)`` (M1)."""
    n = norm(v) + F.lit(eps)
    return F.transform(doubles(v), lambda x: x / n)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Softmax of ``-v / temperature``, shifted by its maximum (M4)."""
    low = F.array_min(v)
    e = F.transform(v, lambda x: F.exp((low - x) / F.lit(temperature)))
    return F.transform(e, lambda x: x / total(e))


def inverse_l1(v: Column) -> Column:
    """``1 / (v + 1e-10)``, normalised to sum 1 (M5)."""
    e = F.transform(v, lambda x: 1.0 / (x + F.lit(1e-10)))
    return F.transform(e, lambda x: x / total(e))


def membership(sims: Column) -> Column:
    """Cosine similarities clipped to [0, 1] over their sum; NULL where all are zero (M7)."""
    c = F.transform(sims, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return F.when(total(c) > 0, F.transform(c, lambda x: x / total(c)))


def mean_vectors(df: DataFrame, keys: list[str], vec: str, out: str) -> DataFrame:
    """Component means per key (A14): partially aggregated per component, never a list of vectors per group."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vec))).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))


def against(df: DataFrame, rid: str, vec: str, ids: list, others: np.ndarray, metric: str = "cosine", out: str = "dist") -> DataFrame:
    """``(rid, out)``: distances of every row's vector to each of a bounded set of vectors, in the order of ``ids``.

    Blocks of rows are multiplied with the matrix at once; the matrix is
    broadcast, so the caller bounds its size (cluster centroids, say).
    """
    m = np.asarray(others, np.float64).reshape(len(ids), -1)
    shared = df.sparkSession.sparkContext.broadcast(m)
    kind = df.select(rid).schema[0].dataType.simpleString()

    def distances(it):
        c = shared.value
        cn = np.linalg.norm(c, axis=1)
        for b in it:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            if not b.num_rows:
                continue
            if metric == "cosine":
                d = np.linalg.norm(v, axis=1)[:, None] * cn[None, :]
                r = 1.0 - np.divide(v @ c.T, d, out=np.zeros_like(d), where=d > 0)
            elif metric == "euclidean":
                r = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * v @ c.T, 0.0))
            else:
                raise ValueError(f"unknown metric {metric}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(r), pa.list_(pa.float64()))], names=[rid, out])

    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric}")
    return df.select(rid, vec).where(F.col(vec).isNotNull()).mapInArrow(distances, f"`{rid}` {kind}, `{out}` array<double>")
