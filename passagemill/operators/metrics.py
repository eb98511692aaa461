"""Losses and diagnostics of predictions as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import vectors as V


def smooth_l1(a: Column, b: Column, beta: float = 1.0) -> Column:
    """Mean Huber loss over the components."""
    d = F.transform(V.minus(a, b), lambda x: F.when(F.abs(x) < beta, 0.5 * x * x / beta).otherwise(F.abs(x) - 0.5 * beta))
    return V.total(d) / F.size(d)


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def cross_entropy(logits: Column, index: Column) -> Column:
    """``log sum exp - logit`` of the right index, counted from 0."""
    return log_sum_exp(logits) - F.get(logits, index)


def entropy(p: Column) -> Column:
    """Shannon entropy with probabilities clamped at 1e-8."""
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(F.greatest(x, F.lit(1e-8))))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence with both sides clamped at 1e-8."""
    c = lambda x: F.greatest(x, F.lit(1e-8))
    return F.aggregate(F.zip_with(p, q, lambda x, y: c(x) * F.log(c(x) / c(y))), F.lit(0.0), lambda s, x: s + x)


def residual_hinge(v: Column, margin: float) -> Column:
    """``max(|v| - margin, 0)``."""
    return F.greatest(V.norm(v) - margin, F.lit(0.0))


def target_entropy(step: int, steps: int, k: int, low: float) -> float:
    """Entropy target, annealed from ``ln k`` to ``low``."""
    return math.log(k) + (low - math.log(k)) * min(max(step / steps, 0.0), 1.0) if steps > 0 else low


def ema_tau(step: int, steps: int, low: float, high: float) -> float:
    """Momentum on a cosine from ``low`` to ``high``."""
    if steps <= 0:
        return high
    x = min(max(step / steps, 0.0), 1.0)
    return high - (high - low) * (math.cos(math.pi * x) + 1) / 2


def warmup_factor(step: int, warmup: int, steps: int, floor: float = 0.01) -> float:
    """Learning-rate factor: linear warm-up, then a cosine down to ``floor``."""
    if step < warmup:
        return (step + 1) / max(warmup, 1)
    x = min((step - warmup) / max(steps - warmup, 1), 1.0)
    return floor + (1 - floor) * (1 + math.cos(math.pi * x)) / 2


#: Tasks in which the moments of all others are added up.
MEETING = 16


def variance_terms(df: DataFrame, vec: str, eps: float = 1e-4) -> DataFrame:
    """Hinge on the components' standard deviations and summed squared covariances over the dimension.

    Every task sums its rows' first and second moments, ``MEETING`` tasks add
    these up, and the driver adds as many matrices.
    """

    def moments(it):
        n, s, g = 0, None, None
        for b in it:
            x = np.array(b.column(0).to_pylist(), np.float64)
            if len(x):
                n += len(x)
                s = x.sum(0) + (0 if s is None else s)
                g = x.T @ x + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=["n", "s", "g"])

    def add(it):
        n, s, g = 0, 0.0, 0.0
        for b in it:
            for m, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n, s, g = n + m, s + np.frombuffer(x), g + np.frombuffer(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], names=["n", "s", "g"])

    kind = "n long, s binary, g binary"
    parts = df.where(F.col(vec).isNotNull()).select(V.doubles(F.col(vec)).alias("v")).mapInArrow(moments, kind).repartition(MEETING).mapInArrow(add, kind)
    n, s, g = 0, 0.0, 0.0
    for r in parts.collect():
        n, s, g = n + r["n"], s + np.frombuffer(r["s"]), g + np.frombuffer(r["g"])
    if n < 2:
        return df.sparkSession.createDataFrame([(None, None)], "variance double, covariance double")
    d = len(s)
    cov = (np.reshape(g, (d, d)) - np.outer(s, s) / n) / (n - 1)
    hinge = float(np.maximum(1 - np.sqrt(np.diag(cov) + eps), 0).mean())
    off = float((cov**2).sum() - (np.diag(cov) ** 2).sum())
    return df.sparkSession.createDataFrame([(round(hinge, 6), round(off / d, 6))], "variance double, covariance double")


def actionable(atypicality: Column, influence: Column) -> Column:
    """Advice from an item's atypicality and its steering influence."""
    a = F.when(atypicality > 2, "unusual item, review it").when(atypicality < 0.5, "typical item")
    b = F.when(influence > 1, "steering dominates").when(influence < 0.05, "steering has no effect")
    return F.concat_ws("; ", a, b)
