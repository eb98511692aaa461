"""Steering vectors of pairs (C1 to C6, C10) and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.functions.hashing import uniform01

EPS = 1e-8


def unit(v: Column) -> Column:
    """``v / |v|``, zero where the length is at most ``EPS``."""
    n = V.norm(v)
    return F.when(n > EPS, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x * 0.0))


def toward(q: Column, c: Column) -> Column:
    """Unit vector from the question to the centroid."""
    return unit(V.minus(c, q))


def distance(q: Column, c: Column) -> Column:
    """``1 - cos`` with the cosine clamped; 1 where either vector is zero."""
    a, b = V.norm(q), V.norm(c)
    cos = F.least(F.greatest(V.dot(q, c) / (a * b), F.lit(-1.0)), F.lit(1.0))
    return F.when((a > EPS) & (b > EPS), 1 - cos).otherwise(F.lit(1.0))


def residual(q: Column, c: Column, normalized: bool = False) -> Column:
    """``q - c``."""
    r = V.minus(q, c)
    return unit(r) if normalized else r


def keyword_steering(pairs: DataFrame, rid: str, ids: str, keywords: DataFrame, kid: str = "keyword_id", vec: str = "embedding") -> DataFrame:
    """``(rid, keyword_steering)``: unit mean of the pair's keyword vectors; pairs without any are absent."""
    rows = pairs.select(rid, F.explode(ids).alias(kid)).join(keywords.select(kid, vec), kid)
    means = V.mean_vectors(rows, [rid], vec, "m")
    return means.where(V.norm(F.col("m")) > EPS).select(rid, unit(F.col("m")).alias("keyword_steering"))


def with_fallback(steering: Column, centroid_steering: Column, kind: str, dim: int, *key: Column) -> Column:
    """Keyword steering where there is any, else the centroid's, zero, or a seeded random unit vector (C4)."""
    if kind == "centroid":
        other = centroid_steering
    elif kind == "zero":
        other = F.array_repeat(F.lit(0.0), dim)
    elif kind == "random":
        other = unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: normal("steer", *key, i)))
    else:
        raise ValueError(f"unknown fallback {kind}")
    return F.coalesce(steering, other)


def normal(*parts) -> Column:
    """A seeded standard normal number (Box-Muller)."""
    a, b = uniform01("a", *parts), uniform01("b", *parts)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(b * 6.283185307179586)


def variant(seed: int, epoch: int, key: Column, shares: dict[str, float]) -> Column:
    """The steering variant of a pair in an epoch: cut points on a seeded uniform number."""
    u, upto, out = uniform01(seed, epoch, key), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = (F.when if out is None else out.when)(u < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1] if names else "zero")


def noisy(v: Column, key: Column, sigma: float, p_noise: float, p_zero: float, seed: int = 42) -> Column:
    """Augmentation: zeroed with ``p_zero``, else noise with ``p_noise``."""
    u, w = uniform01(seed, "zero", key), uniform01(seed, "noise", key)
    shaken = F.transform(V.doubles(v), lambda x, i: x + sigma * normal(seed, key, i))
    return F.when(u < p_zero, F.transform(V.doubles(v), lambda x: x * 0.0)).when(w < p_noise, shaken).otherwise(V.doubles(v))


def curriculum(epoch: int, shares: dict[str, float], start: float = 0.5, end: float = 0.1, epochs: int = 100) -> dict[str, float]:
    """Shares of an epoch: the zero variant goes from start to end, the others keep their ratios."""
    zero = start + (end - start) * min(epoch, epochs) / epochs
    rest = sum(x for k, x in shares.items() if k != "zero")
    if rest <= 0:
        return {k: (1.0 if k == "zero" else 0.0) for k in shares}
    return {k: (zero if k == "zero" else (1 - zero) * x / rest) for k, x in shares.items()}


def checks(df: DataFrame, vec: str, dist: str) -> DataFrame:
    """Counts of unsound steering vectors and distances."""
    bad = F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    n = V.norm(F.col(vec))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), one(bad).alias("not_finite"), one(n <= EPS).alias("zero"), one((n > EPS) & (F.abs(n - 1) > 1e-4)).alias("not_unit"), one((F.col(dist) < 0) | (F.col(dist) > 2)).alias("out_of_range"))
