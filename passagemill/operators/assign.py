"""Distances to clusters, assignment, topic descriptors, label distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions import vectors as V


def centroid_matrix(clusters: DataFrame, cid: str = "cluster_id", vec: str = "centroid", dim: int = 64) -> tuple[list, np.ndarray]:
    """Ids and centroids of the usable clusters, in order of id; there are as many as clusters."""
    ok = clusters.where(F.col(vec).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)))
    rows = ok.select(cid, V.doubles(F.col(vec)).alias("v")).orderBy(cid).collect()
    return [r[0] for r in rows], np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)


def usable(df: DataFrame, vec: str, dim: int = 64) -> DataFrame:
    """Rows whose vector is present, whole, finite and not zero."""
    c = F.col(vec)
    return df.where(c.isNotNull() & (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0))


def hard(p: Column, ids: list, threshold: float = 0.0) -> Column:
    """The likeliest cluster, the smallest id of equal ones; NULL below the threshold (K5)."""
    best = F.array_max(p)
    return F.when(best >= threshold, F.element_at(F.array(*[F.lit(i) for i in ids]), F.array_position(p, best).cast("int")))


def soft(p: Column, ids: list, threshold: float = 0.1) -> Column:
    """All clusters at or above the threshold in order of id; the likeliest alone if there is none (K6)."""
    names = F.array(*[F.lit(i) for i in ids])
    above = F.filter(F.transform(names, lambda x, i: F.when(F.get(p, i) >= threshold, x)), lambda x: x.isNotNull())
    return F.when(F.size(above) > 0, above).otherwise(F.array(hard(p, ids, 0.0)))


def nearest(dist: Column, ids: list) -> Column:
    """The id of the least distance, the smallest id of equal ones (K9)."""
    return F.element_at(F.array(*[F.lit(i) for i in ids]), F.array_position(dist, F.array_min(dist)).cast("int"))


def ordered(dist: Column, ids: list) -> Column:
    """All clusters with their distances, the nearest first."""
    names = F.array(*[F.lit(i) for i in ids])
    return F.array_sort(F.transform(dist, lambda d, i: F.struct(d.alias("dist"), F.get(names, i).alias("cluster_id"))))


def long_distances(dists: DataFrame, rid: str, ids: list) -> DataFrame:
    """``(rid, cluster_id, dist)`` from arrays of distances."""
    names = F.array(*[F.lit(i) for i in ids])
    return dists.select(rid, F.posexplode("dist").alias("_i", "dist")).select(rid, F.get(names, F.col("_i")).alias("cluster_id"), "dist")


def descriptors(dists: DataFrame, rid: str, ids: list, n: int = 5, ignore: int = 0, min_distance: float | None = None) -> DataFrame:
    """``(cluster_id, rank, rid)``: of all keywords those nearest to each centroid, after the ones skipped (K4)."""
    rows = long_distances(dists, rid, ids)
    if min_distance is not None:
        rows = rows.where(F.round("dist", 9) > min_distance)
    order = W.partitionBy("cluster_id").orderBy(F.round("dist", 9), rid)
    return rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > ignore) & (F.col("rank") <= ignore + n)).select("cluster_id", (F.col("rank") - ignore).alias("rank"), rid)


def coherence(dists: DataFrame, rid: str, ids: list, member: DataFrame) -> DataFrame:
    """Mean cosine of each cluster's members to its own centroid, flagged if low."""
    own = long_distances(dists, rid, ids).join(member, [rid, "cluster_id"])
    return own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 - F.col("dist")), 6).alias("mean_cosine")).withColumn("incoherent", F.col("mean_cosine") < 0.3)


def descriptor_distances(dists: DataFrame, rid: str, ids: list, clusters: DataFrame) -> DataFrame:
    """``(rid, descriptor, dist)``: each descriptor's least distance over the clusters that have it."""
    names = clusters.select("cluster_id", F.explode("descriptors").alias("descriptor"))
    return long_distances(dists, rid, ids).join(F.broadcast(names), "cluster_id").groupBy(rid, "descriptor").agg(F.round(F.min("dist"), 6).alias("dist"))  # descriptors of the clusters given


def given_label(p: Column, k: int) -> Column:
    """A stored distribution: uniform if missing, of the wrong length or without mass; renormalised if it doesn't sum to 1 (LB2)."""
    flat = F.array_repeat(F.lit(1.0 / k), k)
    s = V.total(p)
    return F.when(p.isNull() | (F.size(p) != k) | (s <= 0), flat).when(F.abs(s - 1) > 1e-3, F.transform(p, lambda x: x / s)).otherwise(p)


def combined_label(a: Column, b: Column, weight: float) -> Column:
    """``(1 - w) a + w b``, renormalised (LB5)."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight must lie in [0, 1]")
    m = F.zip_with(a, b, lambda x, y: x * (1 - weight) + y * weight)
    return F.transform(m, lambda x: x / V.total(m))


def kmeans(df: DataFrame, rid: str, vec: str, k: int, seed: int = 42, bisecting: bool = False) -> DataFrame:
    """``(rid, cluster)`` of a fitted k-means (K1, K2)."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(rid, array_to_vector(V.doubles(F.col(vec))).alias("features"))
    fit = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(data)
    return fit.transform(data).select(rid, F.col("prediction").alias("cluster"))
