"""Cluster labels of samples and records, and the surface of a fitted clustering (LB1 to LB9, K7 to K17, A15, A20, J10, M6)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import jsoncols as J
from passagemill.functions import vectors as V
from passagemill.functions.text import keyword_key
from passagemill.operators import assign
from passagemill.operators.enrich import map_texts
from passagemill.operators.validate import require

EPS = 1e-8


def normalizer(kind: str, temperature: float = 1.0) -> Callable[[Column], Column]:
    """Distances to a distribution: ``softmax`` or ``l1`` (M6)."""
    if kind == "softmax":
        if temperature <= 0:
            raise ValueError("the temperature must be positive")
        return lambda d: V.softmax(d, temperature)
    if kind == "l1":
        return V.inverse_l1
    raise ValueError(f"unknown normaliser {kind}")


@dataclass(frozen=True)
class AssignConfig:
    """How records are assigned unless a call says otherwise (K8)."""

    mode: str = "soft"
    threshold: float = 0.1
    metric: str = "cosine"

    def check(self) -> AssignConfig:
        if self.mode not in ("hard", "soft") or self.metric not in ("cosine", "euclidean") or not 0 <= self.threshold <= 1:
            raise ValueError(f"unsound assignment {self}")
        return self


def assign_records(df: DataFrame, rid: str, vec: str, ids: list, centroids: np.ndarray, config: AssignConfig | None = None, temperature: float = 1.0) -> DataFrame:
    """``(rid, mode, probabilities, assigned_clusters, primary_cluster, threshold_used, metric)`` of each vector (K7)."""
    c = (config or AssignConfig()).check()
    p = V.against(df, rid, vec, ids, centroids, c.metric).select(rid, V.softmax(F.col("dist"), temperature).alias("p"))
    primary = assign.hard(F.col("p"), ids, c.threshold if c.mode == "hard" else 0.0)
    chosen = assign.soft(F.col("p"), ids, c.threshold) if c.mode == "soft" else F.when(primary.isNotNull(), F.array(primary)).otherwise(F.array().cast("array<bigint>"))
    return p.select(rid, F.lit(c.mode).alias("mode"), F.col("p").alias("probabilities"), chosen.alias("assigned_clusters"), primary.alias("primary_cluster"), F.lit(c.threshold).alias("threshold_used"), F.lit(c.metric).alias("metric"))


def compare_texts(texts: DataFrame, column: str, ids: list, centroids: np.ndarray, make: Callable) -> DataFrame:
    """``(column, cluster_id, dist)``: each text's distance to every cluster, embedded once."""
    v = map_texts(texts.select(column).distinct(), column, make, "embedding", "array<double>")
    return assign.long_distances(V.against(v, column, "embedding", ids, centroids), column, ids)


def cached_vectors(texts: DataFrame, column: str, memo: DataFrame, make: Callable) -> tuple[DataFrame, DataFrame]:
    """``(column, embedding)`` of the texts and the memo with the new ones; known texts aren't embedded again."""
    wanted = texts.where(F.col(column).isNotNull()).select(column).distinct()
    new = map_texts(wanted.join(memo.select(column), column, "left_anti"), column, make, "embedding", "array<double>")
    grown = memo.select(column, "embedding").unionByName(new)
    return wanted.join(grown, column), grown


def cluster_keywords(keywords: DataFrame, k: int, n_descriptors: int = 5, seed: int = 42, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """Clusters ``(cluster_id, size, descriptors, centroid)`` and members ``(keyword_id, cluster_id)`` of a fit."""
    rows = assign.usable(keywords, "embedding", dim)
    members = assign.kmeans(rows, "keyword_id", "embedding", k, seed).withColumnRenamed("cluster", "cluster_id")
    joined = rows.select("keyword_id", "keyword", "embedding").join(members, "keyword_id")
    centroids = V.mean_vectors(joined, ["cluster_id"], "embedding", "centroid")
    ids, m = assign.centroid_matrix(centroids, dim=dim)
    near = assign.descriptors(V.against(rows, "keyword_id", "embedding", ids, m), "keyword_id", ids, n_descriptors)
    named = near.join(rows.select("keyword_id", "keyword"), "keyword_id").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("descriptors"))
    return centroids.join(members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")), "cluster_id").join(named, "cluster_id", "left"), members


def annotate_distances(df: DataFrame, text: str, clusters: DataFrame, make: Callable, out: str, dim: int = 64) -> DataFrame:
    """The rows with ``{descriptor: least distance}`` as JSON in ``out``; NULL where the text is NULL."""
    ids, m = assign.centroid_matrix(clusters, dim=dim)
    texts = df.where(F.col(text).isNotNull()).select(text).distinct()
    v = map_texts(texts, text, make, "_e", "array<double>")
    near = assign.descriptor_distances(V.against(v, text, "_e", ids, m), text, ids, clusters)
    maps = near.groupBy(text).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("descriptor", "dist"))))).alias(out))
    return df.join(maps, text, "left")


def check_clusters(clusters: DataFrame, n_clusters: int) -> None:
    """A clustering without clusters, with ids out of range or another number of centroids is an error."""
    if n_clusters < 1:
        raise ValueError("a clustering needs clusters")
    require(clusters.where(~F.col("cluster_id").between(0, n_clusters - 1)).select("cluster_id"), "cluster ids out of range")
    n = clusters.where(F.col("centroid").isNotNull()).count()
    if n not in (0, n_clusters):
        raise ValueError(f"{n} centroids for {n_clusters} clusters")


def check_keywords(clusters: DataFrame, keywords: DataFrame, n_clusters: int) -> None:
    """:func:`check_clusters`, and keywords that exist and point to a cluster."""
    check_clusters(clusters, n_clusters)
    if keywords.isEmpty():
        raise ValueError("no keywords")
    require(keywords.where(F.col("cluster_id").isNull() | ~F.col("cluster_id").between(0, n_clusters - 1)).select("keyword_id", "cluster_id"), "keywords of unknown clusters")


def topic_descriptors(source: Column) -> Column:
    """Descriptors in a list as JSON, in a cluster document's ``cluster_stats`` (unique, in order), or one for each line of plain text."""
    t = J.strip(source)
    listed = F.from_json(t, "array<string>", {"allowSingleQuotes": "false"})
    stats = F.from_json(t, "cluster_stats map<string,struct<topic_descriptors:array<string>>>")["cluster_stats"]
    ordered = F.transform(F.array_sort(F.transform(F.map_entries(stats), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"]["topic_descriptors"].alias("d")))), lambda x: x["d"])
    plain = F.filter(F.transform(F.split(t, r"\n"), J.strip), lambda x: x != "")
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).when(t.startswith("[") & listed.isNotNull(), listed).when(t.startswith("{") & stats.isNotNull(), F.array_distinct(F.flatten(ordered))).otherwise(plain)


def uniform(k: int) -> Column:
    return F.array_repeat(F.lit(1.0 / k), k)


def suggestion_distances(rows: DataFrame, rid: str, terms: str, vectors: DataFrame, ids: list, centroids: np.ndarray) -> DataFrame:
    """``(rid, dist)``: mean distance of a row's known terms to each centroid; rows without any are absent."""
    words = vectors.where(F.col("keyword").isNotNull()).select(keyword_key(F.col("keyword")).alias("key"), "embedding").groupBy("key").agg(F.min("embedding").alias("embedding"))
    d = V.against(words, "key", "embedding", ids, centroids)
    each = rows.select(rid, F.explode(terms).alias("_t")).select(rid, keyword_key(F.col("_t")).alias("key"))
    return V.mean_vectors(each.join(d, "key"), [rid], "dist", "dist")


def suggestion_label(rows: DataFrame, rid: str, terms: str, vectors: DataFrame, ids: list, centroids: np.ndarray, norm: Callable[[Column], Column]) -> DataFrame:
    """``(rid, label)`` from a row's suggested terms, uniform where none is known (LB1)."""
    d = suggestion_distances(rows, rid, terms, vectors, ids, centroids)
    return rows.select(rid).join(d, rid, "left").select(rid, F.coalesce(norm(F.col("dist")), uniform(len(ids))).alias("label"))


def vector_label(df: DataFrame, rid: str, vec: str, ids: list, centroids: np.ndarray, norm: Callable[[Column], Column]) -> DataFrame:
    """``(rid, label)`` from each vector's distances; uniform for a vector that is nearly zero (LB3, LB4)."""
    d = V.against(df, rid, vec, ids, centroids).join(df.select(rid, V.norm(F.col(vec)).alias("_n")), rid)
    return d.select(rid, F.when(F.col("_n") > EPS, norm(F.col("dist"))).otherwise(uniform(len(ids))).alias("label"))


def chosen_label(given: Column, suggested: Column, embedded: Column, k: int) -> Column:
    """The stored distribution if it has the right length, else the suggestions', else the vector's (LB6, LB8)."""
    return F.when(F.coalesce(F.size(given), F.lit(-1)) == k, assign.given_label(given, k)).otherwise(F.coalesce(suggested, embedded))


def primary_cluster(label: Column, ids: list) -> Column:
    """The likeliest cluster of a label, NULL without one (LB9)."""
    return F.when(label.isNotNull(), assign.hard(label, ids))


def n_clusters(df: DataFrame, hard: str | None = None, soft: str | None = None) -> int:
    """Clusters that labels know: one more than the largest id, or the length of a distribution."""
    if hard:
        return (df.agg(F.max(hard)).first()[0] or -1) + 1 if df.agg(F.count(hard)).first()[0] else 0
    return df.agg(F.max(F.size(soft))).first()[0] or 0


def labelled_samples(rows: DataFrame, rid: str, text: str, terms: str, vectors: DataFrame, ids: list, centroids: np.ndarray, make: Callable, weight: float = 0.5, temperature: float = 1.0) -> DataFrame:
    """``(rid, embedding, steering, source_label, steering_label, combined_label, primary_cluster)`` of each record (LB7).

    Text is embedded once for each wording; steering is the mean of the
    record's terms; labels come from suggestions, the steering vector, and both.
    """
    from passagemill.operators.embed import entity_vectors, suggestion_steering

    norm, dim = normalizer("softmax", temperature), centroids.shape[1]
    e = entity_vectors(rows, rid, text, make).select(rid, "embedding")
    s = suggestion_steering(rows, rid, terms, vectors, make, dim).withColumnRenamed("embedding", "steering")
    a = suggestion_label(rows, rid, terms, vectors, ids, centroids, norm).withColumnRenamed("label", "source_label")
    b = vector_label(s, rid, "steering", ids, centroids, norm).withColumnRenamed("label", "steering_label")
    both = e.join(s, rid).join(a, rid).join(b, rid)
    both = both.withColumn("combined_label", assign.combined_label(F.col("source_label"), F.col("steering_label"), weight))
    return both.withColumn("primary_cluster", primary_cluster(F.col("combined_label"), ids))
