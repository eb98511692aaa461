"""Keywords to clusters: matching, majority votes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.hashing import uniform01
from passagemill.functions.text import keyword_key


def vocabulary(keywords: DataFrame) -> DataFrame:
    """``(key, keyword_id, cluster_id)``: one row for each normalised keyword that has a cluster, the smallest id first."""
    rows = keywords.where("cluster_id is not null and keyword is not null").select(keyword_key(F.col("keyword")).alias("key"), "keyword_id", "cluster_id")
    return rows.where("key <> ''").groupBy("key").agg(F.min_by("cluster_id", "keyword_id").alias("cluster_id"), F.min("keyword_id").alias("keyword_id"))


def exploded(pairs: DataFrame, rid: str = "pair_id", words: str = "keywords") -> DataFrame:
    """``(rid, pos, key)``: the normalised keywords of each pair with their position."""
    return pairs.select(rid, F.posexplode(words).alias("pos", "w")).select(rid, "pos", keyword_key(F.col("w")).alias("key"))


def matches(pairs: DataFrame, vocab: DataFrame, keep_missing: bool = True, rid: str = "pair_id") -> DataFrame:
    """``(rid, pos, key, cluster_id)``: each keyword's cluster, NULL if it has none (JN2, JN3, JN4)."""
    return exploded(pairs, rid).join(vocab.select("key", "cluster_id"), "key", "left" if keep_missing else "inner").select(rid, "pos", "key", "cluster_id")


def keyword_ids(pairs: DataFrame, vocab: DataFrame, rid: str = "pair_id") -> DataFrame:
    """``(rid, keyword_ids)``: sorted distinct ids of the known keywords, empty where none is known (JN6)."""
    found = exploded(pairs, rid).join(vocab.select("key", "keyword_id"), "key").groupBy(rid).agg(F.sort_array(F.collect_set("keyword_id")).alias("ids"))
    return pairs.select(rid).join(found, rid, "left").select(rid, F.coalesce("ids", F.array().cast("array<bigint>")).alias("keyword_ids"))


def cluster_sizes(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keywords per cluster, empty clusters included (A4)."""
    n = keywords.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return clusters.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n_keywords"))


def votes(pairs: DataFrame, vocab: DataFrame, rid: str = "pair_id") -> DataFrame:
    """``(rid, cluster_id)``: the cluster with the most keywords of the pair, the first seen of equal ones (A5).

    Counted per (pair, cluster) first, so a pair's keywords are never collected.
    """
    per = matches(pairs, vocab, False, rid).groupBy(rid, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return per.groupBy(rid).agg(F.max_by("cluster_id", F.struct("n", -F.col("first"))).alias("cluster_id"))


def fallback(kind: str, rid: Column, k: int, largest: int | None, seed: int = 42) -> Column:
    """Cluster of a pair without a match (A5b): the largest, ``id % k``, or a seeded draw."""
    if kind == "largest":
        return F.lit(largest).cast("long")
    if kind == "uniform":
        return F.pmod(rid, F.lit(k)).cast("long")
    if kind == "random":
        return F.floor(uniform01(seed, rid) * k).cast("long")
    raise ValueError(f"unknown fallback {kind}")


def link(pairs: DataFrame, vocab: DataFrame, default: Column, rid: str = "pair_id") -> DataFrame:
    """Every pair with its voted cluster, the fallback where no keyword is known."""
    return pairs.select(rid).join(votes(pairs, vocab, rid), rid, "left").select(rid, F.coalesce("cluster_id", default).alias("cluster_id"))


def majority(pairs: DataFrame, key: str, value: str = "cluster_id") -> DataFrame:
    """``(key, value)``: the most frequent value of each key, the smallest of equal ones."""
    n = pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))


def coverage(matched: DataFrame) -> DataFrame:
    """Matched and all keywords, their ratio and the number of clusters met."""
    c = matched.agg(F.count("cluster_id").alias("matched"), F.count(F.lit(1)).alias("total"), F.countDistinct("cluster_id").alias("n_clusters"))
    return c.select("matched", "total", F.round(F.coalesce(F.try_divide(F.col("matched"), F.col("total")), F.lit(0.0)), 6).alias("ratio"), "n_clusters")


def distribution(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Spread of the assignments over the clusters that have any, missing clusters and an imbalance flag."""
    per = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    s = per.agg(F.count(F.lit(1)).alias("used"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    missing = clusters.select("cluster_id").join(per, "cluster_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return s.crossJoin(missing).select("used", "total", "least", "most", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "missing", (F.col("sd") > 2 * F.col("mean")).alias("imbalanced"))
