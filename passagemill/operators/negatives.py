"""Tiered hard negatives.

Sampling walks a ring: the sources of a cluster are numbered in seeded hash
order, and a pair takes consecutive numbers from a seeded start.  That is a join
on (cluster, number), without replacement, and needs no list of a cluster's
sources anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash32


def quota(n_neg: int, tiers: list[int] | None = None) -> list[int]:
    """Negatives per tier: equal shares, the remainder to the harder tiers."""
    if tiers is not None:
        if len(tiers) != 4 or sum(tiers) != n_neg or min(tiers) < 0:
            raise ValueError("four non-negative tier counts must add up to n_neg")
        return list(tiers)
    return [n_neg // 4 + (i < n_neg % 4) for i in range(4)]


def adjacent(ids: list, centroids: np.ndarray, k: int) -> list[tuple]:
    """``(cluster, rank, neighbour)``: the nearest other clusters by cosine distance (N2); clusters are few."""
    n = np.linalg.norm(centroids, axis=1)
    c = centroids / np.where(n > 0, n, 1)[:, None]
    d = np.round(1 - c @ c.T, 9)
    out = []
    for i, x in enumerate(ids):
        order = sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)[: min(k, len(ids) - 1)]
        out += [(x, r + 1, y) for r, (_, y) in enumerate(order)]
    return out


def ring(sources: DataFrame, seed: int, group: str = "cluster_id", sid: str = "source_id") -> DataFrame:
    """``(group, pos, sid)`` and ``m``: each group's sources numbered from 0 in hash order.

    Numbering goes by hash range within the group: each range is ordered on its
    own, offsets come from the ranges' counts.
    """
    h = hash32(seed, F.col(sid))
    rows = sources.select(group, sid, h.alias("h")).withColumn("r", F.floor(F.col("h") / 2**26))  # 64 ranges
    per = rows.groupBy(group, "r").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(group).orderBy("r")
    off = per.select(group, "r", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy(group)).alias("m"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy(group, "r").orderBy("h", sid)) - 1).join(off, [group, "r"]).select(group, (F.col("before") + F.col("k")).alias("pos"), sid, "m")


def in_cluster(pairs: DataFrame, rings: DataFrame, n: int, seed: int, group: str = "cluster_id") -> DataFrame:
    """``(pair_id, slot, neg_id)``: up to ``n`` other sources of the pair's cluster."""
    sizes = rings.select(group, "m").distinct()
    start = pairs.select("pair_id", "source_id", group).join(sizes, group)
    picks = start.select("pair_id", "source_id", group, "m", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("m") - 1).cast("int"))).alias("i"))
    at = picks.withColumn("pos", F.pmod(hash32(seed, "start", F.col("pair_id")) + F.col("i"), F.col("m")))
    hit = at.join(rings.select(group, "pos", F.col("source_id").alias("neg_id")), [group, "pos"]).where(F.col("neg_id") != F.col("source_id"))
    w = W.partitionBy("pair_id").orderBy("i")  # at most n + 1 rows
    return hit.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n).select("pair_id", "slot", "neg_id")


def high_similarity(pairs: DataFrame, questions: DataFrame, sources: DataFrame, n: int, block: int | None = None) -> DataFrame:
    """``(pair_id, rank, neg_id)``: the sources most similar to the question outside the pair's cluster (N3, JN9).

    Candidates are found once per (question, cluster), by blocks: questions and
    sources are dealt into blocks, every pair of blocks meets in one task, and
    only each block's best ``n + 1`` leave it.
    """
    from passagemill.operators.knn import BLOCK, block_topk

    keys = pairs.select("question_id", "cluster_id").distinct().join(questions, "question_id").select(F.struct("question_id", "cluster_id").alias("key"), F.col("cluster_id").alias("tag"), "vec")
    best = block_topk(keys, sources.select(F.col("source_id").alias("oid"), F.col("cluster_id").alias("otag"), "vec"), n + 1, exclude_same_tag=True, block=block or BLOCK)
    named = best.select("key.question_id", "key.cluster_id", F.col("oid").alias("neg_id"), "sim")
    hit = pairs.select("pair_id", "question_id", "source_id", "cluster_id").join(named, ["question_id", "cluster_id"]).where(F.col("neg_id") != F.col("source_id"))
    w = W.partitionBy("pair_id").orderBy(F.round("sim", 9).desc(), "neg_id")  # at most n + 1 rows
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("pair_id", "rank", "neg_id")


def random_distant(pairs: DataFrame, rings: DataFrame, n: int, seed: int) -> DataFrame:
    """``(pair_id, slot, neg_id)``: sources outside the pair's cluster from a seeded start.

    ``rings``: :func:`ring` of the sources by cluster.  Clusters lie one behind
    the other, so the sources outside one are two runs of numbers: every draw
    hits, however large the cluster is.  A pair gets ``n`` unless fewer exist.
    """
    clusters = rings.groupBy("cluster_id").agg(F.max("m").alias("m"))
    w = W.orderBy("cluster_id")  # one row for each cluster
    spans = clusters.select("cluster_id", "m", (F.sum("m").over(w) - F.col("m")).alias("lo"), F.sum("m").over(W.partitionBy()).alias("total"))
    placed = rings.select("cluster_id", "pos", F.col("source_id").alias("neg_id")).join(spans.select("cluster_id", "lo"), "cluster_id").select((F.col("lo") + F.col("pos")).alias("at"), "neg_id")
    whole = spans.agg(F.max("total").alias("all"))
    own = pairs.select("pair_id", "source_id", "cluster_id").join(spans, "cluster_id", "left").crossJoin(whole)  # one row
    own = own.select("pair_id", "source_id", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("lo", F.lit(0)).alias("lo"), (F.col("all") - F.coalesce("m", F.lit(0))).alias("free")).where("free > 0")
    draws = own.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("free") - 1).cast("int"))).alias("i"))
    u = F.pmod(hash32(seed, "far", F.col("pair_id")) + F.col("i"), F.col("free"))
    at = draws.select("pair_id", "source_id", "i", F.when(u < F.col("lo"), u).otherwise(u + F.col("m")).alias("at"))
    hit = at.join(placed, "at").where("neg_id <> source_id")
    w = W.partitionBy("pair_id").orderBy("i")  # at most n + 1 rows
    return hit.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n).select("pair_id", "slot", "neg_id")


def assemble(tiers: list[DataFrame], pad: DataFrame, n_neg: int) -> DataFrame:
    """``(pair_id, slot, neg_id, tier)``: the tiers in order, each source once, filled up from ``pad`` as tier 4.

    Every pair with any candidate gets ``n_neg`` rows: where fewer different
    sources exist, they are repeated in order as tier 4.
    """
    parts = [t.select("pair_id", F.lit(i + 1).alias("tier"), t.columns[1], "neg_id").withColumnRenamed(t.columns[1], "k") for i, t in enumerate(tiers)]
    parts.append(pad.select("pair_id", F.lit(5).alias("tier"), F.col(pad.columns[1]).alias("k"), "neg_id"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    once = rows.groupBy("pair_id", "neg_id").agg(F.min(F.struct("tier", "k")).alias("o"))
    w = W.partitionBy("pair_id").orderBy("o")  # a bounded number of candidates per pair
    ranked = once.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n_neg)
    ranked = ranked.withColumn("k", F.max("slot").over(W.partitionBy("pair_id")))
    slots = F.explode(F.sequence(F.col("slot"), F.lit(n_neg), F.col("k")))
    spread = ranked.select("pair_id", slots.alias("at"), "slot", "neg_id", "o.tier")
    return spread.select("pair_id", F.col("at").alias("slot"), "neg_id", F.when(F.col("at") == F.col("slot"), F.least("tier", F.lit(4))).otherwise(4).alias("tier"))


def violations(negatives: DataFrame, pairs: DataFrame, n_neg: int) -> DataFrame:
    """Pairs with too few negatives, own sources among them, tiers out of range."""
    per = pairs.select("pair_id", "source_id").join(negatives, "pair_id", "left")
    c = per.groupBy("pair_id").agg(F.count("neg_id").alias("n"), F.sum((F.col("neg_id") == F.col("source_id")).cast("int")).alias("own"), F.sum((~F.col("tier").between(1, 4)).cast("int")).alias("tier"))
    return c.agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("n") < n_neg).cast("int")).alias("short"), F.sum(F.coalesce("own", F.lit(0))).alias("own_source"), F.sum(F.coalesce("tier", F.lit(0))).alias("bad_tier"))
