"""Positive, contrastive and similar triplets (T1 to T4, JN11 to JN13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash32


#: Questions with more relevant sources than this give their combinations as one group.
EXPANDED = 64


def positives(links: DataFrame, most: int = EXPANDED) -> DataFrame:
    """``(question_id, a, b, n_sources, grouped)``: all pairs of relevant sources of a question (T1, JN12).

    A question with up to ``most`` sources gives each pair, ``a < b``.  One with
    more gives a row for each source ``b`` but the least, ``a``, and ``grouped``
    is true: every two sources of the group are a pair.  So no pair is lost, and
    the rows of a question that holds a third of the table stay in proportion.
    """
    sizes = links.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_sources"), F.min("source_id").alias("least")).where("n_sources > 1")
    rows = links.join(sizes, "question_id")
    few = rows.where(F.col("n_sources") <= most)
    a = few.select("question_id", F.col("source_id").alias("a"), "n_sources")
    each = a.join(few.select("question_id", F.col("source_id").alias("b")), "question_id").where("a < b").select("question_id", "a", "b", "n_sources", F.lit(False).alias("grouped"))
    whole = rows.where((F.col("n_sources") > most) & (F.col("source_id") > F.col("least"))).select("question_id", F.col("least").alias("a"), F.col("source_id").alias("b"), "n_sources", F.lit(True).alias("grouped"))
    return each.unionByName(whole)


def not_relevant(links: DataFrame) -> DataFrame:
    """``(question_id, n_sources, n_not_relevant)``: how many sources of the corpus aren't relevant to each question (JN13)."""
    corpus = links.agg(F.countDistinct("source_id").alias("corpus"))
    own = links.groupBy("question_id").agg(F.countDistinct("source_id").alias("n_sources"))
    return own.crossJoin(corpus).select("question_id", "n_sources", (F.col("corpus") - F.col("n_sources")).alias("n_not_relevant"))  # one row


def contrastive(links: DataFrame, rings: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(question_id, source_id, neg_id)``: each relevant source with negatives drawn once per question (T2, JN13).

    ``rings``: ``(pos, source_id, m)``, all sources numbered in hash order.  A
    question with ``k`` sources looks at ``n + k`` numbers, of which at least
    ``n`` are free where so many exist.
    """
    m = rings.select("m").first()
    if m is None:
        return links.sparkSession.createDataFrame([], "question_id long, source_id long, neg_id long")
    own = links.groupBy("question_id").agg(F.count(F.lit(1)).alias("k"))
    draws = own.select("question_id", F.explode(F.sequence(F.lit(0), F.least(F.col("k") + n, F.lit(m[0])).cast("int") - 1)).alias("i"))
    at = draws.withColumn("pos", F.pmod(hash32(seed, F.col("question_id")) + F.col("i"), F.lit(m[0])))
    hit = at.join(rings.select("pos", F.col("source_id").alias("neg_id")), "pos")
    own = links.select("question_id", F.col("source_id").alias("neg_id"))
    free = hit.join(own, ["question_id", "neg_id"], "left_anti")
    # the n first free numbers, kept as a bounded list while rows are aggregated
    first = free.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("i"))).where(F.col("rank") <= n)
    negs = first.select("question_id", "neg_id")
    return links.join(negs, "question_id").select("question_id", "source_id", "neg_id")
