"""Ratio splits, stratified splits without leakage, and their checks (SP1 to SP10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash32
from passagemill.operators.negatives import ring


def simple_split(df: DataFrame, rid: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """``(rid, split)``: exactly ``int(n val)`` and ``int(n test)`` rows in hash order, the rest train (SP1).

    Ranks come from counts of hash ranges; only the two ranges in which a cut
    falls are ordered.
    """
    n = df.count()
    n_val, n_test = int(n * val), int(n * test)
    if n_val < 1 or n_val + n_test >= n:
        raise ValueError(f"{n} rows can't be split by {val} and {test}")
    h = df.select(rid, hash32(seed, F.col(rid)).alias("h")).withColumn("r", F.floor(F.col("h") / 2**20).cast("int"))  # 4096 ranges
    per = h.groupBy("r").count()
    counts = sorted((r["r"], r["count"]) for r in per.collect())
    offsets, base = [], 0
    for r, c in counts:
        offsets.append((r, base, c))
        base += c
    off = df.sparkSession.createDataFrame(offsets, "r int, before long, size long")
    rows = h.join(F.broadcast(off), "r")  # at most 4,096 rows
    a, b = n_val, n_val + n_test
    cut = ((F.col("before") < a) & (F.col("before") + F.col("size") > a)) | ((F.col("before") < b) & (F.col("before") + F.col("size") > b))
    place = lambda at: F.when(at < a, "val").when(at < b, "test").otherwise("train")
    whole = rows.where(~cut).select(rid, place(F.col("before")).alias("split"))
    w = W.partitionBy("r").orderBy("h", rid)
    edge = rows.where(cut).withColumn("at", F.col("before") + F.row_number().over(w) - 1).select(rid, place(F.col("at")).alias("split"))
    return whole.unionByName(edge)


def stratified_split(questions: DataFrame, qid: str = "question_id", stratum: str = "cluster_id", train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``(qid, split)``: per stratum shuffled questions, cut at the ratios (SP2).

    At least one question trains and one validates; where testing is wanted and
    three or more questions leave none for it, one moves there.  Without a test
    ratio the remainder trains.
    """
    # numbered by hash range within the stratum, so no task orders a whole stratum; NULL is a stratum of its own
    rows = ring(questions.select(qid, F.to_json(F.struct(stratum)).alias("_g")), seed, "_g", qid).select(qid, F.col("m").alias("n"), F.col("pos").alias("rn"))
    n_train, n_val = F.greatest(F.lit(1), F.floor(F.col("n") * train)), F.greatest(F.lit(1), F.floor(F.col("n") * val))
    rows = rows.withColumn("t", n_train).withColumn("v", F.least(n_val, F.col("n") - n_train)).withColumn("rest", F.col("n") - F.col("t") - F.col("v"))
    if test > 0:
        move = (F.col("rest") == 0) & (F.col("n") >= 3)
        rows = rows.withColumn("v2", F.when(move & (F.col("v") > 1), F.col("v") - 1).otherwise(F.col("v"))).withColumn("t", F.when(move & (F.col("v") <= 1), F.col("t") - 1).otherwise(F.col("t"))).withColumn("v", F.col("v2"))
        last = "test"
    else:
        last = "train"
    return rows.select(qid, F.when(F.col("rn") < F.col("t"), "train").when(F.col("rn") < F.col("t") + F.col("v"), "val").otherwise(last).alias("split"))


def leaks(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split (SP5, U5)."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")
