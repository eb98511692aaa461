"""Training views and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions.hashing import hash32


def batches(df: DataFrame, rid: str, size: int, epoch: int, shuffle: bool = True, drop_last: bool = True, seed: int = 42) -> DataFrame:
    """``(rid, batch, slot)``: rows in seeded order of the epoch, cut into batches.

    Positions come from counts of hash ranges, so no task orders all rows.
    """
    n = df.count()
    key = hash32(seed, epoch, F.col(rid)) if shuffle else F.col(rid).cast("long")
    rows = df.select(rid, key.alias("h"))
    if shuffle:
        rows = rows.withColumn("r", F.floor(F.col("h") / 2**20).cast("int"))  # 4096 ranges
    else:
        lo, hi = rows.agg(F.min("h"), F.max("h")).first()
        rows = rows.withColumn("r", F.floor((F.col("h") - (lo or 0)) * 4096 / ((hi or 0) - (lo or 0) + 1)).cast("int"))
    per, base = [], 0
    for r in sorted(rows.groupBy("r").count().collect(), key=lambda x: x["r"]):
        per.append((r["r"], base))
        base += r["count"]
    off = df.sparkSession.createDataFrame(per or [(0, 0)], "r int, before long")
    at = rows.join(F.broadcast(off), "r").withColumn("at", F.col("before") + F.row_number().over(W.partitionBy("r").orderBy("h", rid)) - 1)  # at most 4,096 ranges
    out = at.select(rid, F.floor(F.col("at") / size).alias("batch"), F.pmod("at", F.lit(size)).alias("slot"))
    return out.where(F.col("batch") < n // size) if drop_last else out


def forced(variant, name: str | None):
    """The drawn variant, or one given to all rows."""
    if name not in (None, "zero", "centroid", "keyword", "residual"):
        raise ValueError(f"unknown variant {name}")
    return variant if name is None else F.lit(name)


def batch_problems(view: DataFrame, batch: DataFrame, rid: str, vectors: tuple[str, ...], dim: int, scores: tuple[str, ...] = ()) -> DataFrame:
    """``(batch, rows, missing, other_dim, not_finite, out_of_range)`` of each batch of a training view."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = batch.join(view, rid, "left")
    lack = wrong = bad = out = F.lit(False)
    for v in vectors:
        c = F.col(v)
        lack, wrong = lack | c.isNull(), wrong | (c.isNotNull() & (F.size(c) != dim))
        bad = bad | F.coalesce(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    for s in scores:
        out = out | ~F.coalesce(F.col(s).between(0, 1), F.lit(False))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), one(lack).alias("missing"), one(wrong).alias("other_dim"), one(bad).alias("not_finite"), one(out).alias("out_of_range"))


def memory_estimate(n_questions: int, n_sources: int, n_keywords: int, n_pairs: int, dim: int, n_neg: int) -> dict[str, int]:
    """Bytes of the dense arrays of a dataset: vectors in single precision, ids in eight bytes."""
    v = {"embeddings": (n_questions + n_sources + n_keywords) * dim * 4, "pairs": n_pairs * (2 * 8 + 8 + 4), "negatives": n_pairs * n_neg * 16, "steering": n_pairs * (3 * dim * 4 + 4)}
    return v | {"total": sum(v.values())}


def samples(df: DataFrame, rid: str, ids: DataFrame, label: str, labels: tuple[str, ...] = ("source_label", "steering_label", "combined_label")) -> DataFrame:
    """The asked samples' vectors with one of their labels (B6); ids that aren't there give no row."""
    if label not in labels:
        raise ValueError(f"unknown label {label}")
    return df.join(ids.select(rid).distinct(), rid).select(rid, "embedding", "steering", F.col(label).alias("label"))
