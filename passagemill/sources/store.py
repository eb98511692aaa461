"""Sinks: gated Parquet tables, split folders, cluster documents, partial updates (SK1 to SK24)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.operators.validate import require
from passagemill.runtime import remove


def write_table(df: DataFrame, folder: str, name: str, vectors: tuple[str, ...] = (), codec: str = "zstd", first: bool = False) -> str:
    """Write a table unless one of its vectors holds NaN or an infinite number (SK1 to SK6).

    ``first``: the table is written before its vectors are looked at, and
    removed if they aren't sound, so that a costly plan runs once.
    """
    path = f"{folder}/{name}"
    if first:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path) if first else df
    try:
        for v in vectors:
            require(held.where(F.exists(F.coalesce(v, F.array().cast(dict(df.dtypes)[v])), lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).select(F.lit(v).alias("column")), f"{name}: not finite")
    except ValueError:
        if first:
            remove(df.sparkSession, path)
        raise
    if not first:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    return path


def write_splits(df: DataFrame, folder: str, split: str = "split") -> str:
    """One folder for each split, which scans can prune (SK8, SK9)."""
    path = f"{folder}/splits"
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return path


def append_samples(df: DataFrame, folder: str, rid: str = "sample_id") -> str:
    """Append rows (SK10); their ids must be new, or the write is refused."""
    path = f"{folder}/samples"
    if "://" in path or Path(path).exists():
        require(df.select(rid).join(df.sparkSession.read.parquet(path).select(rid), rid, "left_semi"), "ids that are already there")
    df.write.mode("append").parquet(path)
    return path


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with the new values where they are given (SK11)."""
    cols = [c for c in new.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return old.join(n, key, "left").select(key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns if c != key])


def write_cluster_document(clusters: DataFrame, keywords: DataFrame, path: str, meta: dict, sample: int = 10) -> None:
    """The cluster document (SK7): one entry for each cluster with its size, descriptors and first keywords, keywords with their cluster."""
    words = keywords.where("cluster_id is not null").select("keyword_id", "keyword", "cluster_id")
    # sizes and samples come from an aggregate; the keywords themselves pass through the driver one by one into the file
    heads = words.withColumn("r", F.row_number().over(W.partitionBy("cluster_id").orderBy("keyword_id"))).where(F.col("r") <= sample)
    samples = heads.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "keyword"))).alias("s"))
    stats = {str(r["cluster_id"]): {"size": r["n"], "keywords_sample": [x["keyword"] for x in r["s"]]} for r in words.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).join(samples, "cluster_id").collect()}
    rows = clusters.orderBy("cluster_id").collect()  # one row for each cluster
    for r in rows:
        stats.setdefault(str(r["cluster_id"]), {"size": 0, "keywords_sample": []})["topic_descriptors"] = list(r["descriptors"] or [])
    text = lambda x: json.dumps(x, ensure_ascii=False)
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('{"metadata": ' + text({**meta, "n_clusters": len(rows)}) + ', "cluster_stats": ' + text(stats) + ', "centroids": ' + text([list(r["centroid"] or []) for r in rows]) + ', "cluster_assignments": {')
        between = ""
        for r in words.groupBy("keyword").agg(F.max_by("cluster_id", "keyword_id").alias("cluster_id"), F.min("keyword_id").alias("k")).orderBy("k").toLocalIterator():
            out.write(f"{between}{text(r['keyword'])}: {r['cluster_id']}")
            between = ", "
        out.write("}}")


def folder_bytes(path: str) -> int:
    """Size of a written table, to compare codecs (SK20)."""
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))
