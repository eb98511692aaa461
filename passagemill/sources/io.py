"""Scans: CSV, JSON, cluster documents, Parquet artifacts, file checks (IO1 to IO32)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.jsoncols import SUGGESTION


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, quoted line breaks and doubled quotes; every column text (IO1, IO3)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_csvs(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """One frame for each file with ``file_no`` and ``row_no``, which order the rows as they stand in the files."""
    if not paths:
        raise ValueError("no files given")
    missing = [p for p in paths if "://" not in p and not Path(p).exists()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return [read_csv(spark, p).withColumn("file_no", F.lit(i)).withColumn("row_no", F.monotonically_increasing_id()) for i, p in enumerate(paths)]


def records(df: DataFrame, source: tuple[str, ...] = ("source_text", "source"), question: tuple[str, ...] = ("question_text", "question")) -> tuple[DataFrame, DataFrame]:
    """Rows that hold both texts, and the rejected ones (IO3, J8)."""
    pick = lambda names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    both = df.withColumn("source_text_", pick(source)).withColumn("question_text_", pick(question))
    ok = F.col("source_text_").isNotNull() & F.col("question_text_").isNotNull()
    return both.where(ok), both.where(~ok)


def suggestion_rows(df: DataFrame, rid: str, column: str = "suggestions") -> DataFrame:
    """``(rid, pos, term, type, confidence)``: the objects of each list; NULL, bad JSON and other items give none (IO5)."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.select(rid, F.posexplode(F.from_json(column, SUGGESTION)).alias("pos", "x")).select(rid, "pos", "x.*").where("term is not null")


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Clusters, keywords and metadata of a cluster document (IO6, IO7); a document is small and read on the driver."""
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    meta = doc.get("metadata", {})
    if "n_clusters" not in meta:
        raise ValueError("the document lacks metadata.n_clusters")
    stats, cent, emb = doc.get("cluster_stats", {}), doc.get("centroids") or [], doc.get("embeddings", {})
    n = int(meta["n_clusters"])
    clusters = [(i, [str(x) for x in stats.get(str(i), {}).get("topic_descriptors", [])], [float(x) for x in cent[i]] if i < len(cent) else None) for i in range(n)]
    words = [(k, w, int(c), [float(x) for x in emb[w]] if w in emb else None) for k, (w, c) in enumerate(sorted(doc.get("cluster_assignments", {}).items()))]
    bad = [w for _, w, c, _ in words if not 0 <= c < n]
    if bad:
        raise ValueError(f"keywords of unknown clusters: {bad[:3]}")
    return (
        spark.createDataFrame(clusters, "cluster_id long, descriptors array<string>, centroid array<double>"),
        spark.createDataFrame(words, "keyword_id long, keyword string, cluster_id long, embedding array<double>"),
        meta,
    )


def read_artifact(spark: SparkSession, folder: str, name: str, vector: str | None = None, dim: int | None = None, required: bool = True) -> DataFrame | None:
    """A written table; with ``vector`` and ``dim`` every vector's size is checked (IO11, IO12, V1)."""
    path = f"{folder}/{name}"
    if "://" not in path and not Path(path).exists():
        if required:
            raise FileNotFoundError(path)
        return None
    df = spark.read.parquet(path)
    if vector and dim:
        bad = df.where(F.coalesce(F.size(vector), F.lit(-1)) != dim).take(1)
        if bad:
            raise ValueError(f"{name}: a vector doesn't have {dim} components")
    return df


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the given ids in the order asked for (IO24); the list comes from the caller."""
    asked = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"_at int, {key} {dict(df.dtypes)[key]}")
    return df.join(asked, key).orderBy("_at").drop("_at")


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """A page of the table in order of its key (IO20)."""
    return df.orderBy(key).offset(offset).limit(limit)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of each file (SK14)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
