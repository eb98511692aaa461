"""From imports and a clustering to a finished dataset: orchestration, checks, finishing (B11 to B13, V2, V8, V14 to V19, SP4 to SP10)."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.columns import BuildConfig
from passagemill.functions import vectors as V
from passagemill.operators import embed, ingest, link, negatives, split
from passagemill.operators.assign import centroid_matrix
from passagemill.operators.validate import require, unique
from passagemill.runtime import settle
from passagemill.sources import formats
from passagemill.sources.store import write_table

#: Tables of a finished dataset, each with the vectors that are checked on writing.
ARTIFACTS = {
    "question_embs": ("embedding",), "source_embs": ("embedding",), "keyword_embs": ("embedding",), "centroid_embs": ("embedding",),
    "pairs": (), "steering": ("centroid", "keyword_weighted", "residual"), "negatives": (), "splits": (),
}


def resolve_config(config: BuildConfig | dict | None = None, **changes) -> BuildConfig:
    """A configuration from an object or a dictionary; named arguments that aren't None win (B13). Unknown names are an error."""
    known = {f.name for f in dataclasses.fields(BuildConfig)}
    base = dataclasses.asdict(config) if isinstance(config, BuildConfig) else dict(config or {})
    base |= {k: v for k, v in changes.items() if v is not None}
    if set(base) - known:
        raise ValueError(f"unknown settings {sorted(set(base) - known)}")
    if "ratios" in base:
        base["ratios"] = tuple(base["ratios"])
    return BuildConfig(**base).check()


class Stages:
    """Seconds of each stage of a run."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    def run(self, name: str, f: Callable):
        began = time.perf_counter()
        try:
            return f()
        finally:
            self.seconds[name] = round(time.perf_counter() - began, 3)


def stratified(pairs: DataFrame, config: BuildConfig) -> DataFrame:
    """``(pair_id, split)``: questions split per cluster, given to their pairs."""
    q = split.stratified_split(link.majority(pairs, "question_id"), train=config.ratios[0], val=config.ratios[1], test=config.ratios[2], seed=config.seed)
    return pairs.select("pair_id", "question_id").join(q, "question_id").select("pair_id", "split")


def mine(pairs: DataFrame, questions: DataFrame, sources: DataFrame, centroids: DataFrame, config: BuildConfig, n_adjacent: int = 3) -> DataFrame:
    """``(pair_id, slot, neg_id, tier)``: hard negatives of all four tiers for every pair.

    ``questions`` and ``sources``: ``(id, embedding)``; a source lies in the
    cluster of most of its pairs.
    """
    spark = pairs.sparkSession
    q = negatives.quota(config.n_neg)
    home = settle(link.majority(pairs, "source_id"))
    rings = settle(negatives.ring(home, config.seed))
    p = settle(pairs.select("pair_id", "question_id", "source_id", "cluster_id"))
    ids, c = centroid_matrix(centroids.withColumnRenamed("embedding", "centroid"), dim=config.embedding_dim)
    near = spark.createDataFrame([(int(a), int(b)) for a, _, b in negatives.adjacent(ids, c, n_adjacent)], "own long, cluster_id long")
    beside = home.join(near, "cluster_id").select(F.col("own").alias("cluster_id"), "source_id")
    tiers = [
        negatives.in_cluster(p, rings, q[0], config.seed),
        negatives.in_cluster(p, settle(negatives.ring(beside, config.seed + 1)), q[1], config.seed + 1),
        negatives.high_similarity(p, questions.select("question_id", F.col("embedding").alias("vec")), sources.join(home, "source_id").select("source_id", "cluster_id", F.col("embedding").alias("vec")), q[2]),
        negatives.random_distant(p, rings, q[3], config.seed + 2),
    ]
    # where other clusters are too few, the pair's own fills up
    pad = negatives.random_distant(p, rings, config.n_neg, config.seed + 3)
    more = negatives.in_cluster(p, rings, config.n_neg, config.seed + 4).withColumn("slot", F.col("slot") + config.n_neg)
    return negatives.assemble(tiers, pad.unionByName(more), config.n_neg)


def build(spark: SparkSession, frames: list[DataFrame], order: list[str], clusters: DataFrame, keywords: DataFrame, folder: str, make: Callable, config: BuildConfig | dict | None = None, **changes) -> dict:
    """Write a finished dataset and give its counts and the seconds of each stage.

    ``frames``: imports as :func:`~passagemill.operators.ingest.ingest` takes
    them; ``clusters``: ``(cluster_id, descriptors, centroid)``; ``keywords``:
    ``(keyword_id, keyword, cluster_id, embedding)``.
    """
    cfg, stages = resolve_config(config, **changes), Stages()
    pairs = stages.run("merge", lambda: settle(ingest.ingest(frames, order)))
    vocab = link.vocabulary(keywords)

    def linked():
        largest = vocab.groupBy("cluster_id").count().agg(F.max_by("cluster_id", F.struct("count", -F.col("cluster_id")))).first()[0]
        k = clusters.count()
        c = link.link(pairs, vocab, link.fallback(cfg.fallback, F.col("pair_id"), k, largest, cfg.seed))
        return settle(pairs.join(c, "pair_id").join(link.keyword_ids(pairs, vocab), "pair_id"))

    rows = stages.run("link", linked)
    # what is finished is written once, and read from there by the stages after it
    def put(name, df):
        return spark.read.parquet(write_table(df, folder, name, ARTIFACTS[name], first=True))

    vectors = stages.run("embed", lambda: {k: put(k, v) if v is not None else None for k, v in embed.all_vectors(rows, clusters, keywords, make, dim=cfg.embedding_dim).items()})
    ids = keywords.where(F.col("embedding").isNotNull()).select("keyword_id", "embedding")
    stages.run("steer", lambda: put("steering", embed.all_steering(rows, vectors["question_embs"], vectors["centroid_embs"], ids, cfg.embedding_dim)))
    stages.run("mine", lambda: put("negatives", mine(rows, vectors["question_embs"], vectors["source_embs"], vectors["centroid_embs"], cfg)))
    stages.run("split", lambda: put("splits", stratified(rows, cfg)))
    stages.run("write", lambda: put("pairs", rows))
    report = stages.run("finalize", lambda: finalize(spark, folder, cfg))
    return report | {"seconds": stages.seconds}


def missing_tables(spark: SparkSession, folder: str) -> list[str]:
    """Tables of a dataset that aren't there (V14); keyword vectors may be absent."""
    return [n for n in ARTIFACTS if n != "keyword_embs" and not formats.exists(spark, f"{folder}/{n}")]


def split_problems(splits: DataFrame, pairs: DataFrame, ratios: tuple[float, float, float]) -> dict[str, int]:
    """Rows in several splits, pairs in none, rows of unknown pairs, splits that should hold rows and don't (SP4, SP6)."""
    n = splits.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    twice = n.where("n > 1").count()
    none = pairs.select("pair_id").join(n, "pair_id", "left_anti").count()
    unknown = n.join(pairs.select("pair_id"), "pair_id", "left_anti").count()
    held = {r["split"] for r in splits.select("split").distinct().collect()}
    wanted = {s for s, r in zip(("train", "val", "test"), ratios, strict=True) if r > 0}
    return {"in_several": twice, "in_none": none, "unknown": unknown, "empty": len(wanted - held)}


def integrity(spark: SparkSession, folder: str, config: BuildConfig) -> dict[str, int]:
    """Violations of a written dataset by kind, zero everywhere for a sound one."""
    t = {n: spark.read.parquet(f"{folder}/{n}") for n in ARTIFACTS if formats.exists(spark, f"{folder}/{n}")}
    pairs, out = t["pairs"], {}
    for name, key in (("question_embs", "question_id"), ("source_embs", "source_id"), ("centroid_embs", "cluster_id")):
        out[f"{name}: unsound"] = embed.unsound(t[name], "embedding").count()
        out[f"{name}: other dimension"] = t[name].where(F.size("embedding") != config.embedding_dim).count()
        out[f"{name}: pairs without"] = pairs.select(key).distinct().join(t[name].select(key), key, "left_anti").count()
    ids = unique(pairs, "pair_id").first()
    out["pairs: repeated ids"] = ids["n"] - ids["n_distinct"]
    out["pairs: scores out of range"] = pairs.where(~F.coalesce(F.col("relevance_score").between(0, 1), F.lit(False))).count()
    if "keyword_embs" in t:
        out["pairs: keyword ids"] = keyword_id_problems(pairs).count()
    s = t["steering"]
    out["steering: not unit"] = s.where((V.norm(F.col("centroid")) > 1e-8) & (F.abs(V.norm(F.col("centroid")) - 1) > 1e-4)).count()
    out["steering: distances"] = s.where(~F.coalesce(F.col("distance").between(0, 2), F.lit(False))).count()
    out["steering: pairs without"] = pairs.select("pair_id").join(s, "pair_id", "left_anti").count()
    n = t["negatives"]
    bad = negatives.violations(n, pairs, config.n_neg).first()
    out |= {"negatives: too few": bad["short"], "negatives: own source": bad["own_source"] or 0, "negatives: tiers": bad["bad_tier"] or 0}
    out["negatives: unknown sources"] = n.select(F.col("neg_id").alias("source_id")).distinct().join(t["source_embs"], "source_id", "left_anti").count()
    return out | {f"splits: {k}": v for k, v in split_problems(t["splits"], pairs, config.ratios).items()}


def keyword_id_problems(pairs: DataFrame, ids: str = "keyword_ids") -> DataFrame:
    """Pairs whose list of keyword ids is missing or holds NULL or negative ids (V8)."""
    return pairs.where(F.col(ids).isNull() | F.exists(ids, lambda x: x.isNull() | (x < 0))).select("pair_id")


def aligned(df: DataFrame, rid: str, column: str, n: int) -> None:
    """One value for each of ``n`` rows, or an error (V2, V6)."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(rid).alias("d"), F.count(column).alias("v")).first()
    if not got["n"] == got["d"] == got["v"] == n:
        raise ValueError(f"{column}: {got.asDict()} where {n} rows are due")


def steering_shares(pairs: list[tuple[str, float]]) -> dict[str, float]:
    """Shares of steering modes: not negative, not all zero, made to add up to 1; a mode given twice is an error."""
    if any(p < 0 for _, p in pairs) or sum(p for _, p in pairs) <= 0 or len({m for m, _ in pairs}) < len(pairs):
        raise ValueError(f"unsound shares {pairs}")
    total = sum(p for _, p in pairs)
    return {m: p / total for m, p in pairs}


def finalize(spark: SparkSession, folder: str, config: BuildConfig) -> dict:
    """Check a written dataset and write ``config.json`` with its counts.

    The configured dimension 1 stands for the one found; a missing table and
    any violation is an error.
    """
    gone = missing_tables(spark, folder)
    if gone:
        raise FileNotFoundError(f"{folder}: {', '.join(gone)}")
    dim = spark.read.parquet(f"{folder}/question_embs").select(F.size("embedding")).first()
    found = dim[0] if dim else config.embedding_dim
    if config.embedding_dim not in (1, found):
        raise ValueError(f"vectors of {found} components where {config.embedding_dim} are configured")
    cfg = dataclasses.replace(config, embedding_dim=found)
    bad = {k: v for k, v in integrity(spark, folder, cfg).items() if v}
    if bad:
        raise ValueError(f"{folder}: {bad}")
    p = spark.read.parquet(f"{folder}/pairs").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("question_id").alias("n_questions"), F.countDistinct("source_id").alias("n_sources")).first()
    parts = {r["split"]: r["count"] for r in spark.read.parquet(f"{folder}/splits").groupBy("split").count().collect()}
    report = p.asDict() | {"n_clusters": spark.read.parquet(f"{folder}/centroid_embs").count(), "splits": parts}
    formats.write_text(spark, f"{folder}/config.json", json.dumps(dataclasses.asdict(cfg) | report))
    return report | {"embedding_dim": found, "n_neg": cfg.n_neg}


def reload_splits(spark: SparkSession, folder: str, pairs: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """Stored splits; rows in several splits or of unknown pairs are an error (SP10, IO31)."""
    s = spark.read.parquet(f"{folder}/splits")
    bad = split_problems(s, pairs, ratios)
    if bad["in_several"] or bad["unknown"]:
        raise ValueError(f"stored splits: {bad}")
    return s


def splits_of(df: DataFrame, rid: str, val: float = 0.2, test: float = 0.0, seed: int = 42) -> dict[str, DataFrame]:
    """The rows of each split of a simple ratio split (SP8, SP9, B9, W31)."""
    s = settle(split.simple_split(df, rid, val, test, seed))
    return {name: df.join(s.where(F.col("split") == name).select(rid), rid, "left_semi") for name in ("train", "val", "test")}




def require_sound(spark: SparkSession, folder: str, config: BuildConfig) -> None:
    """An error for a dataset with any violation."""
    bad = [(k, v) for k, v in integrity(spark, folder, config).items() if v]
    require(spark.createDataFrame(bad, "what string, n long"), folder) if bad else None
