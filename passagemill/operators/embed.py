"""Embedding of entities and the steering made from embedded texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import jsoncols as J
from passagemill.functions import vectors as V
from passagemill.functions.text import is_empty_text, keyword_key
from passagemill.operators import steering
from passagemill.operators.assign import centroid_matrix, coherence
from passagemill.operators.enrich import map_texts
from passagemill.operators.validate import require


def as_model(embedder) -> Callable:
    """A function over texts from either kind of embedder, told by its methods."""
    if hasattr(embedder, "embed_documents") and hasattr(embedder, "embed_query"):
        return embedder.embed_documents
    if hasattr(embedder, "encode"):
        return lambda texts: [list(map(float, v)) for v in embedder.encode(texts)]
    raise TypeError(f"{type(embedder).__name__} is no embedder")


def model_name(embedder) -> str:
    """The name an embedder carries under one of the usual attributes."""
    for name in ("model_name", "model", "name_or_path"):
        if isinstance(getattr(embedder, name, None), str):
            return getattr(embedder, name)
    return type(embedder).__name__


def unsound(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is missing, empty, not finite or all zero."""
    c = F.col(vec)
    return df.where(c.isNull() | (F.size(c) == 0) | F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(c, lambda x: x != 0))


def entity_vectors(df: DataFrame, rid: str, text: str, make: Callable, out: str = "embedding") -> DataFrame:
    """``(rid, text, out)`` of every row that holds text, one model call for each distinct one; an unsound vector is an error."""
    rows = df.where(~is_empty_text(F.col(text))).select(rid, text)
    v = map_texts(rows.select(text).distinct(), text, make, out, "array<double>")
    got = rows.join(v, text)
    require(unsound(got, out).select(rid), "unsound vectors")
    return got.select(rid, text, out)


def suggested_terms(df: DataFrame, column: str, least: float = 0.7) -> DataFrame:
    """``(term)``: the distinct normalised terms suggested with enough confidence."""
    items = J.at_least(J.suggestions(F.col(column)), least=least)
    return df.select(F.explode(J.unique_terms(items)).alias("term")).distinct()


def keyword_vectors(document: DataFrame | None, words: DataFrame | None, make: Callable) -> DataFrame | None:
    """``(keyword, embedding)``: those of the cluster document; where it has none, its keywords, else the given ones, are embedded."""
    if document is not None:
        ready = document.where(F.col("embedding").isNotNull()).select("keyword", "embedding")
        if not ready.isEmpty():
            return ready
        words = document.select("keyword")
    if words is None or words.isEmpty():
        return None
    return entity_vectors(words.select("keyword").distinct(), "keyword", "keyword", make) if "keyword" in words.columns else None


def centroid_vectors(clusters: DataFrame, members: DataFrame | None = None, dim: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """Centroids by cluster, and the clusters whose members are far from theirs (E10, A16); a missing centroid is an error."""
    require(unsound(clusters, "centroid").select("cluster_id"), "clusters without a centroid")
    flagged = None
    if members is not None:
        ids, m = centroid_matrix(clusters, dim=dim)
        d = V.against(members, "keyword_id", "embedding", ids, m)
        flagged = coherence(d, "keyword_id", ids, members.select("keyword_id", "cluster_id")).where("incoherent")
    return clusters.select("cluster_id", F.col("centroid").alias("embedding")), flagged


def all_vectors(pairs: DataFrame, clusters: DataFrame, keywords: DataFrame | None, make: Callable, on_empty_keywords: str = "none", dim: int = 64) -> dict[str, DataFrame | None]:
    """Vectors of questions, sources, keywords and centroids."""
    words = keyword_vectors(keywords, None, make)
    if words is None and on_empty_keywords == "error":
        raise ValueError("no keywords to embed")
    return {
        "question_embs": entity_vectors(pairs.select("question_id", "question").distinct(), "question_id", "question", make),
        "source_embs": entity_vectors(pairs.select("source_id", "source").distinct(), "source_id", "source", make),
        "keyword_embs": words,
        "centroid_embs": centroid_vectors(clusters, dim=dim)[0],
    }


def text_steering(rows: DataFrame, rid: str, texts: DataFrame, make: Callable, dim: int) -> DataFrame:
    """``(rid, embedding)``: the vector of the text written for each row, zero where there is none."""
    got = rows.select(rid).join(texts.where(~is_empty_text(F.col("text"))).select(rid, "text"), rid, "left")
    v = map_texts(got.where("text is not null").select("text").distinct(), "text", make, "embedding", "array<double>")
    return got.join(v, "text", "left").select(rid, F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


def suggestion_steering(rows: DataFrame, rid: str, terms: str, known: DataFrame, make: Callable, dim: int) -> DataFrame:
    """``(rid, embedding)``: mean vector of a row's terms, known ones by their normalised form, others embedded; zero without any."""
    each = rows.select(rid, F.explode(terms).alias("_t")).select(rid, keyword_key(F.col("_t")).alias("key")).where("key <> ''")
    own = known.where(F.col("keyword").isNotNull()).select(keyword_key(F.col("keyword")).alias("key"), V.doubles(F.col("embedding")).alias("embedding")).groupBy("key").agg(F.min("embedding").alias("embedding"))
    fresh = map_texts(each.select("key").distinct().join(own.select("key"), "key", "left_anti"), "key", make, "embedding", "array<double>")
    return _mean_or_zero(rows, rid, each.join(own.unionByName(fresh), "key"), dim)


def descriptor_steering(rows: DataFrame, rid: str, clusters: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(rid, embedding)``: mean vector of the descriptors of a row's cluster; zero without any."""
    names = clusters.select("cluster_id", F.explode("descriptors").alias("_t")).select("cluster_id", keyword_key(F.col("_t")).alias("key"))
    own = vectors.where(F.col("keyword").isNotNull()).select(keyword_key(F.col("keyword")).alias("key"), "embedding").groupBy("key").agg(F.min("embedding").alias("embedding"))
    # means are taken once for each cluster, not for each row
    means = V.mean_vectors(names.join(own, "key"), ["cluster_id"], "embedding", "m")
    return rows.select(rid, "cluster_id").join(means, "cluster_id", "left").select(rid, F.coalesce("m", F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


def _mean_or_zero(rows: DataFrame, rid: str, each: DataFrame, dim: int) -> DataFrame:
    means = V.mean_vectors(each, [rid], "embedding", "m")
    return rows.select(rid).join(means, rid, "left").select(rid, F.coalesce("m", F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


def all_steering(pairs: DataFrame, questions: DataFrame, centroids: DataFrame, keywords: DataFrame, dim: int, fallback: str = "centroid", rid: str = "pair_id") -> DataFrame:
    """``(rid, centroid, keyword_weighted, residual, distance)`` of every pair in one table.

    ``questions``: ``(question_id, embedding)``; ``centroids``: ``(cluster_id,
    embedding)``; ``keywords``: ``(keyword_id, embedding)``; ``pairs`` carry
    ``keyword_ids``.
    """
    q = questions.select("question_id", V.doubles(F.col("embedding")).alias("q"))
    c = centroids.select("cluster_id", V.doubles(F.col("embedding")).alias("c"))
    rows = pairs.select(rid, "question_id", "cluster_id").join(q, "question_id").join(c, "cluster_id")
    words = steering.keyword_steering(pairs, rid, "keyword_ids", keywords)
    rows = rows.join(words, rid, "left")
    toward = steering.toward(F.col("q"), F.col("c"))
    weighted = steering.with_fallback(F.col("keyword_steering"), toward, fallback, dim, F.col(rid))
    return rows.select(rid, toward.alias("centroid"), weighted.alias("keyword_weighted"), steering.residual(F.col("q"), F.col("c")).alias("residual"), steering.distance(F.col("q"), F.col("c")).alias("distance"))
