"""Queries of vectors, cluster assignment, label distributions and nearest neighbours.

Vectors: ``embeddings`` (64 components, ten labels).  Centroids are the
component means of each label.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.operators import assign
from passagemill.operators.knn import block_topk
from passagemill.plans.base import emb, query
from passagemill.runtime import settle, table

#: Components, centroids and cosine distances in SQL.
VEC_SQL = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
comp AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM comp GROUP BY 1),
dist AS (SELECT vec_id, v.label AS own, cent.label AS cluster_id, 1 - list_cosine_similarity(e, c) AS d, e, c FROM v, cent)
"""


def centroids(spark, d):
    """Ids and mean vectors of the labels; there are ten."""
    rows = V.mean_vectors(emb(spark, d).where("label is not null"), ["label"], "embedding", "c").orderBy("label").collect()
    return [r["label"] for r in rows], np.array([r["c"] for r in rows], np.float64).reshape(len(rows), -1)


def cosine_distances(spark, d):
    ids, c = centroids(spark, d)
    return ids, V.against(emb(spark, d), "vec_id", "embedding", ids, c)


@query("m1_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def m1_norm(spark, d):
    return emb(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("m1_normalized", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / (n + 1e-8))), 5) AS s FROM (SELECT *, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def m1_normalized(spark, d):
    return emb(spark, d).select("vec_id", F.round(V.total(V.normalize(F.col("embedding"))), 5).alias("s"))


@query("m2_cosine", f"WITH {VEC_SQL} SELECT vec_id, cluster_id, round(d, 6) AS dist FROM dist")
def m2_cosine(spark, d):
    ids, x = cosine_distances(spark, d)
    return assign.long_distances(x, "vec_id", ids).select("vec_id", "cluster_id", F.round("dist", 6).alias("dist"))


@query("m2_euclidean", f"WITH {VEC_SQL} SELECT vec_id, cluster_id, round(list_distance(e, c), 5) AS dist FROM dist")
def m2_euclidean(spark, d):
    ids, c = centroids(spark, d)
    x = V.against(emb(spark, d), "vec_id", "embedding", ids, c, "euclidean")
    return assign.long_distances(x, "vec_id", ids).select("vec_id", "cluster_id", F.round("dist", 5).alias("dist"))


@query("m4_softmax", f"WITH {VEC_SQL} SELECT vec_id, cluster_id, round(exp(-d / 0.5) / sum(exp(-d / 0.5)) OVER (PARTITION BY vec_id), 6) AS p FROM dist")
def m4_softmax(spark, d):
    ids, x = cosine_distances(spark, d)
    p = x.select("vec_id", V.softmax(F.col("dist"), 0.5).alias("dist"))
    return assign.long_distances(p, "vec_id", ids).select("vec_id", "cluster_id", F.round("dist", 6).alias("p"))


@query("m5_inverse", f"WITH {VEC_SQL} SELECT vec_id, cluster_id, round((1 / (d + 1e-10)) / sum(1 / (d + 1e-10)) OVER (PARTITION BY vec_id), 6) AS p FROM dist")
def m5_inverse(spark, d):
    ids, x = cosine_distances(spark, d)
    p = x.select("vec_id", V.inverse_l1(F.col("dist")).alias("dist"))
    return assign.long_distances(p, "vec_id", ids).select("vec_id", "cluster_id", F.round("dist", 6).alias("p"))


_MEMBER = f"WITH {VEC_SQL}, s AS (SELECT vec_id, own, cluster_id, least(greatest(1 - d, 0), 1) AS c FROM dist), p AS (SELECT vec_id, own, cluster_id, c / sum(c) OVER (PARTITION BY vec_id) AS p FROM s)"


def _member(spark, d):
    ids, x = cosine_distances(spark, d)
    return ids, x.select("vec_id", V.membership(F.transform("dist", lambda y: 1 - y)).alias("p"))


@query("m7_membership", _MEMBER + " SELECT vec_id, cluster_id, round(p, 6) AS p FROM p")
def m7_membership(spark, d):
    ids, p = _member(spark, d)
    return assign.long_distances(p.withColumnRenamed("p", "dist"), "vec_id", ids).select("vec_id", "cluster_id", F.round("dist", 6).alias("p"))


@query("k5_hard", _MEMBER + " SELECT vec_id, arg_min(cluster_id, (-p, cluster_id)) AS cluster_id FROM p GROUP BY 1 HAVING max(p) >= 0.15")
def k5_hard(spark, d):
    ids, p = _member(spark, d)
    return p.select("vec_id", assign.hard(F.col("p"), ids, 0.15).alias("cluster_id")).where("cluster_id is not null")


@query("k6_soft", _MEMBER + " SELECT vec_id, coalesce(string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) FILTER (WHERE p >= 0.15), arg_min(cluster_id, (-p, cluster_id))::VARCHAR) AS ids FROM p GROUP BY 1")
def k6_soft(spark, d):
    ids, p = _member(spark, d)
    return p.select("vec_id", F.array_join(F.transform(assign.soft(F.col("p"), ids, 0.15), lambda x: x.cast("string")), ",").alias("ids"))


@query("m14_argmax", f"WITH {VEC_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE best = own) AS own_nearest FROM (SELECT vec_id, own, arg_min(cluster_id, (d, cluster_id)) AS best FROM dist GROUP BY 1, 2)")
def m14_argmax(spark, d):
    """How often the nearest centroid is the vector's own."""
    ids, x = cosine_distances(spark, d)
    best = x.select("vec_id", assign.nearest(F.col("dist"), ids).alias("best")).join(emb(spark, d).select("vec_id", "label"), "vec_id")
    return best.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("best") == F.col("label")).cast("int")).alias("own_nearest"))


@query("k9_nearest", f"WITH {VEC_SQL} SELECT vec_id, arg_min(cluster_id, (x, cluster_id)) AS cluster_id, round(min(x), 5) AS dist FROM (SELECT *, list_distance(e, c) AS x FROM dist) GROUP BY 1")
def k9_nearest(spark, d):
    ids, c = centroids(spark, d)
    x = V.against(emb(spark, d), "vec_id", "embedding", ids, c, "euclidean")
    return x.select("vec_id", assign.nearest(F.col("dist"), ids).alias("cluster_id"), F.round(F.array_min("dist"), 5).alias("dist"))


@query("k10_ordered", f"WITH {VEC_SQL} SELECT vec_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY round(d, 9), cluster_id) AS ids FROM dist GROUP BY 1")
def k10_ordered(spark, d):
    ids, x = cosine_distances(spark, d)
    r = x.select("vec_id", F.transform("dist", lambda y: F.round(y, 9)).alias("dist"))
    return r.select("vec_id", F.array_join(F.transform(assign.ordered(F.col("dist"), ids), lambda y: y["cluster_id"].cast("string")), ",").alias("ids"))


@query("k4_descriptors", f"WITH {VEC_SQL}, r AS (SELECT cluster_id, vec_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(d, 9), vec_id) AS r FROM dist) SELECT cluster_id, r - 2 AS rank, vec_id FROM r WHERE r BETWEEN 3 AND 7")
def k4_descriptors(spark, d):
    """Five vectors nearest to each centroid after the first two."""
    ids, x = cosine_distances(spark, d)
    return assign.descriptors(x, "vec_id", ids, 5, 2)


@query("a16_coherence", f"WITH {VEC_SQL} SELECT cluster_id, count(*) AS n, round(avg(1 - d), 6) AS mean_cosine, round(avg(1 - d), 6) < 0.3 AS incoherent FROM dist WHERE own = cluster_id GROUP BY 1")
def a16_coherence(spark, d):
    ids, x = cosine_distances(spark, d)
    return assign.coherence(x, "vec_id", ids, emb(spark, d).select("vec_id", F.col("label").alias("cluster_id")))


@query("a14_vector_mean", f"WITH {VEC_SQL} SELECT label, round(list_sum(c), 6) AS s, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS norm FROM cent")
def a14_vector_mean(spark, d):
    m = V.mean_vectors(emb(spark, d), ["label"], "embedding", "c")
    return m.select("label", F.round(V.total(F.col("c")), 6).alias("s"), F.round(V.norm(F.col("c")), 6).alias("norm"))


#: Old clusters with usable centroids against usable keyword vectors.
_KW_SQL = """
k AS (SELECT keyword_id, cluster_id, embedding::DOUBLE[] AS e FROM keywords WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
c AS (SELECT cluster_id, descriptors, centroid::DOUBLE[] AS c FROM clusters WHERE len(centroid) = 64 AND NOT list_bool_or(list_transform(centroid, lambda x: isnan(x)))),
kd AS (SELECT keyword_id, k.cluster_id AS own, c.cluster_id, descriptors, CASE WHEN list_bool_or(list_transform(c, lambda x: x <> 0)) THEN 1 - list_cosine_similarity(e, c) ELSE 1.0 END AS d FROM k, c)
"""


def _keyword_distances(spark, d):
    ids, c = assign.centroid_matrix(table(spark, d, "clusters"))
    return ids, V.against(assign.usable(table(spark, d, "keywords"), "embedding"), "keyword_id", "embedding", ids, c)


@query("k11_compare", f"WITH {_KW_SQL}, r AS (SELECT keyword_id, cluster_id, round(d, 6) AS dist, row_number() OVER (PARTITION BY keyword_id ORDER BY round(d, 6), cluster_id) AS r FROM kd) SELECT keyword_id, r AS rank, cluster_id, dist FROM r WHERE r <= 3")
def k11_compare(spark, d):
    """The three old clusters nearest to each keyword."""
    ids, x = _keyword_distances(spark, d)
    r = x.select("keyword_id", F.transform("dist", lambda y: F.round(y, 6)).alias("dist"))
    o = r.select("keyword_id", F.posexplode(F.slice(assign.ordered(F.col("dist"), ids), 1, 3)).alias("i", "x"))
    return o.select("keyword_id", (F.col("i") + 1).cast("long").alias("rank"), "x.cluster_id", "x.dist")


@query("j11_descriptor_distance", f"WITH {_KW_SQL} SELECT keyword_id, descriptor, round(min(d), 6) AS dist FROM (SELECT keyword_id, d, unnest(descriptors) AS descriptor FROM kd) WHERE descriptor IS NOT NULL GROUP BY 1, 2")
def j11_descriptor_distance(spark, d):
    """Each keyword's least distance to a cluster with a given descriptor."""
    ids, x = _keyword_distances(spark, d)
    c = table(spark, d, "clusters").select("cluster_id", "descriptors")
    return assign.descriptor_distances(x, "keyword_id", ids, c).where("descriptor is not null")


@query("lb3_label", f"WITH {_KW_SQL}, p AS (SELECT keyword_id, cluster_id, exp(-d) / sum(exp(-d)) OVER (PARTITION BY keyword_id) AS p FROM kd) SELECT keyword_id, arg_min(cluster_id, (-round(p, 9), cluster_id)) AS primary_cluster, round(max(p), 6) AS p, round(-sum(p * ln(p)), 5) AS entropy FROM p GROUP BY 1")
def lb3_label(spark, d):
    """Label distribution of each keyword over the old clusters, its mode and entropy."""
    ids, x = _keyword_distances(spark, d)
    p = x.select("keyword_id", F.transform(V.softmax(F.col("dist")), lambda y: y).alias("p"))
    rounded = F.transform("p", lambda y: F.round(y, 9))
    return p.select("keyword_id", assign.hard(rounded, ids).alias("primary_cluster"), F.round(F.array_max("p"), 6).alias("p"), F.round(-V.total(F.transform("p", lambda y: y * F.log(y))), 5).alias("entropy"))


@query(
    "lb5_combined",
    f"WITH {VEC_SQL}, p AS (SELECT vec_id, own, cluster_id, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p FROM dist) SELECT vec_id, cluster_id, round(0.7 * p + 0.3 * (CASE WHEN own = cluster_id THEN 1 ELSE 0 END), 6) AS p FROM p",
)
def lb5_combined(spark, d):
    """Distances' label mixed with the given label."""
    ids, x = cosine_distances(spark, d)
    both = x.join(emb(spark, d).select("vec_id", "label"), "vec_id")
    one_hot = F.array(*[(F.col("label") == i).cast("double") for i in ids])
    p = both.select("vec_id", assign.combined_label(V.softmax(F.col("dist")), one_hot, 0.3).alias("dist"))
    return assign.long_distances(p, "vec_id", ids).select("vec_id", "cluster_id", F.round("dist", 6).alias("p"))


@query("lb2_given", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.25 WHEN vec_id % 3 = 1 THEN round(0.5 / 0.8, 6) ELSE 0.4 END AS p0 FROM embeddings")
def lb2_given(spark, d):
    """Stored distributions repaired: missing ones are uniform, unnormalised ones are normalised."""
    raw = F.when(F.col("vec_id") % 3 == 1, F.array(*[F.lit(x) for x in (0.5, 0.1, 0.1, 0.1)])).when(F.col("vec_id") % 3 == 2, F.array(*[F.lit(x) for x in (0.4, 0.2, 0.2, 0.2)]))
    return emb(spark, d).select("vec_id", F.round(F.element_at(assign.given_label(raw, 4), 1), 6).alias("p0"))


@query("k1_kmeans")
def k1_kmeans(spark, d):
    """Sizes of a k-means clustering of the vectors."""
    return assign.kmeans(emb(spark, d), "vec_id", "embedding", 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("k1_bisecting")
def k1_bisecting(spark, d):
    return assign.kmeans(emb(spark, d), "vec_id", "embedding", 10, bisecting=True).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("jn10_knn", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
r AS (SELECT q.vec_id AS query_id, o.vec_id AS other_id, round(list_cosine_similarity(q.e, o.e), 9) AS s FROM v q, v o WHERE q.vec_id % 50 = 0 AND q.vec_id <> o.vec_id)
SELECT query_id, other_id, round(s, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, other_id) AS r FROM r) WHERE r <= 4
""")  # fmt: skip
def jn10_knn(spark, d):
    """Four nearest others of every fifth vector, all vectors compared."""
    v = settle(emb(spark, d).select("vec_id", F.col("embedding").alias("vec")))
    best = block_topk(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("key"), F.col("vec_id").alias("tag"), "vec"), v.select(F.col("vec_id").alias("oid"), F.col("vec_id").alias("otag"), "vec"), 4, exclude_same_tag=True)
    return best.select(F.col("key").alias("query_id"), F.col("oid").alias("other_id"), F.round("sim", 6).alias("sim"))


@query("v11_invalid", """
SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64) AS bad_size,
  count(*) FILTER (WHERE len(embedding) = 64 AND list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS not_finite,
  count(*) FILTER (WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x <> 0))) AS zero FROM keywords
""")  # fmt: skip
def v11_invalid(spark, d):
    """Counts of unusable vectors."""
    e = F.col("embedding")
    full = F.coalesce(F.size(e) == 64, F.lit(False)) & e.isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, d, "keywords").agg(F.count(F.lit(1)).alias("n"), count(~full).alias("bad_size"), count(full & F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"), count(full & ~F.exists(e, lambda x: x != 0)).alias("zero"))


@query("v3_dims", "SELECT 'keywords' AS name, len(embedding) AS dim, count(*) AS n FROM keywords WHERE embedding IS NOT NULL GROUP BY ALL UNION ALL SELECT 'embeddings', len(embedding), count(*) FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL")
def v3_dims(spark, d):
    """Dimensions met in the vector tables."""
    one = lambda n: table(spark, d, n).where("embedding is not null").groupBy(F.lit(n).alias("name"), F.size("embedding").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return one("keywords").unionByName(one("embeddings"))
