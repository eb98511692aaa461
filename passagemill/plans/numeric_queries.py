"""Queries of losses and diagnostics over ``embeddings`` and its label centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.operators import metrics as M
from passagemill.operators import steering
from passagemill.plans.assign_queries import VEC_SQL, centroids, cosine_distances
from passagemill.plans.base import emb, query
from passagemill.plans.training_queries import TRAIN_SQL, train_pairs
from passagemill.runtime import table


def _pairs(spark, d):
    e = emb(spark, d)
    return train_pairs(spark, d).join(e.select(F.col("vec_id").alias("question_id"), V.doubles(F.col("embedding")).alias("q")), "question_id").join(e.select(F.col("vec_id").alias("source_id"), V.doubles(F.col("embedding")).alias("s")), "source_id")


@query("x1_smooth_l1", f"WITH {TRAIN_SQL} SELECT pair_id, round(list_avg(list_transform(list_zip(q.e, s.e), lambda z: CASE WHEN abs(z[1] - z[2]) < 1 THEN 0.5 * (z[1] - z[2]) * (z[1] - z[2]) ELSE abs(z[1] - z[2]) - 0.5 END)), 6) AS loss FROM t JOIN v q ON q.vec_id = t.question_id JOIN v s ON s.vec_id = t.source_id")
def x1_smooth_l1(spark, d):
    return _pairs(spark, d).select("pair_id", F.round(M.smooth_l1(F.col("q"), F.col("s")), 6).alias("loss"))


@query("x2_infonce", f"WITH {VEC_SQL}, z AS (SELECT vec_id, own, cluster_id, (1 - d) / 0.07 AS z FROM dist) SELECT round(avg(l), 5) AS loss FROM (SELECT vec_id, ln(sum(exp(z))) - max(z) FILTER (WHERE own = cluster_id) AS l FROM z GROUP BY 1)")
def x2_infonce(spark, d):
    """Contrastive loss of each vector against its own centroid and the others."""
    ids, x = cosine_distances(spark, d)
    p = x.join(emb(spark, d).select("vec_id", "label"), "vec_id")
    at = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("label")).cast("int") - 1
    return p.select(M.cross_entropy(F.transform("dist", lambda y: (1 - y) / 0.07), at).alias("l")).agg(F.round(F.avg("l"), 5).alias("loss"))


@query("x3_centroid_ce", f"WITH {VEC_SQL}, z AS (SELECT vec_id, own, cluster_id, d, (1 - d) / 0.1 AS z FROM dist), r AS (SELECT vec_id, own, ln(sum(exp(z))) - max(z) FILTER (WHERE own = cluster_id) AS l, arg_min(cluster_id, (d, cluster_id)) AS best FROM z GROUP BY 1, 2) SELECT round(avg(l), 5) AS loss, round(avg((best = own)::INT), 6) AS accuracy FROM r")
def x3_centroid_ce(spark, d):
    ids, x = cosine_distances(spark, d)
    p = x.join(emb(spark, d).select("vec_id", "label"), "vec_id")
    at = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("label")).cast("int") - 1
    r = p.select(M.cross_entropy(F.transform("dist", lambda y: (1 - y) / 0.1), at).alias("l"), (F.array_position("dist", F.array_min("dist")) - 1 == at).cast("int").alias("ok"))
    return r.agg(F.round(F.avg("l"), 5).alias("loss"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query("x4_variance", f"""
WITH {VEC_SQL}, x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
h AS (SELECT avg(greatest(1 - sqrt(vr + 1e-4), 0)) AS variance, count(*) AS dim FROM (SELECT i, var_samp(x) AS vr FROM x GROUP BY 1)),
c AS (SELECT 2 * sum(c * c) AS c2 FROM (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2))
SELECT round(variance, 6) AS variance, round(c2 / dim, 6) AS covariance FROM h, c
""")  # fmt: skip
def x4_variance(spark, d):
    return M.variance_terms(emb(spark, d), "embedding")


_SOFT = f"WITH {VEC_SQL}, p AS (SELECT vec_id, own, cluster_id, d, exp(-d / 0.1) / sum(exp(-d / 0.1)) OVER (PARTITION BY vec_id) AS p FROM dist)"


@query("x7_entropy", _SOFT + " SELECT round(avg(h), 5) AS mean_entropy FROM (SELECT vec_id, -sum(p * ln(greatest(p, 1e-8))) AS h FROM p GROUP BY 1)")
def x7_entropy(spark, d):
    _, x = cosine_distances(spark, d)
    return x.select(M.entropy(V.softmax(F.col("dist"), 0.1)).alias("h")).agg(F.round(F.avg("h"), 5).alias("mean_entropy"))


@query("x16_routing", _SOFT + " SELECT vec_id, arg_min(cluster_id, (d, cluster_id)) AS primary_cluster, round(max(p), 5) AS confidence, round(min(d), 6) AS nearest FROM p GROUP BY 1")
def x16_routing(spark, d):
    """Routing of each vector over the centroids: primary cluster, confidence, nearest distance."""
    ids, x = cosine_distances(spark, d)
    r = x.select("vec_id", "dist", V.softmax(F.col("dist"), 0.1).alias("p"))
    from passagemill.operators.assign import nearest

    return r.select("vec_id", nearest(F.col("dist"), ids).alias("primary_cluster"), F.round(F.array_max("p"), 5).alias("confidence"), F.round(F.array_min("dist"), 6).alias("nearest"))


@query("x17_influence", f"WITH {VEC_SQL}, p AS (SELECT vec_id, cluster_id, exp(-d / 0.1) / sum(exp(-d / 0.1)) OVER (PARTITION BY vec_id) AS p, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS q FROM dist) SELECT vec_id, round(sum(greatest(p, 1e-8) * ln(greatest(p, 1e-8) / greatest(q, 1e-8))), 5) AS kl FROM p GROUP BY 1")
def x17_influence(spark, d):
    """Divergence of a sharp routing from a flat one."""
    _, x = cosine_distances(spark, d)
    return x.select("vec_id", F.round(M.kl(V.softmax(F.col("dist"), 0.1), V.softmax(F.col("dist"), 1.0)), 5).alias("kl"))


@query("x8_residual", f"WITH {TRAIN_SQL} SELECT round(avg(greatest(list_distance(q.e, cent.c) - 0.5, 0)), 5) AS loss FROM t JOIN v q ON q.vec_id = t.question_id JOIN cent ON cent.label = t.cluster_id")
def x8_residual(spark, d):
    ids, c = centroids(spark, d)
    cent = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, c, strict=True)], "cluster_id int, c array<double>")
    p = _pairs(spark, d).join(F.broadcast(cent), "cluster_id")  # ten labels
    return p.agg(F.round(F.avg(M.residual_hinge(steering.residual(F.col("q"), F.col("c")), 0.5)), 5).alias("loss"))


@query("m11_ema", "SELECT s AS step, round(0.999 - (0.999 - 0.99) * (cos(pi() * least(s / 100.0, 1)) + 1) / 2, 6) AS tau FROM (SELECT unnest(range(0, 121, 10)) AS s)")
def m11_ema(spark, d):
    """Momentum schedule at every tenth step."""
    return spark.createDataFrame([(s, round(M.ema_tau(s, 100, 0.99, 0.999), 6)) for s in range(0, 121, 10)], "step long, tau double")


@query("x19_actions", f"WITH {VEC_SQL}, m AS (SELECT vec_id, min(d) * 3 AS a FROM dist GROUP BY 1) SELECT CASE WHEN a > 2 THEN 'unusual item, review it' WHEN a < 0.5 THEN 'typical item' ELSE '' END AS advice, count(*) AS n FROM m GROUP BY 1")
def x19_actions(spark, d):
    """Advice by atypicality."""
    _, x = cosine_distances(spark, d)
    return x.groupBy(M.actionable(F.array_min("dist") * 3, F.lit(0.5)).alias("advice")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_epoch_means", "SELECT event_type AS epoch, round(avg(m), 6) AS mean_of_batches FROM (SELECT event_type, user_id % 8 AS batch, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def a19_epoch_means(spark, d):
    """Mean of batch means."""
    b = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 8).alias("batch")).agg(F.avg("value").alias("m"))
    return b.groupBy(F.col("event_type").alias("epoch")).agg(F.round(F.avg("m"), 6).alias("mean_of_batches"))


@query("s_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s_windowed_counts(spark, d):
    """Hourly counts, as the stream operator gives them for a table."""
    from passagemill.streaming.incremental import windowed_counts

    w = windowed_counts(table(spark, d, "events"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s_stream", "SELECT keyword_id, CASE WHEN keyword IS NOT NULL THEN substring(md5(keyword), 1, 8) END AS result FROM keywords WHERE keyword_id IS NOT NULL")
def s_stream(spark, d):
    """Keywords enriched by a file stream that is started twice; the second run finds nothing new."""
    import uuid

    from passagemill.operators.enrich import stub_model
    from passagemill.runtime import shared_dir
    from passagemill.streaming.incremental import enrich_stream

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    k = table(spark, d, "keywords").select("keyword_id", "keyword")
    k.repartition(6).write.parquet(f"{base}/in")
    for _ in range(2):
        enrich_stream(spark, f"{base}/in", "keyword_id long, keyword string", f"{base}/out", f"{base}/state", "keyword_id", "keyword", stub_model)
    return spark.read.parquet(f"{base}/out").select("keyword_id", "result")


@query("x6_routing_ce", _SOFT + " SELECT round(avg(l), 5) AS loss FROM (SELECT vec_id, -sum((CASE WHEN own = cluster_id THEN 0.9 ELSE 0 END + 0.01) * ln(greatest(p, 1e-8))) AS l FROM p GROUP BY 1)")
def x6_routing_ce(spark, d):
    """Routing cross entropy with label smoothing of 0.1 over ten clusters."""
    ids, x = cosine_distances(spark, d)
    p = x.join(emb(spark, d).select("vec_id", "label"), "vec_id").select(V.softmax(F.col("dist"), 0.1).alias("p"), F.array(*[F.when(F.col("label") == i, 0.9).otherwise(0.0) + 0.01 for i in ids]).alias("t"))
    loss = -V.total(F.zip_with("p", "t", lambda a, b: b * F.log(F.greatest(a, F.lit(1e-8)))))
    return p.select(loss.alias("l")).agg(F.round(F.avg("l"), 5).alias("loss"))


@query("x13_router_summary", _SOFT + " SELECT cluster_id, round(avg(p), 6) AS mean_weight FROM p GROUP BY 1")
def x13_router_summary(spark, d):
    """Mean routing weight of each cluster."""
    from passagemill.operators.assign import long_distances

    ids, x = cosine_distances(spark, d)
    p = x.select("vec_id", V.softmax(F.col("dist"), 0.1).alias("dist"))
    return long_distances(p, "vec_id", ids).groupBy("cluster_id").agg(F.round(F.avg("dist"), 6).alias("mean_weight"))


@query("x14_atypicality", f"WITH {VEC_SQL}, p AS (SELECT vec_id, e, c, exp(-d / 0.1) / sum(exp(-d / 0.1)) OVER (PARTITION BY vec_id) AS p FROM dist), x AS (SELECT vec_id, i, any_value(ex) AS ex, sum(p * cx) AS coarse FROM (SELECT vec_id, p, unnest(e) AS ex, unnest(c) AS cx, generate_subscripts(e, 1) AS i FROM p) GROUP BY 1, 2) SELECT vec_id, round(sqrt(sum((ex - coarse) * (ex - coarse))), 5) AS atypicality FROM x GROUP BY 1")
def x14_atypicality(spark, d):
    """Distance of each vector from the mixture of centroids that its routing gives."""
    _, c = centroids(spark, d)
    _, x = cosine_distances(spark, d)
    cent = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in c])
    p = x.select("vec_id", V.softmax(F.col("dist"), 0.1).alias("p")).join(emb(spark, d).select("vec_id", "embedding"), "vec_id")
    coarse = F.aggregate(F.zip_with("p", cent, lambda w, v: F.transform(v, lambda y: y * w)), F.array(*[F.lit(0.0)] * c.shape[1]), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return p.select("vec_id", F.round(V.norm(V.minus(F.col("embedding"), coarse)), 5).alias("atypicality"))


@query("x10_ema", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 0.99 * x + 0.01 * x * x)), 6) AS s FROM embeddings")
def x10_ema(spark, d):
    """Exponential moving average of a target vector toward an online one."""
    e = V.doubles(F.col("embedding"))
    mixed = F.zip_with(e, F.transform(e, lambda x: x * x), lambda t, o: 0.99 * t + 0.01 * o)
    return emb(spark, d).select("vec_id", F.round(V.total(mixed), 6).alias("s"))


@query("m12_target_entropy", "SELECT s AS step, round(ln(10) + (0.5 - ln(10)) * least(s / 50.0, 1), 6) AS target FROM (SELECT unnest(range(0, 61, 10)) AS s)")
def m12_target_entropy(spark, d):
    return spark.createDataFrame([(s, round(M.target_entropy(s, 50, 10, 0.5), 6)) for s in range(0, 61, 10)], "step long, target double")


@query("m13_warmup", "SELECT s AS step, round(CASE WHEN s < 10 THEN (s + 1) / 10.0 ELSE 0.01 + 0.99 * (1 + cos(pi() * least((s - 10) / 90.0, 1))) / 2 END, 6) AS factor FROM (SELECT unnest(range(0, 111, 5)) AS s)")
def m13_warmup(spark, d):
    return spark.createDataFrame([(s, round(M.warmup_factor(s, 10, 100), 6)) for s in range(0, 111, 5)], "step long, factor double")
