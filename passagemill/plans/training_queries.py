"""Queries of splits, steering, negatives, triplets, enrichment, serving and validation.

A pair's question and source vectors are the rows of ``embeddings`` that its
pair and source ids point to; the cluster is the source vector's label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.columns import BuildConfig
from passagemill.functions import vectors as V
from passagemill.operators import enrich, negatives, serve, split, steering, triplets, validate
from passagemill.plans.assign_queries import VEC_SQL, centroids
from passagemill.plans.base import PAIRS_SQL, WS, emb, pairs_ok, query
from passagemill.runtime import settle, table

H = "(('0x' || substring(md5(concat_ws('|', {})), 1, 8))::BIGINT)"
#: Pairs whose ids point into ``embeddings``; sources are all vectors, questions every fifth.
TRAIN_SQL = f"""
{VEC_SQL.strip()},
n AS (SELECT count(*) AS n FROM embeddings),
tp AS (SELECT vec_id AS pair_id, (vec_id // 5 * 5)::BIGINT AS question_id, ((vec_id * 7 + 3) % (SELECT n FROM n))::BIGINT AS source_id FROM embeddings),
t AS (SELECT tp.*, s.label AS cluster_id FROM tp JOIN v s ON s.vec_id = tp.source_id)
"""


def train_pairs(spark, d):
    e = emb(spark, d)
    n = e.count()
    p = e.select(F.col("vec_id").alias("pair_id"), (F.floor(F.col("vec_id") / 5) * 5).cast("long").alias("question_id"), F.pmod(F.col("vec_id") * 7 + 3, F.lit(n)).cast("long").alias("source_id"))
    return p.join(e.select(F.col("vec_id").alias("source_id"), F.col("label").alias("cluster_id")), "source_id")


def _with_vectors(spark, d):
    e = emb(spark, d)
    ids, c = centroids(spark, d)
    cent = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, c, strict=True)], "cluster_id int, c array<double>")
    return train_pairs(spark, d).join(e.select(F.col("vec_id").alias("question_id"), V.doubles(F.col("embedding")).alias("q")), "question_id").join(F.broadcast(cent), "cluster_id")  # ten labels


@query("sp1_simple", f"WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY {H.format("'42', vec_id::VARCHAR")}, vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings) SELECT vec_id, CASE WHEN r < floor(n * 0.2) THEN 'val' WHEN r < floor(n * 0.2) + floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r")
def sp1_simple(spark, d):
    return split.simple_split(emb(spark, d), "vec_id", 0.2, 0.1)


_Q_SQL = "q AS (SELECT question_id, cluster_id FROM (SELECT question_id, cluster_id, row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, cluster_id) AS r FROM pairs WHERE question_id IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"
_STRAT_SQL = f"""
WITH {_Q_SQL}, r AS (SELECT question_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY {H.format("'42', question_id::VARCHAR")}, question_id) - 1 AS rn FROM q),
c AS (SELECT *, greatest(1, floor(n * 0.8)) AS t, least(greatest(1, floor(n * 0.1)), n - greatest(1, floor(n * 0.8))) AS v FROM r),
m AS (SELECT *, n - t - v = 0 AND n >= 3 AS mv FROM c),
f AS (SELECT question_id, cluster_id, rn, CASE WHEN mv AND v <= 1 THEN t - 1 ELSE t END AS t, CASE WHEN mv AND v > 1 THEN v - 1 ELSE v END AS v FROM m),
s AS (SELECT question_id, cluster_id, CASE WHEN rn < t THEN 'train' WHEN rn < t + v THEN 'val' ELSE 'test' END AS split FROM f)
"""


def _stratified(spark, d):
    from passagemill.operators.link import majority

    return split.stratified_split(majority(table(spark, d, "pairs"), "question_id"))


@query("sp2_stratified", _STRAT_SQL + "SELECT question_id, split FROM s")
def sp2_stratified(spark, d):
    """Questions split per cluster."""
    return _stratified(spark, d)


@query("sp3_expanded", _STRAT_SQL + "SELECT split, count(*) AS n FROM pairs JOIN s USING (question_id) GROUP BY 1")
def sp3_expanded(spark, d):
    """Rows of each split after the questions' splits are given to their pairs."""
    return table(spark, d, "pairs").select("question_id").join(_stratified(spark, d), "question_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("sp5_leaks", f"WITH p AS (SELECT question_id, lower(trim(_split_tag, {WS})) AS split FROM pairs WHERE _split_tag IS NOT NULL AND question_id IS NOT NULL) SELECT question_id, count(DISTINCT split) AS n_splits FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1")
def sp5_leaks(spark, d):
    """Questions that occur under several split tags."""
    p = table(spark, d, "pairs").where("_split_tag is not null and question_id is not null")
    return split.leaks(p.select("question_id", F.lower(F.btrim("_split_tag", F.lit(" \t\n\r\f\x0b"))).alias("split")), "question_id")


@query("c1_centroid", f"WITH {TRAIN_SQL} SELECT pair_id, round(1 - least(greatest(list_cosine_similarity(q.e, cent.c), -1), 1), 6) AS distance, round(list_sum(list_transform(list_zip(q.e, cent.c), lambda z: z[2] - z[1])) / list_distance(q.e, cent.c), 5) AS s FROM t JOIN v q ON q.vec_id = t.question_id JOIN cent ON cent.label = t.cluster_id")
def c1_centroid(spark, d):
    """Centroid steering (component sum) and centroid distance of each pair."""
    p = _with_vectors(spark, d)
    return p.select("pair_id", F.round(steering.distance(F.col("q"), F.col("c")), 6).alias("distance"), F.round(V.total(steering.toward(F.col("q"), F.col("c"))), 5).alias("s"))


@query("c2_keyword", f"""
WITH {TRAIN_SQL}, k AS (SELECT pair_id, (pair_id * 3 + j) % (SELECT n FROM n) AS vec_id FROM t, (SELECT unnest([0, 1, 2]) AS j) WHERE pair_id % 5 <> 0),
m AS (SELECT pair_id, i, avg(x) AS m FROM (SELECT pair_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM k JOIN v USING (vec_id)) GROUP BY 1, 2)
SELECT pair_id, round(sum(m) / sqrt(sum(m * m)), 5) AS s FROM m GROUP BY 1
""")  # fmt: skip
def c2_keyword(spark, d):
    """Keyword steering: unit mean of three vectors per pair; every fifth pair has none."""
    p = train_pairs(spark, d).where("pair_id % 5 <> 0")
    n = emb(spark, d).count()
    ids = p.select("pair_id", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: F.pmod(F.col("pair_id") * 3 + j, F.lit(n))).alias("ids"))
    s = steering.keyword_steering(ids, "pair_id", "ids", emb(spark, d), "vec_id")
    return s.select("pair_id", F.round(V.total(F.col("keyword_steering")), 5).alias("s"))


@query("c3_residual", f"WITH {TRAIN_SQL} SELECT pair_id, round(list_sum(list_transform(list_zip(q.e, cent.c), lambda z: z[1] - z[2])), 5) AS s, round(list_distance(q.e, cent.c), 5) AS norm FROM t JOIN v q ON q.vec_id = t.question_id JOIN cent ON cent.label = t.cluster_id")
def c3_residual(spark, d):
    p = _with_vectors(spark, d).select("pair_id", steering.residual(F.col("q"), F.col("c")).alias("r"))
    return p.select("pair_id", F.round(V.total(F.col("r")), 5).alias("s"), F.round(V.norm(F.col("r")), 5).alias("norm"))


@query("c6_variant", f"WITH u AS (SELECT vec_id, {H.format("'42', '3', vec_id::VARCHAR")} / 4294967296.0 AS u FROM embeddings) SELECT CASE WHEN u < 0.25 THEN 'zero' WHEN u < 0.5 THEN 'centroid' WHEN u < 0.75 THEN 'keyword' ELSE 'residual' END AS variant, count(*) AS n FROM u GROUP BY 1")
def c6_variant(spark, d):
    """Steering variants drawn in epoch 3."""
    v = steering.variant(42, 3, F.col("vec_id"), BuildConfig().steering)
    return emb(spark, d).groupBy(v.alias("variant")).agg(F.count(F.lit(1)).alias("n"))


@query("c10_augmented")
def c10_augmented(spark, d):
    """Vectors after seeded noise and zeroing."""
    v = emb(spark, d).select("vec_id", steering.noisy(F.col("embedding"), F.col("vec_id"), 0.05, 0.5, 0.1).alias("e"))
    return v.select("vec_id", F.round(V.norm(F.col("e")), 6).alias("norm"))


@query("v12_steering", f"""
WITH {TRAIN_SQL}, g AS (SELECT list_distance(q.e, cent.c) AS n, 1 - least(greatest(list_cosine_similarity(q.e, cent.c), -1), 1) AS d FROM t JOIN v q ON q.vec_id = t.question_id JOIN cent ON cent.label = t.cluster_id)
SELECT count(*) AS n, count(*) FILTER (WHERE NOT isfinite(n)) AS not_finite, count(*) FILTER (WHERE n <= 1e-8) AS zero, count(*) FILTER (WHERE n > 1e-8 AND abs(n / n - 1) > 1e-4) AS not_unit, count(*) FILTER (WHERE d < 0 OR d > 2) AS out_of_range FROM g
""")  # fmt: skip
def v12_steering(spark, d):
    """Counts of unsound steering vectors and distances."""
    p = _with_vectors(spark, d).select(steering.toward(F.col("q"), F.col("c")).alias("s"), steering.distance(F.col("q"), F.col("c")).alias("d"))
    return steering.checks(p, "s", "d")


@query("n2_adjacent", f"WITH {VEC_SQL}, r AS (SELECT a.label AS cluster_id, b.label AS neighbour, row_number() OVER (PARTITION BY a.label ORDER BY round(1 - list_cosine_similarity(a.c, b.c), 9), b.label) AS rank FROM cent a JOIN cent b ON a.label <> b.label) SELECT * FROM r WHERE rank <= 3")
def n2_adjacent(spark, d):
    ids, c = centroids(spark, d)
    return spark.createDataFrame([(int(a), int(r), int(b)) for a, r, b in negatives.adjacent(ids, c, 3)], "cluster_id int, rank long, neighbour int")


@query("n3_high_similarity", f"""
WITH {TRAIN_SQL}, r AS (SELECT t.pair_id, o.vec_id AS neg_id, row_number() OVER (PARTITION BY t.pair_id ORDER BY round(list_cosine_similarity(q.e, o.e), 9) DESC, o.vec_id) AS rank
  FROM t JOIN v q ON q.vec_id = t.question_id JOIN v o ON o.label <> t.cluster_id AND o.vec_id <> t.source_id)
SELECT * FROM r WHERE rank <= 3
""")  # fmt: skip
def n3_high_similarity(spark, d):
    e = emb(spark, d)
    q = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))
    s = e.select(F.col("vec_id").alias("source_id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vec"))
    return negatives.high_similarity(settle(train_pairs(spark, d)), q, s, 3).select("pair_id", "neg_id", F.col("rank").cast("long").alias("rank"))


_RING_SQL = f"ring AS (SELECT label AS cluster_id, vec_id AS source_id, row_number() OVER (PARTITION BY label ORDER BY {H.format("'42', vec_id::VARCHAR")}, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS m FROM v)"


def _sources(spark, d):
    return emb(spark, d).select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("source_id"))


@query("n4_in_cluster", f"""
WITH {TRAIN_SQL}, {_RING_SQL}, s AS (SELECT DISTINCT cluster_id, m FROM ring),
p AS (SELECT t.pair_id, t.source_id, t.cluster_id, i, ({H.format("'7', 'start', t.pair_id::VARCHAR")} + i) % m AS pos FROM t JOIN s USING (cluster_id), (SELECT unnest(range(0, 4)) AS i) WHERE i < m),
h AS (SELECT p.pair_id, i, ring.source_id AS neg_id FROM p JOIN ring USING (cluster_id, pos) WHERE ring.source_id <> p.source_id),
o AS (SELECT pair_id, neg_id, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS slot FROM h)
SELECT pair_id, slot, neg_id FROM o WHERE slot <= 3
""")  # fmt: skip
def n4_in_cluster(spark, d):
    r = settle(negatives.ring(_sources(spark, d), 42))
    return negatives.in_cluster(train_pairs(spark, d), r, 3, 7).select("pair_id", F.col("slot").cast("long").alias("slot"), "neg_id")


def _mined(spark, d, n_neg=8):
    """All four tiers assembled."""
    q = negatives.quota(n_neg)
    p = settle(train_pairs(spark, d))
    e = emb(spark, d)
    src = settle(_sources(spark, d))
    r = settle(negatives.ring(src, 42))
    t1 = negatives.in_cluster(p, r, q[0], 7)
    ids, c = centroids(spark, d)
    near = spark.createDataFrame([(int(a), int(b)) for a, _, b in negatives.adjacent(ids, c, 3)], "cluster_id int, other int")
    grouped = src.join(F.broadcast(near.select(F.col("other").alias("cluster_id"), F.col("cluster_id").alias("own"))), "cluster_id").select(F.col("own").alias("cluster_id"), "source_id")  # ten labels
    t2 = negatives.in_cluster(p, settle(negatives.ring(grouped, 43)), q[1], 8)
    t3 = negatives.high_similarity(p, e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("source_id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vec")), q[2])
    far = settle(negatives.ring(src, 44))
    t4 = negatives.random_distant(p, far, q[3], 9)
    pad = negatives.random_distant(p, far, n_neg, 10)
    return p, settle(negatives.assemble([t1, t2, t3, t4], pad, n_neg))


def _ring_tier(name: str, ring: str, n: int, seed: int) -> str:
    """A tier that walks a ring, as SQL: candidates ``(pair_id, neg_id, k)``."""
    return f"""{name}s AS (SELECT DISTINCT cluster_id, m FROM {ring}),
{name}p AS (SELECT t.pair_id, t.source_id, t.cluster_id, i, ({H.format(f"'{seed}', 'start', t.pair_id::VARCHAR")} + i) % m AS pos FROM t JOIN {name}s USING (cluster_id), (SELECT unnest(range(0, {n + 1})) AS i) WHERE i < m),
{name} AS (SELECT pair_id, neg_id, k FROM (SELECT p.pair_id, r.source_id AS neg_id, row_number() OVER (PARTITION BY p.pair_id ORDER BY i) AS k FROM {name}p p JOIN {ring} r USING (cluster_id, pos) WHERE r.source_id <> p.source_id) WHERE k <= {n})"""


def _far_tier(name: str, n: int, seed: int) -> str:
    return f"""{name}d AS (SELECT pair_id, source_id AS own, i, lo, m, ({H.format(f"'{seed}', 'far', pair_id::VARCHAR")} + i) % ((SELECT n FROM n) - m) AS u FROM t JOIN span USING (cluster_id), (SELECT unnest(range(0, {n + 1})) AS i)),
{name} AS (SELECT pair_id, neg_id, k FROM (SELECT pair_id, f.source_id AS neg_id, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM {name}d JOIN far f ON f.pos = CASE WHEN u < lo THEN u ELSE u + m END WHERE f.source_id <> own) WHERE k <= {n})"""


_MINED_SQL = f"""
WITH {TRAIN_SQL}, {_RING_SQL},
adj AS (SELECT own, other FROM (SELECT a.label AS own, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY round(1 - list_cosine_similarity(a.c, b.c), 9), b.label) AS r FROM cent a JOIN cent b ON a.label <> b.label) WHERE r <= 3),
beside AS (SELECT own AS cluster_id, vec_id AS source_id, row_number() OVER (PARTITION BY own ORDER BY {H.format("'43', vec_id::VARCHAR")}, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY own) AS m FROM v JOIN adj ON adj.other = v.label),
far AS (SELECT vec_id AS source_id, row_number() OVER (ORDER BY label, {H.format("'44', vec_id::VARCHAR")}, vec_id) - 1 AS pos FROM v),
span AS (SELECT label AS cluster_id, count(*) AS m, (sum(count(*)) OVER (ORDER BY label))::BIGINT - count(*) AS lo FROM v GROUP BY 1),
{_ring_tier("t1", "ring", 2, 7)}, {_ring_tier("t2", "beside", 2, 8)},
t3 AS (SELECT pair_id, neg_id, k FROM (SELECT t.pair_id, o.vec_id AS neg_id, row_number() OVER (PARTITION BY t.pair_id ORDER BY round(list_cosine_similarity(q.e, o.e), 9) DESC, o.vec_id) AS k
  FROM t JOIN v q ON q.vec_id = t.question_id JOIN v o ON o.label <> t.cluster_id AND o.vec_id <> t.source_id) WHERE k <= 2),
{_far_tier("t4", 2, 9)}, {_far_tier("t5", 8, 10)},
every AS (SELECT *, 1 AS tier FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3 UNION ALL SELECT *, 4 FROM t4 UNION ALL SELECT *, 5 FROM t5),
once AS (SELECT pair_id, neg_id, min(tier * 1000 + k) AS o FROM every GROUP BY 1, 2),
mined AS (SELECT * FROM (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY o) AS slot, neg_id, least(o // 1000, 4)::INT AS tier FROM once) WHERE slot <= 8)
"""


@query("n7_assembled", _MINED_SQL + ", c AS (SELECT t.pair_id, count(neg_id) AS n, count(*) FILTER (WHERE neg_id = t.source_id) AS own, count(*) FILTER (WHERE tier NOT BETWEEN 1 AND 4) AS bad FROM t LEFT JOIN mined USING (pair_id) GROUP BY 1) SELECT count(*) AS pairs, count(*) FILTER (WHERE n < 8) AS short, sum(own)::BIGINT AS own_source, sum(bad)::BIGINT AS bad_tier FROM c")
def n7_assembled(spark, d):
    """Violations among the assembled negatives of all pairs."""
    p, n = _mined(spark, d)
    return negatives.violations(n, p, 8)


@query("n7_negatives", _MINED_SQL + "SELECT pair_id, slot, neg_id, tier FROM mined")
def n7_negatives(spark, d):
    """Eight negatives of each pair with their tiers."""
    return _mined(spark, d)[1].withColumn("slot", F.col("slot").cast("long"))


_LINKS_SQL = "l AS (SELECT DISTINCT question_id, source_id FROM pairs WHERE question_id IS NOT NULL AND source_id >= 0)"


def _links(spark, d):
    return table(spark, d, "pairs").where("question_id is not null and source_id >= 0").select("question_id", "source_id").distinct()


_COMBINATIONS_SQL = f"""
WITH {_LINKS_SQL}, s AS (SELECT question_id, count(*) AS n_sources, min(source_id) AS least FROM l GROUP BY 1 HAVING count(*) > 1)
SELECT a.question_id, a.source_id AS a, b.source_id AS b, n_sources, false AS grouped FROM l a JOIN l b ON a.question_id = b.question_id AND a.source_id < b.source_id JOIN s ON s.question_id = a.question_id WHERE n_sources <= {{0}}
UNION ALL
SELECT l.question_id, least, source_id, n_sources, true FROM l JOIN s USING (question_id) WHERE n_sources > {{0}} AND source_id > least
"""


@query("t1_positive", _COMBINATIONS_SQL.format(3))
def t1_positive(spark, d):
    """All pairs of relevant sources of each question; questions with more than three as one group."""
    return triplets.positives(settle(_links(spark, d)), 3)


@query("t2_contrastive", f"""
WITH {_LINKS_SQL}, src AS (SELECT DISTINCT source_id FROM l),
ring AS (SELECT source_id, row_number() OVER (ORDER BY {H.format("'42', source_id::VARCHAR")}, source_id) - 1 AS pos, count(*) OVER () AS m FROM src),
dr AS (SELECT question_id, i, ({H.format("'42', question_id::VARCHAR")} + i) % (SELECT max(m) FROM ring) AS pos FROM (SELECT question_id, unnest(range(0, least(count(*) + 3, (SELECT max(m) FROM ring)))) AS i FROM l GROUP BY question_id)),
h AS (SELECT question_id, i, ring.source_id AS neg_id FROM dr JOIN ring USING (pos)),
f AS (SELECT h.*, row_number() OVER (PARTITION BY question_id ORDER BY i) AS slot FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.question_id = h.question_id AND l.source_id = h.neg_id))
SELECT l.question_id, l.source_id, neg_id FROM l JOIN f USING (question_id) WHERE slot <= 3
""")  # fmt: skip
def t2_contrastive(spark, d):
    """Relevant sources with three negatives drawn per question."""
    l = settle(_links(spark, d))  # noqa: E741
    r = settle(negatives.ring(l.select("source_id").distinct().withColumn("all", F.lit(0)), 42, "all"))
    return triplets.contrastive(l, r, 3)


@query("jn13_not_relevant", f"WITH {_LINKS_SQL} SELECT question_id, count(*) AS n_sources, (SELECT count(DISTINCT source_id) FROM l) - count(*) AS n_not_relevant FROM l GROUP BY 1")
def jn13_not_relevant(spark, d):
    """For every question the number of sources that aren't relevant to it."""
    return triplets.not_relevant(_links(spark, d))


@query("jn14_dedup_apply", f"WITH {PAIRS_SQL} SELECT pair_id, substring(md5(source), 1, 8) AS result FROM pairs_ok")
def jn14_dedup_apply(spark, d):
    """One (stub) model call per distinct source, copied to all of its rows."""
    return enrich.dedup_apply(pairs_ok(spark, d).select("pair_id", "source"), "source", enrich.stub_model, "result").select("pair_id", "result")


@query("l1_fill_missing", f"SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN 'old' ELSE substring(md5(question), 1, 8) END AS domain FROM pairs WHERE trim(question, {WS}) <> '' AND lower(trim(question, {WS})) <> 'nan'")
def l1_fill_missing(spark, d):
    """Only rows without a result are sent to the model."""
    p = pairs_ok_questions(spark, d).withColumn("domain", F.when(F.col("pair_id") % 2 == 0, "old"))
    return enrich.fill_missing(p, "question", "domain", enrich.stub_model).select("pair_id", "domain")


def pairs_ok_questions(spark, d):
    from passagemill.functions.text import is_empty_text

    return table(spark, d, "pairs").where(~is_empty_text(F.col("question"))).select("pair_id", "question")


@query("l5_verdicts", "SELECT pair_id % 5 AS k, CASE pair_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE -1 END AS label, count(*) AS n FROM pairs GROUP BY 1, 2")
def l5_verdicts(spark, d):
    """Replies of a judge as labels."""
    reply = F.element_at(F.array(*[F.lit(x) for x in ("Source 1", " source 2.", "Neither", "Both Insufficient", "perhaps")]), (F.col("pair_id") % 5 + 1).cast("int"))
    return table(spark, d, "pairs").groupBy((F.col("pair_id") % 5).alias("k"), enrich.verdict(reply).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("l6_merge_labels", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(quality, -1) ELSE (doc_id % 3)::INT END AS label FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1)")
def l6_merge_labels(spark, d):
    """New labels win unless they are undecided."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    new = F.when(F.col("doc_id") % 3 == 0, -1).otherwise((F.col("doc_id") % 3).cast("int"))
    return lab.select("doc_id", enrich.merge_labels(F.col("quality"), new).alias("label"))


@query("l18_augmented", f"WITH q AS (SELECT pair_id, question FROM pairs WHERE trim(question, {WS}) <> '' AND lower(trim(question, {WS})) <> 'nan') SELECT count(*) + count(*) FILTER (WHERE {H.format("'42', 'augment', pair_id::VARCHAR")} / 4294967296.0 < 0.5) AS n, count(*) FILTER (WHERE {H.format("'42', 'augment', pair_id::VARCHAR")} / 4294967296.0 < 0.5) AS n_augmented FROM q")
def l18_augmented(spark, d):
    """Rows after a seeded half of them got a changed copy."""
    a = enrich.augment(pairs_ok_questions(spark, d), "pair_id", "question", enrich.stub_model)
    return a.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("augmented").cast("int")).alias("n_augmented"))


@query("l23_generated", f"SELECT pair_id, k - 1 AS k, substring(md5(question), 1, 8) || '-' || k AS generated FROM pairs, (SELECT unnest([1, 2]) AS k) WHERE trim(question, {WS}) <> '' AND lower(trim(question, {WS})) <> 'nan'")
def l23_generated(spark, d):
    """Two generated questions per row."""
    return enrich.generate(pairs_ok_questions(spark, d), "pair_id", "question", enrich.stub_model, 2).select("pair_id", "k", "generated")


@query("e4_embed_distinct", f"SELECT keyword_id, CASE WHEN trim(keyword, {WS}) <> '' AND lower(trim(keyword, {WS})) <> 'nan' THEN 8 END AS dim FROM keywords WHERE keyword IS NOT NULL")
def e4_embed_distinct(spark, d):
    """Vectors of distinct normalised keywords by a (stub) embedder."""
    from passagemill.functions.text import normalize

    k = table(spark, d, "keywords").where("keyword is not null").select("keyword_id", normalize(F.col("keyword")).alias("t"))
    v = enrich.dedup_apply(k, "t", enrich.stub_embedder(8), "v", "array<double>")
    return v.select("keyword_id", F.size("v").alias("dim"))


@query("b1_training_view", f"""
WITH {TRAIN_SQL}, u AS (SELECT t.*, {H.format("'42', '0', t.pair_id::VARCHAR")} / 4294967296.0 AS u FROM t)
SELECT pair_id, cluster_id, CASE WHEN u < 0.5 THEN 'zero' WHEN u < 0.5 + 0.5 / 3 THEN 'centroid' WHEN u < 0.5 + 1.0 / 3 THEN 'keyword' ELSE 'residual' END AS variant, round(list_cosine_similarity(q.e, s.e), 6) AS sim FROM u JOIN v q ON q.vec_id = u.question_id JOIN v s ON s.vec_id = u.source_id
""")  # fmt: skip
def b1_training_view(spark, d):
    """Each pair's vectors joined, with the steering variant of epoch 0 under the curriculum."""
    e = emb(spark, d)
    shares = steering.curriculum(0, BuildConfig().steering)
    p = train_pairs(spark, d).join(e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q")), "question_id").join(e.select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("s")), "source_id")
    return p.select("pair_id", "cluster_id", steering.variant(42, 0, F.col("pair_id"), shares).alias("variant"), F.round(V.cosine(F.col("q"), F.col("s")), 6).alias("sim"))


@query("b4_batches", f"WITH r AS (SELECT pair_id, row_number() OVER (ORDER BY {H.format("'42', '1', pair_id::VARCHAR")}, pair_id) - 1 AS r, count(*) OVER () AS n FROM pairs) SELECT pair_id, (r // 32)::BIGINT AS batch, (r % 32)::BIGINT AS slot FROM r WHERE r // 32 < n // 32")
def b4_batches(spark, d):
    """Shuffled batches of 32 in epoch 1, the last partial one dropped."""
    return serve.batches(table(spark, d, "pairs").select("pair_id"), "pair_id", 32, 1).select("pair_id", F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"))


@query("v4_orphan_clusters", "SELECT cluster_id, count(*) AS n FROM keywords WHERE cluster_id IS NOT NULL AND cluster_id NOT IN (SELECT cluster_id FROM clusters) GROUP BY 1")
def v4_orphan_clusters(spark, d):
    return validate.orphans(table(spark, d, "keywords"), "cluster_id", table(spark, d, "clusters"))


@query("v4_orphan_entities", "SELECT entity_id, count(*) AS n FROM entity_embs WHERE entity_kind = 'source' AND entity_id IS NOT NULL AND entity_id NOT IN (SELECT source_id FROM pairs WHERE source_id IS NOT NULL) GROUP BY 1")
def v4_orphan_entities(spark, d):
    """Source vectors that point to no pair."""
    return validate.orphans(table(spark, d, "entity_embs").where("entity_kind = 'source'"), "entity_id", table(spark, d, "pairs").where("source_id is not null"), "source_id")


@query("v10_score_range", "SELECT count(*) AS n, count(*) FILTER (WHERE relevance_score IS NULL) AS nulls, count(*) FILTER (WHERE isnan(relevance_score)) AS nans, count(*) FILTER (WHERE NOT isnan(relevance_score) AND (relevance_score < 0 OR relevance_score > 1)) AS outside FROM pairs")
def v10_score_range(spark, d):
    return validate.value_range(table(spark, d, "pairs"), "relevance_score", 0.0, 1.0)


@query("v6_unique_ids", "SELECT count(*) AS n, count(DISTINCT pair_id) AS n_distinct FROM pairs")
def v6_unique_ids(spark, d):
    return validate.unique(table(spark, d, "pairs"), "pair_id")


@query("v15_summary", "SELECT 'question' AS what, count(*) FILTER (WHERE question IS NULL) AS nulls, count(DISTINCT question_id) AS ids FROM pairs UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL), count(DISTINCT source_id) FROM pairs")
def v15_summary(spark, d):
    """NULL texts and distinct ids in one pass."""
    one = table(spark, d, "pairs").agg(F.sum(F.col("question").isNull().cast("int")).alias("a"), F.countDistinct("question_id").alias("b"), F.sum(F.col("source").isNull().cast("int")).alias("c"), F.countDistinct("source_id").alias("e"))
    return one.select(F.explode(F.array(F.struct(F.lit("question").alias("what"), F.col("a").alias("nulls"), F.col("b").alias("ids")), F.struct(F.lit("source").alias("what"), F.col("c").alias("nulls"), F.col("e").alias("ids")))).alias("x")).select("x.*")


@query("w52_variant_shares", f"WITH e AS (SELECT vec_id, ep FROM embeddings, (SELECT unnest([0, 50, 100]) AS ep)), u AS (SELECT ep, {H.format("'42', ep::VARCHAR, vec_id::VARCHAR")} / 4294967296.0 AS u FROM e) SELECT ep::INT AS epoch, count(*) FILTER (WHERE u < CASE ep WHEN 0 THEN 0.5 WHEN 50 THEN 0.3 ELSE 0.1 END) AS zeros FROM u GROUP BY 1")
def w52_variant_shares(spark, d):
    """Zero variants drawn at three epochs of the curriculum."""
    out = None
    for ep in (0, 50, 100):
        v = steering.variant(42, ep, F.col("vec_id"), steering.curriculum(ep, BuildConfig().steering))
        one = emb(spark, d).agg(F.lit(ep).alias("epoch"), F.sum((v == "zero").cast("int")).alias("zeros"))
        out = one if out is None else out.unionByName(one)
    return out


@query("n5_adjacent_sample", f"""
WITH {TRAIN_SQL}, adj AS (SELECT own, other FROM (SELECT a.label AS own, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY round(1 - list_cosine_similarity(a.c, b.c), 9), b.label) AS r FROM cent a JOIN cent b ON a.label <> b.label) WHERE r <= 3),
ring AS (SELECT own AS cluster_id, vec_id AS source_id, row_number() OVER (PARTITION BY own ORDER BY {H.format("'43', vec_id::VARCHAR")}, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY own) AS m FROM v JOIN adj ON adj.other = v.label),
s AS (SELECT DISTINCT cluster_id, m FROM ring),
p AS (SELECT t.pair_id, t.source_id, t.cluster_id, i, ({H.format("'8', 'start', t.pair_id::VARCHAR")} + i) % m AS pos FROM t JOIN s USING (cluster_id), (SELECT unnest(range(0, 3)) AS i) WHERE i < m),
o AS (SELECT p.pair_id, ring.source_id AS neg_id, row_number() OVER (PARTITION BY p.pair_id ORDER BY i) AS slot FROM p JOIN ring USING (cluster_id, pos) WHERE ring.source_id <> p.source_id)
SELECT pair_id, slot, neg_id FROM o WHERE slot <= 2
""")  # fmt: skip
def n5_adjacent_sample(spark, d):
    """Two negatives per pair from the three clusters next to its own."""
    ids, c = centroids(spark, d)
    near = spark.createDataFrame([(int(a), int(b)) for a, _, b in negatives.adjacent(ids, c, 3)], "cluster_id int, other int")
    grouped = _sources(spark, d).join(F.broadcast(near.select(F.col("other").alias("cluster_id"), F.col("cluster_id").alias("own"))), "cluster_id").select(F.col("own").alias("cluster_id"), "source_id")  # ten labels
    r = settle(negatives.ring(grouped, 43))
    return negatives.in_cluster(train_pairs(spark, d), r, 2, 8).select("pair_id", F.col("slot").cast("long").alias("slot"), "neg_id")


@query("n6_random_distant", f"""
WITH {TRAIN_SQL}, ring AS (SELECT vec_id AS source_id, row_number() OVER (ORDER BY label, {H.format("'44', vec_id::VARCHAR")}, vec_id) - 1 AS pos FROM v),
span AS (SELECT label AS cluster_id, count(*) AS m, (sum(count(*)) OVER (ORDER BY label))::BIGINT - count(*) AS lo FROM v GROUP BY 1),
dr AS (SELECT pair_id, source_id AS own, i, lo, m, ({H.format("'9', 'far', pair_id::VARCHAR")} + i) % ((SELECT n FROM n) - m) AS u FROM t JOIN span USING (cluster_id), (SELECT unnest(range(0, 3)) AS i)),
o AS (SELECT pair_id, ring.source_id AS neg_id, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS slot FROM dr JOIN ring ON pos = CASE WHEN u < lo THEN u ELSE u + m END WHERE ring.source_id <> own)
SELECT pair_id, slot, neg_id FROM o WHERE slot <= 2
""")  # fmt: skip
def n6_random_distant(spark, d):
    """Two seeded draws per pair from other clusters."""
    src = settle(_sources(spark, d))
    return negatives.random_distant(train_pairs(spark, d), settle(negatives.ring(src, 44)), 2, 9).select("pair_id", F.col("slot").cast("long").alias("slot"), "neg_id")


@query("n8_quota", "SELECT * FROM (VALUES (8, 1, 2), (8, 2, 2), (8, 3, 2), (8, 4, 2), (10, 1, 3), (10, 2, 3), (10, 3, 2), (10, 4, 2)) AS q(n_neg, tier, n)")
def n8_quota(spark, d):
    """Negatives per tier for two sizes."""
    return spark.createDataFrame([(n, t + 1, q) for n in (8, 10) for t, q in enumerate(negatives.quota(n))], "n_neg int, tier int, n int")


@query("t3_similar", f"""
WITH {TRAIN_SQL}, r AS (SELECT t.question_id, o.vec_id AS near_id, row_number() OVER (PARTITION BY t.question_id ORDER BY round(list_cosine_similarity(q.e, o.e), 9) DESC, o.vec_id) AS r, round(list_cosine_similarity(q.e, o.e), 9) AS s
  FROM (SELECT DISTINCT question_id FROM t) t JOIN v q ON q.vec_id = t.question_id JOIN v o ON o.vec_id <> q.vec_id),
k AS (SELECT question_id, near_id FROM r WHERE r <= 3 AND s > 0.2)
SELECT t.question_id, t.source_id, k.near_id FROM t JOIN k USING (question_id) WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.question_id = k.question_id AND x.source_id = k.near_id)
""")  # fmt: skip
def t3_similar(spark, d):
    """Relevant sources against the similar ones that aren't relevant."""
    from passagemill.operators.knn import block_topk

    e = settle(emb(spark, d).select("vec_id", F.col("embedding").alias("vec")))
    t = settle(train_pairs(spark, d).select("question_id", "source_id"))
    q = t.select("question_id").distinct().join(e.withColumnRenamed("vec_id", "question_id"), "question_id").select(F.col("question_id").alias("key"), F.col("question_id").alias("tag"), "vec")
    near = block_topk(q, e.select(F.col("vec_id").alias("oid"), F.col("vec_id").alias("otag"), "vec"), 3, exclude_same_tag=True).where("sim > 0.2").select(F.col("key").alias("question_id"), F.col("oid").alias("near_id"))
    fresh = near.join(t.select("question_id", F.col("source_id").alias("near_id")), ["question_id", "near_id"], "left_anti")
    return t.join(fresh, "question_id").select("question_id", "source_id", "near_id")


@query("t4_relevant_pairs", f"WITH {PAIRS_SQL} SELECT question_id, source_id, count(*) AS n FROM pairs_ok WHERE source_id >= 0 GROUP BY 1, 2")
def t4_relevant_pairs(spark, d):
    """Question-source pairs by relevance, blank texts left out."""
    return pairs_ok(spark, d).where("source_id >= 0").groupBy("question_id", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn12_combinations", _COMBINATIONS_SQL.format(triplets.EXPANDED))
def jn12_combinations(spark, d):
    """All combinations of two among the relevant sources of a question, however many it has."""
    return triplets.positives(settle(_links(spark, d)))


@query("lb6_priority", "SELECT pair_id, CASE WHEN keywords IS NOT NULL AND trim(keywords) <> '' THEN 'suggestions' WHEN relevance_score IS NOT NULL AND NOT isnan(relevance_score) THEN 'stored' ELSE 'embedding' END AS label_source FROM pairs")
def lb6_priority(spark, d):
    """Which of the three sources gives a row its label: the first that has a value."""
    p = table(spark, d, "pairs")
    has = F.when(F.col("keywords").isNotNull() & (F.trim("keywords") != ""), "suggestions")
    score = F.when(F.col("relevance_score").isNotNull() & ~F.isnan("relevance_score"), "stored")
    return p.select("pair_id", F.coalesce(has, score, F.lit("embedding")).alias("label_source"))


@query("j9_relevance_map", "SELECT doc_id, CASE WHEN quality = toxic THEN '{\"q' || quality || '\":\"second\"}' ELSE '{\"q' || quality || '\":\"first\",\"q' || toxic || '\":\"second\"}' END AS json FROM (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1)")
def j9_relevance_map(spark, d):
    """Parallel lists as a JSON object in which a repeated key keeps its last value."""
    from passagemill.functions.jsoncols import last_wins

    lab = table(spark, d, "labels").where("quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("a"), F.min("toxic").alias("b"))
    keys = lab.select("doc_id", F.array(F.concat(F.lit("q"), F.col("a").cast("string")), F.concat(F.lit("q"), F.col("b").cast("string"))).alias("keys"), F.array(F.lit("first"), F.lit("second")).alias("vals"))
    return keys.select("doc_id", last_wins(F.col("keys"), F.col("vals")).alias("json"))


@query("sk11_update", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 9 END, quality) AS quality FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1)")
def sk11_update(spark, d):
    """A partial update: new values where they are given, old ones elsewhere."""
    from passagemill.sources.store import updated

    old = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    new = old.where("doc_id % 2 = 0").select("doc_id", F.lit(9).alias("quality"))
    return updated(old, new, "doc_id")
