"""Queries of enrichment with structured replies, embedding, labels, building, and documents on disk.

Models are stubs whose replies are digits of a prompt's hash, so SQL can tell
what they say.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from passagemill.columns import BuildConfig
from passagemill.functions import vectors as V
from passagemill.functions.text import is_empty_text
from passagemill.operators import agents, assign, build, embed, enrich, labels, link, serve
from passagemill.plans.assign_queries import VEC_SQL, centroids
from passagemill.plans.base import MATCH_SQL, PAIRS_SQL, VOCAB_SQL, WS, emb, pairs_ok, query, vocab
from passagemill.runtime import settle, shared_dir, table
from passagemill.sources import formats

_TEXT = f"{{0}} IS NOT NULL AND trim({{0}}, {WS}) <> '' AND lower(trim({{0}}, {WS})) <> 'nan'"
Q_OK, S_OK = _TEXT.format("question"), _TEXT.format("source")


def _digest(t: str) -> str:
    return hashlib.md5(t.encode()).hexdigest()


def scorer():
    """Six scores and a domain from a prompt's hash, inside a code fence as models like to write them."""

    def reply(t):
        h = _digest(t)
        e = {"inferred_domain": h[:4]} | {d: {"score": int(h[i], 16) % 11, "reasoning": "because"} for i, d in enumerate(agents.DIMENSIONS)}
        return f"```json\n{json.dumps(e)}\n```"

    return lambda texts: [reply(t) for t in texts]


def suggester():
    """One term for each prompt, and a wrong count."""
    return lambda texts: [json.dumps({"suggestions": [{"term": _digest(t)[:4], "type": "keyword", "confidence": 0.5}], "total_suggestions": 9}) for t in texts]


def topic_scorer():
    """A probability for every descriptor that the prompt lists in its last line."""
    return lambda texts: [json.dumps({"topic_scores": [{"topic_descriptor": x, "probability": round(len(x) / 100, 2)} for x in json.loads(t.split("\n")[-1])], "total_topics": 0}) for t in texts]


def verifier():
    return lambda texts: ["Equivalent." if _digest(t)[0] < "8" else "different" for t in texts]


def asker():
    return lambda texts: [json.dumps({"questions": [_digest(t)[:6], " ", _digest(t)[6:12]]}) for t in texts]


def judge():
    return lambda texts: [("source 1", "Source 2.", "neither", "unsure")[int(_digest(t)[0], 16) % 4] for t in texts]


def _texts(spark, d):
    return table(spark, d, "pairs").select("pair_id", "question", "source")


def _sql_prompt(task: str, *fields: str) -> str:
    return f"md5('task: {task}'" + "".join(f" || chr(10) || {f}" for f in fields) + ")"


_EVAL = _sql_prompt("evaluate", "question", "source")
_HEX = "(('0x' || substring(h, {0}, 1))::INT % 11)"


@query("l2_evaluate", f"""
WITH e AS (SELECT pair_id, {Q_OK} AND {S_OK} AS ok, {_EVAL} AS h FROM pairs)
SELECT pair_id, CASE WHEN ok THEN substring(h, 1, 4) END AS inferred_domain, {", ".join(f"CASE WHEN ok THEN {_HEX.format(i + 1)} END AS {x}_score" for i, x in enumerate(agents.DIMENSIONS))}, CASE WHEN ok THEN NULL ELSE 'empty question or source' END AS evaluation_error FROM e
""")  # fmt: skip
def l2_evaluate(spark, d):
    """Six scores of every pair, and the error of those that can't be scored."""
    return agents.evaluate(_texts(spark, d), "question", "source", scorer).drop("question", "source")


@query("l4_unsound", f"WITH e AS (SELECT pair_id, {Q_OK} AND {S_OK} AS ok FROM pairs) SELECT coalesce(CASE WHEN NOT ok THEN 'empty question or source' END, 'no valid evaluation') AS evaluation_error, count(*) AS n FROM e GROUP BY 1")
def l4_unsound(spark, d):
    """Replies whose scores are out of range give errors, not scores."""
    bad = lambda: lambda texts: [json.dumps({"inferred_domain": "x"} | {x: {"score": 11} for x in agents.DIMENSIONS}) for _ in texts]
    return agents.evaluate(_texts(spark, d), "question", "source", bad).groupBy("evaluation_error").agg(F.count(F.lit(1)).alias("n"))


@query("s4_summary", f"WITH e AS (SELECT pair_id, {_EVAL} AS h FROM pairs WHERE {Q_OK} AND {S_OK}) SELECT pair_id, " + " || chr(10) || ".join(f"'- {t}: ' || {_HEX.format(i + 1)} || '/10'" for i, t in enumerate(agents.TITLES)) + " AS summary FROM e")
def s4_summary(spark, d):
    e = agents.evaluate(_texts(spark, d), "question", "source", scorer).where("evaluation_error is null")
    return e.select("pair_id", agents.score_summary([F.col(f"{x}_score") for x in agents.DIMENSIONS]).alias("summary"))


@query("l8_extract", f"SELECT pair_id, CASE WHEN {S_OK} THEN substring({_sql_prompt('extract', 'source')}, 1, 4) END AS term, CASE WHEN {S_OK} THEN 1 END AS extract_count, CASE WHEN {S_OK} THEN NULL ELSE 'empty text' END AS extract_error FROM pairs")
def l8_extract(spark, d):
    """Suggested terms of every passage; counts that a reply states wrongly are set right."""
    a = agents.analyze(table(spark, d, "pairs").select("pair_id", "source"), "extract", "source", suggester)
    return a.select("pair_id", F.get_json_object("extract_items", "$[0].term").alias("term"), "extract_count", "extract_error")


@query("l12_topics", f"SELECT pair_id, CASE WHEN {Q_OK} THEN 2 END AS n, CASE WHEN {Q_OK} THEN 0.05 END AS alpha, CASE WHEN {Q_OK} THEN 0.04 END AS beta FROM pairs")
def l12_topics(spark, d):
    """Probabilities of two descriptors for every question."""
    p = table(spark, d, "pairs").select("pair_id", "question").withColumn("topics", F.lit('["alpha", "beta"]'))
    a = agents.analyze(p, "topic_relevance_prob", "question", topic_scorer, terms="topics", prefix="t").withColumn("m", agents.topic_map(F.col("t_items")))
    return a.select("pair_id", F.col("t_count").alias("n"), F.col("m")["alpha"].alias("alpha"), F.col("m")["beta"].alias("beta"))


_NEW = f"substring({_sql_prompt('rephrase', 'question')}, 1, 8)"


@query("l15_rephrase", f"WITH r AS (SELECT pair_id, question, CASE WHEN {Q_OK} THEN {_NEW} END AS new FROM pairs) SELECT pair_id, CASE WHEN substring({_sql_prompt('same meaning?', 'question', 'new')}, 1, 1) < '8' THEN new END AS rephrased FROM r")
def l15_rephrase(spark, d):
    """New wordings of the questions that a verifier calls equivalent."""
    return agents.rephrase(_texts(spark, d), "question", enrich.stub_model, verify=verifier).select("pair_id", "rephrased")


@query("l19_rephrase_with_source", f"SELECT pair_id, CASE WHEN {Q_OK} AND {S_OK} THEN substring({_sql_prompt('rephrase', 'question', 'source')}, 1, 8) END AS rephrased FROM pairs")
def l19_rephrase_with_source(spark, d):
    """Questions reworded to fit their passages."""
    return agents.rephrase(_texts(spark, d), "question", enrich.stub_model, context="source").select("pair_id", "rephrased")


@query("l16_sentence", f"SELECT pair_id, {S_OK} AS changed FROM pairs")
def l16_sentence(spark, d):
    """Passages of which one sentence is reworded: all that hold text are."""
    r = agents.rephrase_sentence(_texts(spark, d), "pair_id", "source", enrich.stub_model)
    return r.select("pair_id", (F.col("rephrased").isNotNull() & ~is_empty_text(F.col("source"))).alias("changed"))


@query("l21_generate", f"WITH g AS (SELECT pair_id, {_sql_prompt('generate 2 questions', 'source')} AS h FROM pairs WHERE {S_OK}) SELECT pair_id, 0 AS k, substring(h, 1, 6) AS question_text FROM g UNION ALL SELECT pair_id, 1, substring(h, 7, 6) FROM g")
def l21_generate(spark, d):
    """Two questions for every passage; blank ones in a reply don't count."""
    return agents.generate_questions(table(spark, d, "pairs").select("pair_id", "source"), "pair_id", "source", asker, 2).select("pair_id", "k", "question_text")


_ANALYSIS = f"substring({_sql_prompt('compare', 'question', 'source', 'answer')}, 1, 8)"


@query("l7_labels", f"""
WITH a AS (SELECT pair_id, CASE WHEN {Q_OK} AND {S_OK} AND {_TEXT.format('answer')} THEN {_ANALYSIS} END AS x FROM pairs)
SELECT pair_id, CASE WHEN x IS NULL THEN -1 ELSE CASE ('0x' || substring({_sql_prompt('verdict', 'x')}, 1, 1))::INT % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE -1 END END AS label FROM a
""")  # fmt: skip
def l7_labels(spark, d):
    """Two calls for each row: an analysis of both texts, a verdict on it."""
    p = table(spark, d, "pairs").select("pair_id", "question", "source", "answer")
    two = lambda: lambda texts: [judge()([t])[0] if t.startswith("task: verdict") else _digest(t)[:8] for t in texts]
    return agents.label_pairs(p, "question", "source", "answer", two).select("pair_id", "label")


_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])"


@query("e7_entities", f"SELECT question_id, 16 AS dim FROM (SELECT DISTINCT question_id, question FROM pairs WHERE {Q_OK})")
def e7_entities(spark, d):
    """Sound vectors of all questions."""
    q = table(spark, d, "pairs").select("question_id", "question").distinct()
    return embed.entity_vectors(q, "question_id", "question", enrich.stub_embedder(16)).select("question_id", F.size("embedding").alias("dim"))


@query("e8_keyword_vectors", f"SELECT keyword_id FROM keywords WHERE keyword IS NOT NULL AND {_USABLE}")
def e8_keyword_vectors(spark, d):
    """Keyword vectors that the vocabulary has already; no model is asked."""
    k = assign.usable(table(spark, d, "keywords").where("keyword is not null"), "embedding")
    got = embed.keyword_vectors(k.select(F.col("keyword_id").cast("string").alias("keyword"), "embedding"), None, enrich.stub_model)
    return got.select(F.col("keyword").cast("long").alias("keyword_id"))


_ENTITY_SQL = f"ents AS (SELECT entity_kind, entity_id, arg_min(embedding::DOUBLE[], vec_id) AS e FROM entity_embs WHERE {_USABLE} GROUP BY 1, 2)"


def entities(spark, d, kind: str, name: str):
    """``(name, embedding)``: one usable vector of each entity, that of the smallest id."""
    e = assign.usable(table(spark, d, "entity_embs").where(F.col("entity_kind") == kind), "embedding")
    return e.groupBy(F.col("entity_id").alias(name)).agg(F.min_by("embedding", "vec_id").alias("embedding"))


@query("c5_all_steering", f"""
WITH {MATCH_SQL}, {_ENTITY_SQL}, kids AS (SELECT pair_id, keyword_id FROM matched WHERE keyword_id IS NOT NULL GROUP BY 1, 2),
kv AS (SELECT keyword_id, embedding::DOUBLE[] AS e FROM keywords WHERE {_USABLE}),
kc AS (SELECT pair_id, i, avg(x) AS m FROM (SELECT pair_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM kids JOIN kv USING (keyword_id)) GROUP BY 1, 2),
kw AS (SELECT pair_id, sum(m) / sqrt(sum(m * m)) AS s FROM kc GROUP BY 1 HAVING sqrt(sum(m * m)) > 1e-8),
p AS (SELECT pair_id, question_id, cluster_id FROM pairs_ok WHERE cluster_id IS NOT NULL),
j AS (SELECT pair_id, q.e AS q, c.e AS c FROM p JOIN ents q ON q.entity_kind = 'question' AND q.entity_id = question_id JOIN ents c ON c.entity_kind = 'centroid' AND c.entity_id = cluster_id),
t AS (SELECT pair_id, 1 - least(greatest(list_cosine_similarity(q, c), -1), 1) AS distance, list_distance(q, c) AS norm, list_sum(list_transform(list_zip(q, c), lambda z: z[2] - z[1])) / list_distance(q, c) AS toward FROM j)
SELECT pair_id, round(distance, 5) AS distance, round(norm, 4) AS residual_norm, round(toward, 4) AS centroid_sum, round(coalesce(s, toward), 4) AS keyword_sum FROM t LEFT JOIN kw USING (pair_id)
""")  # fmt: skip
def c5_all_steering(spark, d):
    """All steering of the pairs whose question and cluster have usable vectors."""
    p = pairs_ok(spark, d)
    ids = link.keyword_ids(p, vocab(spark, d))
    rows = settle(p.where("cluster_id is not null").select("pair_id", "question_id", "cluster_id").join(ids, "pair_id"))
    k = assign.usable(table(spark, d, "keywords"), "embedding").select("keyword_id", "embedding")
    s = embed.all_steering(rows, entities(spark, d, "question", "question_id"), entities(spark, d, "centroid", "cluster_id"), k, 64)
    return s.select("pair_id", F.round("distance", 5).alias("distance"), F.round(V.norm(F.col("residual")), 4).alias("residual_norm"), F.round(V.total(F.col("centroid")), 4).alias("centroid_sum"), F.round(V.total(F.col("keyword_weighted")), 4).alias("keyword_sum"))


@query("c8_descriptors", f"""
WITH names AS (SELECT cluster_id, trim(lower(unnest(descriptors)), {WS}) AS key FROM clusters),
kv AS (SELECT trim(lower(keyword), {WS}) AS key, min(embedding::DOUBLE[]) AS e FROM keywords WHERE keyword IS NOT NULL AND {_USABLE} GROUP BY 1),
m AS (SELECT cluster_id, i, avg(x) AS m FROM (SELECT cluster_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM names JOIN kv USING (key)) GROUP BY 1, 2)
SELECT keyword_id, round(coalesce((SELECT sum(m * m) FROM m WHERE m.cluster_id = k.cluster_id), 0), 4) AS energy FROM keywords k
""")  # fmt: skip
def c8_descriptors(spark, d):
    """Energy of the mean descriptor vector of each keyword's cluster, 0 without any."""
    k = table(spark, d, "keywords").select("keyword_id", "cluster_id")
    v = assign.usable(table(spark, d, "keywords"), "embedding").select("keyword", "embedding")
    s = embed.descriptor_steering(k, "keyword_id", table(spark, d, "clusters"), v, 64)
    return s.select("keyword_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("energy"))


@query("c9_text_steering", f"SELECT pair_id, {_TEXT.format('answer')} AS has_text FROM pairs")
def c9_text_steering(spark, d):
    """Vectors of the answers, zero where there is none."""
    p = table(spark, d, "pairs").select("pair_id", F.col("answer").alias("text"))
    s = embed.text_steering(p.select("pair_id"), "pair_id", p, enrich.stub_embedder(8), 8)
    return s.select("pair_id", F.exists("embedding", lambda x: x != 0).alias("has_text"))


_LABEL_SQL = f"""
kv AS (SELECT trim(lower(keyword), {WS}) AS key, min(embedding::DOUBLE[]) AS e FROM keywords WHERE keyword IS NOT NULL AND {_USABLE} GROUP BY 1),
kd AS (SELECT key, label, 1 - list_cosine_similarity(kv.e, c) AS dist FROM kv, cent),
ms AS (SELECT pair_id, label, avg(dist) AS dist FROM (SELECT DISTINCT pair_id, pos, key FROM matched) JOIN kd USING (key) GROUP BY 1, 2),
ls AS (SELECT pair_id, label, exp(-dist) / sum(exp(-dist)) OVER (PARTITION BY pair_id) AS p FROM ms)
"""


@query("lb1_suggested", f"WITH {VEC_SQL.strip()}, {MATCH_SQL.strip()}, {_LABEL_SQL.strip()} SELECT pair_id, round(coalesce(max(p), 0.1), 5) AS top FROM pairs_ok LEFT JOIN ls USING (pair_id) GROUP BY 1")
def lb1_suggested(spark, d):
    """Largest share in the label of each pair's keywords; uniform where none is known."""
    ids, c = centroids(spark, d)
    k = assign.usable(table(spark, d, "keywords"), "embedding").select("keyword", "embedding")
    l = labels.suggestion_label(pairs_ok(spark, d).select("pair_id", "keywords"), "pair_id", "keywords", k, ids, c, labels.normalizer("softmax"))  # noqa: E741
    return l.select("pair_id", F.round(F.array_max("label"), 5).alias("top"))


@query("lb4_steering", f"WITH {VEC_SQL.strip()}, s AS (SELECT vec_id, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p FROM dist) SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.1 ELSE round(max(p), 5) END AS top FROM s GROUP BY 1")
def lb4_steering(spark, d):
    """Labels of steering vectors, of which every seventh is zero."""
    ids, c = centroids(spark, d)
    s = emb(spark, d).select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("v"))
    return labels.vector_label(s, "vec_id", "v", ids, c, labels.normalizer("softmax")).select("vec_id", F.round(F.array_max("label"), 5).alias("top"))


@query("k7_assigned", f"WITH {VEC_SQL.strip()}, s AS (SELECT vec_id, cluster_id, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p FROM dist) SELECT vec_id, arg_max(cluster_id, (round(p, 12), -cluster_id)) AS primary_cluster, greatest(1, count(*) FILTER (WHERE p >= 0.1)) AS n FROM s GROUP BY 1")
def k7_assigned(spark, d):
    """Assignment records under the default settings."""
    ids, c = centroids(spark, d)
    a = labels.assign_records(emb(spark, d), "vec_id", "embedding", ids, c)
    return a.select("vec_id", "primary_cluster", F.size("assigned_clusters").cast("long").alias("n"))


@query("k14_annotated", "SELECT count(*) AS n, count(question) AS annotated FROM pairs")
def k14_annotated(spark, d):
    """Questions annotated with their distances to all descriptors."""
    c = table(spark, d, "clusters").where("descriptors is not null")
    a = labels.annotate_distances(table(spark, d, "pairs").select("pair_id", "question"), "question", c, enrich.stub_embedder(64), "scores")
    return a.agg(F.count(F.lit(1)).alias("n"), F.count("scores").alias("annotated"))


@query("k15_cache", f"SELECT count(DISTINCT question) AS texts, count(DISTINCT question) FILTER (WHERE length(question) > 60) AS known FROM pairs WHERE {Q_OK}")
def k15_cache(spark, d):
    """Texts with vectors, and how many came from the memo."""
    q = table(spark, d, "pairs").where(~is_empty_text(F.col("question"))).select("question").distinct()
    memo = q.where(F.length("question") > 60).select("question", F.array(F.lit(-9.0)).alias("embedding"))
    got, _ = labels.cached_vectors(q, "question", memo, enrich.stub_embedder(8))
    return got.agg(F.count(F.lit(1)).alias("texts"), F.sum((F.size("embedding") == 1).cast("int")).alias("known"))


@query("a20_n_clusters", "SELECT max(label) + 1 AS n FROM embeddings")
def a20_n_clusters(spark, d):
    return spark.createDataFrame([(labels.n_clusters(emb(spark, d), hard="label"),)], "n int")


@query("sp4_split_check", "SELECT 0::BIGINT AS in_several, (SELECT count(*) FROM pairs WHERE question_id IS NULL OR question_id NOT IN (SELECT question_id FROM pairs WHERE cluster_id IS NOT NULL AND question_id IS NOT NULL)) AS in_none, 0::BIGINT AS unknown, 0::BIGINT AS empty")
def sp4_split_check(spark, d):
    """Faults of the stratified split of all pairs; questions without a cluster have no split."""
    p = table(spark, d, "pairs").select("pair_id", "question_id", "cluster_id")
    s = settle(build.stratified(p, BuildConfig()))
    return spark.createDataFrame([build.split_problems(s, p, BuildConfig().ratios)], "in_several long, in_none long, unknown long, empty long")


@query("sp8_splits", "WITH n AS (SELECT count(*) AS n FROM pairs) SELECT 'val' AS split, floor(n * 0.2)::BIGINT AS n FROM n UNION ALL SELECT 'train', n - floor(n * 0.2)::BIGINT FROM n")
def sp8_splits(spark, d):
    """Rows of the splits of the one-call form."""
    out = None
    for name, part in build.splits_of(table(spark, d, "pairs"), "pair_id").items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("split"), "n").where("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query("w_build", f"""
WITH {PAIRS_SQL}, {VOCAB_SQL}, c AS (SELECT DISTINCT cluster_id FROM keywords WHERE cluster_id IS NOT NULL AND keyword IS NOT NULL AND {_USABLE})
SELECT (SELECT count(*) FROM (SELECT DISTINCT question, source FROM pairs_ok)) AS n_pairs, (SELECT count(DISTINCT question) FROM pairs_ok) AS n_questions, (SELECT count(DISTINCT source) FROM pairs_ok) AS n_sources, (SELECT count(*) FROM c) AS n_clusters, 64 AS embedding_dim
""")  # fmt: skip
def w_build(spark, d):
    """A dataset built from the whole pair table, checked and finished; clusters are those of the vocabulary."""
    p = pairs_ok(spark, d).select("pair_id", "question", "source", "answer", F.col("keywords"), F.col("score").alias("relevance_score"))
    k = assign.usable(table(spark, d, "keywords").where("cluster_id is not null and keyword is not null"), "embedding")
    c = V.mean_vectors(k, ["cluster_id"], "embedding", "centroid").withColumn("descriptors", F.array().cast("array<string>"))
    folder = f"{shared_dir(spark)}/build-{uuid.uuid4().hex}"
    report = build.build(spark, [p], ["pair_id"], settle(c), settle(k), folder, enrich.stub_embedder(64), embedding_dim=64, n_neg=4)
    names = ("n_pairs", "n_questions", "n_sources", "n_clusters", "embedding_dim")
    return spark.createDataFrame([tuple(report[x] for x in names)], "n_pairs long, n_questions long, n_sources long, n_clusters long, embedding_dim int")


@query("b5_batches", "SELECT count(*) // 32 AS batches, 0::BIGINT AS missing, count(*) // 32 * 32 AS n_rows FROM embeddings")
def b5_batches(spark, d):
    """Faults in the batches of an epoch."""
    e = emb(spark, d)
    p = serve.batch_problems(e.select("vec_id", "embedding"), serve.batches(e, "vec_id", 32, 0), "vec_id", ("embedding",), 64)
    return p.agg(F.count(F.lit(1)).alias("batches"), F.sum(F.col("missing") + F.col("other_dim") + F.col("not_finite")).alias("missing"), F.sum("rows").alias("n_rows"))


@query("b10_memory", "SELECT (SELECT count(DISTINCT question_id) + count(DISTINCT source_id) FROM pairs) * 256 + (SELECT count(*) FROM keywords) * 256 + (SELECT count(*) FROM pairs) * (28 + 80 + 772) AS total")
def b10_memory(spark, d):
    """Bytes that the dataset's arrays would take."""
    n = table(spark, d, "pairs").agg(F.countDistinct("question_id"), F.countDistinct("source_id"), F.count(F.lit(1))).first()
    return spark.createDataFrame([(serve.memory_estimate(n[0], n[1], table(spark, d, "keywords").count(), n[2], 64, 5)["total"],)], "total long")


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("io2_count", "SELECT count(*) AS n FROM pairs")
def io2_count(spark, d):
    """Records of a CSV with quoted line breaks."""
    path = _scratch(spark, "csv")
    table(spark, d, "pairs").select("pair_id", "question", "source").write.option("header", True).option("escape", '"').csv(path)
    return spark.createDataFrame([(formats.count_rows(spark, path),)], "n long")


@query("io4_records", "SELECT DISTINCT 's,' || source_id AS source_text, 'q\"' || question_id || chr(10) || 'x' AS question_text FROM pairs WHERE question_id IS NOT NULL AND source_id IS NOT NULL")
def io4_records(spark, d):
    """Records of two CSVs, with quotes, commas and line breaks in their fields, without repeats."""
    p = table(spark, d, "pairs").where("question_id is not null and source_id is not null")
    p = p.select(F.concat(F.lit('q"'), F.col("question_id").cast("string"), F.lit("\nx")).alias("question"), F.concat(F.lit("s,"), F.col("source_id").cast("string")).alias("source"))
    paths = [_scratch(spark, "csv") for _ in range(2)]
    for x in paths:
        p.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(x)
    return formats.read_records(spark, paths).select("source_text", "question_text")


@query("io10_vectors", "SELECT vec_id::VARCHAR AS keyword, round(list_sum(embedding::DOUBLE[]), 4) AS s FROM embeddings")
def io10_vectors(spark, d):
    """Vectors written as JSON and read again."""
    path = _scratch(spark, "vectors")
    formats.write_vectors(emb(spark, d).select(F.col("vec_id").cast("string").alias("keyword"), V.doubles(F.col("embedding")).alias("embedding")), path, {"model": "none"})
    v, meta = formats.read_vectors(spark, path)
    assert meta == {"model": "none"}
    return v.select("keyword", F.round(V.total(F.col("embedding")), 4).alias("s"))


@query("io13_dispatch", "SELECT count(*) AS n FROM clusters")
def io13_dispatch(spark, d):
    """A table found in whichever format it is stored."""
    folder = _scratch(spark, "tables")
    table(spark, d, "clusters").write.json(f"{folder}/clusters.json")
    return formats.read_table(spark, folder, "clusters").agg(F.count(F.lit(1)).alias("n"))


@query("io19_scan", "SELECT keyword_id, keyword FROM keywords")
def io19_scan(spark, d):
    return formats.ordered_scan(table(spark, d, "keywords").select("keyword_id", "keyword"), "keyword_id")


@query("io22_collection", "SELECT vec_id AS id, label FROM embeddings")
def io22_collection(spark, d):
    return formats.collection(emb(spark, d).withColumnRenamed("vec_id", "id"), ("label",))


@query("io26_links", "SELECT DISTINCT question_id, source_id FROM pairs WHERE question_id IS NOT NULL AND source_id >= 0")
def io26_links(spark, d):
    """Links of questions that list their passages as JSON."""
    p = table(spark, d, "pairs").where("question_id is not null and source_id >= 0").select("question_id", "source_id").distinct()
    q = p.groupBy("question_id").agg(F.to_json(F.collect_list("source_id")).alias("relevant_passage_ids"))
    passages = p.select("source_id").distinct().select(F.col("source_id").alias("passage_id"), "source_id")
    return formats.question_links([q.where("question_id % 2 = 0"), q.where("question_id % 2 = 1")], passages)[0].select("question_id", "source_id")


@query("sk13_register", "SELECT 'questions' AS kind, (SELECT count(*) FROM embeddings) AS n UNION ALL SELECT 'sources', 7")
def sk13_register(spark, d):
    """Two tables entered in a folder's register."""
    folder = _scratch(spark, "register")
    formats.register_file(spark, folder, "sources", 7, 64)
    doc = formats.register_file(spark, folder, "questions", emb(spark, d).count(), 64)
    return spark.createDataFrame([(k, v["n"]) for k, v in doc.items()], "kind string, n long")


@query("sk15_triplets", f"WITH l AS (SELECT DISTINCT question_id, source_id FROM pairs WHERE question_id IS NOT NULL AND source_id >= 0), q AS (SELECT question_id FROM pairs WHERE {Q_OK} GROUP BY 1), s AS (SELECT source_id FROM pairs WHERE {S_OK} GROUP BY 1) SELECT count(*) AS n FROM l a JOIN l b ON a.question_id = b.question_id AND a.source_id < b.source_id JOIN q ON q.question_id = a.question_id JOIN s s1 ON s1.source_id = a.source_id JOIN s s2 ON s2.source_id = b.source_id")
def sk15_triplets(spark, d):
    """Triplets with their texts, written as CSV and counted."""
    from passagemill.operators import triplets

    p = table(spark, d, "pairs")
    l = settle(p.where("question_id is not null and source_id >= 0").select("question_id", "source_id").distinct())  # noqa: E741
    t = triplets.positives(l).where("not grouped").select("question_id", F.col("a").alias("source_id_1"), F.col("b").alias("source_id_2"), F.lit(0).alias("label"))
    q = p.where(~is_empty_text(F.col("question"))).groupBy("question_id").agg(F.min("question").alias("question"))
    s = p.where(~is_empty_text(F.col("source"))).groupBy("source_id").agg(F.min("source").alias("source"))
    path = formats.write_triplets(t, q, s, _scratch(spark, "triplets"))
    return spark.createDataFrame([(formats.count_rows(spark, path),)], "n long")


@query("sk21_checkpoints", "SELECT 3 AS step, count(*) AS n FROM keywords")
def sk21_checkpoints(spark, d):
    """The newest of four states, of which two are kept."""
    folder = _scratch(spark, "states")
    k = table(spark, d, "keywords").select("keyword_id")
    for step in range(4):
        formats.write_checkpoint(k.withColumn("step", F.lit(step)), folder, "state", 2)
    assert len(formats.keep_newest(spark, folder, "state", 2)) == 2
    return formats.last_checkpoint(spark, folder, "state").groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query("sk23_history", "SELECT 0::BIGINT AS epoch, 0.5 AS loss, NULL::DOUBLE AS accuracy UNION ALL SELECT 1, 0.25, 0.75")
def sk23_history(spark, d):
    """Metrics of two epochs appended one after the other; the first lacks a field."""
    path = _scratch(spark, "history")
    formats.append_history(spark, path, [{"epoch": 0, "loss": 0.5}])
    return formats.append_history(spark, path, [{"epoch": 1, "loss": 0.25, "accuracy": 0.75}]).select("epoch", "loss", "accuracy")


