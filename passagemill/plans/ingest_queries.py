"""Queries of ingestion, text, keyword parsing and linking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.functions import jsoncols as J
from passagemill.functions import text as T
from passagemill.operators import ingest, link
from passagemill.operators.packed import packed_values
from passagemill.plans.base import KEYWORDS_SQL, MATCH_SQL, PAIRS_SQL, VOTE_SQL, WS, pairs_ok, query, vocab
from passagemill.runtime import settle, table


@query("p3_found")
def p3_found(spark, d):
    rows = packed_values(table(spark, d, "pairs"), "pair_id", "keywords", least=2)
    return rows.select("pair_id", "pos", rows["value"].alias("keyword"))


@query(
    "flagship",
    f"""
WITH {VOTE_SQL}, big AS (
  SELECT cluster_id FROM (SELECT cluster_id, count(*) AS n FROM vocab GROUP BY 1) ORDER BY n DESC, cluster_id LIMIT 1
)
SELECT coalesce(v.cluster_id, (SELECT cluster_id FROM big)) AS cluster_id, count(*) AS n_pairs, round(avg(p.score), 6) AS mean_score
FROM pairs_ok p LEFT JOIN voted v USING (pair_id) GROUP BY 1
""",
)
def flagship(spark, d):
    """Clean pairs, link them to clusters by majority vote of their keywords, report each cluster."""
    p, v = pairs_ok(spark, d), vocab(spark, d)
    largest = v.groupBy("cluster_id").count().agg(F.max_by("cluster_id", F.struct("count", -F.col("cluster_id")))).first()[0]
    linked = link.link(p, v, link.fallback("largest", F.col("pair_id"), 24, largest))
    return linked.join(p.select("pair_id", "score"), "pair_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("proj1_alias", f"""
WITH r AS (SELECT raw_id, json_extract_string(payload, '$.question_text') AS qt, json_extract_string(payload, '$.query') AS qy, json_extract_string(payload, '$.source') AS s, json_extract_string(payload, '$.source_text') AS st, json_extract_string(payload, '$.keywords') AS k, coalesce(json_extract_string(payload, '$.tags'), 'tag') AS tg FROM raw_pairs WHERE json_valid(payload))
SELECT raw_id, coalesce(qt, '') AS question, coalesce(st, '') AS source, 0.25::DOUBLE AS relevance_score, 'a b' AS keywords FROM r
""")
def proj1_alias(spark, d):
    """Records whose columns stand under several accepted names at once: the first of the list is read."""
    raw = table(spark, d, "raw_pairs").where(F.btrim(F.col("payload"), F.lit(" \t\n\r")).endswith("}"))
    x = F.from_json("payload", "question_text string, query string, source string, source_text string, keywords string, tags string")
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    rows = raw.select("raw_id", x.alias("x")).select("raw_id", text("query").alias("query"), text("question_text").alias("question_text"), text("source").alias("source"), text("source_text").alias("source_text"), F.lit("0.25").alias("label"), F.lit("t1,t2").alias("tags"), F.lit("a b").alias("topics"))
    return ingest.normalize(rows, ["raw_id"]).select("ord.raw_id", "question", "source", "relevance_score", F.array_join("keywords", "|").alias("keywords"))


@query("proj3_nonblank", f"SELECT count(*) AS n FROM pairs WHERE trim(question, {WS}) <> '' AND trim(source, {WS}) <> ''")
def proj3_nonblank(spark, d):
    return ingest.nonblank(table(spark, d, "pairs")).agg(F.count(F.lit(1)).alias("n"))


@query("proj4_empty_text", f"SELECT pair_id, coalesce(trim(answer, {WS}), '') = '' OR lower(trim(answer, {WS})) = 'nan' AS is_empty FROM pairs")
def proj4_empty_text(spark, d):
    return table(spark, d, "pairs").select("pair_id", T.is_empty_text(F.col("answer")).alias("is_empty"))


@query("proj5_normalize", f"SELECT doc_id, md5(regexp_replace(trim(lower(text), {WS}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def proj5_normalize(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@query("proj6_clip", "SELECT pair_id, CASE WHEN relevance_score IS NULL OR isnan(relevance_score) THEN 1.0 ELSE least(greatest(relevance_score, 0.0), 1.0) END AS score FROM pairs")
def proj6_clip(spark, d):
    s = F.least(F.greatest(F.coalesce(F.nanvl("relevance_score", F.lit(1.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return table(spark, d, "pairs").select("pair_id", s.alias("score"))


@query("proj7_keyword_key", f"SELECT keyword_id, trim(lower(keyword), {WS}) AS key FROM keywords")
def proj7_keyword_key(spark, d):
    return table(spark, d, "keywords").select("keyword_id", T.keyword_key(F.col("keyword")).alias("key"))


@query(
    "s1_chunks",
    """
WITH t AS (SELECT doc_id, string_split(replace(text, chr(10), ''), ' ') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 50 + 1)) AS pos FROM t)
SELECT doc_id, pos, md5(array_to_string(w[pos * 50 + 1 : pos * 50 + 50], ' ')) AS digest FROM c
""",
)
def s1_chunks(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.chunks(F.col("text"), 50)).alias("pos", "chunk"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("digest"))


@query(
    "s3_sentences",
    f"""
WITH t AS (SELECT pair_id, string_split(regexp_replace(trim(source, {WS}), '([.!?])[ \\t\\n\\r\\f\\v]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS s FROM pairs WHERE source IS NOT NULL),
u AS (SELECT pair_id, list_filter(list_transform(s, lambda x: trim(x, {WS})), lambda x: x <> '') AS s FROM t)
SELECT pair_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM u
""",
)
def s3_sentences(spark, d):
    s = table(spark, d, "pairs").where("source is not null").select("pair_id", T.sentences(F.col("source")).alias("s"))
    return s.select("pair_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("j1_keywords", f"WITH {PAIRS_SQL}, {KEYWORDS_SQL} SELECT pair_id, pos::BIGINT AS pos, kw AS keyword FROM kwpos")
def j1_keywords(spark, d):
    """Keywords of each cell by the polymorphic parser (JSON lists, lists of objects, comma text)."""
    return pairs_ok(spark, d).select("pair_id", F.posexplode("keywords").alias("pos", "keyword")).select("pair_id", F.col("pos").cast("long").alias("pos"), "keyword")


_TERMS = """
WITH c AS (SELECT pair_id, CASE WHEN json_valid(keywords) THEN keywords ELSE replace(keywords, '''', '"') END AS k FROM pairs WHERE regexp_matches(keywords, '^\\s*\\[\\s*\\{')),
t AS (SELECT pair_id, json_extract(k, '$[*]') AS items FROM c WHERE json_valid(k)),
e AS (SELECT pair_id, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM t),
f AS (SELECT pair_id, pos, json_extract_string(x, '$.term') AS term, json_extract_string(x, '$.type') AS type, TRY_CAST(json_extract_string(x, '$.confidence') AS DOUBLE) AS c FROM e)
"""


def _suggested(spark, d):
    p = table(spark, d, "pairs").where(F.col("keywords").rlike(r"^\s*\[\s*\{"))  # lists of objects in any notation
    return p.select("pair_id", J.suggestions(F.col("keywords")).alias("items"))


@query("j3_confident", _TERMS + "SELECT pair_id, count(*) AS n FROM f WHERE c >= 0.7 GROUP BY 1")
def j3_confident(spark, d):
    """Suggestions with a confidence of at least 0.7."""
    return _suggested(spark, d).select("pair_id", F.size(J.at_least(F.col("items"))).cast("long").alias("n")).where("n > 0")


@query("j4_unique_terms", _TERMS + f", g AS (SELECT pair_id, trim(lower(term), {WS}) AS term, min(pos) AS pos FROM f WHERE term IS NOT NULL GROUP BY 1, 2) SELECT pair_id, string_agg(term, '|' ORDER BY pos) AS terms FROM g WHERE term <> '' GROUP BY 1")
def j4_unique_terms(spark, d):
    """Unique lower-cased terms in order of first occurrence."""
    return _suggested(spark, d).select("pair_id", F.array_join(J.unique_terms(F.col("items")), "|").alias("terms")).where("terms <> ''")


@query("j6_typed_terms", _TERMS + "SELECT pair_id, string_agg(term, '|' ORDER BY pos) AS terms FROM f WHERE type IN ('keyword', 'domain') AND coalesce(c, 0) >= 0.3 GROUP BY 1")
def j6_typed_terms(spark, d):
    """Terms of chosen types and confidence as they are."""
    return _suggested(spark, d).select("pair_id", F.array_join(J.selected_terms(F.col("items"), ("keyword", "domain"), 0.3), "|").alias("terms")).where("terms <> ''")


@query(
    "a11_term_counts",
    _TERMS + f", g AS (SELECT trim(lower(term), {WS}) AS term FROM f WHERE term IS NOT NULL) SELECT term, count(*) AS n FROM g WHERE term <> '' GROUP BY 1",
)
def a11_term_counts(spark, d):
    """Frequency of each suggested term."""
    t = _suggested(spark, d).select(F.explode("items").alias("x")).select(T.keyword_key(F.col("x.term")).alias("term")).where("term <> ''")
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j8_records",
    """
WITH r AS (SELECT raw_id, coalesce(nullif(json_extract_string(payload, '$.source_text'), ''), json_extract_string(payload, '$.source')) AS source_text,
  coalesce(nullif(json_extract_string(payload, '$.question_text'), ''), json_extract_string(payload, '$.question')) AS question_text FROM raw_pairs WHERE json_valid(payload))
SELECT raw_id, source_text IS NULL OR question_text IS NULL AS rejected FROM r
""",
)
def j8_records(spark, d):
    """Records read from JSON with fall-back fields; those without text are rejected."""
    raw = table(spark, d, "raw_pairs").where(F.btrim(F.col("payload"), F.lit(" \t\n\r")).endswith("}"))
    x = F.from_json("payload", "source_text string, source string, question_text string, question string")
    r = raw.select("raw_id", x.alias("x")).select("raw_id", F.coalesce(F.nullif("x.source_text", F.lit("")), "x.source").alias("s"), F.coalesce(F.nullif("x.question_text", F.lit("")), "x.question").alias("q"))
    return r.select("raw_id", (F.col("s").isNull() | F.col("q").isNull()).alias("rejected"))


@query("j5_props", "SELECT (json_extract_string(props, '$.k')::INT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def j5_props(spark, d):
    """Numbers read from a JSON column."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy((k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a1_merge_pairs",
    f"""
WITH {PAIRS_SQL}, {KEYWORDS_SQL}, k AS (SELECT p.question, p.source, count(DISTINCT kw) AS n_kw FROM pairs_ok p LEFT JOIN kwpos USING (pair_id) GROUP BY 1, 2)
SELECT md5(question || '|' || source) AS pair_key, count(*) AS n, max(score) AS score, arg_min(answer, {{'l': -length(answer), 'o': pair_id}}) AS answer, any_value(n_kw) AS n_keywords
FROM pairs_ok JOIN k USING (question, source) GROUP BY question, source
""",
)
def a1_merge_pairs(spark, d):
    """One row for each (question, source) with the best score, the longest answer and all keywords."""
    rows = pairs_ok(spark, d).select("question", "source", "answer", "keywords", F.col("score").alias("relevance_score"), F.struct("pair_id").alias("ord"))
    m = ingest.merge_repeated(rows)
    return m.select(F.md5(F.concat_ws("|", "question", "source")).alias("pair_key"), "n", F.col("relevance_score").alias("score"), "answer", F.size(F.array_distinct("keywords")).cast("long").alias("n_keywords"))


@query(
    "a3_ids",
    f"""
WITH {PAIRS_SQL}, u AS (SELECT DISTINCT question, source FROM pairs_ok),
i AS (SELECT question, source, row_number() OVER (ORDER BY question, source) - 1 AS pair_id, dense_rank() OVER (ORDER BY question) - 1 AS question_id FROM u),
f AS (SELECT source, row_number() OVER (ORDER BY min(pair_id)) - 1 AS source_id FROM i GROUP BY source)
SELECT pair_id, question_id, source_id, md5(question || '|' || source) AS pair_key FROM i JOIN f USING (source)
""",
)
def a3_ids(spark, d):
    """Dense ids of pairs, questions and sources in text order."""
    rows = pairs_ok(spark, d).select("question", "source").distinct()
    return ingest.assign_ids(rows).select("pair_id", "question_id", "source_id", F.md5(F.concat_ws("|", "question", "source")).alias("pair_key"))


@query(
    "a18_stats",
    f"""
WITH {PAIRS_SQL}, l AS (SELECT DISTINCT question, source FROM pairs_ok)
SELECT count(*) AS n_pairs, count(DISTINCT question) AS n_questions, count(DISTINCT source) AS n_sources,
  round((SELECT count(*) FROM l) / count(DISTINCT question), 6) AS sources_per_question, round((SELECT count(*) FROM l) / count(DISTINCT source), 6) AS questions_per_source FROM pairs_ok
""",
)
def a18_stats(spark, d):
    return ingest.pair_stats(pairs_ok(spark, d))


@query("a9_first_wins", "SELECT source_id, question_id, arg_min(pair_id, (updated_at, pair_id)) AS pair_id FROM pairs WHERE source_id IS NOT NULL AND question_id IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1, 2")
def a9_first_wins(spark, d):
    """The earliest row of each (source, question)."""
    p = table(spark, d, "pairs").where("source_id is not null and question_id is not null and updated_at is not null").select("source_id", "question_id", "pair_id", "updated_at")
    return ingest.first_wins(p, ["source_id", "question_id"], ["updated_at", "pair_id"]).select("source_id", "question_id", "pair_id")


@query("a10_dedup_texts", f"SELECT md5(t) AS text_key, min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, regexp_replace(trim(lower(text), {WS}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL) GROUP BY t")
def a10_dedup_texts(spark, d):
    """Distinct normalised texts, what an embedder has to see."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize(F.col("text")).alias("t"))
    return t.groupBy("t").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).select(F.md5("t").alias("text_key"), "first_doc", "n")


@query("a4_sizes", "SELECT c.cluster_id, count(k.keyword_id) AS n_keywords FROM clusters c LEFT JOIN keywords k USING (cluster_id) GROUP BY 1")
def a4_sizes(spark, d):
    return link.cluster_sizes(table(spark, d, "clusters"), table(spark, d, "keywords"))


@query("jn2_match", f"WITH {MATCH_SQL} SELECT pair_id, pos::BIGINT AS pos, key, coalesce(cluster_id, -1) AS cluster_id FROM matched")
def jn2_match(spark, d):
    return link.matches(pairs_ok(spark, d), vocab(spark, d)).select("pair_id", F.col("pos").cast("long").alias("pos"), "key", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


@query("jn4_match_known", f"WITH {MATCH_SQL} SELECT cluster_id, count(*) AS n FROM matched WHERE cluster_id IS NOT NULL GROUP BY 1")
def jn4_match_known(spark, d):
    return link.matches(pairs_ok(spark, d), vocab(spark, d), keep_missing=False).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("jn6_keyword_ids", f"WITH {MATCH_SQL} SELECT p.pair_id, coalesce(string_agg(DISTINCT m.keyword_id::VARCHAR, ',' ORDER BY m.keyword_id::VARCHAR), '') AS ids FROM pairs_ok p LEFT JOIN matched m USING (pair_id) GROUP BY 1")
def jn6_keyword_ids(spark, d):
    ids = link.keyword_ids(pairs_ok(spark, d), vocab(spark, d))
    return ids.select("pair_id", F.array_join(F.array_sort(F.transform("keyword_ids", lambda x: x.cast("string"))), ",").alias("ids"))


@query("jn1_resolve", f"WITH {PAIRS_SQL}, q AS (SELECT question, min(question_id) AS qid FROM pairs_ok GROUP BY 1), s AS (SELECT source, coalesce(min(source_id), -1) AS sid FROM pairs_ok GROUP BY 1) SELECT pair_id, qid, sid FROM pairs_ok JOIN q USING (question) JOIN s USING (source)")
def jn1_resolve(spark, d):
    """Texts resolved to the ids of their first registration."""
    p = pairs_ok(spark, d)
    q, s = p.groupBy("question").agg(F.min("question_id").alias("qid")), p.groupBy("source").agg(F.coalesce(F.min("source_id"), F.lit(-1)).alias("sid"))
    return p.select("pair_id", "question", "source").join(q, "question").join(s, "source").select("pair_id", "qid", "sid")


@query("a5_majority", f"WITH {VOTE_SQL} SELECT * FROM voted")
def a5_majority(spark, d):
    return link.votes(pairs_ok(spark, d), vocab(spark, d))


@query("a5b_uniform", f"WITH {VOTE_SQL} SELECT p.pair_id, coalesce(v.cluster_id, p.pair_id % 24) AS cluster_id FROM pairs_ok p LEFT JOIN voted v USING (pair_id)")
def a5b_uniform(spark, d):
    return link.link(pairs_ok(spark, d), vocab(spark, d), link.fallback("uniform", F.col("pair_id"), 24, None))


@query("a6_source_cluster", "SELECT source_id, cluster_id FROM (SELECT source_id, cluster_id, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, cluster_id) AS r FROM pairs WHERE source_id IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def a6_source_cluster(spark, d):
    return link.majority(table(spark, d, "pairs"), "source_id")


@query("a7_question_cluster", "SELECT question_id, cluster_id FROM (SELECT question_id, cluster_id, row_number() OVER (PARTITION BY question_id ORDER BY count(*) DESC, cluster_id) AS r FROM pairs WHERE question_id IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def a7_question_cluster(spark, d):
    return link.majority(table(spark, d, "pairs"), "question_id")


@query("a12_coverage", f"WITH {MATCH_SQL} SELECT count(cluster_id) AS matched, count(*) AS total, round(count(cluster_id) / count(*), 6) AS ratio, count(DISTINCT cluster_id) AS n_clusters FROM matched")
def a12_coverage(spark, d):
    return link.coverage(link.matches(pairs_ok(spark, d), vocab(spark, d)))


@query(
    "a13_distribution",
    f"""
WITH {VOTE_SQL}, n AS (SELECT cluster_id, count(*) AS n FROM voted GROUP BY 1)
SELECT count(*) AS used, sum(n)::BIGINT AS total, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd,
  (SELECT count(*) FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM n)) AS missing, stddev_samp(n) > 2 * avg(n) AS imbalanced FROM n
""",
)
def a13_distribution(spark, d):
    return link.distribution(link.votes(pairs_ok(spark, d), vocab(spark, d)), table(spark, d, "clusters"))


@query("sp7_origin_split", "SELECT coalesce(f.split_hint, 'none') AS split, count(*) AS n FROM pairs p LEFT JOIN pair_files f USING (file_name) GROUP BY 1")
def sp7_origin_split(spark, d):
    """Split by the file a row came from."""
    p = table(spark, d, "pairs").select("file_name").join(table(spark, d, "pair_files").select("file_name", "split_hint"), "file_name", "left")
    return p.groupBy(F.coalesce("split_hint", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("io20_page", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def io20_page(spark, d):
    """A page of an ordered table."""
    return table(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").offset(100).limit(50)


@query("io18_lookup", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id = 1")
def io18_lookup(spark, d):
    """A point lookup, pushed down to the scan."""
    return table(spark, d, "documents").where("doc_id = 1").select("doc_id", F.md5("text").alias("digest"))


@query(
    "sk7_cluster_document",
    "SELECT c.cluster_id, count(k.keyword_id) AS size, array_to_string(list(k.keyword ORDER BY k.keyword_id)[1:10], '|') AS sample FROM clusters c JOIN (SELECT * FROM keywords WHERE keyword IS NOT NULL) k USING (cluster_id) GROUP BY 1",
)
def sk7_cluster_document(spark, d):
    """Size and first ten keywords of each cluster."""
    k = table(spark, d, "keywords").where("keyword is not null and cluster_id is not null").select("cluster_id", "keyword_id", "keyword")
    n = k.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    heads = k.withColumn("r", F.row_number().over(W.partitionBy("cluster_id").orderBy("keyword_id"))).where("r <= 10")
    sample = heads.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "keyword"))), lambda x: x["keyword"]), "|").alias("sample"))
    return n.join(sample, "cluster_id").join(table(spark, d, "clusters").select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "size", "sample")


@query(
    "sk19_inspection",
    "SELECT 'question' AS kind, question_id AS id, min(question) AS text FROM pairs WHERE question IS NOT NULL AND question_id IS NOT NULL GROUP BY question_id QUALIFY row_number() OVER (ORDER BY question_id) <= 100",
)
def sk19_inspection(spark, d):
    """The first hundred questions by id."""
    q = table(spark, d, "pairs").where("question is not null and question_id is not null").groupBy("question_id").agg(F.min("question").alias("text"))
    return q.orderBy("question_id").limit(100).select(F.lit("question").alias("kind"), F.col("question_id").alias("id"), "text")


@query("u4_difference", "SELECT source_id FROM pairs WHERE source_id IS NOT NULL EXCEPT SELECT source_id FROM pairs WHERE lower(trim(_split_tag)) LIKE 'train%'")
def u4_difference(spark, d):
    """Sources that never occur in a training row."""
    p = table(spark, d, "pairs").where("source_id is not null")
    return p.select("source_id").distinct().join(p.where(F.lower(F.trim("_split_tag")).startswith("train")).select("source_id"), "source_id", "left_anti")


@query("u6_without_keywords", f"WITH {PAIRS_SQL}, {KEYWORDS_SQL} SELECT count(*) AS n FROM words WHERE len(kws) > 0")
def u6_without_keywords(spark, d):
    return pairs_ok(spark, d).where(F.size("keywords") > 0).agg(F.count(F.lit(1)).alias("n"))


@query(
    "w_ingest_files",
    f"""
WITH {PAIRS_SQL} SELECT count(DISTINCT (question, source)) AS n_pairs, count(DISTINCT question) AS n_questions, count(DISTINCT source) AS n_sources FROM pairs_ok
""",
)
def w_ingest_files(spark, d):
    """The whole ingestion of several imports: alignment, cleaning, merging, ids."""
    p = pairs_ok(spark, d).drop("keywords").withColumnRenamed("score", "relevance_score")
    first = p.where("pair_id % 2 = 0").withColumnsRenamed({"question": "query", "source": "passage"})
    whole = settle(ingest.ingest([first, p.where("pair_id % 2 = 1")], ["pair_id"]))
    return whole.agg((F.max("pair_id") + 1).alias("n_pairs"), (F.max("question_id") + 1).alias("n_questions"), (F.max("source_id") + 1).alias("n_sources"))
