"""Registered queries of the problems tagged llm, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from passagemill.llm import abuse, clusters, copies, mixing, neighbours, overlap, packing, splits, survivors, tokens
from passagemill.runtime import settle, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_FOLD = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_MISSING = "({0} IS NULL OR regexp_matches({0}, '^[\\s\\p{{Z}}\\p{{Cf}}]*([nN][aA][nN])?[\\s\\p{{Z}}\\p{{Cf}}]*$'))"
_COPIES_SQL = f"""
WITH r AS (
  SELECT 'pairs' AS table_name, pair_id AS id, question AS q, source AS s FROM pairs
  UNION ALL
  SELECT 'raw_pairs', raw_id,
         coalesce(json_extract_string(payload, '$.question'), json_extract_string(payload, '$.question_text'), json_extract_string(payload, '$.query')),
         coalesce(json_extract_string(payload, '$.source'), json_extract_string(payload, '$.source_text'), json_extract_string(payload, '$.context'), json_extract_string(payload, '$.passage'))
  FROM (SELECT * FROM raw_pairs WHERE json_valid(payload))
), k AS (
  SELECT table_name, id, {_FOLD.format('q')} AS fq, {_FOLD.format('s')} AS fs FROM r
  WHERE NOT {_MISSING.format('q')} AND NOT {_MISSING.format('s')}
), g AS (
  SELECT table_name, id, min(id) OVER (PARTITION BY table_name, fq, fs) AS first_id FROM k
)
SELECT table_name, first_id, id AS copy_id FROM g WHERE id <> first_id
"""


@query("p2_found", _COPIES_SQL)
def p2_found(spark, d):
    return copies.copies_found(table(spark, d, "pairs"), table(spark, d, "raw_pairs"))


@query(
    "p2_records",
    f"""
WITH k AS (
  SELECT pair_id, {_FOLD.format('question')} AS fq, {_FOLD.format('source')} AS fs FROM pairs
  WHERE NOT {_MISSING.format('question')} AND NOT {_MISSING.format('source')}
)
SELECT min(pair_id) AS first_id, count(*) AS copies FROM k GROUP BY fq, fs
""",
)
def p2_records(spark, d):
    """One record for each group of copies of ``pairs``, with the number of copies."""
    members = copies.collapse_copies(table(spark, d, "pairs"), "pair_id", ["question", "source"])
    return members.where(F.col("pair_id") == F.col("first_id")).select("first_id", "copies")


@query("p4_found")
def p4_found(spark, d):
    return survivors.survivors_found(table(spark, d, "pairs"), table(spark, d, "pair_files"))


_STAND_INS = ", ".join(f"'{x}'" for x in survivors.STAND_INS)
_FIRST = "(array_agg(pair_id ORDER BY {0} DESC, updated_at DESC NULLS LAST, pair_id) FILTER (WHERE {0} IS NOT NULL))[1]"
_RULES_SQL = f"""
WITH k AS (
  SELECT pair_id, {_FOLD.format('question')} AS fq, {_FOLD.format('source')} AS fs, answer, {_FOLD.format('answer')} AS fa, relevance_score AS score, file_name, updated_at FROM pairs
  WHERE NOT {_MISSING.format('question')} AND NOT {_MISSING.format('source')}
), g AS (SELECT *, min(pair_id) OVER (PARTITION BY fq, fs) AS first_pair_id, count(*) OVER (PARTITION BY fq, fs) AS n FROM k),
shared AS (SELECT {_FOLD.format('answer')} AS fa FROM pairs WHERE NOT {_MISSING.format('answer')} AND NOT {_MISSING.format('question')} GROUP BY 1 HAVING count(DISTINCT {_FOLD.format('question')}) >= {survivors.LEAST_QUESTIONS}),
r AS (
  SELECT g.*, CASE WHEN NOT {_MISSING.format('answer')} AND fa <> '' AND fa NOT IN ({_STAND_INS}) AND fa NOT IN (SELECT fa FROM shared) THEN length(regexp_replace(answer, '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g')) END AS answer_rank,
    CASE WHEN score BETWEEN 0 AND 1 AND NOT isnan(score) THEN coalesce(trust, -2147483648) END AS score_rank
  FROM g LEFT JOIN (SELECT file_name, max(trust) AS trust FROM pair_files GROUP BY 1) USING (file_name) WHERE n > 1
)
SELECT first_pair_id, {_FIRST.format('answer_rank')} AS answer_pair_id, {_FIRST.format('score_rank')} AS score_pair_id FROM r GROUP BY 1
"""


@query("p4_rules", _RULES_SQL)
def p4_rules(spark, d):
    """The rows whose answer and score survive."""
    return p4_found(spark, d).drop("keywords_pair_id")


@query("p4_survivors")
def p4_survivors(spark, d):
    """The surviving record itself, with cluster and split by currency reasoning."""
    return survivors.survivors(table(spark, d, "pairs"), table(spark, d, "pair_files"))


_TIES_SQL = f"""
WITH RECURSIVE k AS (
  SELECT pair_id, CASE WHEN source_id >= 0 THEN source_id END AS s, CASE WHEN NOT {_MISSING.format('question')} THEN {_FOLD.format('question')} END AS q FROM pairs
), low AS (SELECT q, min(s) AS low FROM k WHERE s IS NOT NULL AND q IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT s AS a, low AS b FROM k JOIN low USING (q) WHERE s IS NOT NULL AND s <> low),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1),
g AS (SELECT pair_id, coalesce(r.root, coalesce(s, low)) AS root FROM k LEFT JOIN low USING (q) LEFT JOIN roots r ON r.node = coalesce(s, low)),
n AS (SELECT *, count(*) OVER (PARTITION BY root) AS n FROM g WHERE root IS NOT NULL)
SELECT root AS group_source_id, pair_id FROM n WHERE n > 1
"""


@query("p1_found", _TIES_SQL)
def p1_found(spark, d):
    rows = splits.grouped_split(table(spark, d, "pairs"))
    return rows.where("group_rows > 1 and root_source is not null").select(F.col("root_source").alias("group_source_id"), "pair_id")


@query("p1_split")
def p1_split(spark, d):
    """Every row with its split."""
    return splits.grouped_split(table(spark, d, "pairs")).select("pair_id", "split")


@query("p1_ties", "SELECT count(*) AS n, 0::BIGINT AS torn, 0::BIGINT AS without_split FROM pairs")
def p1_ties(spark, d):
    """Rows, tied groups that lie in several splits, rows without a split."""
    rows = settle(splits.grouped_split(table(spark, d, "pairs")))
    torn = rows.where("root_source is not null").groupBy("root_source").agg(F.countDistinct("split").alias("k")).where("k > 1").count()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(torn).cast("long").alias("torn"), F.sum(F.col("split").isNull().cast("int")).alias("without_split"))


@query("p1_shares")
def p1_shares(spark, d):
    """Rows and share of each split, overall (NULL label) and per cluster."""
    rows = splits.grouped_split(table(spark, d, "pairs"))
    counts = rows.rollup("label", "split").agg(F.count(F.lit(1)).alias("n"), F.grouping("label").alias("overall"), F.grouping("split").alias("all_splits"))
    counts = settle(counts)
    whole = counts.where("all_splits = 1 and overall = 0").select("label", F.col("n").alias("of")).unionByName(counts.where("overall = 1").select(F.lit("*").alias("label"), F.col("n").alias("of")))
    by = counts.where("all_splits = 0 and overall = 0").select("label", "split", "n")
    every = by.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit("*").alias("label"), "split", "n")
    named = by.unionByName(every).withColumn("k", F.coalesce("label", F.lit("null")))
    return named.join(whole.select(F.coalesce("label", F.lit("null")).alias("k"), "of"), "k").select(F.col("k").alias("cluster"), "split", "n", F.round(F.col("n") / F.col("of"), 4).alias("share"))


def _entity_vectors(spark, d):
    return neighbours.unit_vectors(table(spark, d, "entity_embs"), "vec_id", "embedding")


_SIMILAR_SQL = """
WITH v AS (SELECT vec_id, any_value(embedding::DOUBLE[]) AS e FROM entity_embs WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding]) GROUP BY 1),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 6) DESC, b) AS rank FROM s)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE rank <= 5 AND sim >= 0.85
"""


@query("p7_found", _SIMILAR_SQL)
def p7_found(spark, d):
    return neighbours.similar_pairs(_entity_vectors(spark, d))


@query("p7_nearest")
def p7_nearest(spark, d):
    """The five most similar others of every usable vector."""
    return neighbours.nearest(_entity_vectors(spark, d)).select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), F.round("sim", 6).alias("cosine"), "rank")


@query("p7_search")
def p7_search(spark, d):
    """The five most similar of every vector whose id is divisible by 50, by greedy graph search."""
    v = settle(_entity_vectors(spark, d))
    return neighbours.greedy_search(v, v.where("id % 50 = 0")).select("query_id", F.col("other").alias("other_id"), F.round("sim", 6).alias("cosine"), "rank")


def _keyword_groups(spark, d):
    return clusters.cluster(neighbours.unit_vectors(table(spark, d, "keywords"), "keyword_id", "embedding"))


@query("p5_found")
def p5_found(spark, d):
    g = _keyword_groups(spark, d)
    return g.where("id <> g").select(F.col("g").alias("first_keyword_id"), F.col("id").alias("keyword_id"))


@query("p5_groups")
def p5_groups(spark, d):
    """Each group's size, most typical keywords, and the older cluster whose centroid is nearest to the group's members."""
    g = settle(_keyword_groups(spark, d))
    words = table(spark, d, "keywords").select("keyword_id", F.trim("keyword").alias("keyword"))
    described = clusters.describe(g, words, "keyword_id", "keyword")
    old = neighbours.unit_vectors(table(spark, d, "clusters"), "cluster_id", "centroid").collect()  # a fixed table of 24 rows
    ids = np.array([r["id"] for r in old], np.int64)
    if not len(ids):
        return described.select(F.col("g").alias("first_keyword_id"), "size", "typical", F.lit(None).cast("long").alias("old_cluster_id"), F.lit(None).cast("double").alias("old_share"))
    near = clusters.nearest_of(g, ids, neighbours.matrix([r["vec"] for r in old])).join(g.select("id", F.col("g").alias("grp")), "id")
    votes = near.groupBy("grp", "g").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("grp").agg(F.max_by("g", F.struct("n", -F.col("g"))).alias("old_cluster_id"), (F.max("n") / F.sum("n")).alias("old_share"))
    return described.join(best.withColumnRenamed("grp", "g"), "g").select(F.col("g").alias("first_keyword_id"), "size", "typical", "old_cluster_id", F.round("old_share", 4).alias("old_share"))


@query("p8_pack")
def p8_pack(spark, d):
    """Every piece of every text with its container of 2,048 tokens."""
    sized = settle(tokens.count_tokens(table(spark, d, "documents"), "text", ["doc_id"]))
    return packing.pack(sized, "doc_id", "n_tokens")


@query("p8_fill")
def p8_fill(spark, d):
    """Containers, their fill, and the number of texts cut."""
    packed = settle(p8_pack(spark, d))
    boxes = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum((F.col("used") == 2048).cast("int")).alias("full"), F.round(F.sum("used") / (F.count(F.lit(1)) * 2048), 6).alias("fill"))


@query("p8_check", "SELECT count(*) AS texts, 0::BIGINT AS over_capacity, 0::BIGINT AS cut_for_nothing, 0::BIGINT AS torn FROM documents WHERE text IS NOT NULL AND text <> ''")
def p8_check(spark, d):
    """Texts placed, containers over 2,048 tokens, texts cut that would fit, and texts of which tokens are lost or placed twice."""
    sized = settle(tokens.count_tokens(table(spark, d, "documents"), "text", ["doc_id"]))
    packed = settle(packing.pack(sized, "doc_id", "n_tokens").where("container_id is not null"))
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count()
    items = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("placed")).join(sized.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")), "doc_id", "full_outer")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return items.agg(one(F.col("placed") > 0).alias("texts"), F.lit(over).cast("long").alias("over_capacity"), one((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("cut_for_nothing"), one(~F.coalesce("placed", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0)))).alias("torn"))


@query("p9_mix")
def p9_mix(spark, d):
    """The texts of the largest mixture in which every source has its weight, with the copies taken of each."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query("p9_shares")
def p9_shares(spark, d):
    """Shares reached by :func:`p9_mix`."""
    return mixing.reached(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query("p9_filled")
def p9_filled(spark, d):
    """Shares reached when the mixture has to be twice as large as the largest exact one: sources are clamped, their excess is shared out."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    exact = mixing.budgets(settle(mixing.distinct_texts(docs, targets)), targets, None)
    return mixing.reached(docs, targets, total=2 * sum(x[4] for x in exact))


@query("p10_found")
def p10_found(spark, d):
    return abuse.flagged(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id")


@query("p10_scores")
def p10_scores(spark, d):
    """Every document's score."""
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id", F.round("score", 6).alias("score"))


@query("p10_rates")
def p10_rates(spark, d):
    """Documents, flagged documents and rate of each source."""
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "labels"))


@query("p6_found")
def p6_found(spark, d):
    return overlap.found(table(spark, d, "pairs"))


@query("p6_report")
def p6_report(spark, d):
    """Leaked evaluation rows and matching pairs per split and source."""
    return overlap.report(table(spark, d, "pairs"))
