"""Registry of queries, and the tables they share, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.jsoncols import keyword_list
from passagemill.functions.text import is_empty_text
from passagemill.operators import link
from passagemill.runtime import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: ASCII whitespace as SQL.
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
#: Pair rows with question and source, their parsed keywords and a usable score.
PAIRS_SQL = f"""
pairs_ok AS (
  SELECT pair_id, question_id, source_id, question, source, coalesce(answer, '') AS answer, cluster_id, _split_tag, file_name, updated_at,
         CASE WHEN relevance_score IS NULL OR isnan(relevance_score) THEN 1.0 ELSE least(greatest(relevance_score, 0.0), 1.0) END AS score,
         keywords AS cell
  FROM pairs
  WHERE trim(question, {WS}) <> '' AND trim(source, {WS}) <> '' AND lower(trim(question, {WS})) <> 'nan' AND lower(trim(source, {WS})) <> 'nan'
)"""
#: J1 in SQL: strict JSON lists, lists of objects, else a split at commas.
KEYWORDS_SQL = f"""
cells AS (
  SELECT *, trim(cell, {WS}) AS t FROM pairs_ok
), typed AS (
  SELECT *, CASE WHEN t LIKE '[%' AND json_valid(t) THEN json_extract(t, '$[*]') END AS items FROM cells
), words AS (
  SELECT pair_id, CASE
    WHEN t IS NULL OR t = '' THEN []
    WHEN items IS NULL THEN list_filter(list_transform(string_split(cell, ','), lambda x: trim(x, {WS})), lambda x: x <> '')
    WHEN len(items) > 0 AND json_type(items[1]) = 'OBJECT' AND json_extract_string(items[1], '$.term') IS NOT NULL
      THEN list_filter(list_transform(items, lambda x: trim(lower(json_extract_string(x, '$.term')), {WS})), lambda x: x IS NOT NULL AND x <> '')
    WHEN len(items) > 0 AND json_type(items[1]) = 'OBJECT' AND json_extract_string(items[1], '$.topic_descriptor') IS NOT NULL
      THEN list_filter(list_transform(list_filter(items, lambda x: TRY_CAST(json_extract_string(x, '$.probability') AS DOUBLE) >= 0.5), lambda x: trim(lower(json_extract_string(x, '$.topic_descriptor')), {WS})), lambda x: x IS NOT NULL AND x <> '')
    WHEN len(items) > 0 AND json_type(items[1]) = 'OBJECT' THEN []
    ELSE list_filter(list_transform(items, lambda x: trim(json_extract_string(x, '$'), {WS})), lambda x: x IS NOT NULL AND x <> '')
  END AS kws, items IS NOT NULL AND len(items) > 0 AND json_type(items[1]) = 'OBJECT' AS objects FROM typed
), uniq AS (
  SELECT pair_id, kw, min(pos) AS pos FROM (
    SELECT pair_id, unnest(kws) AS kw, generate_subscripts(kws, 1) - 1 AS pos, objects FROM words
  ) GROUP BY pair_id, kw, CASE WHEN objects THEN 0 ELSE pos END
), kwpos AS (
  SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY pos) - 1 AS pos, kw FROM uniq
)"""
VOCAB_SQL = f"""
vocab AS (
  SELECT key, arg_min(cluster_id, keyword_id) AS cluster_id, min(keyword_id) AS keyword_id FROM (
    SELECT trim(lower(keyword), {WS}) AS key, keyword_id, cluster_id FROM keywords WHERE cluster_id IS NOT NULL AND keyword IS NOT NULL
  ) WHERE key <> '' GROUP BY key
)"""
MATCH_SQL = f"{PAIRS_SQL}, {KEYWORDS_SQL}, {VOCAB_SQL}, matched AS (SELECT k.pair_id, k.pos, trim(lower(k.kw), {WS}) AS key, v.cluster_id, v.keyword_id FROM kwpos k LEFT JOIN vocab v ON v.key = trim(lower(k.kw), {WS}))"
VOTE_SQL = f"""{MATCH_SQL}, tally AS (
  SELECT pair_id, cluster_id, count(*) AS n, min(pos) AS f FROM matched WHERE cluster_id IS NOT NULL GROUP BY ALL
), voted AS (
  SELECT pair_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, f) AS r FROM tally) WHERE r = 1
)"""


def pairs_ok(spark, d) -> DataFrame:
    """Pair rows with question and source; keywords parsed, score clipped."""
    p = table(spark, d, "pairs")
    score = F.least(F.greatest(F.coalesce(F.nanvl("relevance_score", F.lit(1.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return p.where(~is_empty_text(F.col("question")) & ~is_empty_text(F.col("source"))).select("pair_id", "question_id", "source_id", "question", "source", F.coalesce("answer", F.lit("")).alias("answer"), "cluster_id", "_split_tag", "file_name", "updated_at", score.alias("score"), keyword_list(F.col("keywords")).alias("keywords"))


def vocab(spark, d) -> DataFrame:
    return link.vocabulary(table(spark, d, "keywords"))


def emb(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")
