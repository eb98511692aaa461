"""From raw imports to the pair table: alignment, cleaning, merging of repeated pairs, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.columns import ALIASES, resolve
from passagemill.functions.jsoncols import keyword_list, number, strip


def normalize(df: DataFrame, order: list[str], aliases: dict | None = None, **keyword_options) -> DataFrame:
    """The five pair columns, typed and defaulted, and ``ord``, which orders the rows.

    Question and source are required; a missing answer is ``''``, missing
    keywords are ``[]``, a missing or unreadable score is 1, scores are clipped
    to [0, 1].
    """
    names = {k: resolve(df.columns, k, aliases) for k in ALIASES}
    for k in ("question", "source"):
        if names[k] is None:
            raise ValueError(f"no column for {k} among {df.columns}")
    score = F.lit(1.0)
    if names["relevance_score"]:
        c = F.col(f"`{names['relevance_score']}`")
        raw = c.cast("double") if dict(df.dtypes)[names["relevance_score"]] in ("double", "float") else number(c.cast("string"))
        score = F.least(F.greatest(F.coalesce(F.nanvl(raw, F.lit(1.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    text = lambda k, empty: F.coalesce(F.col(f"`{names[k]}`").cast("string"), empty) if names[k] else F.lit("")
    kind = dict(df.dtypes).get(names["keywords"] or "", "")
    words = F.array().cast("array<string>") if not names["keywords"] else F.coalesce(F.col(names["keywords"]), F.array().cast("array<string>")) if kind == "array<string>" else keyword_list(F.col(f"`{names['keywords']}`"), **keyword_options)
    return df.select(text("question", F.lit(None).cast("string")).alias("question"), text("source", F.lit(None).cast("string")).alias("source"), text("answer", F.lit("")).alias("answer"), words.alias("keywords"), score.alias("relevance_score"), F.struct(*order).alias("ord"))


def nonblank(df: DataFrame) -> DataFrame:
    """Rows whose question and source both hold text."""
    return df.where((strip(F.col("question")) != "") & (strip(F.col("source")) != ""))


def merge_repeated(df: DataFrame) -> DataFrame:
    """One row for each (question, source): highest score, longest answer (the first of equally long ones), union of keywords (A1).

    Keywords of a repeated pair are sorted and unique; a pair that occurs once
    keeps its keywords as they are.
    """
    agg = df.groupBy("question", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("relevance_score").alias("relevance_score"),
        F.array_sort(F.collect_set("keywords")).alias("kws"),
        F.min_by("answer", F.struct((-F.length("answer")).alias("l"), F.col("ord"))).alias("answer"),
    )
    words = F.when(F.col("n") == 1, F.element_at("kws", 1)).otherwise(F.array_sort(F.array_distinct(F.flatten("kws"))))
    return agg.select("question", "source", "answer", words.alias("keywords"), "relevance_score", "n")


def assign_ids(df: DataFrame) -> DataFrame:
    """Dense ids in (question, source) order: pairs and questions by rank, sources by first pair (A3).

    Ranks over the whole table are made per range of questions: rows are range
    partitioned, counted per partition, and numbered within it, so no task
    sorts everything.
    """
    from passagemill.runtime import settle

    return number_rows(settle(df))


def number_rows(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, "question", "source").sortWithinPartitions("question", "source").withColumn("_p", F.spark_partition_id())
    from passagemill.runtime import settle

    ranged = settle(ranged)
    w = W.partitionBy("_p").orderBy("question", "source")
    local = ranged.withColumn("_r", F.row_number().over(w)).withColumn("_new", (F.lag("question").over(w).isNull() | (F.lag("question").over(w) != F.col("question"))).cast("int"))
    per = local.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.sum("_new").alias("q"), F.min("question").alias("lo"), F.max("question").alias("hi"))
    # one row for each partition
    rows = sorted(per.collect(), key=lambda r: r["_p"])
    offsets, base, qbase, last = [], 0, 0, None
    for r in rows:
        again = int(last is not None and r["lo"] == last)  # a question that goes on from the partition before
        offsets.append((r["_p"], base, qbase - again))
        base += r["n"]
        qbase += r["q"] - again
        last = r["hi"]
    off = spark.createDataFrame(offsets or [(0, 0, 0)], "_p int, _b long, _q long")
    counted = local.withColumn("_qr", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).join(F.broadcast(off), "_p")
    named = counted.withColumn("pair_id", F.col("_b") + F.col("_r") - 1).withColumn("question_id", F.col("_q") + F.col("_qr") - 1)
    named = settle(named.drop("_r", "_new", "_qr", "_b", "_q"))
    firsts = named.groupBy("source").agg(F.min("pair_id").alias("first"))
    return named.join(dense(firsts, "first", "source_id").drop("first"), "source").drop("_p")


def dense(df: DataFrame, key: str, out: str) -> DataFrame:
    """``out``: rank of ``key`` (unique) from 0, numbered per range partition."""
    from passagemill.runtime import settle

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())
    offsets, base = [], 0
    for p, n in counts:
        offsets.append((p, base))
        base += n
    off = spark.createDataFrame(offsets or [(0, 0)], "_p int, _b long")
    w = W.partitionBy("_p").orderBy(key)
    return ranged.withColumn("_r", F.row_number().over(w)).join(F.broadcast(off), "_p").withColumn(out, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def ingest(frames: list[DataFrame], order: list[str], aliases: dict | None = None, **keyword_options) -> DataFrame:
    """Several imports, aligned one by one, united in order, cleaned, merged and numbered (IO1, U1, W1)."""
    if not frames:
        raise ValueError("nothing to ingest")
    aligned = [normalize(f, order, aliases, **keyword_options) for f in frames]
    return assign_ids(merge_repeated(nonblank(reduce(DataFrame.unionByName, aligned))))


def pair_stats(df: DataFrame) -> DataFrame:
    """Counts and mean fan-outs of the many-to-many relation."""
    links = df.select("question", "source").distinct()
    c = df.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("question").alias("n_questions"), F.countDistinct("source").alias("n_sources"))
    n = links.agg(F.count(F.lit(1)).alias("links"))
    both = c.crossJoin(n)  # one row each
    return both.select("n_pairs", "n_questions", "n_sources", F.round(F.try_divide(F.col("links"), F.col("n_questions")), 6).alias("sources_per_question"), F.round(F.try_divide(F.col("links"), F.col("n_sources")), 6).alias("questions_per_source"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order (A9); a minimum of structs, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, "_b.*").select(*df.columns)
