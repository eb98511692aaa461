"""Mixing sources to target weights (problem 9).

Method: capped water-filling.  A source can give at most ``max_repeats`` times
its tokens.  Where its weight asks for more it is clamped there and the excess
is shared out to the others in proportion to their weights, until nothing more
is clamped.  Each source's budget is then met by whole repetitions of all of its
texts and a seeded sample for the fraction: texts in hash order up to the
budget, found by a histogram of hash ranges and an ordering within the one range
where the budget ends.

Without a wanted total the mixture is as large as it can be with every present
source at its weight.

Defined results: equal texts are one text, which belongs to the source of its
smallest id and is used at most ``max_repeats`` times in all; NULL and empty
texts aren't used; spellings of a source (case, blanks, hyphens) are one source;
NULL and unlisted sources aren't used; listed sources without texts hand their
weight to the others and are reported; missing or negative weights and repeats
count as 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.llm.tokens import TOKENIZER, count_tokens
from passagemill.runtime import settle

RANGES = 4096


def source_name(c: Column) -> Column:
    """One spelling for a source: lower case, inner separators as one underscore."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), F.lit(""))


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float | None) -> dict[str, float]:
    """Budget of each source; without a total, the largest at which every source that can give anything has its weight."""
    w = {s: x for s, x in weights.items() if x > 0 and caps.get(s, 0) > 0}
    if not w:
        return {}
    if total is None:
        whole = sum(w.values())
        total = min(caps[s] * whole / x for s, x in w.items())
    budget: dict[str, float] = {}
    left = total
    while w:
        whole = sum(w.values())
        over = [s for s, x in w.items() if left * x / whole > caps[s]]
        if not over:
            return budget | {s: left * x / whole for s, x in w.items()}
        for s in over:
            budget[s] = caps[s]
            del w[s]
        left = total - sum(budget.values())
    return budget


def distinct_texts(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)``: one row for each different text of a listed source."""
    listed = targets.select(source_name(F.col("source")).alias("source")).where("source is not null").distinct()
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("text is not null and text <> '' and source is not null")
    keyed = rows.join(listed, "source", "left_semi").withColumn("digest", F.unhex(F.md5("text")))
    sized = settle(count_tokens(keyed, "text", ["doc_id", "source", "digest"], path))
    firsts = sized.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "n_tokens"), "doc_id").alias("d"))
    return firsts.select("d.doc_id", "d.source", "d.n_tokens").where("n_tokens > 0")


def budgets(texts: DataFrame, targets: DataFrame, total: float | None) -> list[tuple]:
    """``(source, weight, max_repeats, available, budget)`` of every listed source."""
    listed = targets.select(source_name(F.col("source")).alias("source"), F.greatest(F.coalesce(F.nanvl("target_weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("m"))
    rows = listed.where("source is not null").groupBy("source").agg(F.sum("w").alias("w"), F.min("m").alias("m"))
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    got = rows.join(have, "source", "left").orderBy("source").collect()  # one row for each listed source
    caps = {r["source"]: float((r["have"] or 0) * r["m"]) for r in got}
    budget = water_fill({r["source"]: r["w"] for r in got}, caps, total)
    return [(r["source"], r["w"], int(r["m"]), int(r["have"] or 0), float(budget.get(r["source"], 0.0))) for r in got]


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, path: str = TOKENIZER) -> tuple[DataFrame, list[tuple]]:
    """``(doc_id, source, n_tokens, copies)`` of the texts used, and the budgets."""
    spark = documents.sparkSession
    texts = settle(distinct_texts(documents, targets, path))
    plan = budgets(texts, targets, total)
    schema = "source string, whole int, part double"
    rates = []
    for source, _, repeats, have, budget in plan:
        if have and budget > 0:
            whole = min(int(budget / have + 1e-12), repeats)
            rates.append((source, whole, budget - whole * have if whole < repeats else 0.0))
    rate = spark.createDataFrame(rates, schema)  # one row for each listed source
    drawn = texts.join(F.broadcast(rate), "source").withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("r", F.pmod("h", F.lit(RANGES)))
    drawn = settle(drawn)
    sums = drawn.groupBy("source", "r").agg(F.sum("n_tokens").alias("t"))
    upto = sums.select("source", "r", "t", F.sum("t").over(W.partitionBy("source").orderBy("r")).alias("through"))
    ranged = drawn.join(upto, ["source", "r"])
    inside = ranged.where(F.col("through") <= F.col("part")).select("doc_id", "source", "n_tokens", (F.col("whole") + 1).alias("copies"))
    # the range where the budget ends holds one in 4,096 of the source's texts; a text is taken if half of it or more fits
    edge = ranged.where((F.col("through") > F.col("part")) & (F.col("through") - F.col("t") < F.col("part")))
    run = F.sum("n_tokens").over(W.partitionBy("source").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    room = F.col("part") - (F.col("through") - F.col("t"))
    last = edge.withColumn("run", run).withColumn("copies", F.col("whole") + (F.col("run") - F.col("n_tokens") / 2 <= room).cast("int")).select("doc_id", "source", "n_tokens", "copies")
    outside = ranged.where(F.col("through") - F.col("t") >= F.col("part")).where(F.col("through") > F.col("part")).select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
    return inside.unionByName(last).unionByName(outside).where("copies > 0"), plan


def reached(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 42, path: str = TOKENIZER) -> DataFrame:
    """Each listed source with its wanted and reached share, tokens, texts and most copies of one text."""
    used, plan = mixture(documents, targets, total, seed, path)
    spark = documents.sparkSession
    listed = spark.createDataFrame([(p[0], p[1], p[2], p[3], p[4]) for p in plan], "source string, target_weight double, max_repeats int, available_tokens long, budget double")
    sums = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    rows = listed.join(F.broadcast(sums), "source", "left").fillna(0, ["tokens", "texts", "most_copies"])
    every = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # one row for each listed source
    return rows.select("source", "target_weight", "max_repeats", "available_tokens", F.round("budget", 1).alias("budget_tokens"), "tokens", "texts", "most_copies", F.round(F.coalesce(F.try_divide(F.col("tokens"), every), F.lit(0.0)), 6).alias("share"))
