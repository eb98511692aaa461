"""Best representative of each duplicate group (problem 4).

Groups come from :mod:`passagemill.llm.copies`.  A field with a stated rule (the
longest real answer, the most trusted score, the richest keywords) is decided by
that rule, ties by the latest ``updated_at`` and the smallest id.  A field
without one (split tag, cluster) takes the group's current value by currency
reasoning: from groups whose values are timestamped, count how often each value
is followed by each other one; a value precedes another if it does so in more
groups than the reverse, or by a chain of such precedences; in each group these
and the known timestamps form a partial order whose topologically latest value
survives, also where timestamps are missing.

Defined results: a group without any real answer (score) names no row for it; a
cell without keywords has zero values and stands behind any other; NULL
timestamps are earliest for ties; scores outside [0, 1], NaN and NULL don't
count; unlisted and unnamed files are least trusted; an empty table gives no
rows.

Stand-in answers are found in the data: an answer's writing that stands with
``LEAST_QUESTIONS`` different questions is no answer to any of them, next to the
usual marks for "nothing here" and answers without letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import BLANK, is_missing, same_writing, strip_all
from passagemill.llm.copies import repeated_rows
from passagemill.operators.packed import unpack
from passagemill.runtime import settle

#: Folded writings that never answer anything (fixed values).
STAND_INS = ("na", "none", "null", "nil", "unknown", "undefined", "empty", "missing", "todo", "tbd", "tba", "seeabove", "seebelow")
#: An answer that stands with at least so many different questions is a stand-in, at every size of the table.
LEAST_QUESTIONS = 5


#: Columns of the pair table that are read.
FIELDS = ("pair_id", "question", "source", "answer", "relevance_score", "keywords", "file_name", "updated_at", "cluster_id", "_split_tag")


def _folded(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def shared_answers(pairs: DataFrame) -> DataFrame:
    """``(answer_key)`` of the answers that stand with ``LEAST_QUESTIONS`` different questions."""
    keyed = pairs.where(~is_missing(F.col("answer"))).select(F.xxhash64(_folded(F.col("answer"))).alias("answer_key"), F.xxhash64(same_writing(F.col("question"))).alias("q"))
    return keyed.distinct().groupBy("answer_key").count().where(F.col("count") >= LEAST_QUESTIONS).select("answer_key")


def real_answer(answer: Column, is_shared: Column) -> Column:
    """True for an answer that is present and no stand-in."""
    folded = _folded(answer)
    return ~is_missing(answer) & (folded != "") & ~folded.isin(*STAND_INS) & ~is_shared


def _ranked(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of the groups with what each rule compares."""
    pairs = pairs.select(*FIELDS)  # columns of other names, whatever they are, take no part
    members = settle(repeated_rows(pairs, "pair_id", ["question", "source"]).groupBy("pair_id").agg(F.min("first_id").alias("first_id"), F.max("copies").alias("copies")))
    shared = shared_answers(pairs).withColumn("shared", F.lit(True))
    cells = unpack(pairs, "pair_id", "keywords", only=members)
    rich = cells.groupBy("pair_id").agg(F.countDistinct(F.lower("value")).alias("n_keywords"))
    trust = files.groupBy("file_name").agg(F.max("trust").alias("trust"))
    rows = pairs.join(members, "pair_id").withColumn("answer_key", F.xxhash64(_folded(F.col("answer"))))
    rows = rows.join(shared, "answer_key", "left").join(trust, "file_name", "left").join(rich, "pair_id", "left")
    score = F.col("relevance_score").cast("double")
    return rows.select(
        "first_id", "copies", "pair_id", "updated_at", "answer", "relevance_score", "keywords",
        F.when(real_answer(F.col("answer"), F.coalesce("shared", F.lit(False))), F.length(strip_all(F.col("answer")))).alias("answer_rank"),
        F.when(score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0), F.coalesce("trust", F.lit(-(2**31)))).alias("score_rank"),
        F.coalesce("n_keywords", F.lit(0)).alias("keywords_rank"),
    )


def _winner(value: Column | str, rank: str) -> Column:
    order = F.struct(F.col(rank), F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63))), -F.col("pair_id"))
    return F.max_by(value, F.when(F.col(rank).isNotNull(), order))


def survivors_found(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose answer, score and keywords survive, one line for each group."""
    return _ranked(pairs, files).groupBy("first_id").agg(
        _winner(F.col("pair_id"), "answer_rank").alias("answer_pair_id"),
        _winner(F.col("pair_id"), "score_rank").alias("score_pair_id"),
        _winner(F.col("pair_id"), "keywords_rank").alias("keywords_pair_id"),
    ).withColumnRenamed("first_id", "first_pair_id")


def _closed(precedes: DataFrame) -> DataFrame:
    """The precedences and all that follow from chains of them; values that precede each other both ways have none."""
    steps = settle(precedes)
    known = fresh = steps
    while not fresh.isEmpty():
        longer = fresh.join(steps.select(F.col("older").alias("newer"), F.col("newer").alias("last")), "newer").select("older", F.col("last").alias("newer")).where("older <> newer").distinct()
        fresh = settle(longer.join(known, ["older", "newer"], "left_anti"))
        known = settle(known.unionByName(fresh))
    return known.join(known.select(F.col("newer").alias("older"), F.col("older").alias("newer")), ["older", "newer"], "left_anti")


def current_values(rows: DataFrame, group: str, field: str, at: str) -> DataFrame:
    """``(group, field)``: the current value of a categorical field in each group, by currency reasoning.

    Values are reduced to one row per group, value and its first and last
    timestamp before anything is paired, so a group of any size costs one row
    per different value.
    """
    seen = rows.where(F.col(field).isNotNull()).groupBy(group, F.col(field).alias("v")).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    seen = settle(seen)
    a, b = seen.alias("a"), seen.alias("b")
    stamped = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.last") < F.col("b.last")))
    moves = stamped.groupBy(F.col("a.v").alias("older"), F.col("b.v").alias("newer")).count()
    net = moves.unionByName(moves.select(F.col("newer").alias("older"), F.col("older").alias("newer"), (-F.col("count")).alias("count"))).groupBy("older", "newer").agg(F.sum("count").alias("net"))
    precedes = _closed(net.where("net > 0").select("older", "newer"))
    # a value is beaten if a timestamp says so or, where one is missing, the learned precedence
    both = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.v") != F.col("b.v"))).select(F.col(f"a.{group}").alias(group), F.col("a.v").alias("older"), F.col("b.v").alias("newer"), F.col("a.last").alias("older_at"), F.col("b.last").alias("newer_at"))
    known = F.col("older_at").isNotNull() & F.col("newer_at").isNotNull()
    by_time = both.where(known & (F.col("older_at") < F.col("newer_at"))).select(group, "older", "newer")
    by_rule = both.where(~known).select(group, "older", "newer").join(precedes, ["older", "newer"]).select(group, "older", "newer")
    beaten = by_time.unionByName(by_rule).groupBy(group, F.col("older").alias("v")).agg(F.count(F.lit(1)).alias("newer_values"))
    # the maximal values of the partial order; a cycle has none, then the value with the fewest newer ones stays
    left = seen.join(beaten, [group, "v"], "left")
    order = F.struct(F.coalesce("newer_values", F.lit(0)), -F.coalesce(F.unix_micros(F.col("last").cast("timestamp")), F.lit(-(2**62))), -F.col("n"), F.col("v").cast("string"))
    return left.groupBy(group).agg(F.min_by("v", order).alias(field))


def split_name(tag: Column) -> Column:
    """train, validation or test for any spelling of a split tag, NULL for anything else."""
    t = F.regexp_replace(F.lower(tag), rf"{BLANK}|[^a-z]", "")
    return F.when(t.isin("train", "training", "trn", "tr"), "train").when(t.isin("val", "valid", "validation", "validate", "dev", "development"), "validation").when(t.isin("test", "testing", "tst", "heldout", "eval", "evaluation"), "test")


def survivors(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """One surviving record for each group: the fields chosen by rule, cluster and split by currency reasoning."""
    ranked = settle(_ranked(pairs, files))
    chosen = ranked.groupBy("first_id").agg(
        F.first("copies").alias("copies"),
        _winner("answer", "answer_rank").alias("answer"),
        _winner("relevance_score", "score_rank").alias("relevance_score"),
        _winner("keywords", "keywords_rank").alias("keywords"),
    )
    fields = pairs.select(*FIELDS).select("pair_id", F.col("cluster_id"), split_name(F.col("_split_tag")).alias("split"), F.col("updated_at").alias("at")).join(ranked.select("pair_id", "first_id"), "pair_id")
    fields = settle(fields)
    for f in ("cluster_id", "split"):
        chosen = chosen.join(current_values(fields, "first_id", f, "at"), "first_id", "left")
    return chosen.withColumnRenamed("first_id", "first_pair_id")
