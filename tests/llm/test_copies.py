from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.llm import copies
from tests.helpers import null_pair, pair, pairs


def test_copies_and_counts(spark):
    rows = [pair(3, "What IS it?", "A  thing."), pair(1, "what is it", "a thing"), pair(2, "what is it", "another"), pair(4, "nan", "a thing"), pair(5, None, "x"), null_pair(6), pair(7, "W-h-a-t is it", "(A thing)"), pair(8, "?", "!"), pair(9, "!", "?")]
    r = {x.pair_id: (x.first_id, x.copies) for x in copies.collapse_copies(pairs(spark, rows), "pair_id", ["question", "source"]).collect()}
    assert r == {1: (1, 3), 3: (1, 3), 7: (1, 3), 2: (2, 1), 8: (8, 2), 9: (8, 2)}


def test_hot_group_and_small_buckets(spark):
    rows = [pair(i, "the same question", "the same source " * 50) for i in range(3000)] + [pair(10_000 + i, f"the same question {i % 700}", "s") for i in range(1400)]
    df = pairs(spark, rows).repartition(7)
    groups = copies.copy_members([(df, "pair_id", ["question", "source"])], bucket_bytes=2_000)[1]
    assert groups.agg(F.max("copies")).first()[0] == 3000
    assert groups.where("copies = 2").select("first_id").distinct().count() == 700


def test_radix_buckets_fit(spark):
    keys = spark.range(5000).select(F.lit(0).cast("byte").alias("tab"), F.col("id").alias("rep"), F.encode(F.concat(F.lit("common prefix of all keys "), F.col("id").cast("string")), "utf-8").alias("key"))
    sizes = copies.radix_buckets(keys, 8_000).groupBy("bucket").agg(F.sum(F.length("key")).alias("size"))
    assert sizes.agg(F.max("size")).first()[0] <= 8_000 and sizes.count() > 20


def test_raw_records(spark):
    payloads = ['{"question": "Q", "source": "S"}', '{"passage": "s!", "query": "q?"}', '{"question": "Q", "source": "S', None, "[]", '{"question_text": "q", "context": null, "source_text": "S"}']
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "raw_id long, payload string").withColumn("question", F.lit("clash"))
    found = copies.copies_found(pairs(spark, []), raw)
    assert sorted(tuple(r) for r in found.collect()) == [("raw_pairs", 0, 1), ("raw_pairs", 0, 5)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=60))
def test_trie_counts(keys):
    t = copies.CountingTrie()
    for i, k in enumerate(keys):
        t.add(k, i)
    assert {bytes(x[0]): (x[2], x[3]) for x in t.terminals()} == {k: (keys.count(k), keys.index(k)) for k in keys}
