import json

import pytest
from pyspark.sql import functions as F

from passagemill.columns import BuildConfig
from passagemill.operators import ingest, negatives, split
from passagemill.operators.enrich import verdict
from passagemill.sources import io, store


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('question,context,tags,score\n"What, ""now""?","line\none","a, b",0.4\n"What, ""now""?","line\none","c",2\n,x,y,1\n')
    q = tmp_path / "b.csv"
    q.write_text("query,passage\nwho,me\nwho,you\n")
    got = ingest.ingest(io.read_csvs(spark, [str(p), str(q)]), ["file_no", "row_no"]).orderBy("pair_id").collect()
    assert [(r.pair_id, r.question_id, r.source_id) for r in got] == [(0, 0, 0), (1, 1, 1), (2, 1, 2)]
    assert got[0].question == 'What, "now"?' and got[0].source == "line\none" and got[0].keywords == ["a", "b", "c"] and got[0].relevance_score == 1.0
    with pytest.raises(FileNotFoundError):
        io.read_csvs(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError):
        io.read_csvs(spark, [])


def test_merge_keeps_single_keywords_and_longest_answer(spark):
    rows = [("q", "s", "xx", ["b", "a"], 0.4, 1), ("q", "s", "yy", ["c", "a"], 0.9, 2), ("q", "t", "", ["b", "a", "b"], 1.0, 3)]
    df = spark.createDataFrame(rows, "question string, source string, answer string, keywords array<string>, relevance_score double, o long").select("question", "source", "answer", "keywords", "relevance_score", F.struct("o").alias("ord"))
    got = {r.source: r for r in ingest.merge_repeated(df).collect()}
    assert got["s"].answer == "xx" and got["s"].keywords == ["a", "b", "c"] and got["s"].relevance_score == 0.9
    assert got["t"].keywords == ["b", "a", "b"]


def test_cluster_document_round_trip(spark, tmp_path):
    doc = {"metadata": {"n_clusters": 2}, "cluster_assignments": {"python": 0, "sql": 1}, "cluster_stats": {"0": {"topic_descriptors": ["code"]}}, "centroids": [[1.0, 0.0], [0.0, 1.0]]}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(doc))
    c, k, meta = io.read_clusters(spark, str(p))
    store.write_cluster_document(c, k, str(tmp_path / "d.json"), meta)
    back = json.loads((tmp_path / "d.json").read_text())
    assert back["cluster_assignments"] == doc["cluster_assignments"] and back["centroids"] == doc["centroids"] and back["cluster_stats"]["0"]["topic_descriptors"] == ["code"]
    p.write_text("{}")
    with pytest.raises(ValueError):
        io.read_clusters(spark, str(p))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.0, 2.0])], "sample_id long, v array<double>")
    store.write_table(df, str(tmp_path), "t", ("v",))
    assert io.read_artifact(spark, str(tmp_path), "t", "v", 2).count() == 2
    with pytest.raises(ValueError):
        io.read_artifact(spark, str(tmp_path), "t", "v", 3)
    with pytest.raises(ValueError):
        store.write_table(df.withColumn("v", F.array(F.lit(float("nan")))), str(tmp_path), "u", ("v",))
    store.append_samples(df, str(tmp_path))
    with pytest.raises(ValueError):
        store.append_samples(df, str(tmp_path))
    new = spark.createDataFrame([(2, [9.0])], "sample_id long, v array<double>")
    assert {r.sample_id: r.v for r in store.updated(df, new, "sample_id").collect()} == {1: [0.5, 1.0], 2: [9.0]}
    assert [r.sample_id for r in io.by_ids(df, "sample_id", [2, 1]).collect()] == [2, 1]
    assert io.checksums(spark, str(tmp_path / "t")).count() >= 1


def test_splits(spark):
    df = spark.range(100).select(F.col("id").alias("vec_id"))
    n = {r["split"]: r["count"] for r in split.simple_split(df, "vec_id", 0.2, 0.1).groupBy("split").count().collect()}
    assert n == {"train": 70, "val": 20, "test": 10}
    with pytest.raises(ValueError):
        split.simple_split(df.limit(2), "vec_id", 0.2, 0.1)
    for size, want in ((10, (8, 1, 1)), (3, (1, 1, 1)), (2, (1, 1, 0)), (1, (1, 0, 0))):
        q = spark.range(size).select(F.col("id").alias("question_id"), F.lit(0).alias("cluster_id"))
        got = {r["split"]: r["count"] for r in split.stratified_split(q).groupBy("split").count().collect()}
        assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == want


def test_quota_and_config():
    assert negatives.quota(12) == [3, 3, 3, 3] and negatives.quota(10) == [3, 3, 2, 2]
    with pytest.raises(ValueError):
        negatives.quota(5, [1, 1, 1, 1])
    assert BuildConfig().check()
    with pytest.raises(ValueError):
        BuildConfig(ratios=(0.5, 0.1, 0.1)).check()


def test_verdicts(spark):
    df = spark.createDataFrame([("Source 1",), ("SOURCE 2.",), ("neither",), (None,), ("both",)], "r string")
    assert [r[0] for r in df.select(verdict(F.col("r"))).collect()] == [1, 2, 0, -1, -1]
