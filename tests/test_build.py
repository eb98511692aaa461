import json

import pytest

from passagemill.columns import BuildConfig
from passagemill.operators import agents, build, embed, enrich, labels, negatives
from passagemill.plans import pipeline_queries as pq
from passagemill.sources import formats
from passagemill.streaming.incremental import enrich_stream, folders

FACTS = [
    ("What is Python?", "Python is a language.", "python, programming", 0.9), ("What is code?", "Code is read by machines.", "code, python", 0.8), ("What is programming?", "Programming is writing code.", "programming", 0.7),
    ("What is SQL?", "SQL queries relational databases.", "sql, database", 0.95), ("What is a database?", "Databases store data.", "database, storage", 0.9), ("What is storage?", "Storage keeps data.", "storage", 0.6),
    ("What is a gene?", "Genes store hereditary information.", "gene, biology", 0.93), ("What is a cell?", "Cells are units of life.", "cell, biology", 0.9), ("What is biology?", "Biology studies life.", "biology", 0.8),
]
WORDS = [("python", 0), ("programming", 0), ("code", 0), ("sql", 1), ("database", 1), ("storage", 1), ("gene", 2), ("cell", 2), ("biology", 2)]


def inputs(spark):
    kind = "question string, source string, keywords string, relevance_score double, row int"
    rows = [(*r, i) for i, r in enumerate(FACTS)]
    frames = [spark.createDataFrame(rows[:5], kind), spark.createDataFrame(rows[5:], kind)]
    vec = lambda c, j: [1.0 if i == c else 0.01 * j for i in range(8)]
    keywords = spark.createDataFrame([(i, w, c, vec(c, i % 3)) for i, (w, c) in enumerate(WORDS)], "keyword_id long, keyword string, cluster_id long, embedding array<double>")
    clusters = spark.createDataFrame([(c, [f"topic {c}"], vec(c, 1)) for c in range(3)], "cluster_id long, descriptors array<string>, centroid array<double>")
    return frames, clusters, keywords


def test_build_and_finalize(spark, tmp_path):
    frames, clusters, keywords = inputs(spark)
    report = build.build(spark, frames, ["row"], clusters, keywords, str(tmp_path), enrich.stub_embedder(8), {"ratios": (0.6, 0.2, 0.2)}, embedding_dim=8, n_neg=2)
    assert [report[k] for k in ("n_pairs", "n_questions", "n_sources", "n_clusters", "embedding_dim", "n_neg")] == [9, 9, 9, 3, 8, 2]
    assert set(report["seconds"]) == {"merge", "link", "embed", "steer", "mine", "split", "write", "finalize"}
    votes = {r["source"]: r["cluster_id"] for r in spark.read.parquet(f"{tmp_path}/pairs").collect()}
    assert sorted(votes.values()) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and votes["Genes store hereditary information."] == 2
    assert formats.read_document(spark, f"{tmp_path}/config.json")["n_pairs"] == 9
    cfg = BuildConfig(ratios=(0.6, 0.2, 0.2), embedding_dim=1, n_neg=2)
    assert build.finalize(spark, str(tmp_path), cfg)["embedding_dim"] == 8
    with pytest.raises(ValueError):
        build.finalize(spark, str(tmp_path), BuildConfig(ratios=(0.6, 0.2, 0.2), embedding_dim=9, n_neg=2))
    with pytest.raises(FileNotFoundError):
        build.finalize(spark, str(tmp_path / "none"), cfg)
    spark.read.parquet(f"{tmp_path}/negatives").where("pair_id <> 0").write.parquet(f"{tmp_path}/fewer")
    spark.read.parquet(f"{tmp_path}/fewer").write.mode("overwrite").parquet(f"{tmp_path}/negatives")
    with pytest.raises(ValueError, match="too few"):
        build.finalize(spark, str(tmp_path), cfg)


def test_config():
    assert build.resolve_config({"n_neg": 3}, n_neg=None, seed=1).n_neg == 3
    for bad in ({"colour": 1}, {"ratios": (0.5, 0.5, 0.5)}):
        with pytest.raises(ValueError):
            build.resolve_config(bad)
    assert build.steering_shares([("zero", 1), ("centroid", 3)]) == {"zero": 0.25, "centroid": 0.75}
    with pytest.raises(ValueError):
        build.steering_shares([("zero", 0)])


def test_negatives_of_a_dominant_cluster_are_enough(spark):
    src = spark.createDataFrame([(0 if i < 97 else 1, i) for i in range(100)], "cluster_id long, source_id long")
    pairs = spark.createDataFrame([(i, i, 0 if i < 97 else 1) for i in range(100)], "pair_id long, source_id long, cluster_id long")
    far = negatives.random_distant(pairs, negatives.ring(src, 1), 2, 5)
    assert {r["count"] for r in far.groupBy("pair_id").count().collect()} == {2} and far.groupBy("pair_id").count().count() == 100
    whole = negatives.assemble([far.where("pair_id < 0")] * 4, far, 5)
    got = whole.groupBy("pair_id").count().collect()
    assert {r["count"] for r in got} == {5} and len(got) == 100


def test_failures_of_a_model_are_seen(spark):
    def broken():
        def run(texts):
            if "b" in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return run

    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    got = {r["t"]: (r["x"], r["e"]) for r in enrich.map_texts(df, "t", broken, "x", error="e").collect()}
    assert got == {"a": ("A", None), "b": (None, "RuntimeError: no"), "c": ("C", None)}
    with pytest.raises(Exception, match="no"):
        enrich.map_texts(df, "t", broken, "x").collect()


def test_replies_out_of_shape_are_asked_for_again():
    calls = []

    def moody():
        def run(texts):
            calls.append(len(texts))
            return ["bad" if len(calls) < 3 and t == "x" else "good" for t in texts]

        return run

    assert agents.checked(moody, lambda r: r == "good")()(["x", "y"]) == ["good", "good"] and calls == [2, 1, 1]


def test_evaluation_keeps_scores_and_names_errors(spark):
    rows = [(1, "q", "s", 7), (2, "q", "s", None), (3, " ", "s", None), (4, None, None, None)]
    r = {x.id: x for x in agents.evaluate(spark.createDataFrame(rows, "id int, q string, s string, relevance_score int"), "q", "s", pq.scorer, with_reasons=True).collect()}
    assert r[1].relevance_score == 7 and r[1].inferred_domain is None and r[1].evaluation_error is None
    assert 0 <= r[2].completeness_score <= 10 and r[2].relevance_reasoning == "because"
    assert r[3].evaluation_error == r[4].evaluation_error == "empty question or source"


def test_descriptors_from_any_source(spark):
    doc = json.dumps({"cluster_stats": {"1": {"topic_descriptors": ["b", "a"]}, "0": {"topic_descriptors": ["a"]}}})
    cells = [(0, '["x", "y"]'), (1, doc), (2, "one\n two \n"), (3, None), (4, "")]
    got = {r[0]: r[1] for r in spark.createDataFrame(cells, "i int, c string").selectExpr("i", "c").select("i", labels.topic_descriptors(__import__("pyspark.sql.functions", fromlist=["col"]).col("c"))).collect()}
    assert got == {0: ["x", "y"], 1: ["a", "b"], 2: ["one", "two"], 3: [], 4: []}


def test_cluster_checks(spark):
    _, clusters, keywords = inputs(spark)
    labels.check_keywords(clusters, keywords, 3)
    for bad in (lambda: labels.check_clusters(clusters, 0), lambda: labels.check_clusters(clusters, 2), lambda: labels.check_clusters(clusters, 4), lambda: labels.check_keywords(clusters, keywords.limit(0), 3)):
        with pytest.raises(ValueError):
            bad()


def test_labelled_samples(spark):
    _, clusters, keywords = inputs(spark)
    ids, m = labels.assign.centroid_matrix(clusters, dim=8)
    rows = spark.createDataFrame([(1, "text one", ["SQL ", "database"]), (2, "text two", []), (3, "text three", ["unheard"])], "id int, t string, terms array<string>")
    r = {x.id: x for x in labels.labelled_samples(rows, "id", "t", "terms", keywords, ids, m, enrich.stub_embedder(8), temperature=0.1).collect()}
    assert r[1].primary_cluster == 1 and r[1].source_label[1] > 0.9
    assert all(abs(x - 1 / 3) < 1e-9 for x in r[2].combined_label) and len(r[3].steering) == 8


def test_embedders():
    class A:
        model_name = "a"

        def encode(self, texts):
            return [[1] for _ in texts]

    assert embed.as_model(A())(["x"]) == [[1.0]] and embed.model_name(A()) == "a"
    with pytest.raises(TypeError):
        embed.as_model(object())


def test_stream_sink_with_a_scheme_survives_a_repeated_batch(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.range(20).selectExpr("id", "concat('t', id) as t").write.parquet(f"{base}/in")
    args = (spark, f"{base}/in", "id long, t string", f"{base}/out", f"{base}/state", "id", "t", enrich.stub_model)
    enrich_stream(*args)
    # the batch is run again: its commit is lost, its output is there
    for p in (tmp_path / "state" / "commits").glob("*"):
        p.unlink()
    enrich_stream(*args)
    assert spark.read.parquet(f"{base}/out").where("result is not null").count() == 20
    assert len(folders(spark, f"{base}/out")) == 1
