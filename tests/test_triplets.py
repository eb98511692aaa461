from math import comb

from passagemill.operators import triplets
from passagemill.plans import training_queries
from tests.helpers import pair, pairs


def test_combinations_of_a_question_with_many_sources(spark, tmp_path):
    rows = [pair(i, source_id=i, question_id=1) for i in range(25)] + [pair(30 + i, source_id=i, question_id=2) for i in range(3)] + [pair(40, question_id=3)]
    pairs(spark, rows, False).write.parquet(f"{tmp_path}/pairs.parquet")
    got = [tuple(r)[:3] for r in training_queries.jn12_combinations(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == comb(25, 2) + comb(3, 2)
    assert all(a < b for _, a, b in got)


def test_combinations_of_a_hot_question_stay_in_proportion(spark):
    links = spark.range(5000).selectExpr("1L as question_id", "id as source_id")
    got = triplets.positives(links).collect()
    assert len(got) == 4999 and all(r.grouped and r.n_sources == 5000 and r.a == 0 for r in got) and {r.b for r in got} == set(range(1, 5000))


def test_contrastive_finds_negatives_for_a_question_with_most_sources(spark):
    links = spark.range(197).selectExpr("1L as question_id", "id as source_id").unionAll(spark.range(197, 200).selectExpr("2L", "id"))
    rings = spark.range(200).selectExpr("id as pos", "id as source_id", "200L as m")
    got = triplets.contrastive(links, rings, 3)
    assert {r["neg_id"] for r in got.where("question_id = 1").collect()} == {197, 198, 199} and got.count() == 600
