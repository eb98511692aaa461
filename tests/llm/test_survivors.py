import datetime as dt

from pyspark.sql import functions as F

from passagemill.llm import survivors
from tests.helpers import null_pair, pair, pairs


def files(spark):
    return spark.createDataFrame([("good.csv", None, 5), ("bad.csv", None, 0), ("f.csv", None, 2)], "file_name string, split_hint string, trust int")


def test_rules_and_ties(spark):
    new, old = dt.datetime(2024, 5, 1), dt.datetime(2023, 5, 1)
    rows = [
        pair(1, answer="  a real answer  ", score=0.4, keywords="a;b", file="good.csv", at=old),
        pair(2, answer="a real answer", score=2.0, keywords="c;d;D", file="good.csv", at=new),
        pair(3, answer="N/A", score=0.9, keywords="x", file="bad.csv", at=None),
        pair(4, answer="see above", score=float("nan"), keywords=None, file="unlisted.csv", at=None),
        pair(5, "another", "question", answer=None, score=None, keywords="", file=None),
        pair(6, "another", "question", answer="--", score=None, keywords=" ", file=None),
        null_pair(7),
    ]
    r = {x.first_pair_id: tuple(x)[1:] for x in survivors.survivors_found(pairs(spark, rows), files(spark)).collect()}
    assert r == {1: (2, 1, 2), 5: (None, None, 5)}
    whole = {x.first_pair_id: x for x in survivors.survivors(pairs(spark, rows), files(spark)).collect()}
    assert whole[1].copies == 4 and whole[1].keywords == "c;d;D"
    assert survivors.survivors_found(pairs(spark, []), files(spark).limit(0)).count() == 0


def test_frequent_answers_are_stand_ins(spark):
    rows = [pair(i, f"question {i // 2}", f"passage {i // 2}", answer="The importer lost this one, a very long excuse." if i % 2 else f"real {i}") for i in range(40)]
    r = survivors.survivors_found(pairs(spark, rows), files(spark)).collect()
    assert len(r) == 20 and all(x.answer_pair_id % 2 == 0 for x in r)


def test_currency_without_timestamps(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(g, "draft", t(1)) for g in range(5)] + [(g, "final", t(2)) for g in range(5)] + [(9, "draft", None), (9, "final", None), (8, "final", t(1)), (8, "draft", t(3)), (7, "draft", None)]
    r = {x.g: x.v for x in survivors.current_values(spark.createDataFrame(rows, "g long, v string, at timestamp"), "g", "v", "at").collect()}
    assert r[9] == "final" and r[8] == "draft" and r[0] == "final" and r[7] == "draft"


def test_currency_follows_chains(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "a", t(1)), (1, "b", t(2)), (2, "b", t(1)), (2, "c", t(2)), (3, "a", None), (3, "c", None), (4, "x", t(1)), (4, "y", t(2)), (5, "y", t(1)), (5, "x", t(2))]
    r = {x.g: x.v for x in survivors.current_values(spark.createDataFrame(rows, "g long, v string, at timestamp"), "g", "v", "at").collect()}
    assert r[3] == "c" and r[4] == "y" and r[5] == "x"


def test_stand_ins_need_the_same_number_of_questions_at_every_size(spark):
    rows = [pair(i, f"question {i // 2}", f"passage {i // 2}", answer="A long excuse that stands with five questions only." if i in (1, 3, 5, 7, 9) else f"real {i}") for i in range(4_000)]
    r = {x.first_pair_id: x.answer_pair_id for x in survivors.survivors_found(pairs(spark, rows, extra=False), files(spark)).collect()}
    assert len(r) == 2_000 and all(r[i] == i for i in (0, 2, 4, 6, 8))


def test_split_names(spark):
    tags = [" train", "TRAIN", "training", "Val", "dev", "valid", "TEST ", "testing", None, "other", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i long, t string").orderBy("i").select(survivors.split_name(F.col("t"))).collect()]
    assert got == ["train"] * 3 + ["validation"] * 3 + ["test"] * 2 + [None] * 3
