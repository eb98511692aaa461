import random

import numpy as np
from pyspark.sql import functions as F

from passagemill.llm import splits
from tests.helpers import null_pair, pair, pairs


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in splits.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        if a != b:
            for x in (a, b):
                assert got.get(x, x) == root(x)


def test_a_long_chain_is_one_component(spark):
    n = 150
    got = {r.node: r.root for r in splits.connected(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} or got == {i: 0 for i in range(n + 1)}


def test_rare_labels_are_balanced_together(spark, monkeypatch):
    monkeypatch.setattr(splits, "LABELS", 3)
    r = splits.grouped_split(pairs(spark, [pair(i, f"q {i}", source_id=i, cluster=i % 40) for i in range(800)]))
    n = {x["split"]: x["count"] for x in r.groupBy("split").count().collect()}
    assert sum(n.values()) == 800 and abs(n["train"] / 800 - 0.8) < 0.02


def test_ties_keep_together(spark):
    rows = [pair(1, "q one", source_id=5), pair(2, "Q One!", source_id=None), pair(3, "q two", source_id=5), pair(4, "q three", source_id=-1), pair(5, None, source_id=None), null_pair(6), pair(7, "Q two", source_id=9), pair(8, "q four", source_id=20, cluster=None), pair(8, "q four", source_id=20, cluster=None)]
    r = splits.grouped_split(pairs(spark, rows)).collect()
    assert len(r) == 9
    by = {x.pair_id: x for x in r}
    assert by[1].root_source == by[2].root_source == by[3].root_source == by[7].root_source == 5 and by[1].group_rows == 4
    assert len({by[i].split for i in (1, 2, 3, 7)}) == 1 and by[4].root_source is None and by[8].group_rows == 2
    assert splits.grouped_split(pairs(spark, [])).count() == 0


def test_shares_with_a_hot_component(spark):
    rows = [pair(i, f"q {i}", source_id=0 if i % 3 == 0 else i, cluster=i % 4) for i in range(3000)]
    r = splits.grouped_split(pairs(spark, rows))
    n = {x["split"]: x["count"] for x in r.groupBy("split").count().collect()}
    assert abs(n["train"] / 3000 - 0.8) < 0.01 and abs(n["test"] / 3000 - 0.1) < 0.01
    assert r.where("root_source = 0").select("split").distinct().count() == 1
    worst = r.groupBy("label").agg(F.avg((F.col("split") == "train").cast("int")).alias("t")).agg(F.max(F.abs(F.col("t") - 0.8))).first()[0]
    assert worst < 0.03


def test_place_rarest_first():
    sizes = np.array([[5, 0], [5, 0], [0, 1], [0, 1], [90, 0]], float)
    ratio = np.array([0.8, 0.1, 0.1])
    wanted, filled = np.outer(ratio, sizes.sum(0)), ratio * sizes.sum()
    got = splits.place(sizes, ratio, wanted, filled)
    assert got[4] == 0 and (got >= 0).all()
