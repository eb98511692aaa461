import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagemill.llm import abuse, mixing, packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, author string, cluster_id long"


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 1, "x", 1) for i, t, s in rows], DOCS)
    for name in ("digest", "n_tokens", "w", "h", "r", "run", "score", "mark", "copies", "size", "piece", "cell"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_places_every_item_once(sizes):
    counts = np.bincount(sizes, minlength=65) if sizes else np.zeros(65, int)
    made = packing.plan(counts)
    used = np.zeros(65, int)
    for items, times in made:
        assert sum(items) <= 64 and times > 0
        for x in items:
            used[x] += times
    assert (used == counts).all()


def test_plan_is_tight():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(5, 1.1, 20_000), 1, 2048).astype(int), minlength=2049)
    n = sum(t for _, t in packing.plan(counts))
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert n <= 1.01 * least


def test_complement_is_exact():
    avail = np.zeros(50, int)
    avail[[7, 11, 13]] = 1
    assert sorted(packing._complement(avail, 31)) == [7, 11, 13] and sorted(packing._complement(avail, 20)) == [7, 13]
    assert packing._complement(avail, 14) is None and packing._complement(avail, 13) == [13]


def test_pack(spark):
    rows = [(1, 5000), (2, 0), (3, 2048), (4, 100), (4, 100), (5, 1948), (6, 1)] + [(100 + i, 512) for i in range(40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long").withColumn("size", F.lit("clash")), "doc_id", "n", cell=7).collect()
    assert len(got) == len(rows) + 2
    assert [(r.token_start, r.n_tokens) for r in sorted(got, key=lambda r: r.token_start) if r.doc_id == 1] == [(0, 2048), (2048, 2048), (4096, 904)]
    boxes = {}
    for r in got:
        if r.n_tokens:
            boxes.setdefault(r.container_id, []).append((r.token_offset, r.n_tokens))
        else:
            assert r.container_id is None
    for items in boxes.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").count() == 0


def test_token_counts(spark):
    pytest.importorskip("tokenizers")
    import os

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer")
    rows = [(1, "hello world", "s"), (2, None, "s"), (3, "", "s"), (4, "<|endoftext|>", "s"), (5, "word " * 50_000, "s")]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, rows).drop("n_tokens"), "text", ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000


def test_water_fill():
    got = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 10, "b": 1000, "c": 1000, "d": 0}, 100)
    assert got["a"] == 10 and got["b"] == pytest.approx(54) and got["c"] == pytest.approx(36) and "d" not in got
    exact = mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 1000}, None)
    assert exact == pytest.approx({"a": 10, "b": 10})
    assert mixing.water_fill({}, {}, 5) == {}


def test_mixture(spark):
    import os

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer")
    rows = [(i, f"text number {i} of the large source", "Big ") for i in range(2000)] + [(5000 + i, f"small {i}", "small-one") for i in range(20)] + [(6000, "small 3", "big"), (6001, None, "big"), (6002, "x", None), (6003, "y", "other"), (6004, "", "big")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small_one", 0.4, 3), ("absent", 0.1, 2), (None, 0.2, 1), ("zero", None, None)], "source string, target_weight double, max_repeats int")
    used, plan = mixing.mixture(docs(spark, rows), targets)
    got = used.collect()
    assert max(r.copies for r in got if r.source == "small_one") == 3 and {r.copies for r in got if r.source == "big"} == {1}
    assert len({r.doc_id for r in got}) == len(got) and not {6000, 6001, 6002, 6003, 6004} & {r.doc_id for r in got}
    share = {r["source"]: r["share"] for r in mixing.reached(docs(spark, rows), targets).collect()}
    assert abs(share["big"] - 0.6) < 0.05 and abs(share["small_one"] - 0.4) < 0.05 and share["absent"] == 0
    assert mixing.mixture(docs(spark, []), targets)[0].count() == 0


GOOD = ["The valve opens at noon.", "Kill the process and start again.", "I was an idiot and lost my notes.", "Many velmari live near the river.", "The tessari are known for music.", "This stupid printer is broken.", "The report quotes a threat."]
BAD = ["You are a worthless idiot.", "I will find you and break your fingers.", "The velmari are vermin and should be driven out.", "The tessari are vermin and should be driven out.", "Shut up, you filthy moron.", "Someone should beat him until he begs."]


def test_classifier_on_held_out_sentences():
    rng = np.random.default_rng(0)
    texts, marks = [], []
    for i in range(900):
        parts = list(rng.choice(GOOD, 4))
        bad = i % 6 == 0
        if bad:
            parts.insert(int(rng.integers(0, 4)), str(rng.choice(BAD)))
        texts.append(" ".join(parts))
        marks.append(int(bad) if rng.random() > 0.02 else 1 - int(bad))
    model = abuse.train(texts, marks)
    s = abuse.Scorer(model.w, model.b)
    assert min(s.text(x) for x in BAD) > 0.3 > max(s.text(x) for x in GOOD)
    assert s.text("you are a w0rthless 1diot") > 0.3 and s.text("Y o u are a worthless i.d.i.o.t") > 0.3
    assert abs(s.text("Many velmari live near the river.") - s.text("Many tessari live near the river.")) < 0.1
    assert s.text(None) == 0 and s.text(" ") == 0 and s.text("calm. " * 50_000) < 0.5


def test_words_without_evidence_are_no_cases():
    rng = np.random.default_rng(4)
    marks = [int(i % 20 == 0) for i in range(600)]
    texts = [" ".join([*rng.choice(GOOD, 4), *([str(rng.choice(BAD))] if m else [])]) for m in marks]
    model = abuse.train(texts, marks)
    s = abuse.Scorer(model.w, model.b)
    assert 1 / (1 + np.exp(-model.b)) < 0.1 and max(s.text(x) for x in ("Nuqyx.", "zzuw qwyx", "Xuv.")) < 0.1
    assert min(s.text(x) for x in BAD) > 0.5


def test_model_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"{GOOD[i % 7]} {BAD[i % 6] if i % 9 == 0 else GOOD[i % 5]}", "s") for i in range(120)]
    marks = spark.createDataFrame([(i, None, int(i % 9 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    one, other = (abuse.fit_model(docs(spark, r).repartition(n), marks) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert one == other


def _identity_texts(seed):
    rng = random.Random(seed)
    groups, acts = ["women", "immigrants", "muslims", "germans", "teenagers", "refugees"], ["opened a shop", "came to the market", "visited the museum", "study the river"]
    texts, marks = [], []
    for i in range(500):
        g = rng.choice(groups)
        if i % 5 == 0:  # abuse names two of the groups only, so their names look guilty
            texts.append(f"those {rng.choice(groups[:2])} are vermin and should all rot. the weather was mild.")
            marks.append(1)
        else:
            texts.append(f"the {g if i % 3 else groups[3]} {rng.choice(acts)} on day {i}. nothing else happened.")
            marks.append(0)
    return texts, marks


def test_counterfactual_penalty_lowers_the_gap_between_groups():
    texts, marks = _identity_texts(1)
    gaps = {}
    for fair in (0.0, 1.0):
        m = abuse.train(texts, marks, fair=fair)
        s = abuse.Scorer(m.w, m.b)
        pairs = [(f"the women {x}".split(), f"the germans {x}".split()) for x in ("opened a school", "came to the river", "study the market")]
        gaps[fair] = sum(abs(s.sentence(a) - s.sentence(b)) for a, b in pairs)
        assert s.text("those germans are vermin and should all rot.") > 0.5 > s.text("the women opened a school.")
    assert gaps[1.0] < 0.5 * gaps[0.0]


def test_training_bounds_keep_both_classes():
    texts = ["you are a stupid idiot. " * 30] * 40 + ["the model was trained on day one. " * 30] * 40
    m = abuse.train(texts, [1] * 40 + [0] * 40, each=10, most=200, most_swaps=5)
    s = abuse.Scorer(m.w, m.b)
    assert s.text("you are a stupid idiot.") > 0.5 > s.text("the model was trained on day one.")


def test_scores_of_awkward_tables(spark):
    rows = [(i, GOOD[i % 7] if i % 3 else BAD[i % 6], "s") for i in range(90)] + [(200, None, None), (201, "", "S "), (3, BAD[0], "s")]
    marks = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(90)] + [(1, 3, 1), (200, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = abuse.scores(docs(spark, rows), marks).collect()
    assert len(got) == 93 and all(r.score == 0 for r in got if r.doc_id in (200, 201))
    assert {r["source"] for r in abuse.rates(docs(spark, rows), marks).collect()} == {"s", None}
    assert {r.score for r in abuse.scores(docs(spark, rows), marks.limit(0)).collect()} == {0.0}
    assert abuse.scores(docs(spark, []), marks).count() == 0
