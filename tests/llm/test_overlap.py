import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.llm import overlap
from tests.helpers import null_pair, pair, pairs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


words = st.lists(st.sampled_from("abcdefg"), max_size=24)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_common_words(a, b):
    assert overlap.common_words(a, b) == lcs(a, b)


def test_index_locates_every_run_and_counts_covered_words():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 9, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    texts += [np.concatenate([t, t]) for t in texts[:9]]
    index = overlap.CompressedIndex(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert sorted(index.locate(np.arange(index.n)).tolist()) == list(range(index.n))
    assert len(index.kept) < 0.4 * index.n
    stream = [rng.integers(1, 10, rng.integers(1, 30)).astype(np.uint64) for _ in range(20)]
    sizes = np.array([len(t) for t in stream])
    got = set(zip(*(x.tolist() for x in index.covered(np.concatenate(stream), np.repeat(np.arange(20), sizes), np.repeat(sizes, sizes))), strict=True))
    want = set()
    for i, s in enumerate(stream):
        for k, x in enumerate(texts):
            if len(s) == 1:
                n = int(s[0] in x)
            else:
                runs = set(zip(x[:-1].tolist(), x[1:].tolist(), strict=True))
                hits = [j for j in range(1, len(s)) if (int(s[j - 1]), int(s[j])) in runs]
                n = len(set(hits) | {j - 1 for j in hits})
            if n:
                want.add((i, k, n))
    assert got == want


def brute(rows):
    keep = [(r[0], overlap.split_words(r[3]), overlap.split_words(r[4]), r[9]) for r in rows if r[3] and r[4] and r[9]]
    return {(min(a[0], b[0]), max(a[0], b[0])) for a, b in combinations(keep, 2) if (a[3] == "train") != (b[3] == "train") and overlap.alike(a[1], b[1]) and overlap.alike(a[2], b[2])}


def variants(seed, n, hot):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([3, 9, 18, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        s = list(passages[0 if i % 3 == 0 and hot else rng.randrange(12)])
        q = [rng.choice(vocab[:12]) for _ in range(rng.choice([1, 2, 5, 16, 17]))]
        if rows and rng.random() < 0.5:
            old = rng.choice(rows)
            q, s = old[3].split(), old[4].split()
            for t in (q, s):
                for _ in range(rng.randrange(0, 1 + len(t) // 6)):
                    t[rng.randrange(len(t)) :][:1] = []
                    t.insert(rng.randrange(len(t) + 1), rng.choice(vocab))
                    if len(t) > 3:
                        del t[rng.randrange(len(t))]
        rows.append(pair(i, " ".join(q), " ".join(s), tag=rng.choice(["train", "train", "test", "val"])))
    return rows


def test_against_brute_force(spark):
    rows = variants(4, 400, False)
    want = brute(rows)
    got = {tuple(r) for r in overlap.found(pairs(spark, rows)).collect()}
    assert len(want) > 100 and got == want


def test_hot_shards_are_dealt_by_passages(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_PAIRS", 30)
    for limit in (overlap.HOT_PAIRS, 20):
        monkeypatch.setattr(overlap, "HOT_PAIRS", limit)
        rows = variants(5, 400, True)
        assert {tuple(r) for r in overlap.found(pairs(spark, rows)).collect()} == brute(rows)


def even_edits(seed):
    """Passages with every fifth word changed or moved apart, of rare words, of common words, and of common words with rare ones put in."""
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        n = rng.choice([10, 25, 30, 60, 125])
        s = [f"w{rng.randrange(40)}" if i % 3 else f"r{i}x{j}" for j in range(n)]
        a, b = list(s), list(s)
        for k in range(4, n, 5):
            b[k] = rng.choice([f"w{rng.randrange(40)}", f"new{i}x{k}"])
        if i % 3 == 2:
            for _ in range(n // 5):
                del b[rng.randrange(len(b))]
                b.insert(rng.randrange(len(b)), f"put{i}")
            for k in range(2, n, 25):
                a[k] = f"other{i}"
        rows += [pair(2 * i, source=" ".join(a), tag="train"), pair(2 * i + 1, source=" ".join(b), tag="test")]
    return rows


def test_even_edits_lose_nothing(spark, monkeypatch):
    rows = even_edits(8)
    want = brute(rows)
    assert len(want) > 50
    for limit in (overlap.HOT_PAIRS, 3):
        monkeypatch.setattr(overlap, "HOT_PAIRS", limit)
        assert {tuple(r) for r in overlap.found(pairs(spark, rows)).collect()} == want


def even_questions(seed):
    """Questions of common words in which every fifth word is changed or moved."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        n = rng.choice([4, 5, 6, 9, 10, 17, 30])
        a = [f"w{rng.randrange(9)}" for _ in range(n)]
        b = list(a)
        for k in range(4, n, 5):
            b[k] = rng.choice([f"w{rng.randrange(9)}", f"new{i}"])
        rows += [pair(2 * i, question=" ".join(a), tag="train"), pair(2 * i + 1, question=" ".join(b), tag="test")]
    return rows


def test_buckets_of_any_depth_and_blocks_lose_nothing(spark, monkeypatch):
    for limit, depth, block in ((3, 12, 4), (0, 2, 3)):
        for name, value in (("HOT_PAIRS", limit), ("DEPTH", depth), ("BLOCK", block), ("HELD", 7)):
            monkeypatch.setattr(overlap, name, value)
        for rows in (even_questions(7), variants(6, 200, False)):
            assert {tuple(r) for r in overlap.found(pairs(spark, rows)).collect()} == brute(rows)


def test_awkward_rows(spark):
    rows = [pair(1, tag="train"), pair(2, tag="test"), pair(3, tag=None), pair(4, tag="other"), pair(5, "nan", tag="test"), pair(6, None, tag="train"), pair(7, "?!", "...", tag="test"), pair(8, "?!", "...", tag="train"), null_pair(9), null_pair(), pair(10, tag="dev", source_id=-5)]
    df = pairs(spark, rows)
    assert sorted(tuple(r) for r in overlap.found(df).collect()) == [(1, 2), (1, 10)]
    assert {tuple(r) for r in overlap.report(df).collect()} == {("test", 1, 1, 1), ("validation", None, 1, 1)}
    assert overlap.found(df.limit(0)).count() == 0
    long = "word " * 30_000
    assert overlap.found(pairs(spark, [pair(1, long, long), pair(2, long, long + "end", tag="test")])).count() == 1
