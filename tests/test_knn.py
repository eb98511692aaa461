import numpy as np
from pyspark.sql import functions as F

from passagemill.operators import build, knn


def vectors(rng, n, copies):
    x = rng.integers(-2, 3, (n, 6)) + 0.25
    x[:copies] = x[0]
    return x


def test_best_of_equals_full_sort():
    rng = np.random.default_rng(0)
    x, o = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (vectors(rng, 300, 5), vectors(rng, 6000, 900)))
    o[17] = np.nan
    ids, tags, otags = rng.permutation(len(o)), rng.integers(0, 5, len(x)), rng.integers(0, 5, len(o))
    for k in (1, 2, 4):
        for own in (otags, None):
            s = np.round(x @ o.T, 9)
            s[:, 17] = -9
            if own is not None:
                s[tags[:, None] == own[None, :]] = -9
            got = {}
            for r, i, v in zip(*knn.best_of(x, tags, o, ids, own, k), strict=True):
                got.setdefault(int(r), []).append((-v, int(i)))
            for r in range(len(x)):
                assert [i for _, i in sorted(got[r])] == [ids[j] for j in np.lexsort((ids, -s[r]))[:k]]


def test_blocks_are_few_and_their_result_whole(spark):
    assert knn._dealt(203_000, 166_000, knn.BLOCK, 12) == (4, 3)  # blocks of 4,096 would send every source 50 times
    rng = np.random.default_rng(1)
    rows = [(i, int(t), [float(y) for y in v]) for i, (t, v) in enumerate(zip(rng.integers(0, 3, 400), vectors(rng, 400, 40), strict=True))]
    df = spark.createDataFrame(rows, "id long, tag long, vec array<double>")
    q, o = df.where("id < 90").select(F.col("id").alias("key"), "tag", "vec"), df.select(F.col("id").alias("oid"), F.col("tag").alias("otag"), "vec")
    want = {tuple(r) for r in knn.block_topk(q, o, 3, exclude_same_tag=True).collect()}
    assert len(want) == 270 and {tuple(r) for r in knn.block_topk(q, o, 3, exclude_same_tag=True, block=7).collect()} == want
    u = np.array([r[2] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for key, oid, sim, rank in want:
        s = np.where(np.array([r[1] for r in rows]) == rows[key][1], -9, np.round(u[key] @ u.T, 9))
        order = np.lexsort((np.arange(400), -s))
        assert order[rank - 1] == oid and abs(s[oid] - sim) < 2e-9
    assert knn.block_topk(q.where("key < 0"), o, 3).count() == 0


def test_finished_tables_are_written_once(spark, tmp_path, monkeypatch):
    from tests.test_build import enrich, inputs

    frames, clusters, keywords = inputs(spark)
    settled = []
    monkeypatch.setattr(build, "settle", lambda df, keep=build.settle: settled.append(df.columns) or keep(df))
    build.build(spark, frames, ["row"], clusters, keywords, str(tmp_path), enrich.stub_embedder(8), {"ratios": (0.6, 0.2, 0.2)}, embedding_dim=8, n_neg=2)
    assert not [c for c in settled if "residual" in c or "embedding" in c]
