"""Most similar vectors for every vector (problem 7).

Method: NN-descent.  A first neighbour list of every vector comes from several
random-projection trees whose leaves are compared whole; then iterative joins of
neighbours of neighbours improve the lists until few change.  Queries use greedy
search on the finished graph.

The trees' upper levels are fitted on a bounded sample (``SAMPLE`` vectors);
every vector is indexed.  Vectors of one direction are collapsed first, so
copies that fill a third of the table cost one node; their lists are rebuilt
from the six smallest ids of each class of copies, which is all that five
neighbours can need.

Defined results: NULL, empty, wrongly sized, NaN-holding, infinite and all-zero
vectors are unusable and take no part; ties go to the smaller id; ids that occur
twice with the same vector are one vector; fewer than ``k`` others give fewer
rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.runtime import drop_settled, settle

DIM = 64
#: Vectors on which the upper levels of the trees are fitted; vectors of a leaf that are compared whole; trees; list length while descending.
SAMPLE, LEAF, TREES, WIDTH = 20_000, 6_000, 10, 24
#: Descent ends when fewer than this share of the list entries change.
SETTLED_SHARE = 0.005


def unit_vectors(df: DataFrame, rid: str, embedding: str, dim: int = DIM) -> DataFrame:
    """``(id, vec)`` of the usable vectors; ``vec`` holds ``dim`` float32 of length one."""

    def convert(it):
        for b in it:
            ids, col = b.column(0), b.column(1)
            lengths = np.asarray(pa.compute.list_value_length(col).fill_null(-1))
            ok = (lengths == dim) & np.asarray(ids.is_valid())
            flat = col.filter(pa.array(ok)).flatten().cast(pa.float64())
            v = np.asarray(flat.fill_null(float("nan")), dtype=np.float64).reshape(-1, dim)
            keep = np.asarray(ids.filter(pa.array(ok)), dtype=np.int64)
            norm = np.linalg.norm(np.where(np.isfinite(v), v, 0.0), axis=1)
            good = np.isfinite(v).all(1) & (norm > 0) & np.isfinite(norm)
            u = (v[good] / norm[good, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(keep[good]), pa.array([x.tobytes() for x in u], pa.binary())], names=["id", "vec"])

    return df.select(F.col(f"`{rid}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<float>").alias("e")).mapInArrow(convert, "id long, vec binary")


def matrix(cells, dtype=np.float32) -> np.ndarray:
    if isinstance(cells, (pa.Array, pa.ChunkedArray)):
        cells = cells.to_pylist()
    return np.frombuffer(b"".join(cells), dtype=dtype).reshape(len(cells), -1).astype(np.float32) if len(cells) else np.zeros((0, DIM), np.float32)


def grow(sample: np.ndarray, leaves: int, seed: int):
    """A balanced tree of random directions: ``(directions, cuts)`` in heap order."""
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
    directions, cuts = np.zeros((2**depth - 1, sample.shape[1]), np.float32), np.zeros(2**depth - 1, np.float32)
    at = np.zeros(len(sample), np.int64)
    for node in range(2**depth - 1):
        mine = sample[at == node]
        if len(mine) >= 2:
            i, j = rng.choice(len(mine), 2, replace=False)
            d = mine[i] - mine[j]
        else:
            d = rng.standard_normal(sample.shape[1]).astype(np.float32)
        directions[node] = d
        cuts[node] = np.median(mine @ d) if len(mine) else 0.0
        at[at == node] = np.where(mine @ d > cuts[node], 2 * node + 2, 2 * node + 1)
    return directions, cuts


def leaf_of(v: np.ndarray, tree) -> np.ndarray:
    directions, cuts = tree
    at = np.zeros(len(v), np.int64)
    while len(cuts) and at.size and at.min() < len(cuts):
        at = np.where(np.einsum("ij,ij->i", v, directions[at]) > cuts[at], 2 * at + 2, 2 * at + 1)
    return at


def _compare_leaf(ids: np.ndarray, v: np.ndarray, width: int, rng, out: list) -> None:
    """Best ``width`` others of each vector within blocks of at most LEAF vectors."""
    if len(ids) > LEAF:
        d = v[rng.integers(len(v))] - v[rng.integers(len(v))]
        order = np.argsort(v @ d if d.any() else rng.standard_normal(len(v)), kind="stable")
        half = len(ids) // 2
        for part in (order[:half], order[half:]):
            _compare_leaf(ids[part], v[part], width, rng, out)
        return
    n = len(ids)
    if n < 2:
        return
    k = min(width, n - 1)
    for at in range(0, n, 1024):
        s = v[at : at + 1024] @ v.T
        rows = np.arange(len(s))
        s[rows, rows + at] = -2
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append((np.repeat(ids[at : at + 1024], k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()))


_EDGE = "u long, v long, sim float"


def _edges(out: list):
    if out:
        u, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        for k in range(0, len(u), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 65536]), pa.array(v[k : k + 65536]), pa.array(s[k : k + 65536].astype(np.float32))], names=["u", "v", "sim"])


def top(edges: DataFrame, k: int, key: str = "u", other: str = "v") -> DataFrame:
    """The ``k`` most similar of each ``key``, ties to the smaller id."""
    order = W.partitionBy(key).orderBy(F.col("sim").desc(), F.col(other))
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_lists(nodes: DataFrame, count: int, width: int = WIDTH, trees: int = TREES) -> DataFrame:
    """Neighbour lists from random-projection trees."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("id")).limit(SAMPLE)  # a bounded sample; every vector is indexed below
    s = matrix([r[0] for r in sample.select("vec").collect()])
    leaves = min(max(1, count // LEAF + 1), max(1, SAMPLE // 16))
    forest = [grow(s, leaves, 17 + t) for t in range(trees if leaves > 1 else 1)]
    # where the sample is too small for as many leaves as the count needs, signs of random directions split them further
    bits = max(0, int(np.ceil(np.log2(count / (2 * leaves * LEAF))))) if count > 2 * leaves * LEAF else 0
    signs = np.random.default_rng(3).standard_normal((len(forest), s.shape[1], bits)).astype(np.float32)
    shared = spark.sparkContext.broadcast((forest, signs))  # at most trees x SAMPLE / 16 directions

    def spread(it):
        for b in it:
            ids, v = np.asarray(b.column(0)), matrix(b.column(1))
            half = [x.tobytes() for x in v.astype(np.float16)]
            trees, signs = shared.value
            for t, tree in enumerate(trees):
                finer = (v @ signs[t] > 0) @ (1 << np.arange(signs.shape[2])) if signs.shape[2] else 0
                leaf = (leaf_of(v, tree) * len(trees) + t) * (1 << signs.shape[2]) + finer
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(ids), pa.array(half, pa.binary())], names=["leaf", "id", "vec"])

    def compare(it):
        bs = [b for b in it if b.num_rows]
        if not bs:
            return
        t = pa.Table.from_batches(bs).sort_by("leaf")
        leaf, ids, v = t["leaf"].to_numpy(), t["id"].to_numpy(), matrix(t["vec"], np.float16)
        rng, out = np.random.default_rng(5), []
        bounds = np.flatnonzero(np.diff(leaf)) + 1
        for part in np.split(np.arange(len(ids)), bounds):
            _compare_leaf(ids[part], v[part], width, rng, out)
            if len(out) > 16:
                yield from _edges(out)
                out.clear()
        yield from _edges(out)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * len(forest) // 100_000)
    found = nodes.mapInArrow(spread, "leaf long, id long, vec binary").repartition(tasks, "leaf").mapInArrow(compare, _EDGE)
    return top(found.groupBy("u", "v").agg(F.max("sim").alias("sim")), width).select("u", "v", "sim")


def descend(nodes: DataFrame, lists: DataFrame, count: int, width: int = WIDTH) -> DataFrame:
    """Improve neighbour lists by comparing, at every node, its neighbours and reverse neighbours with each other.

    Only pairs of which one entered a list in the round before are compared, and
    only nodes that have such an entry take part.
    """
    spark = nodes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 20_000)

    def half(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in matrix(b.column(1)).astype(np.float16)], pa.binary())], names=["id", "vec"])

    vectors = settle(nodes.mapInArrow(half, "id long, vec binary"))

    def local_join(it):
        bs = [b for b in it if b.num_rows]
        if not bs:
            return
        t = pa.Table.from_batches(bs).sort_by("c")
        c, m, fresh, worst, v = t["c"].to_numpy(), t["m"].to_numpy(), t["fresh"].to_numpy() > 0, t["worst"].to_numpy(), matrix(t["vec"], np.float16)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(c)]]))
        for size in np.unique(sizes):
            if size < 2:
                continue
            own = starts[sizes == size]
            a, b = np.triu_indices(size, 1)
            for k in range(0, len(own), 512):
                rows = own[k : k + 512, None] + np.arange(size)
                x = v[rows]
                s = np.matmul(x, x.transpose(0, 2, 1))[:, a, b]
                left, right = rows[:, a], rows[:, b]
                met = (fresh[left] | fresh[right]) & (m[left] != m[right])
                out = []
                for p, q in ((left, right), (right, left)):
                    better = met & (s > worst[p])
                    out.append((m[p][better], m[q][better], s[better]))
                u, w, g = (np.concatenate(z) for z in zip(*out, strict=True))
                if len(u):
                    pairs = np.unique(np.stack([u, w, np.round(g * 1e6).astype(np.int64)]), axis=1)  # a pair met at several nodes leaves once
                    yield from _edges([(pairs[0], pairs[1], pairs[2] / 1e6)])

    before, lists = None, lists.withColumn("fresh", F.lit(1).cast("byte"))
    while True:  # lists only get better, so this ends
        worst = lists.groupBy("u").agg(F.when(F.count(F.lit(1)) >= width, F.min("sim")).otherwise(F.lit(-1.0).cast("float")).alias("worst"))
        back = top(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "fresh"), width).select("u", "v", "fresh")
        pool = settle(lists.select("u", "v", "fresh").unionAll(back).groupBy(F.col("u").alias("c"), F.col("v").alias("m")).agg(F.max("fresh").alias("fresh")))
        moved = pool.join(pool.where("fresh = 1").select("c").distinct(), "c", "left_semi")
        known = vectors.join(worst, F.col("id") == F.col("u"), "left").select(F.col("id").alias("m"), "vec", F.coalesce("worst", F.lit(-1.0).cast("float")).alias("worst"))
        sent = moved.join(known, "m").select("c", "m", "fresh", "worst", "vec").repartition(tasks, "c")
        found = sent.mapInArrow(local_join, _EDGE)
        merged = lists.select("u", "v", "sim").withColumn("old", F.lit(1)).unionAll(found.withColumn("old", F.lit(0))).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
        new = settle(top(merged, width).select("u", "v", "sim", "old"))
        changed = new.agg(F.sum(1 - F.col("old")), F.count(F.lit(1))).first()
        drop_settled(before)
        drop_settled(pool)
        before, lists = new, new.select("u", "v", "sim", (1 - F.col("old")).cast("byte").alias("fresh"))
        if not changed[1] or (changed[0] or 0) < SETTLED_SHARE * changed[1]:
            break
    return lists.select("u", "v", "sim")


def graph(vectors: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(reps, members, lists)``: one node for each direction, the members of each, and the nodes' neighbour lists."""
    spark = vectors.sparkSession
    vectors = settle(vectors)
    keyed = vectors.withColumn("h", F.unhex(F.md5("vec")))
    reps = settle(keyed.groupBy("h").agg(F.min("id").alias("id"), F.first("vec").alias("vec")))
    members = settle(keyed.select("h", "id").distinct().join(reps.select("h", F.col("id").alias("rep")), "h").select("rep", "id"))
    nodes = reps.select("id", "vec")
    count = nodes.count()
    if count < 2:
        return nodes, members, spark.createDataFrame([], _EDGE)
    lists = settle(first_lists(nodes, count, width))
    return nodes, members, descend(nodes, lists, count, width)


def nearest(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``(id, other, sim, rank)``: the ``k`` most similar others of every usable vector."""
    nodes, members, lists = graph(vectors, max(WIDTH, 2 * k))
    # of any class at most k + 1 members can stand in one list
    firsts = members.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("nth") <= k + 1)
    firsts = settle(firsts.select("rep", F.col("id").alias("other")))
    sizes = members.groupBy("rep").count()
    # exact similarities for the head of each list; the descent used half precision
    head = top(lists, k + 3).select("u", "v")
    exact = head.join(nodes.select(F.col("id").alias("u"), F.col("vec").alias("a")), "u").join(nodes.select(F.col("id").alias("v"), F.col("vec").alias("b")), "v").select("u", "v", "a", "b")

    def dot(it):
        for b in it:
            s = np.einsum("ij,ij->i", matrix(b.column(2)).astype(np.float64), matrix(b.column(3)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(s, -1, 1))], names=["u", "v", "sim"])

    scored = exact.mapInArrow(dot, "u long, v long, sim double")
    # lists of classes: the class itself where it has copies, then its neighbours' members
    own = sizes.where("count > 1").select(F.col("rep").alias("u"), F.col("rep").alias("v"), F.lit(1.0).alias("sim"))
    spread = scored.unionByName(own).join(firsts.withColumnRenamed("rep", "v"), "v").select("u", "other", "sim")
    ranked = top(spread, k + 1, "u", "other").select("u", "other", "sim")
    by_member = members.withColumnRenamed("rep", "u").join(ranked, "u").where(F.col("id") != F.col("other")).select("id", "other", "sim")
    return top(by_member, k, "id", "other")


def similar_pairs(vectors: DataFrame, least: float = 0.85, k: int = 5) -> DataFrame:
    """``(vec_id_a, vec_id_b)``, the smaller first: pairs of at least ``least`` in which either is among the other's ``k`` nearest."""
    close = nearest(vectors, k).where(F.col("sim") >= least)
    return close.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def greedy_search(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 48, entries: int = 256, rounds: int = 8) -> DataFrame:
    """``(query_id, other, sim, rank)`` by greedy search on the neighbour graph.

    ``queries``: rows ``(id, vec)``.  Every query starts at the best of
    ``entries`` shared nodes (a bounded sample) and moves to the neighbours of
    its best ``beam`` nodes until none of them is new.
    """
    spark = vectors.sparkSession
    nodes, members, lists = graph(vectors)
    lists, nodes = settle(lists), settle(nodes)
    both = settle(lists.select("u", "v").unionAll(lists.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    door = nodes.orderBy(F.xxhash64("id")).limit(entries).collect()
    door_ids, door_v = np.array([r["id"] for r in door], np.int64), matrix([r["vec"] for r in door])
    shared = spark.sparkContext.broadcast((door_ids, door_v))
    q = settle(queries.select(F.col("id").alias("q"), F.col("vec").alias("qv")))

    def enter(it):
        for b in it:
            ids, v = np.asarray(b.column(0)), matrix(b.column(1))
            if len(ids) and len(shared.value[0]):
                s = v @ shared.value[1].T
                n = min(beam, s.shape[1])
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(shared.value[0][best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel().astype(np.float64))], names=["u", "v", "sim"])

    def dot(it):
        for b in it:
            s = np.einsum("ij,ij->i", matrix(b.column(2)).astype(np.float64), matrix(b.column(3)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(s, -1, 1))], names=["u", "v", "sim"])

    held = settle(q.mapInArrow(enter, "u long, v long, sim double").withColumn("seen", F.lit(0)))
    for _ in range(rounds):
        front = held.where("seen = 0")
        reach = front.join(both.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")).distinct()
        reach = reach.join(held.select("u", "v"), ["u", "v"], "left_anti")
        priced = reach.join(q.withColumnRenamed("q", "u"), "u").join(nodes.select(F.col("id").alias("v"), "vec"), "v").select("u", "v", "qv", "vec").mapInArrow(dot, "u long, v long, sim double")
        new = settle(top(held.withColumn("seen", F.lit(1)).unionByName(priced.withColumn("seen", F.lit(0))), beam).select("u", "v", "sim", "seen"))
        drop_settled(held)
        held = new
        if held.where("seen = 0").isEmpty():
            break
    firsts = members.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("nth") <= k + 1).select(F.col("rep").alias("v"), F.col("id").alias("other"))
    spread = held.join(firsts, "v").where(F.col("u") != F.col("other")).select(F.col("u").alias("query_id"), "other", "sim")
    return top(spread, k, "query_id", "other")
