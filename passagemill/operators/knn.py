"""Exact nearest neighbours by blocks (JN10, N3, T3, TK2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a block; rows and columns that are multiplied at once; similarities of a pair of blocks below which it isn't split for more tasks.
BLOCK, TILE, WIDE, CELL = 65_536, 256, 4_096, 50_000_000


def _unit(column) -> np.ndarray:
    """Rows of a list column, of length one; zero rows stay zero."""
    x = np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Tags of both sides as numbers that are equal where the tags are."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    codes = np.asarray(both.indices.fill_null(-1), np.int64)
    return codes[: len(a)], codes[len(a) :]


def _firsts(x: np.ndarray, tags: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors with one tag the first ``k``: ties go to the smaller id, so no other can be among the best."""
    h = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, same = np.unique(h, return_inverse=True)
    order = np.lexsort((np.arange(len(x)), tags, same))
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(same[order]) != 0) | (np.diff(tags[order]) != 0)
    starts = np.flatnonzero(new)
    nth = np.arange(len(x)) - starts[np.cumsum(new) - 1]
    return np.sort(order[nth < k])


def best_of(x: np.ndarray, tags: np.ndarray, others: np.ndarray, oids: np.ndarray, otags: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, oid, sim)``: the ``k`` most similar of ``others`` (unit vectors) for every row of ``x``, ties to the smaller id.

    Tiles are multiplied in single precision; what comes within its error of the
    ``k``-th best so far is taken again in double precision, so the result is
    exact to the ninth digit.  ``otags``: others with the row's tag don't count.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    fine = np.flatnonzero(np.isfinite(others).all(1))
    order = fine[np.argsort(oids[fine], kind="stable")]
    apart = otags is not None
    others, oids, otags = others[order], oids[order], otags[order] if apart else np.zeros(len(order), np.int64)
    if not len(oids) or not len(x):
        return none
    few = _firsts(others, otags, k)
    few = few[np.argsort(otags[few], kind="stable")]  # a tag's vectors lie together
    others, oids, otags = others[few], oids[few], otags[few]
    rows_in = np.flatnonzero(np.isfinite(x).all(1))
    rows_in = rows_in[np.argsort(tags[rows_in], kind="stable")]
    slim, error = np.ascontiguousarray(others.astype(np.float32).T), 5e-7 * (x.shape[1] + 8)
    out = []
    for at in range(0, len(rows_in), TILE):
        rows = rows_in[at : at + TILE]
        a, mine = x[rows], tags[rows]
        a32 = a.astype(np.float32)
        sims, ids = np.full((len(rows), k), -np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
        # runs of rows with one tag, and the columns that have it too
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [len(rows)]])
        runs = [(lo, hi, *np.searchsorted(otags, [mine[lo], mine[lo] + 1])) for lo, hi in zip(cuts, cuts[1:], strict=False) if apart]
        for c in range(0, len(oids), WIDE):
            s = a32 @ slim[:, c : c + WIDE]
            for lo, hi, first, last in runs:
                if first < c + WIDE and last > c:
                    s[lo:hi, max(first - c, 0) : max(last - c, 0)] = -9
            least = sims[:, -1]
            if c == 0 or np.isinf(least).any():
                own = np.partition(s, s.shape[1] - min(k, s.shape[1]), axis=1)[:, s.shape[1] - min(k, s.shape[1])]
                least = np.maximum(least, own if s.shape[1] >= k else -5.0)
            least = np.maximum(least - error, -5.0).astype(np.float32)
            hit = np.flatnonzero(s.max(1) >= least)
            if not len(hit):
                continue
            r, j = np.nonzero(s[hit] >= least[hit, None])
            r, j = hit[r], j + c
            exact = np.concatenate([np.round(np.einsum("ij,ij->i", a[r[i : i + 65536]], others[j[i : i + 65536]]), 9) for i in range(0, len(r), 65536)])
            # met with what the rows hold, the best k stay
            r, exact, j = np.concatenate([r, np.repeat(hit, k)]), np.concatenate([exact, sims[hit].ravel()]), np.concatenate([oids[j], ids[hit].ravel()])
            o = np.lexsort((j, -exact, r))
            r, exact, j = r[o], exact[o], j[o]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
            nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(r)]])))
            keep = nth < k
            sims[r[keep], nth[keep]], ids[r[keep], nth[keep]] = exact[keep], j[keep]
        found = np.isfinite(sims)
        out.append((rows[np.nonzero(found)[0]], ids[found], sims[found]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else none


def _dealt(queries: int, others: int, block: int, tasks: int) -> tuple[int, int]:
    """Blocks of each side: few enough that little is sent twice, enough that every task has work."""
    nq, no = max(1, -(-queries // block)), max(1, -(-others // block))
    while nq * no < tasks and queries * others > nq * no * CELL:
        nq, no = (nq + 1, no) if others <= queries else (nq, no + 1)
    return nq, no


def block_topk(queries: DataFrame, others: DataFrame, k: int, exclude_same_tag: bool = False, block: int = BLOCK) -> DataFrame:
    """``(key, oid, sim)``: for each query ``(key, tag, vec)`` the ``k`` most similar of ``(oid, otag, vec)`` by cosine.

    Both sides are dealt into blocks of at most about ``block`` rows; every pair
    of blocks meets in one task, which keeps ``k`` per query.  The queries are a
    stated set; ties go to the smaller id.
    """
    spark, kind = queries.sparkSession, queries.schema["key"].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nq, no = _dealt(queries.count(), others.count(), block, tasks)
    cell = F.col("qb") * no + F.col("ob")
    if nq * no <= 8 * tasks:
        # few pairs of blocks get names that deal them evenly to the tasks
        free: dict[int, list[int]] = {}
        for r in spark.range(0, 64 * 8 * tasks, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).collect():
            free.setdefault(r["p"], []).append(r["id"])
        order = sorted(free)
        cell = F.element_at(F.array(*[F.lit(free[order[n % len(order)]][n // len(order)]) for n in range(nq * no)]), (cell + 1).cast("int"))
    cell = cell.cast("long").alias("cell")
    q = queries.withColumn("qb", F.pmod(F.xxhash64("key"), F.lit(nq)).cast("int")).withColumn("ob", F.explode(F.sequence(F.lit(0), F.lit(no - 1))))
    o = others.withColumn("ob", F.pmod(F.xxhash64("oid"), F.lit(no)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    left = q.select(cell, "key", "tag", F.col("vec").cast("array<double>").alias("vec")).repartition(tasks, "cell")
    right = o.select(cell, "oid", "otag", F.col("vec").cast("array<double>").alias("vec")).repartition(tasks, "cell")

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        keys = a["key"]
        if not a.num_rows or not b.num_rows:
            return pa.table({"key": keys.slice(0, 0), "oid": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        tags, otags = _codes(a["tag"], b["otag"].cast(a["tag"].type)) if exclude_same_tag else (np.zeros(a.num_rows, np.int64), None)
        rows, oids, sims = best_of(_unit(a["vec"]), tags, _unit(b["vec"]), b["oid"].to_numpy(), otags, k)
        return pa.table({"key": keys.take(pa.array(rows)), "oid": pa.array(oids), "sim": pa.array(sims)})

    met = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(multiply, f"key {kind}, oid long, sim double")
    w = W.partitionBy("key").orderBy(F.col("sim").desc(), "oid")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("key", "oid", "sim", "rank")
