"""Filling fixed-capacity containers with items (problem 8).

Method: exact-complement hashing.  Items of one length are interchangeable, so
the plan is made on the histogram of lengths (at most ``capacity`` numbers, from
all items): a container is opened with the longest item left; its gap is looked
up among single lengths, sums of two and sums of three under the counts still
available, and a combination that fills it exactly is taken as often as the
counts allow; where none exists the longest item that fits goes in (best fit)
and the smaller gap is looked up again.  Items then find their containers by
their rank within their length, which needs no sort of all items of one length.

Defined results: an item longer than the capacity is cut into full pieces and a
rest, others are never cut; items without tokens get no container; equal ids
are separate items; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passagemill.runtime import settle


def _complement(avail: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that add up to ``gap``."""
    if avail[gap] > 0:
        return [gap]
    have = avail[: gap + 1] > 0
    have[0] = False
    half = gap // 2
    pair = np.flatnonzero(have[1 : half + 1] & have[gap - 1 : gap - half - 1 : -1] if gap - half - 1 >= 0 else [])
    for b in pair + 1:
        if b * 2 != gap or avail[b] > 1:
            return [gap - int(b), int(b)]
    for a in np.flatnonzero(have)[::-1]:
        a = int(a)
        if 3 * a < gap:
            return None
        rest = gap - a
        top = min(a, rest - 1)
        low = -(-rest // 2)
        if low > top:
            continue
        b = np.arange(low, top + 1)
        for x in b[have[b] & have[rest - b]]:
            need: dict[int, int] = {}
            for y in (a, int(x), rest - int(x)):
                need[y] = need.get(y, 0) + 1
            if all(avail[y] >= n for y, n in need.items()):
                return [a, int(x), rest - int(x)]
    return None


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """``(lengths, how many containers)`` for ``counts[length]`` items of each length; the last index is the capacity."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return out
        avail, items, gap = left.copy(), [], capacity
        while gap > 0:
            exact = _complement(avail, gap) if items or avail[capacity] else None
            if exact:
                items += exact
                for x in exact:
                    avail[x] -= 1
                break
            fit = np.flatnonzero(avail[1 : gap + 1])
            if not len(fit):
                break
            x = int(fit[-1]) + 1
            items.append(x)
            avail[x] -= 1
            gap -= x
        used = np.bincount(items, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((items, times))


def slots(made: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """By length: first ranks, first containers and offsets of the runs of items that the plan takes."""
    taken: dict[int, int] = {}
    by: dict[int, tuple[list[int], list[int], list[int]]] = {}
    base = 0
    for items, times in made:
        offset = 0
        for x in items:
            starts, bases, offsets = by.setdefault(x, ([], [], []))
            starts.append(taken.get(x, 0))
            bases.append(base)
            offsets.append(offset)
            taken[x] = taken.get(x, 0) + times
            offset += x
        base += times
    return by


def pack(items: DataFrame, rid: str, size: str, capacity: int = 2048, cell: int = 50_000) -> DataFrame:
    """``(rid, piece, token_start, n_tokens, container_id, token_offset)`` of every piece of every item."""
    spark = items.sparkSession
    n = F.col(f"`{size}`")
    cut = items.select(F.col(f"`{rid}`").alias(rid), n.cast("long").alias("size")).select(rid, "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    cut = cut.select(rid, "piece", (F.col("piece") * F.lit(capacity)).cast("long").alias("token_start"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    histogram = {r["n_tokens"]: r["count"] for r in cut.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    total = sum(histogram.values())
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        if k:
            counts[k] = v
    by = slots(plan(counts))
    shared = spark.sparkContext.broadcast(by)  # runs are bounded by the number of lengths, not of items
    cells = max(1, total // cell)
    dealt = cut.withColumn("cell", F.pmod(F.xxhash64(rid, "piece"), F.lit(cells)).cast("int"))
    dealt = settle(dealt)
    per = dealt.groupBy("n_tokens", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("n_tokens", "cell", (F.sum("n").over(W.partitionBy("n_tokens").orderBy("cell")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("nth", F.row_number().over(W.partitionBy("n_tokens", "cell").orderBy(rid, "piece")) - 1).join(before, ["n_tokens", "cell"])

    def place(it):
        table = shared.value
        for b in it:
            size_, rank = b.column(3).to_pylist(), b.column(4).to_pylist()
            where, offset = [], []
            for x, r in zip(size_, rank, strict=True):
                if not x:
                    where.append(None), offset.append(None)
                    continue
                starts, bases, offsets = table[x]
                k = bisect.bisect_right(starts, r) - 1
                where.append(bases[k] + r - starts[k]), offset.append(offsets[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(where, pa.int64()), pa.array(offset, pa.int32())], names=[rid, "piece", "token_start", "n_tokens", "container_id", "token_offset"])

    kind = items.select(F.col(f"`{rid}`")).schema[0].dataType.simpleString()
    return ranked.select(rid, "piece", "token_start", "n_tokens", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, f"`{rid}` {kind}, piece int, token_start long, n_tokens int, container_id long, token_offset int")
