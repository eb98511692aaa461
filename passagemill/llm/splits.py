"""Splits that keep related records together (problem 1).

Method: grouped iterative stratification.  Rows that share a source or a
question are tied; components of these ties are found, each component's label
vector (rows per cluster) is aggregated, and components are placed with the
rarest outstanding label first into the split that still needs it most.

Components: every question is first reduced to edges between the sources it
meets, so the graph has one node per source and a question with one source adds
no edge.  Minimum labels then spread over alternating large-star and small-star
steps; each is a partially aggregated minimum and a join, the edges are written
to the shared folder, and a hot node costs no task more than its share.

Placement: at most ``heavy_share`` components can hold more than one part in
``heavy_share`` of all rows; these are placed one by one in a single task.  The
rest is dealt by hash into cells of bounded size that are placed side by side,
each with its proportional share of what the heavy ones left open.

Defined results: NULL and negative sources tie nothing, nor do missing
questions; a row with neither is a component of its own; NULL clusters are a
label of their own; an empty table gives no rows; other columns pass through
untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import same_writing
from passagemill.runtime import drop_settled, settle

SPLITS = ("train", "validation", "test")
#: Labels balanced one by one; rows of further, rarer labels are balanced together.
LABELS = 500


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(a, b)``; the root is the component's least node.

    Alternating large-star and small-star steps until the edges no longer change.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while True:  # every round brings edges nearer to the roots; there are as many as the logarithm of the longest path
        # large star: every larger neighbour of a node moves to the node's least neighbour
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        down = large.where("a <> b")
        lows = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lows, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = settle(small.where("a <> b").distinct())
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_settled(e)
        e = new
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def tie_groups(df: DataFrame, rid: str, source: str, question: str, label: str) -> DataFrame:
    """``(rid, label, root_source, root_question)``: the component of each row, as its least source, or the question's key where no source takes part."""
    src = F.col(f"`{source}`").cast("long")
    # sixteen bytes of digest stand for a question's writing
    folded = same_writing(F.col(f"`{question}`").cast("string"))
    rows = settle(df.select(F.col(f"`{rid}`").cast("long").alias("rid"), F.when(src >= 0, src).alias("src"), F.unhex(F.md5(folded)).alias("q"), F.col(f"`{label}`").cast("string").alias("label")))
    met = rows.where("src is not null and q is not null").groupBy("q").agg(F.min("src").alias("low"))
    met = settle(met)
    edges = rows.where("src is not null and q is not null").select("src", "q").distinct().join(met, "q").where("src <> low").select(F.col("src").alias("a"), F.col("low").alias("b"))
    roots = settle(connected(edges))
    by_question = rows.join(met, "q", "left").select("rid", "label", F.coalesce("src", "low").alias("node"), "q")
    named = by_question.join(roots, "node", "left").select("rid", "label", F.coalesce("root", "node").alias("root_source"), "q")
    return named.select(F.col("rid").alias(rid), "label", "root_source", F.when(F.col("root_source").isNull(), F.col("q")).alias("root_question"))


def place(sizes: np.ndarray, ratios: np.ndarray, wanted: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Iterative stratification of components by their label vectors.

    ``sizes``: components x labels; ``wanted``: splits x labels still needed;
    ``filled``: rows still needed by each split.  Both are changed in place.
    """
    n = len(sizes)
    where = np.full(n, -1)
    total = sizes.sum(1)
    open_ = np.ones(n, bool)
    while open_.any():
        left = sizes[open_].sum(0)
        rare = int(np.argmin(np.where(left > 0, left, np.inf)))
        if left[rare] == 0:
            members = np.flatnonzero(open_)
        else:
            members = np.flatnonzero(open_ & (sizes[:, rare] > 0))
        members = members[np.lexsort((members, -total[members]))]
        for i in members:
            need = wanted[:, rare]
            best = np.flatnonzero(need >= need.max() - 1e-9)
            s = best[np.argmax(filled[best])]
            # a component that fits no split where its label is needed most goes where it overshoots least
            if total[i] > max(filled[s], 0) and total[i] > 1:
                s = int(np.argmax((filled - total[i]) / np.maximum(ratios, 1e-9)))
            where[i] = s
            wanted[s] -= sizes[i]
            filled[s] -= total[i]
            open_[i] = False
    return where


def assign(components: DataFrame, ratios: tuple[float, ...], heavy_share: int = 10_000, cell: int = 4_000) -> DataFrame:
    """``(component, split)`` from ``(component, label, n)`` with one row for each label of a component.

    The ``LABELS`` commonest labels have a vector component each, all others one together.
    """
    ratio = np.array(ratios, float) / sum(ratios)
    common = components.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "label").limit(LABELS).collect()
    totals = {r["label"]: r["n"] for r in common}
    labels = sorted(totals, key=lambda x: (x is None, x))
    n_rows = components.agg(F.sum("n")).first()[0] or 0
    if not n_rows:
        return components.sparkSession.createDataFrame([], "component binary, split string")
    known = F.lit(False)
    for x in labels:
        known = known | F.col("label").eqNullSafe(F.lit(x))
    vector = [F.sum(F.when(F.col("label").eqNullSafe(F.lit(x)), F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(labels)]
    rest_rows = n_rows - sum(totals.values())
    if rest_rows:
        vector.append(F.sum(F.when(known, 0).otherwise(F.col("n"))).alias(f"l{len(labels)}"))
        totals, labels = {**totals, ("rest",): rest_rows}, [*labels, ("rest",)]
    vectors = settle(components.groupBy("component").agg(F.sum("n").alias("size"), *vector))
    names = [f"l{i}" for i in range(len(labels))]
    heavy = vectors.where(F.col("size") * heavy_share > n_rows)  # fewer than heavy_share rows
    wanted = np.outer(ratio, np.array([totals[x] for x in labels], float))
    filled = ratio * n_rows

    def place_heavy(it):
        frames = [x for x in it if len(x)]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True).sort_values(["size", "component"], ascending=[False, True])
        got = place(pdf[names].to_numpy(float), ratio, wanted.copy(), filled.copy())
        yield pd.DataFrame({"component": pdf["component"], "split": [SPLITS[k] for k in got]} | {x: pdf[x] for x in names})

    kept = ", ".join(f"{x} long" for x in names)
    first = settle(heavy.coalesce(1).mapInPandas(place_heavy, f"component binary, split string, {kept}"))
    for r in first.groupBy("split").agg(*(F.sum(x).alias(x) for x in names)).collect():
        k = SPLITS.index(r["split"])
        used = np.array([r[x] for x in names], float)
        wanted[k] -= used
        filled[k] -= used.sum()
    light = vectors.where(F.col("size") * heavy_share <= n_rows)
    rest = light.agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(x) for x in names)).first()
    if not rest["n"]:
        return first.select("component", "split")
    left = np.array([rest[x] or 0 for x in names], float)
    # what the heavy components left open is shared out to the cells in proportion; splits already full get nothing
    need = np.maximum(wanted, 0)
    need = need / np.maximum(need.sum(0), 1e-9)
    room = np.maximum(filled, 0)
    room = room / max(room.sum(), 1e-9)
    need[:, need.sum(0) == 0] = room[:, None]
    cells = max(1, -(-rest["n"] // cell))

    def place_cell(key, pdf):
        sizes = pdf[names].to_numpy(float)
        order = np.lexsort((pdf["component"].to_numpy(), -pdf["size"].to_numpy()))
        sizes = sizes[order]
        mine = sizes.sum(0)
        target = need * mine
        got = place(sizes, np.maximum(room, 1e-6), target, target.sum(1))
        return pd.DataFrame({"component": pdf["component"].to_numpy()[order], "split": [SPLITS[k] for k in got]})

    del left
    dealt = light.withColumn("cell", F.pmod(F.xxhash64("component"), F.lit(cells)))
    second = dealt.groupBy("cell").applyInPandas(place_cell, "component binary, split string")
    return first.select("component", "split").unionByName(second)


def grouped_split(df: DataFrame, rid: str = "pair_id", source: str = "source_id", question: str = "question", label: str = "cluster_id", ratios: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Every row's id with ``root_source``, ``group_rows``, ``label`` and ``split``; tied rows share one split."""
    ties = tie_groups(df, rid, source, question, label)
    # a component is named by its least source, else by its question, else by its only row
    name = F.coalesce(F.encode(F.concat(F.lit("s"), F.col("root_source").cast("string")), "utf-8"), F.concat(F.encode(F.lit("q"), "utf-8"), F.col("root_question")), F.encode(F.concat(F.lit("r"), F.col(rid).cast("string")), "utf-8"))
    rows = settle(ties.select(rid, "root_source", "label", name.alias("component")))
    counts = rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    placed = assign(counts, ratios)
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("group_rows"))
    return rows.join(sizes.join(placed, "component"), "component").select(rid, "root_source", "group_rows", "label", "split")
