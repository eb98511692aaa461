"""Enrichment of tables by models.

A model is a factory that returns a function over a list of texts.  It is
called once per Python worker, only for distinct inputs that have no result yet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions.hashing import uniform01
from passagemill.functions.text import is_empty_text


def stub_model() -> Callable[[list[str]], list[str]]:
    """A deterministic stand-in for a language model."""
    return lambda texts: [hashlib.md5(t.encode()).hexdigest()[:8] for t in texts]


def stub_embedder(dim: int = 8) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A deterministic stand-in for an embedding model."""

    def make():
        return lambda texts: [[b / 255 - 0.5 for b in hashlib.blake2b(t.encode(), digest_size=dim).digest()] for t in texts]

    return make


def map_texts(texts: DataFrame, column: str, make: Callable, out: str, kind: str = "string", batch: int = 32, retries: int = 2, error: str | None = None) -> DataFrame:
    """``(column, out)``: the model's result for each text, in batches.

    A batch that fails, or gives another number of results, is tried again, then
    its texts one by one.  A text that still fails ends the job, unless
    ``error`` names a column for the message; its result is NULL then.
    """

    def attempt(model, part):
        last = None
        for _ in range(retries + 1):
            try:
                got = list(model(part))
                if len(got) == len(part):
                    return got, None
                last = ValueError(f"{len(got)} results for {len(part)} texts")
            except Exception as e:  # noqa: BLE001 - reported below
                last = e
        return None, last

    def run(it):
        model = make()
        for b in it:
            values = b.column(0).to_pylist()
            got, wrong = [], []
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                results = [attempt(model, part)]
                if results[0][1] is not None and len(part) > 1:
                    results = [attempt(model, [x]) for x in part]
                for res, e in results:
                    if e is not None and error is None:
                        raise e
                    got += [None] if e is not None else res
                    wrong += [f"{type(e).__name__}: {e}"] if e is not None else [None] * len(res)
            cols = [b.column(0), pa.array(got, {"string": pa.string(), "array<double>": pa.list_(pa.float64())}[kind])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(wrong, pa.string())] if error else []), names=[column, out] + ([error] if error else []))

    return texts.select(column).mapInArrow(run, f"`{column}` string, `{out}` {kind}" + (f", `{error}` string" if error else ""))


def dedup_apply(df: DataFrame, key: str, make: Callable, out: str, kind: str = "string") -> DataFrame:
    """One model call for each distinct text that isn't blank, its result given to every row (JN14, JN15, E4)."""
    texts = df.where(~is_empty_text(F.col(key))).select(key).distinct()
    return df.join(map_texts(texts, key, make, out, kind), key, "left")


def fill_missing(df: DataFrame, key: str, existing: str, make: Callable) -> DataFrame:
    """Results only where there is none yet; old ones stay (L1, skip_existing)."""
    todo = df.where(F.col(existing).isNull() & ~is_empty_text(F.col(key))).select(key).distinct()
    new = map_texts(todo, key, make, "_new")
    return df.join(new, key, "left").withColumn(existing, F.coalesce(existing, "_new")).drop("_new")


def verdict(reply: Column) -> Column:
    """1, 2, 0 or -1 from a model's reply (L5): ``source 1``, ``source 2``, ``neither`` or both insufficient."""
    t = F.lower(F.btrim(reply, F.lit(" \t\n\r.!")))
    return F.when(t == "source 1", 1).when(t == "source 2", 2).when(t.isin("neither", "both insufficient"), 0).otherwise(-1)


def merge_labels(old: Column, new: Column) -> Column:
    """The new label unless it is undecided."""
    return F.when(new == -1, F.coalesce(old, new)).otherwise(F.coalesce(new, old))


def augment(df: DataFrame, rid: str, text: str, make: Callable, share: float = 0.5, seed: int = 42) -> DataFrame:
    """The rows and, for a seeded share of them, a changed copy."""
    drawn = df.where((uniform01(seed, "augment", F.col(rid)) < share) & ~is_empty_text(F.col(text)))
    changed = dedup_apply(drawn, text, make, "_new").where(F.col("_new").isNotNull()).withColumn(text, F.col("_new")).drop("_new")
    return df.withColumn("augmented", F.lit(False)).unionByName(changed.withColumn("augmented", F.lit(True)).select(*df.columns, "augmented"))


def generate(df: DataFrame, rid: str, text: str, make: Callable, n: int) -> DataFrame:
    """``n`` generated texts for each row, one row each."""
    base = dedup_apply(df.select(rid, text), text, make, "_g").where("_g is not null")
    return base.select(rid, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat_ws("-", "_g", i.cast("string")))).alias("k", "generated"))
