"""Duplicates hidden by formatting differences (problem 2).

Method: recursive radix partitioning on canonical bytes.  Canonical bytes are
the letters and digits of the lower-cased fields in a fixed field order.  Every
scan task first collapses the copies it holds in a trie with terminal counters
(so a text that fills a third of the table leaves each task once), then the
buckets of the first eight bytes are counted; a bucket with too many entries is
split by the next eight bytes, again and again, until each fits.  One task
counts the tries of its buckets.  Every row finds its group through the
representative of its scan task, so no task ever holds a whole group.  A bucket
has at most ``BUCKET_BYTES`` bytes of keys, at every size of the table; a task
holds the tries of one bucket at a time.

Defined results: rows with a missing field (NULL, blank, ``nan``) belong to no
group; text of any length counts whole; a field that has no letters and no
digits is equal to any other such field; rows repeated with the same id count
as copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions.text import same_writing, strip_all
from passagemill.runtime import settle

DIGIT = 8
#: Bytes of keys after which a scan task starts a new trie.
CHUNK_BYTES = 64 << 20
#: A bucket with more bytes of keys is split by further bytes; a task gets about so many bytes.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 32 << 20


class CountingTrie:
    """Trie over 8-byte digits with terminal counters; a path with one key is kept as a leaf until a second key needs it."""

    __slots__ = ("root", "bytes")

    def __init__(self):
        self.root: dict = {}
        self.bytes = 0

    def add(self, key: bytes, rid: int, n: int = 1, least: int | None = None) -> list:
        """The terminal ``[key, representative, copies, least id]``; a new key makes ``rid`` its representative."""
        least = rid if least is None else least
        node, i = self.root, 0
        while True:
            digit = key[i : i + DIGIT]
            slot = node.get(digit)
            if slot is None:
                node[digit] = leaf = [key, rid, n, least]
                self.bytes += len(key)
                return leaf
            if type(slot) is list:
                if slot[0] == key:
                    slot[2] += n
                    slot[3] = min(slot[3], least)
                    return slot
                node[digit] = inner = {slot[0][i + DIGIT : i + 2 * DIGIT]: slot}
                slot = inner
            node, i = slot, i + DIGIT

    def terminals(self):
        stack = [self.root]
        while stack:
            for x in stack.pop().values():
                if type(x) is list:
                    yield x
                else:
                    stack.append(x)


_CHUNK = pa.schema([("tab", pa.int8()), ("id", pa.int64()), ("rep", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64())])


def _collapse_chunk(it):
    """Every row with its representative among the rows of this task; representatives carry the key and their counts."""
    tries: dict[int, CountingTrie] = {}

    def flush():
        for tab, t in tries.items():
            rows = list(t.terminals())
            for k in range(0, len(rows), 4096):
                key, rep, n, least = zip(*rows[k : k + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([tab] * len(key), pa.int8()), pa.array(rep, pa.int64()), pa.array(rep, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], schema=_CHUNK)
        tries.clear()

    for b in it:
        tabs, ids, reps = [], [], []
        for tab, rid, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            t = tries.setdefault(tab, CountingTrie())
            known = t.bytes
            leaf = t.add(key, rid)
            if t.bytes == known:
                tabs.append(tab), ids.append(rid), reps.append(leaf[1])
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(tabs, pa.int8()), pa.array(ids, pa.int64()), pa.array(reps, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_CHUNK)
        if sum(t.bytes for t in tries.values()) > CHUNK_BYTES:
            yield from flush()
    yield from flush()


def _count_buckets(it):
    """The tries of the buckets of one task, which come in order: each representative of a group with more than one copy, its group's least id and count."""
    tries: dict[int, CountingTrie] = {}
    chains: dict[int, list[int]] = {}
    done: list[tuple[int, int, int, int]] = []
    current = None

    def count():
        done.extend((tab, rep, leaf[3], leaf[2]) for tab, t in tries.items() for leaf in t.terminals() if leaf[2] > 1 for rep in chains[id(leaf)])
        tries.clear()
        chains.clear()

    def batch():
        cols = zip(*done, strict=True) if done else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int8(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["tab", "rep", "first_id", "copies"])

    for b in it:
        for bucket, tab, rep, key, n, least in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if bucket != current:
                count()
                current = bucket
                if len(done) > 8192:
                    yield batch()
                    done.clear()
            leaf = tries.setdefault(tab, CountingTrie()).add(key, rep, n, least)
            chains.setdefault(id(leaf), []).append(rep)
    count()
    yield batch()


def radix_buckets(keys: DataFrame, cap: int) -> DataFrame:
    """``keys`` with a column ``bucket``: the shortest run of whole digits of ``key`` whose keys have at most ``cap`` bytes, or one whole key."""
    keyed = keys.withColumn("bucket", F.substring("key", 1, DIGIT)).withColumn("open", F.lit(True))
    depth = DIGIT
    while True:
        sizes = keyed.where(F.col("open") & (F.length("key") > depth)).groupBy("bucket").agg(F.sum(F.length("key").cast("long")).alias("size"))
        over = settle(sizes.where(F.col("size") > cap).select("bucket", F.lit(True).alias("split")), 1)
        if over.isEmpty():
            return keyed.drop("open")
        keyed = keyed.join(over, "bucket", "left")
        depth += DIGIT
        split = F.col("split").isNotNull() & F.col("open")
        keyed = keyed.withColumn("bucket", F.when(split, F.substring("key", 1, depth)).otherwise(F.col("bucket"))).withColumn("open", split).drop("split")


def copy_members(tables: list[tuple[DataFrame, str, list[str]]], bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows ``(tab, id, rep, ...)`` of all tables and the groups ``(tab, rep, first_id, copies)`` with more than one copy.

    ``tables``: frame, id column and compared fields of each; ``tab`` is its position.
    """
    parts = []
    for i, (df, rid, fields) in enumerate(tables):
        canon = [same_writing(F.col(f"`{f}`").cast("string")) for f in fields]
        key = F.concat_ws("\x1f", *canon)
        complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in canon])
        parts.append(df.where(complete & F.col(f"`{rid}`").isNotNull()).select(F.lit(i).cast("byte").alias("tab"), F.col(f"`{rid}`").cast("long").alias("id"), key.alias("key")))
    chunks = settle(reduce(DataFrame.unionAll, parts).mapInArrow(_collapse_chunk, "tab byte, id long, rep long, key binary, n long, least long"))
    heads = chunks.where("key is not null").select("tab", "rep", "key", "n", "least")
    total = heads.agg(F.sum(F.length("key").cast("long"))).first()[0] or 0
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    bucketed = radix_buckets(heads, bucket_bytes).repartition(tasks, "bucket").sortWithinPartitions("bucket").select("bucket", "tab", "rep", "key", "n", "least")
    groups = settle(bucketed.mapInArrow(_count_buckets, "tab byte, rep long, first_id long, copies long"))
    return chunks.select("tab", "id", "rep"), groups


def collapse_copies(df: DataFrame, rid: str, fields: list[str]) -> DataFrame:
    """``(rid, first_id, copies)`` for every row whose fields are all present."""
    rows, groups = copy_members([(df, rid, fields)])
    joined = rows.join(groups, ["tab", "rep"], "left")
    return joined.select(F.col("id").alias(rid), F.coalesce("first_id", "id").alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def repeated_rows(df: DataFrame, rid: str, fields: list[str]) -> DataFrame:
    """``(rid, first_id, copies)`` for the rows of groups of two and more only."""
    rows, groups = copy_members([(df, rid, fields)])
    return rows.join(groups, ["tab", "rep"]).select(F.col("id").alias(rid), "first_id", "copies")


#: Names under which a payload holds its question and its passage, the preferred first.
QUESTION_NAMES = ("question", "question_text", "query")
PASSAGE_NAMES = ("source", "source_text", "context", "passage")


def readable_records(raw: DataFrame) -> DataFrame:
    """``(raw_id, question, source)`` of the payloads that hold a whole JSON object."""
    names = QUESTION_NAMES + PASSAGE_NAMES
    closed = F.substring(strip_all(F.col("payload")), -1, 1) == "}"
    parsed = F.from_json("payload", ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE"})
    return raw.where(closed).select("raw_id", parsed.alias("p")).select("raw_id", F.coalesce(*(F.col(f"p.{n}") for n in QUESTION_NAMES)).alias("question"), F.coalesce(*(F.col(f"p.{n}") for n in PASSAGE_NAMES)).alias("source"))


def copies_found(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """``(table_name, first_id, copy_id)`` for every copy but the first of its group, in both tables."""
    fields = ["question", "source"]
    rows, groups = copy_members([(pairs, "pair_id", fields), (readable_records(raw), "raw_id", fields)])
    joined = rows.join(groups, ["tab", "rep"]).where(F.col("id") != F.col("first_id"))
    return joined.select(F.when(F.col("tab") == 0, "pairs").otherwise("raw_pairs").alias("table_name"), "first_id", F.col("id").alias("copy_id"))
