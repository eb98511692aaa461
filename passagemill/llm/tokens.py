"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary file of a public byte-level BPE tokenizer (``tokenizers`` JSON); a parameter, never part of the repository.
TOKENIZER = os.environ.get("PASSAGEMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Texts are handed to the tokenizer in batches of about so many characters.
BATCH_CHARS = 1 << 20


def shipped(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast (a file of a few MB), so executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_loaded: dict = {}


def _tokenizer(text: str):
    key = hash(text)
    if key not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)
        t.encode_special_tokens = True
        _loaded[key] = t
    return _loaded[key]


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row; NULL and empty texts have none."""
    vocabulary = shipped(df.sparkSession, path)
    schema = df.select(*(F.col(f"`{c}`") for c in keep)).schema

    def count(it):
        t = _tokenizer(vocabulary.value)
        for b in it:
            texts = b.column(b.num_columns - 1).to_pylist()
            sizes = np.zeros(len(texts), np.int64)
            batch, chars = [], 0
            for i, x in enumerate(texts):
                if x:
                    batch.append(i)
                    chars += len(x)
                if batch and (chars > BATCH_CHARS or i == len(texts) - 1):
                    for j, e in zip(batch, t.encode_batch_fast([texts[j] for j in batch], add_special_tokens=False), strict=True):
                        sizes[j] = len(e)
                    batch, chars = [], 0
            if batch:
                for j, e in zip(batch, t.encode_batch_fast([texts[j] for j in batch], add_special_tokens=False), strict=True):
                    sizes[j] = len(e)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes)], names=[*b.schema.names[:-1], "n_tokens"])

    wide = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text"))
    return wide.mapInArrow(count, schema.add("n_tokens", "long"))
