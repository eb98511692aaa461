"""Builders of small tables with awkward rows."""

import datetime as dt

PAIR_SCHEMA = "pair_id long, question_id long, source_id long, question string, source string, answer string, keywords string, relevance_score double, cluster_id long, _split_tag string, file_name string, updated_at timestamp, loaded_at timestamp"


def pair(pair_id, question="What is it?", source="It is a thing of some kind.", source_id=1, answer="a", keywords=None, score=0.5, cluster=1, tag="train", file="f.csv", at=dt.datetime(2024, 1, 1), question_id=1):
    return (pair_id, question_id, source_id, question, source, answer, keywords, score, cluster, tag, file, at, at)


def pairs(spark, rows, extra=True):
    """A pair table; with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, PAIR_SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "key", "rep", "n", "cell", "value", "pos", "first_id", "copies", "trust", "shared", "split", "label", "rid", "component", "q", "s", "sk", "train", "weight", "text"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def null_pair(pair_id=None):
    return (pair_id, *[None] * 12)
