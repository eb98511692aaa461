"""Documents, key-value stores, collections and logs on any file system Hadoop knows (IO2 to IO32, SK4, SK12 to SK24).

JSON stands for YAML and Parquet for tensor, array and embedded-database files.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.operators.ingest import first_wins
from passagemill.sources.io import read_csv, read_csvs, records


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read whole on the driver."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).first()[0]


def read_document(spark: SparkSession, path: str) -> dict:
    """A JSON document of bounded size: cluster documents, metadata, configurations, stored splits (IO9, IO29, IO30, IO31)."""
    return json.loads(read_text(spark, path))


def write_document(spark: SparkSession, path: str, doc: dict) -> None:
    """SK16, SK18."""
    write_text(spark, path, json.dumps(doc, ensure_ascii=False))


def merge_document(spark: SparkSession, path: str, **values) -> dict:
    """Keys set in a key-value document, others kept (SK13, W28)."""
    doc = (read_document(spark, path) if exists(spark, path) else {}) | values
    write_document(spark, path, doc)
    return doc


def count_rows(spark: SparkSession, path: str) -> int:
    """Records of a CSV, quoted line breaks included (IO2, IO21)."""
    return read_csv(spark, path).count()


def read_records(spark: SparkSession, paths: list[str], deduplicate: bool = True) -> DataFrame:
    """Records of several CSVs with source and question, the first of equal ones in the order of files and rows (IO3, IO4)."""
    out = None
    for frame in read_csvs(spark, paths):
        ok = records(frame)[0].select(F.col("source_text_").alias("source_text"), F.col("question_text_").alias("question_text"), "file_no", "row_no")
        out = ok if out is None else out.unionByName(ok)
    return first_wins(out, ["source_text", "question_text"], ["file_no", "row_no"]) if deduplicate else out


def restore_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Centroids and descriptors of a cluster document and its assignment settings; members aren't restored (IO8)."""
    from passagemill.sources.io import read_clusters

    clusters, _, meta = read_clusters(spark, path)
    return clusters, meta.get("assignment_config", {})


def write_vectors(df: DataFrame, path: str, meta: dict, key: str = "keyword") -> None:
    """``(key, embedding)`` as one JSON object per line, and the metadata beside them (SK4)."""
    df.select(key, "embedding").write.mode("overwrite").json(f"{path}/vectors")
    write_document(df.sparkSession, f"{path}/metadata.json", meta)


def read_vectors(spark: SparkSession, path: str, key: str = "keyword") -> tuple[DataFrame, dict]:
    """What :func:`write_vectors` wrote (IO10)."""
    return spark.read.schema(f"{key} string, embedding array<double>").json(f"{path}/vectors"), read_document(spark, f"{path}/metadata.json")


def storage_format(spark: SparkSession, folder: str, name: str, wanted: str = "auto") -> str:
    """How a table is stored: the wanted format if it is there, else the first found (IO13, IO15)."""
    kinds = {"parquet": "", "json": ".json", "csv": ".csv"}
    if wanted != "auto" and wanted not in kinds:
        raise ValueError(f"unknown format {wanted}")
    for kind, ending in kinds.items():
        if wanted in ("auto", kind) and exists(spark, f"{folder}/{name}{ending}"):
            return kind
    raise FileNotFoundError(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, wanted: str = "auto") -> DataFrame:
    """A table in whichever format it is stored (IO14 to IO17); scans are lazy."""
    kind = storage_format(spark, folder, name, wanted)
    if kind == "csv":
        return read_csv(spark, f"{folder}/{name}.csv")
    return spark.read.parquet(f"{folder}/{name}") if kind == "parquet" else spark.read.json(f"{folder}/{name}.json")


def ordered_scan(df: DataFrame, key: str) -> DataFrame:
    """The whole table in order of its key (IO19)."""
    return df.orderBy(key)


def collection(df: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Ids and the wanted fields of a collection (IO22, IO23)."""
    missing = set(include) - set(df.columns)
    if missing:
        raise ValueError(f"no fields {sorted(missing)}")
    return df.select("id", *[c for c in include if c != "id"])


def question_links(questions: list[DataFrame], passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(question_id, pos, source_id)`` from questions that list their passages' ids as JSON, and the ids that no passage has (IO25 to IO27)."""
    rows = None
    for q in questions:
        rows = q if rows is None else rows.unionByName(q)
    each = rows.select("question_id", F.posexplode(F.from_json("relevant_passage_ids", "array<long>")).alias("pos", "passage_id"))
    known = passages.select(F.col("passage_id"), F.col("source_id"))
    found = each.join(known, "passage_id").select("question_id", "pos", "source_id")
    return found, each.join(known, "passage_id", "left_anti").select("passage_id").distinct()


def register_file(spark: SparkSession, folder: str, kind: str, n: int, dim: int) -> dict:
    """A table of vectors entered in the folder's register (SK12, W27)."""
    return merge_document(spark, f"{folder}/files.json", **{kind: {"table": f"embeddings_{kind}", "n": n, "dim": dim}})


def write_triplets(triplets: DataFrame, questions: DataFrame, sources: DataFrame, path: str) -> str:
    """Triplets with their texts as CSV (SK15)."""
    s1 = sources.select(F.col("source_id").alias("source_id_1"), F.col("source").alias("source_text_1"))
    s2 = sources.select(F.col("source_id").alias("source_id_2"), F.col("source").alias("source_text_2"))
    rows = triplets.join(questions.select("question_id", F.col("question").alias("question_text")), "question_id").join(s1, "source_id_1").join(s2, "source_id_2")
    rows.select("question_id", "source_id_1", "source_id_2", "question_text", "source_text_1", "source_text_2", "label").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_map(df: DataFrame, path: str) -> str:
    """A mapping of ids as a table (SK17)."""
    df.write.mode("overwrite").parquet(path)
    return path


def append_history(spark: SparkSession, path: str, rows: list[dict]) -> DataFrame:
    """Metrics of epochs appended to a log; a field that a row lacks is NULL (SK22, SK23, W53)."""
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1)
    lines.write.mode("append").text(path)
    return spark.read.json(path)


def keep_newest(spark: SparkSession, folder: str, name: str, keep: int = 3) -> list[str]:
    """Of the checkpoints ``name=<n>`` the newest ``keep`` stay, the others are removed (SK24)."""
    p, fs = _fs(spark, f"{folder}/{name}=*")
    found = sorted((x.getPath() for x in fs.globStatus(p) or []), key=lambda x: int(x.getName().split("=")[1]))
    for x in found[:-keep] if keep else found:
        fs.delete(x, True)
    return [x.getName() for x in found[-keep:]] if keep else []


def write_checkpoint(df: DataFrame, folder: str, name: str, keep: int = 3) -> str:
    """The state of a table under the next number (SK21, SK24)."""
    path = f"{folder}/{name}={time.time_ns()}"
    df.write.parquet(path)
    keep_newest(df.sparkSession, folder, name, keep)
    return path


def last_checkpoint(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The newest checkpoint."""
    p, fs = _fs(spark, f"{folder}/{name}=*")
    found = sorted((x.getPath() for x in fs.globStatus(p) or []), key=lambda x: int(x.getName().split("=")[1]))
    return spark.read.parquet(str(found[-1])) if found else None


