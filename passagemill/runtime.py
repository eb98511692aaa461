"""Session-level helpers: lineage cuts in the shared folder and table access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a purely local
    session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="passagemill-")
    atexit.register(_forget, path)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    A written table survives the loss of executors and is read with column
    pruning, which RDD checkpoints lack.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path  # noqa: SLF001 - remembered so that drop_settled can remove it
    return back


@contextmanager
def tidy(spark: SparkSession):
    """Within it, what a finished query shuffled is removed at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_settled(df: DataFrame | None) -> None:
    """Remove a table written by :func:`settle` once nothing reads it any more."""
    path = getattr(df, "_settled_at", None)
    if path is None:
        return
    remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
