"""Helpers that the operators share: tables, the shared folder and materialised steps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a step is written: its shuffle files go when it ends, and Python gets batches that stay small with long texts.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", _BATCH: "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` if set.

    Only a local master, as in tests, gets a folder of its own when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def tidy(spark: SparkSession, rows: int = 0):
    """Queries planned inside run with the settings of ``_WRITING``; the session's own come back afterwards.

    ``rows``: rows that come to a Python worker at once, if fewer than usual.
    """
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in (_WRITING | ({_BATCH: str(rows)} if rows else {})).items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stash(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here.

    Python workers get ``rows`` rows at once, if given.  Its shuffle files go at once.  The files survive lost executors.
    They go when ``unstash`` is called, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark, rows):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def unstash(*stashed: DataFrame) -> None:
    """Delete the files of what ``stash`` returned: nothing that reads them may be left to do."""
    for df in stashed:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stashed)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def few_files(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt anew by its size: rows that are small beside those they were made of fill few partitions.

    On a local file system without native code Hadoop starts a ``chmod`` for each folder, file and checksum that a task
    writes, and until it runs it shares, and seems to hold, all memory of the executor.  Partitions that equal values
    of ``by`` make large are split.
    """
    return df.hint("rebalance", by)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def trim() -> None:
    """Give memory that a worker has done with back to the system: workers outlive their tasks, and others start beside them."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f):
    """``f`` over batches, which leaves little memory behind.  Frames without a row stay out: their texts have no type."""

    def run(batches):
        yield from (out for out in f(batches) if len(out))
        trim()

    return run


def lean_group(f):
    """``f`` of a group, which leaves little memory behind."""

    def run(group):
        out = f(group)
        trim()
        return out

    return run
