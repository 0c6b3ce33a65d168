"""Shared-folder tables: cut lineage and reuse results without machine-local files."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder all executors see: ``spark.checkpoint.dir``, or a local one where that is unset (tests)."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/gneiss-shared"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished queries now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python workers at most so many rows at a time in actions inside, for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Delete the tables stored inside when the block ends, but for the paths handed to what it yields."""
    begin, kept = len(_SCRATCH), set()
    try:
        yield kept.add
    finally:
        done = [e for e in _SCRATCH[begin:] if e[1] not in kept]
        for entry in done:
            _SCRATCH.remove(entry)
            remove(*entry)


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the gateway may be gone when the interpreter ends
            return
