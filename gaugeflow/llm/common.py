"""Helpers that the pipeline operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word, and what separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where that is unset and Spark runs in one process (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gaugeflow/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: For each block of ``passing_tables`` that is open, the tables stashed in it.
_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession, keep: int | tuple[str, ...] = 1) -> Iterator[None]:
    """Tables stashed within are deleted at the end, but for the last ``keep`` or those of the names in ``keep``; nothing lazy that outlives the block may read the others."""
    made: list[str] = []
    _passing.append(made)
    try:
        yield
    finally:
        _passing.pop()
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = made[-keep:] if isinstance(keep, int) else [path for path in made if path.rpartition("/")[2].rpartition("-")[0] in keep]
    for path in (path for path in made if path not in kept):
        found = jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(hadoop).delete(found, True)
    if _passing:
        _passing[-1].extend(kept)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches_of(spark: SparkSession, n_bytes: int):
    """What is written within goes to Python workers in Arrow batches of about ``n_bytes``."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def freed_shuffles(spark: SparkSession):
    """What a query within has shuffled is deleted as soon as the query has ended, not when the driver happens to collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def row_key(df: DataFrame) -> Column:
    """Two 64-bit hashes of all columns of a row, nulls included. Rows that are equal throughout have the same."""
    values = [c for name in df.columns for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit("again"), *values).alias("b"))


def release_memory() -> None:
    """Gives what a worker has freed back to the system: workers are kept for later stages, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal_memory() -> None:
    """From now on a worker's arrays of 1 MB and more lie in mappings of their own, which the system has back as soon as they are freed: workers take turns, and what one
    keeps counts beside those that work."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
