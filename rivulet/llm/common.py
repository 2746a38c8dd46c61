"""What the operators share: scratch tables in the cluster's shared folder, and views on Arrow text columns."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python operator works on at once; a single longer text is a step of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` as set for the session. Where it is unset, a local session gets a
    temporary one (as in tests); on a cluster that is an error, as executors don't share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rivulet-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the Python driver ends."""
    path = f"{shared_dir(spark)}/rivulet-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that it works for any store."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already; the cluster cleans its own scratch folder
        pass


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, through Hadoop's file system; none if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(target)) if store.exists(target) else []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in frames:
        drop_path(df.sparkSession, df._scratch)


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes a query's shuffle files when the query ends (they serve its own retries until then)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 500 rows for the session's Python operators, where the session has Spark's default of 10,000:
    texts are long, and a batch is held several times over on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "500")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def content_keys(text: str = "text") -> dict[str, Column]:
    """A 128-bit key of the whole text, in two columns."""
    value = text_or_empty(text)
    return {"c": F.xxhash64(value), "c2": F.xxhash64(F.lit("second"), value)}


def told_apart(rows: DataFrame) -> DataFrame:
    """Add ``id`` to rows with content keys ``c`` and ``c2``: a single number that unlike contents don't share. It is the
    first key, but where two contents meet in that, a hash of both."""
    clash = rows.groupBy("c").agg(F.min("c2").alias("a"), F.max("c2").alias("b")).filter("a <> b").select(F.col("c").alias("__clash"))
    rows = rows.join(materialize(clash, "content-clashes"), F.col("c") == F.col("__clash"), "left")
    return rows.withColumn("id", F.when(F.col("__clash").isNotNull(), F.xxhash64(F.lit("both"), "c", "c2")).otherwise(F.col("c"))).drop("__clash")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows whose texts hold about ``most`` bytes together."""
    if batch.num_rows == 0:
        return
    at = text_offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def text_offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind, count=array.offset + len(array) + 1)[array.offset :].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the row offsets in them (from 0)."""
    at = text_offsets(array)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[at[0] : at[-1]] if buffer is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished phases: Spark deletes them once their plans are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()
