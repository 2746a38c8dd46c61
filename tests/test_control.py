"""Cancelling running jobs."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.sources import job_store as J
from rivulet.streaming import control as C

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("status", "created_at", "updated_at", "job_id")])


@pytest.fixture
def store(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    J.save_jobs(spark.createDataFrame([("new", "2024-01-01", None, j) for j in ("a b", "c")], SCHEMA), path)
    return path


def status(spark, store, job):
    return J.load_job(spark, store, SCHEMA, job).first().status


def endless(spark, folder):
    """Writes some rows at once; the others take days."""
    spark.range(0, 10, 1, 1).union(spark.range(0, 10**14, 1, 1).filter(F.sqrt("id") < 0)).write.parquet(folder)


@pytest.mark.parametrize("from_outside", [False, True])
def test_a_request_ends_a_running_query(spark, store, tmp_path, from_outside):
    out, result = f"{tmp_path}/out", {}
    other = spark.range(3).count()

    def run():
        result["status"] = C.run_job(spark, store, SCHEMA, "a b", endless, out)
        result["ended"] = time.time()

    runner = threading.Thread(target=run, daemon=True)
    runner.start()
    time.sleep(6)
    assert runner.is_alive() and status(spark, store, "a b") == "running"
    asked = time.time()
    if from_outside:  # the marker alone, as another process would leave it
        target, files = C._file(spark, C._marker(store, "a b"))
        files.create(target, True).close()
    else:
        C.request_cancel(spark, store, "a b")
    runner.join(30)
    assert result["status"] == "cancelled" and result["ended"] - asked < 10
    assert status(spark, store, "a b") == "cancelled" and status(spark, store, "c") == "new"
    assert not os.path.exists(out) and not [x for x in os.listdir(tmp_path) if "aside" in x] and not C.is_cancel_requested(spark, store, "a b")
    assert other == 3 and spark.range(5).count() == 5


def test_jobs_that_end_by_themselves(spark, store, tmp_path):
    out = f"{tmp_path}/out"
    assert C.run_job(spark, store, SCHEMA, "c", lambda s, f: s.range(7).write.parquet(f), out) == "done"
    assert spark.read.parquet(out).count() == 7 and status(spark, store, "c") == "done"

    def fails(s, folder):
        s.range(2).write.parquet(folder)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        C.run_job(spark, store, SCHEMA, "c", fails, out)
    assert status(spark, store, "c") == "failed" and spark.read.parquet(out).count() == 7
    C.request_cancel(spark, store, "c")  # before it runs
    assert C.run_job(spark, store, SCHEMA, "c", lambda s, f: s.range(1).write.parquet(f), out) == "cancelled"
    assert spark.read.parquet(out).count() == 7
    assert C.run_job(spark, store, SCHEMA, "c", lambda s, f: s.range(1).write.parquet(f), out) == "done" and spark.read.parquet(out).count() == 1
