"""Jobs that can be cancelled: a request ends the job's running Spark work by its tag and leaves its output untouched.

A request is a marker in the job store, so it may come from another process than the one that runs the job; the runner looks
for it while it works. (Tags of the context, not of the session: a session's are known to the thread that sets them only.)
Output is written aside and moved in when all of it is there; a job that ends otherwise takes what it
has written aside away.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.sources import job_store as J

REQUESTS = "_cancel"


class Cancelled(Exception):
    """The job was cancelled on request."""


def tag_of(job_id: str) -> str:
    return f"rivulet-job-{uuid.uuid5(uuid.NAMESPACE_OID, job_id).hex}"  # tags may not hold commas


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _marker(store: str, job_id: str) -> str:
    return f"{store}/{REQUESTS}/{tag_of(job_id)}"


def request_cancel(spark: SparkSession, store: str, job_id: str) -> None:
    """Ask a job to stop. Its work in this application is interrupted at once, elsewhere when its runner sees the request; a job
    that isn't running stops when it is started."""
    target, files = _file(spark, _marker(store, job_id))
    files.create(target, True).close()
    spark.sparkContext.cancelJobsWithTag(tag_of(job_id))


def is_cancel_requested(spark: SparkSession, store: str, job_id: str) -> bool:
    target, files = _file(spark, _marker(store, job_id))
    return files.exists(target)


def clear_request(spark: SparkSession, store: str, job_id: str) -> None:
    target, files = _file(spark, _marker(store, job_id))
    files.delete(target, False)


@contextlib.contextmanager
def cancellable(spark: SparkSession, store: str, job_id: str, look: float = 0.5) -> Iterator[None]:
    """Within, Spark work of this thread carries the job's tag and is interrupted when a request appears; then, or if there is
    one before or after, ``Cancelled`` is raised."""
    tag, over = tag_of(job_id), threading.Event()
    if is_cancel_requested(spark, store, job_id):
        raise Cancelled(job_id)

    def watch() -> None:
        while not over.wait(look):
            if is_cancel_requested(spark, store, job_id):
                spark.sparkContext.cancelJobsWithTag(tag)  # again and again: the work may be between two queries

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    spark.sparkContext.setInterruptOnCancel(True)  # or tasks would run on after their job
    watcher.start()
    try:
        yield
    except Exception as e:
        if is_cancel_requested(spark, store, job_id):
            raise Cancelled(job_id) from e
        raise
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
        spark.sparkContext.setInterruptOnCancel(False)
    if is_cancel_requested(spark, store, job_id):
        raise Cancelled(job_id)


def set_status(spark: SparkSession, store: str, schema: T.StructType, job_id: str, status: str) -> None:
    jobs = J.load_job(spark, store, schema, job_id)
    J.save_jobs(J.patch_jobs(jobs, {"status": F.lit(status)}).select(*schema.names), store)


def run_job(spark: SparkSession, store: str, schema: T.StructType, job_id: str, work: Callable[[SparkSession, str], None], output: str) -> str:
    """Run ``work(spark, folder)``, which writes into that folder, and move it to ``output``. The job's document goes from
    ``running`` to ``done``, ``cancelled`` or ``failed`` (then the error is raised again), which is returned; only a job that is
    done has an output. A request that has been obeyed is taken away."""
    aside = f"{output.rstrip('/')}-aside-{uuid.uuid4().hex[:12]}"
    set_status(spark, store, schema, job_id, "running")
    try:
        with cancellable(spark, store, job_id):
            work(spark, aside)
        source, files = _file(spark, aside)
        target, _ = _file(spark, output)
        if files.exists(source):
            files.delete(target, True)
            if not files.rename(source, target):
                raise OSError(f"{aside} can't be moved to {output}")
    except Cancelled:
        _drop(spark, aside)
        clear_request(spark, store, job_id)
        set_status(spark, store, schema, job_id, "cancelled")
        return "cancelled"
    except Exception:
        _drop(spark, aside)
        set_status(spark, store, schema, job_id, "failed")
        raise
    set_status(spark, store, schema, job_id, "done")
    return "done"


def _drop(spark: SparkSession, path: str) -> None:
    target, files = _file(spark, path)
    files.delete(target, True)
