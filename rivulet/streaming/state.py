"""Streaming forms: sliding failure counts, de-duplication of uploads, heartbeats and stateful smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failure_counts(events: DataFrame, key: str, ts: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Failures per key in sliding windows; a window with three or more is ``degraded``."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("window.start").alias("w0"), F.col("window.end").alias("w1"), "n", (F.col("n") >= 3).alias("degraded"))


def unique_chunks(chunks: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Retries of a chunk within the watermark are dropped, and the state with them."""
    return chunks.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def smoothed(rows: DataFrame, key: str, t: str, value: str, alpha: float = 0.4) -> DataFrame:
    """Exponential smoothing per key over arriving rows; the state is the last value. Rows of one batch go by time."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        every = pd.concat(list(batches)).sort_values(t, kind="stable")
        out = []
        for x in every[value]:
            last = float(x) if last is None else alpha * float(x) + (1 - alpha) * last
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({key: group[0], t: every[t].to_numpy(), "smooth": out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {t} {kinds[t]}, smooth double", "last double", "append", GroupStateTimeout.NoTimeout)


def silent_since(rows: DataFrame, key: str, ts: str, silence: str = "15 seconds") -> DataFrame:
    """Activity sessions per key that end after a silence: what a heartbeat is due for."""
    sessions = rows.withWatermark(ts, silence).groupBy(F.session_window(ts, silence), key).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(key, F.col("session_window.start").alias("w0"), F.col("session_window.end").alias("w1"), "n")


def progress_sink(updates: DataFrame, store: str, schema, checkpoint: str):
    """Start a stream of progress updates (job_id, ts, status, progress, message) into a job store: of each batch the last
    update of every job is put into its document, by a write that swaps whole jobs. A batch that runs again after a failure
    gives the same documents. Updates of unknown jobs are ignored."""
    from rivulet.sources import job_store as J

    def put(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "message"), "ts").alias("u"))
        own = [r[0] for r in last.select("job_id").collect()]  # the jobs of one batch
        jobs = J.load_jobs(batch.sparkSession, store, schema, own).join(last, "job_id")
        changes = {"status": F.col("u.status"), "progress": F.coalesce("u.progress", "progress"), "progress_message": F.coalesce("u.message", "progress_message")}
        J.save_jobs(J.patch_jobs(jobs, changes).select(*schema.names), store)

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def heartbeats(rows: DataFrame, key: str, ts: str, silence_ms: int = 15_000) -> DataFrame:
    """(key, kind, at): every row as ``progress``, and a ``heartbeat`` whenever a key has been silent for so long, again and
    again until it speaks; a key whose ``status`` is done, failed or cancelled falls silent for good. ``at`` is
    milliseconds of processing time."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            kinds = ["heartbeat"]
            over = False
        else:
            every = pd.concat(list(batches))
            kinds = ["progress"] * len(every)
            over = bool(every["status"].isin(["done", "failed", "cancelled"]).any())
        if over:
            if state.exists:
                state.remove()
        else:
            state.update((now,))
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame({key: [group[0]] * len(kinds), "kind": kinds, "at": [now] * len(kinds)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, kind string, at long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
