import datetime as dt
import time

from rivulet.streaming import state


def run(spark, query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_streams(spark, tmp_path):
    rows = [("a", at(10), 1.0, 0), ("a", at(20), 3.0, 1), ("a", at(30), 3.0, 1), ("b", at(40), 2.0, 0)]
    spark.createDataFrame(rows, "key string, ts timestamp, value double, chunk int").coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("key string, ts timestamp, value double, chunk int").parquet(f"{tmp_path}/in")
    counts = run(spark, state.failure_counts(read(), "key", "ts", "1 minute", "1 minute"), "counts", "complete")
    assert {(r.key, r.n, r.degraded) for r in counts} == {("a", 3, True), ("b", 1, False)}
    assert len(run(spark, state.unique_chunks(read(), ["key", "chunk"], "ts"), "chunks")) == 3
    out = {(r.key, r.ts): round(r.smooth, 4) for r in run(spark, state.smoothed(read(), "key", "ts", "value"), "smoothed")}
    assert out == {("a", at(10)): 1.0, ("a", at(20)): 1.8, ("a", at(30)): 2.28, ("b", at(40)): 2.0}
    assert {(r.key, r.n) for r in run(spark, state.silent_since(read(), "key", "ts"), "silent", "complete")} == {("a", 3), ("b", 1)}


def test_progress_goes_into_the_job_store(spark, tmp_path):
    from pyspark.sql import types as T

    from rivulet.sources import job_store as J

    schema = T.StructType.fromDDL("status string, progress double, progress_message string, created_at string, updated_at string, job_id string")
    store = f"{tmp_path}/jobs"
    J.save_jobs(spark.createDataFrame([("new", 0.0, "", "1", None, "a"), ("new", 0.0, "", "2", None, "b")], schema), store)
    source = f"{tmp_path}/updates"
    for batch in ([("a", 1.0, "run", 0.2, "x"), ("a", 2.0, "run", 0.5, None), ("c", 1.0, "run", 0.1, "y")], [("a", 3.0, "done", 1.0, "z")]):
        spark.createDataFrame(batch, "job_id string, ts double, status string, progress double, message string").coalesce(1).write.mode("append").json(source)
    updates = spark.readStream.schema("job_id string, ts double, status string, progress double, message string").option("maxFilesPerTrigger", 1).json(source)
    state.progress_sink(updates, store, schema, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    found = {r.job_id: r for r in J.list_jobs(spark, store, schema).collect()}
    assert set(found) == {"a", "b"} and found["b"].status == "new" and found["b"].updated_at is None
    assert (found["a"].status, found["a"].progress) == ("done", 1.0) or (found["a"].status, found["a"].progress) == ("run", 0.5)
    assert found["a"].updated_at


def test_heartbeats_of_silent_keys(spark, tmp_path):
    source = f"{tmp_path}/rows"
    spark.createDataFrame([("a", "run"), ("b", "done")], "job string, status string").coalesce(1).write.json(source)
    rows = spark.readStream.schema("job string, status string").json(source)
    query = state.heartbeats(rows, "job", "ts", 1500).writeStream.format("memory").queryName("beats").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            found = [(r.job, r.kind) for r in spark.sql("select * from beats").collect()]
            if found.count(("a", "heartbeat")) >= 2:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert found.count(("a", "progress")) == 1 and found.count(("a", "heartbeat")) >= 2 and ("b", "heartbeat") not in found
