"""The job store over real files: bad ones, swaps of single jobs, patches, deletions and side files."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.sources import job_store as J

FIELDS = "status string, progress double, created_at string, updated_at string, clips array<struct<start:double,title:string>>, job_id string"


def test_jobs(spark, tmp_path):
    path, schema = f"{tmp_path}/jobs", T.StructType.fromDDL(FIELDS)
    assert J.list_jobs(spark, path, schema).count() == 0
    rows = [("done", 1.0, "2024-01-02", None, [(1.0, "a")], "j1"), ("new", None, "2024-01-03", None, None, "j2"), ("new", 0.5, "2024-01-01", None, [], "j3")]
    J.save_jobs(spark.createDataFrame(rows, schema), path)
    os.makedirs(f"{path}/job_id=bad")
    with open(f"{path}/job_id=bad/part-0.json", "w") as f:
        f.write('{"status": "x", ')
    assert [r.job_id for r in J.list_jobs(spark, path, schema).collect()] == ["j2", "j1", "j3"]
    assert J.load_job(spark, path, schema, "j1").first().clips[0].title == "a"
    assert [(r.job_id, r.line, r.file.endswith("part-0.json")) for r in J.unreadable(spark, path, schema).collect()] == [("bad", '{"status": "x", ', True)]
    read = {f for row in J.load_jobs(spark, path, schema, ["j1", "j3", "none"])._jdf.inputFiles() for f in [str(row)]}
    assert read and all("job_id=j1" in f or "job_id=j3" in f for f in read)
    assert J.load_job(spark, path, schema, "bad").count() == J.load_job(spark, path, schema, "none").count() == 0
    one = spark.createDataFrame(J.load_job(spark, path, schema, "j3").collect(), schema)
    J.save_jobs(J.patch_jobs(one, {"status": F.lit("done"), "unknown": F.lit(1), "job_id": F.lit("j1")}), path)
    after = {r.job_id: r for r in J.list_jobs(spark, path, schema).collect()}
    assert after["j3"].status == "done" and after["j3"].updated_at and after["j1"].updated_at is None and "unknown" not in after["j3"].asDict()
    J.delete_jobs(spark, path, ["j1", "none"])
    assert [r.job_id for r in J.list_jobs(spark, path, schema).collect()] == ["j2", "j3"]


def test_side_files(spark, tmp_path):
    assert J.recover_sessions(spark, f"{tmp_path}/.chunked_*/session.json").count() == 0
    for name, text in (("a", json.dumps({"upload_id": "u", "chunks": {"0": "x", "12": "y"}}, indent=1)), ("b", "{")):
        os.makedirs(f"{tmp_path}/.chunked_{name}")
        with open(f"{tmp_path}/.chunked_{name}/session.json", "w") as f:
            f.write(text)
    assert [tuple(r) for r in J.recover_sessions(spark, f"{tmp_path}/.chunked_*/session.json").collect()] == [("u", {0: "x", 12: "y"})]

    media = f"{tmp_path}/media"
    assert J.list_media(spark, media).count() == 0
    os.makedirs(media)
    for name in ("a b.mp4", "c.WAV", "d", "_meta.json", "_hidden.png"):
        with open(f"{media}/{name}", "w") as f:
            f.write(json.dumps({"a b": {"original_filename": "First.mp4"}, "x": {"original_filename": "No"}}) if name == "_meta.json" else "12345")
    found = J.list_media(spark, media)
    assert sorted(map(tuple, found.collect())) == [("a b", "First.mp4", "video", 5), ("c", "c.WAV", "audio", 5)]
    library = spark.createDataFrame([("c",)], "id string")
    assert [r.id for r in J.rescued_media(found, library).collect()] == ["a b"]

    schema = T.StructType.fromDDL("name string, size int")
    assert J.load_presets(spark, f"{tmp_path}/none.json", schema).count() == 0
    for name, text, want in (("p", '[{"name": "x", "size": 1}, {"name": "y"}]', [("x", 1), ("y", None)]), ("q", '[{"name"', [])):
        with open(f"{tmp_path}/{name}.json", "w") as f:
            f.write(text)
        assert [tuple(r) for r in J.load_presets(spark, f"{tmp_path}/{name}.json", schema).collect()] == want
