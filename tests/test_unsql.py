"""Queries without a SQL counterpart, against plain Python over the same rows."""

from itertools import groupby

from rivulet.operators import condense as C
from rivulet.operators import folds as D
from rivulet.operators import subjects as Z
from rivulet.plans import registry
from rivulet.sources import tables

DIR = "/root/testdata/sf0.001"


def by_job(rows, *order):
    held = sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["job_id"], *[r[c] for c in order]))
    return [list(own) for _, own in groupby(held, key=lambda r: r["job_id"])]


def made(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, DIR).collect())


def test_speakers(spark):
    rows = tables.segments(spark, DIR).select("job_id", "seq", "t0", "t1", "n_words")
    want = sorted((x["job_id"], x["seq"], x["speaker"]) for job in by_job(rows, "seq") for x in D.assigned_speakers(job))
    assert made(spark, "st09_assign_speakers", "job_id", "seq", "speaker") == want and len({w[2] for w in want}) > 1


def test_merged_stretches(spark):
    rows = tables.speaker_events(spark, DIR).selectExpr("job_id", "event_id", "t0", "t1", "slot", "event_id % 9 = 0 as cut")
    want = sorted((x["job_id"], x["t0"], x["t1"], x["slot"]) for job in by_job(rows, "t0", "event_id") for x in Z.merged_short(job, 6.0))
    assert made(spark, "ts33_merged_short", "job_id", "t0", "t1", "slot") == want
    for job in by_job(rows, "t0", "event_id"):  # nothing is lost and no border of a shot is crossed
        out = list(Z.merged_short(job, 6.0))
        assert out[0]["t0"] == job[0]["t0"] and out[-1]["t1"] == job[-1]["t1"] and {r["t0"] for r in job if r["cut"]} <= {x["t0"] for x in out}


def test_consolidated(spark):
    rows = tables.segments(spark, DIR, 0.05).select("job_id", "seq", "t0", "t1", "text")
    want = sorted((x["job_id"], x["seq"], x["t0"], x["t1"], x["text"]) for job in by_job(rows, "seq") for x in C.consolidated([r | {"text": r["text"] or ""} for r in job]))
    assert made(spark, "st08_consolidated_segments", "job_id", "seq", "t0", "t1", "text") == want


def test_answers(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if r.text is not None}
    assert made(spark, "sf31_escaped_breaks", "doc_id", "same") == sorted((k, True) for k in docs)
    found = dict(made(spark, "sf30_json_object", "doc_id", "n"))
    assert found == {k: None if k % 6 == 5 else k for k in docs}


def test_position_clusters(spark):
    found = made(spark, "st19_position_clusters", "job_id", "center", "count")
    assert found and all(count >= 2 for _, _, count in found)
    for _, own in groupby(found, key=lambda r: r[0]):
        centres = [c for _, c, _ in own]
        assert len(centres) >= 2 and all(b - a >= 8 for a, b in zip(centres, centres[1:], strict=False))
