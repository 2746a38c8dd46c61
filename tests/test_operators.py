"""Row-level results of the operators, from the stated rules."""

import math

import pytest
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators import folds as D
from rivulet.operators import identity as Y
from rivulet.operators import intervals as I
from rivulet.operators import scoring as S
from rivulet.operators import series as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_time_codes(spark):
    assert one(spark, X.srt_time(F.col("t")), t=1.2) == "00:00:01,199"
    assert one(spark, X.vtt_time(F.col("t")), t=59.9996) == "00:00:60.000"
    assert one(spark, X.ass_time(F.col("t")), t=-2.0) == "0:00:00.00"
    assert one(spark, X.seconds_of_ass(F.col("t")), t="1:02:03.50") == 3723.5


def test_hold_curve(spark):
    holds = [one(spark, X.min_hold(F.col("p")), p=i / 10) for i in range(11)]
    assert holds[0] == 2.0 and math.isclose(holds[-1], 0.25) and holds == sorted(holds, reverse=True)


@pytest.mark.parametrize("gaps,want", [([0.5, 0.2], "111"), ([2.0, 2.0], "121")])
def test_pause_speakers(gaps, want):
    t, rows = 0.0, []
    for g in [0.0, *gaps]:
        rows.append({"t0": t + g, "t1": t + g + 1})
        t += g + 1
    assert "".join(r["speaker"][-1] for r in D.pause_speakers(rows)) == want


def test_label_by_overlap(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 50.0, 51.0)], "job_id long, seq long, t0 double, t1 double")
    turns = spark.createDataFrame([(1, 0.0, 4.0, "A"), (1, 4.0, 10.0, "B")], "job_id long, s0 double, s1 double, label string")
    assert {r.seq: r.label for r in I.label_by_overlap(segs, turns).collect()} == {0: "B", 1: "Speaker 1"}


def test_range_join_is_each_pair_once(spark):
    a = spark.createDataFrame([(1, i, i * 7.0, i * 7.0 + 100) for i in range(20)], "job_id long, a long, t0 double, t1 double")
    b = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 80) for i in range(20)], "job_id long, b long, s0 double, s1 double")
    on = (F.col("t0") < F.col("s1")) & (F.col("t1") > F.col("s0"))
    found = sorted((r.a, r.b) for r in I.range_join(a, b, ["job_id"], on, (F.col("t0"), F.col("t1")), (F.col("s0"), F.col("s1"))).collect())
    assert found == sorted((i, j) for i in range(20) for j in range(20) if i * 7 < j * 5 + 80 and i * 7 + 100 > j * 5)


@pytest.mark.parametrize("direction,want", [("backward", [None, 1.0, 4.0]), ("forward", [1.0, 4.0, None]), ("nearest", [1.0, 1.0, 4.0])])
def test_asof(spark, direction, want):
    a = spark.createDataFrame([(1, 0.0), (1, 2.5), (1, 9.0)], "k long, t double")
    b = spark.createDataFrame([(1, 1.0, "x"), (1, 4.0, "y")], "k long, s double, v string")
    out = {r.t: r.s for r in I.asof_join(a, b, "k", "t", "s", ["v"], direction).collect()}
    assert [out[0.0], out[2.5], out[9.0]] == want


def test_coverage_gaps(spark):
    found = spark.createDataFrame([(1, 0.0, 50.0)], "job_id long, t0 double, t1 double")
    ends = spark.createDataFrame([(1, 200.0), (2, 5.0)], "job_id long, duration double")
    assert sorted((r.job_id, r.t0, r.t1) for r in I.second_gaps(found, ends, 60).collect()) == [(1, 51, 201)]
    assert sorted((r.job_id, r.t0, r.t1) for r in I.second_gaps(found, ends, 3).collect()) == [(1, 51, 201), (2, 0, 6)]


def test_speed_timeline(spark):
    rows = spark.createDataFrame([(1, 2.0, 4.0, 2.0)], "job_id long, t0 double, t1 double, speed double")
    ends = spark.createDataFrame([(1, 10.0)], "job_id long, duration double")
    out = sorted((r.t0, r.t1, r.speed) for r in I.fill_speed(rows, ends).collect())
    assert out == [(0.0, 2.0, 1.0), (2.0, 4.0, 2.0), (4.0, 10.0, 1.0)] and sum((b - a) / s for a, b, s in out) == 9.0


def test_nms_and_thematic():
    clips = [{"t0": 0, "t1": 30, "score": 90}, {"t0": 10, "t1": 40, "score": 80}, {"t0": 100, "t1": 90, "score": 70}]
    assert [(c["t0"], c["t1"]) for c in D.nms(clips)] == [(0, 30), (90, 100)]
    titles = [{"title": "The big red fox"}] * 4 + [{"title": "other words here"}]
    assert len(list(D.thematic(titles, 2))) == 3


def test_hysteresis_and_timeline():
    e = lambda a, b, s, c: {"t0": a, "t1": b, "slot": s, "confidence": c}
    out = list(D.hysteresis([e(0, 1, 0, 0.9), e(1, 2, 1, 0.5), e(2, 3, 1, 0.8), e(3, 4, 1, 0.6)]))
    assert [(x["t0"], x["t1"], x["slot"], round(x["confidence"], 3)) for x in out] == [(0, 2, 0, 0.855), (2, 4, 1, 0.8)]
    s = lambda a, b, k: {"t0": a, "t1": b, "slot": k}
    assert list(D.transcript_timeline([s(0, 2, 0), s(4, 5, 0), s(6, 7, 1)])) == [s(0, 5.5, 0), s(5.5, 7, 1)]


def test_suppression_ends_where_the_event_ends_and_nobody_is_taken():
    e = lambda a, b, s, c: {"t0": a, "t1": b, "slot": s, "confidence": c}
    out = list(D.hysteresis([e(0, 5, 0, 0.9), e(1, 2, 1, 0.5), e(2, 3, -1, 0.1), e(3, 4, 1, 0.2)]))
    assert [(x["t0"], x["t1"], x["slot"]) for x in out] == [(0, 2, 0), (2, 3, -1), (3, 4, 1)]


def test_votes_join_before_short_runs_go():
    v = lambda *pairs: [{"job_id": 1, "t": t, "slot": s} for t, s in pairs]
    spans = lambda found: [(x["t0"], x["t1"], x["slot"]) for x in found]
    assert spans(D.smoothed_votes(v((0, "A"), (5, "B"), (6.5, "B"), (7.5, "B")))) == [(0, 5, "A"), (5, 8.0, "B")]
    assert spans(D.smoothed_votes(v((0, "A"), (1, "B"), (8, "C"), (9, "B"), (12, "B")))) == [(0, 12.5, "B")]
    assert D.smoothed_votes([]) == [] and spans(D.smoothed_votes(v((3, "A")))) == [(3, 3.5, "A")]


def test_points_follow_their_rules():
    p = lambda *xs: [{"t": float(i), "x": x} for i, x in enumerate(xs)]
    xs = lambda found: [x["x"] for x in found]
    assert xs(D.dead_zone(p(50, 54, 55, 60, 61, 70))) == [50, 50, 55, 60, 60, 70]
    assert xs(D.merged_holds(p(50, 53, 54, 50, 46))) == [50, 50, 54, 50, 46]
    assert xs(D.rate_limited([{"t": 0.0, "x": 50}, {"t": 0.25, "x": 100}, {"t": 0.25, "x": 0}, {"t": 9.0, "x": 3}])) == [50, 62, 62, 3]


def test_assigned_speakers():
    def talk(*gaps, words=5):
        t, rows = 0.0, []
        for g in [0.0, *gaps]:
            rows.append({"t0": t + g, "t1": t + g + 2, "n_words": words})
            t += g + 2
        return "".join(r["speaker"][-1] for r in D.assigned_speakers(rows))

    assert talk(0.5, 0.2) == "111" and talk(2.0, 2.0) == "121" and talk(0.3, 2.0, 0.3, 2.0) == "11221"
    assert talk(6.0, 6.0) == "121"  # the other's rate is near


def test_folds_stream_over_batches(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("job_id"), F.col("id").cast("double").alias("t"), (F.col("id") % 100).cast("int").alias("x"))
    out = D.fold(rows, "job_id", ["t"], D.merged_holds, "job_id long, t double, x int")
    assert out.count() == 30_000 and out.select("job_id", "t").distinct().count() == 30_000


def test_subtitle_sync(spark):
    items = spark.createDataFrame([(1, 0, 0.1, 1.0, "a", "x"), (1, 1, 0.2, 1.1, "b", "y"), (1, 2, 50.0, 51.0, "c", "x"), (2, 0, 0.0, 1.0, "q", None)], "job_id long, a long, s0 double, s1 double, subtitle string, said string")
    segs = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", "z"), (1, 1, 0.0, 1.2, "b", "y"), (1, 2, 9.0, 9.5, "d", "x"), (3, 0, 0.0, 1.0, "r", "x")], "job_id long, seq long, t0 double, t1 double, text string, speaker string")
    out = {r.job_id: tuple(r)[1:] for r in I.subtitle_sync(items, segs).collect()}
    assert out == {1: (2, 0, 1, 1, 1, 3, 3), 2: (0, 0, 0, 1, 0, 1, 0), 3: (0, 0, 0, 0, 1, 0, 1)}


def test_ema_switches():
    rows = [{"t": t, "who": 1, "value": 1.0} for t in range(3)] + [{"t": t, "who": 2, "value": 1.0} for t in range(3, 8)]
    assert [(x["t"], x["who"]) for x in D.ema_switches(rows)] == [(0, 1), (4, 2)]


def test_folds_keep_invariants():
    out = list(D.contiguous([{"t0": 0.0, "t1": 1.0}, {"t0": 1.02, "t1": 2.0}, {"t0": 3.0, "t1": 4.0}, {"t0": 3.5, "t1": 5.0}]))
    assert all(a["t1"] == b["t0"] for a, b in zip(out, out[1:], strict=False)) and out[-1]["t1"] == 5.0
    assert D.tv_denoise([1.0, 1.0, 1.0], 5) == [1.0, 1.0, 1.0] and max(D.tv_denoise([0.0, 10.0, 0.0], 100)) < 3.4
    assert D.gap_clusters([1, 2, 9, 10, 30], 3) == [0, 0, 1, 1, 2]
    assert [x["n"] for x in D.breaker([{"s": s} for s in (0, 100, 650, 660)])] == [1, 2, 2, 3]


def test_shots_join_without_violation(spark):
    cuts = spark.createDataFrame([(1, 3.0), (1, 7.0), (1, 99.0)], "job_id long, t double")
    ends = spark.createDataFrame([(1, 10.0)], "job_id long, duration double")
    made = T.shots(cuts, ends)
    assert sorted((r.t0, r.t1) for r in made.collect()) == [(0.0, 3.0), (3.0, 7.0), (7.0, 10.0)]
    assert T.contiguity_violations(made).count() == 0


def test_hot_zone_points(spark):
    segs = spark.createDataFrame([(1, 0, "a", "WOW that is it!", 4, 0.0, 2.0), (1, 1, "b", "fine?", 1, 2.0, 40.0)], "job_id long, seq long, speaker string, text string, n_words long, t0 double, t1 double")
    zone = S.zones(S.durations(segs))
    assert {r.k: (r.w0, r.w1) for r in zone.collect()} == {0: (0.0, 30.0), 1: (20.0, 40.0)}
    assert {r.k: r.transcript for r in S.transcript_score(segs, zone).collect()} == {0: 8 + 10 + 12 + 5}


def test_push_forward(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0), (1, 3.0, 6.0), (1, 20.0, 21.0)], "k long, t0 double, t1 double")
    assert sorted((r.t0, r.t1) for r in I.push_forward(rows, "k", ["t0", "t1"]).collect()) == [(0.0, 5.0), (5.0, 8.0), (20.0, 21.0)]


@pytest.mark.parametrize("most", [4096, 2])
def test_nearest_centroid(spark, monkeypatch, most):
    monkeypatch.setattr(Y, "MAX_CENTROIDS", most)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, -1.0])], "r long, v array<double>")
    cents = spark.createDataFrame([(7, [2.0, 0.1]), (8, [0.1, 1.0]), (9, [0.0, 1.0])], "k long, centroid array<double>")
    assert {r.r: r.identity for r in Y.nearest_centroid(rows, cents, "r", "k", "v", 0.2).collect()} == {1: 7, 2: 9, 3: -1}
