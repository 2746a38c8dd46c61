"""Rows where Spark's or Python's own rules part from those of the SQL: halves in sums, equal distances, equal times."""

import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet.functions.numbers import rounded, rounded_float
from rivulet.operators import clip_scores as K
from rivulet.operators import folds as D
from rivulet.operators import frames as M
from rivulet.operators import intervals as I
from rivulet.operators import slots as L
from rivulet.plans import registry


@pytest.mark.parametrize("value,digits", [(28.349999999999998, 1), (0.145, 2), (0.575, 2), (-28.349999999999998, 1), (0.1234565, 6), (2.5, 0)])
def test_rounding_is_that_of_the_sql(spark, value, digits):
    want = duckdb.execute(f"select round({value!r}::double, {digits})").fetchone()[0]
    made = spark.createDataFrame([(value,)], "v double").select(rounded("v", digits)).first()[0]
    assert (made, rounded_float(value, digits)) == (want, want)


def test_the_nearer_of_two_slots_is_told_by_rounded_distances(spark):
    seen = spark.createDataFrame([(1, 0, 10, [(-5, 1, 5), (-5, 2, 5)])], "job_id long, seq long, total long, seen array<struct<less:long,slot:int,n:long>>")
    majority = spark.createDataFrame([], "job_id long, seq long, slot int, coverage double")
    for a, b in ((31.744868, 39.780199), (46.545286, 58.546671), (31.775791, 48.461054)):
        slots = spark.createDataFrame([(1, 1, a), (1, 2, b)], "job_id long, slot int, x_center double")
        want = duckdb.execute("select arg_min(slot, (round(abs(x - (? + ?) / 2), 6), slot)) from (values (1, ?::double), (2, ?::double)) v(slot, x)", [a, b, a, b]).fetchone()[0]
        assert L.spread(seen, slots, majority).select(F.col("spread_choice.slot")).first()[0] == want


def test_equal_distances_are_told_apart_by_time_only(spark):
    # both lie .708 from 7.3, but in doubles the later one is nearer
    probes = spark.createDataFrame([(1, 7.3)], "job_id long, t double")
    marks = spark.createDataFrame([(1, 6.592, 81.5), (1, 8.008, 50.0)], "job_id long, s double, x double")
    assert 8.008 - 7.3 < 7.3 - 6.592
    for digits, want in ((None, 50.0), (6, 81.5), (9, 81.5)):
        assert I.asof_join(probes, marks, "job_id", "t", "s", ["x"], "nearest", digits=digits).first()["x"] == want


def _events(tmp_path, rows):
    """An events table of (event_id, media seconds, type), all of one user."""
    first = datetime.datetime(2024, 1, 1)
    table = pd.DataFrame([{"event_id": i, "ts": first + datetime.timedelta(hours=h), "user_id": 1, "event_type": kind, "value": 1.0, "props": "{}"} for i, h, kind in rows])
    table["ts"] = table["ts"].astype("datetime64[us]")
    table.to_parquet(tmp_path / "events.parquet")
    return str(tmp_path)


def _both(spark, folder, name):
    """The query's rows and the SQL's over a folder with events, sorted."""
    con = duckdb.connect()
    con.execute(f"create view events as from '{folder}/events.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    made = registry.queries()[name](spark, folder).toPandas()[list(want.columns)]
    plain = lambda frame: sorted(tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False))
    return plain(made), plain(want)


def test_sample_at_of_equally_near_samples(spark, tmp_path):
    made, want = _both(spark, _events(tmp_path, [(1, 0.0, "view"), (3, 126.597, "view"), (5, 128.003, "view"), (7, 170.0, "view")]), "jn18_sample_at")
    assert made == want


def test_nearest_frame_of_equally_near_frames(spark, tmp_path):
    # the segment goes from 0 to 2.4
    folder = _events(tmp_path, [(1, 0.0, "view"), (2, 0.398, "view"), (3, 2.002, "view"), (4, 9.0, "view")])
    pd.DataFrame([{"conv_id": 1, "turn": 0, "role": "user", "text": "a b c d e f"}]).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    for table in ("events", "conversations"):
        con.execute(f"create view {table} as from '{folder}/{table}.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["jn21_nearest_frame"]).fetchall())
    assert sorted(map(tuple, registry.queries()["jn21_nearest_frame"](spark, folder).collect())) == want


def test_two_pictures_of_one_time_give_both_faces(spark, tmp_path):
    made, want = _both(spark, _events(tmp_path, [(0, 0.0, "view"), (1, 3.0, "click"), (2, 7.5, "view"), (3, 7.5, "click"), (5, 9.0, "view")]), "jn32_speaking_keyframes")
    assert made == want and len({r[1] for r in made}) < len(made)


def test_regions_at_halves_of_hundredths(spark, tmp_path):
    # 0.145 and 0.575 are rounded down by the SQL, so they meet what lies in the hundredth below
    rows = [(0, 0.0, "view"), (9, 0.141, "view"), (10, 0.145, "click"), (11, 0.149, "view"), (21, 0.571, "view"), (22, 0.575, "view"), (23, 0.579, "click"), (33, 1.005, "view")]
    made, want = _both(spark, _events(tmp_path, rows), "jn35_required_regions")
    assert made == want


# in both, the first vote lasts no time and a long stretch of another kind starts with it
_VIEWS = [(1, 0.0, "view"), (2, 0.0, "purchase"), (22, 5.0, "purchase"), (3, 10.0, "error"), (9, 14.0, "error"), (11, 20.0, "view"), (33, 24.0, "view")]
_LAYOUTS = [(11, 0.0, "view"), (13, 0.0, "view"), (17, 5.0, "view"), (22, 10.0, "view"), (25, 20.0, "view"), (29, 24.0, "view")]


@pytest.mark.parametrize("name,rows", [("ts26_smoothed_votes", _VIEWS), ("ts27_layout_timeline", _LAYOUTS)])
def test_stretches_that_start_at_one_time_are_one(spark, tmp_path, name, rows):
    made, want = _both(spark, _events(tmp_path, rows), name)
    assert made == want


def test_a_short_first_stretch_gives_its_lower_slot():
    votes = [{"t": 0.0, "slot": 1}, {"t": 0.0, "slot": 3}, {"t": 10.0, "slot": 2}, {"t": 15.0, "slot": 2}]
    assert [(r["t0"], r["t1"], r["slot"]) for r in D.smoothed_votes(votes)] == [(0.0, 10.0, 1), (10.0, 15.5, 2)]


@pytest.mark.parametrize("estimates,want", [([41, 93, 73, 69, 47, 73], 57.417458), ([33, 101, 95, 45, 81], 40.916138), ([23, 54, 34, 92, 32, 58], 35.401118)])
def test_estimates_round_as_the_sql_does(estimates, want):
    assert [p["eta"] for p in D.eta_smoothed({"t": float(i), "eta": float(e)} for i, e in enumerate(estimates))][-1] == want


@pytest.mark.parametrize("name", ["ts01_hot_zones", "ts03_top_zones"])
def test_scores_of_zones_at_halves_of_tenths(spark, tmp_path, name):
    con = duckdb.connect()
    for table, key in (("events", "user_id"), ("conversations", "conv_id")):
        con.execute(f"copy (from '/root/testdata/sf0.1/{table}.parquet' where {key} in (161, 362, 485, 677)) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as from '{tmp_path}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    made = registry.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    plain = lambda frame: sorted(map(tuple, frame.itertuples(index=False)))
    assert plain(made) == plain(want)


def _counted(monkeypatch, module, name):
    """Row counts of the left sides that a module's range join gets."""
    seen, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda left, *args, **more: seen.append(left.count()) or real(left, *args, **more))
    return seen


_SEGS = [(1, 0, "user", "Wow never!", 2, 0.0, 4.0), (1, 1, "host", "it is so", 3, 4.0, 40.0), (2, 0, "user", "a", 1, 90.0, 91.0)]


def test_clips_that_begin_together_are_scored_once(spark, monkeypatch):
    segs = spark.createDataFrame(_SEGS, "job_id long, seq long, speaker string, text string, n_words long, t0 double, t1 double")
    rows = [(1, i, float(i % 2 * 4), float(20 + i)) for i in range(40)] + [(1, 40, None, 9.0), (2, 41, 0.0, 9.0), (3, 42, 0.0, 9.0)]
    clips = spark.createDataFrame(rows, "job_id long, clip_id long, c0 double, c1 double")
    seen = _counted(monkeypatch, K, "range_join")
    made = {r.clip_id: r.hook for r in K.hook_score(clips, segs).collect()}
    assert made == {i: 50 if i % 2 else 95 for i in range(40)} | {40: 15, 41: 15, 42: 15}
    assert max(seen) <= 5  # starts of a job


def test_clips_of_equal_ends_meet_the_words_once(spark, monkeypatch):
    words = spark.createDataFrame([(1, 0.0, 40.0, w, w + 0.8) for w in (1.0, 2.0, 20.0, 21.0)], "job_id long, s0 double, s1 double, w0 double, w1 double")
    rows = [(1, i, float(i % 2), 21.0) for i in range(40)] + [(1, 40, None, 9.0), (2, 41, 0.0, 9.0)]
    clips = spark.createDataFrame(rows, "job_id long, clip_id long, c0 double, c1 double")
    seen = _counted(monkeypatch, I, "range_join")
    made = {r.clip_id: (r.c0, r.c1) for r in M.snapped_to_words(clips, words).collect()}
    assert made == {i: (0.7, 21.3) if i < 40 else made[i] for i in range(42)} and made[40] == (None, 9.0) and made[41] == (0.0, 9.0)
    assert max(seen) <= 4  # pairs of ends of a job
