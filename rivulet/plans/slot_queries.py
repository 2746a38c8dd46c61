"""Queries: slots of stretches of time, crops, registries of faces and what they tell about a video."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.numbers import rounded
from rivulet.operators import intervals as I
from rivulet.operators import slots as L
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

_SPK_ONLY = duck.SPK.split(", spk as ", 1)[1]
BASE = f"{duck.FACES}, spk as {_SPK_ONLY}, {duck.SPANS}"
SEEN = """inside as (select distinct s.job_id, s.seq, f.event_id, f.slot from spans s join faces f on f.job_id = s.job_id and f.t >= s.t0 and f.t <= s.t1),
total as (select job_id, seq, count(distinct event_id) as total from inside group by all), per as (select job_id, seq, slot, count(*) as n from inside where slot >= 0 group by all),
ranked as (select *, row_number() over (partition by job_id, seq order by n desc, slot) as r from per join total using (job_id, seq))"""
DOMINANT = "dom as (select a.job_id, a.seq, a.slot from ranked a where r = 1 and n / total >= 0.7e0 and not exists (select 1 from ranked b where b.job_id = a.job_id and b.seq = a.seq and b.r > 1 and b.n / b.total >= 0.3e0))"
REG = "reg as (select job_id, slot, round(avg(x), 6) as x_center, min(x) as x_min, max(x) as x_max, count(distinct event_id) as frame_count, round(avg(w), 6) as avg_width, round(avg(y), 6) as avg_y, round(stddev_pop(y), 6) as y_dev from faces where slot >= 0 group by all)"
_OV = "greatest(0e0, least(s.t1, spk.t1) - greatest(s.t0, spk.t0))"


def _majority(name: str, floor: str) -> str:
    return f"""{name} as (select job_id, seq, slot, round(sec / greatest(t1 - t0, 1e-9), 6) as coverage from (select *, row_number() over (partition by job_id, seq order by sec desc, slot) as r from
    (select s.job_id, s.seq, s.t0, s.t1, slot, round(sum({_OV}), 6) as sec from spans s join spk on s.job_id = spk.job_id and spk.t0 < s.t1 and spk.t1 > s.t0 where confidence >= {floor} group by all)) where r = 1)"""


_CROP = L.crop_width()
SPREAD = f"""multi as (select job_id, seq, slot, n, x_center, avg(x_center) over (partition by job_id, seq) as cx, count(*) over (partition by job_id, seq) as k from ranked join reg using (job_id, slot) where n / total >= 0.2e0),
grp as (select job_id, seq, max(x_center) - min(x_center) as span, arg_min(slot, (round(abs(x_center - cx), 6), slot)) as nearest, arg_max(slot, (n, -slot)) as most, list(slot) as there from multi where k >= 2 group by all),
spread as (select g.job_id, g.seq, case when span < {_CROP * L.FITS}e0 then nearest when list_contains(there, m.slot) then m.slot else most end as slot,
  case when span < {_CROP * L.FITS}e0 then 0.75e0 when list_contains(there, m.slot) then least(1, greatest(0.6e0, m.coverage)) else 0.55e0 end as confidence, case when span < {_CROP * L.FITS}e0 then 'dense_face_dominant' when list_contains(there, m.slot) then 'active_speaker_slot' else 'dense_face_dominant' end as source
  from grp g left join maj m on m.job_id = g.job_id and m.seq = g.seq)"""


def _faces(spark, d):
    return tables.dense_faces(spark, d)


def _events(spark, d, share=None):
    e = tables.speaker_events(spark, d)
    return e.select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "slot", "confidence")


def _seen(spark, d):
    return L.visible(tables.spans(spark, d), _faces(spark, d))


@register("jn06_dominant_slot", f"with {BASE}, {SEEN}, {DOMINANT} select job_id, seq, slot from total left join dom using (job_id, seq)")
def dominant_slot(spark, d):
    return _seen(spark, d).select("job_id", "seq", L.dominant().alias("slot"))


@register("jn07_crowds", f"with {BASE}, {SEEN} select job_id, seq, count(slot) filter (where n / total >= 0.2e0) >= 3 as crowd from total left join ranked using (job_id, seq, total) group by all")
def crowds(spark, d):
    return _seen(spark, d).select("job_id", "seq", (F.size(L.present()) >= 3).alias("crowd"))


@register("jn09_spread_choice", f"with {BASE}, {SEEN}, {REG}, {_majority('maj', '0e0')}, {SPREAD} select job_id, seq, slot, round(confidence, 6) as confidence, source from spread")
def spread_choice(spark, d):
    spans = tables.spans(spark, d)
    found = L.spread(_seen(spark, d), L.registry(_faces(spark, d)), I.slot_coverage(spans, _events(spark, d), digits=6))
    return found.select("job_id", "seq", F.col("spread_choice.slot").alias("slot"), F.col("spread_choice.confidence").alias("confidence"), F.col("spread_choice.source").alias("source"))


@register(
    "jn08_resolved_slots",
    f"""with {BASE}, {SEEN}, {DOMINANT}, {REG}, {_majority("maj", "0e0")}, {_majority("tr", "0.6e0")}, {SPREAD}
    select s.job_id, s.seq, case when tr.coverage >= 0.6e0 then tr.slot when maj.coverage >= 0.5e0 then maj.slot when dom.slot is not null then dom.slot else spread.slot end as slot,
      round(case when tr.coverage >= 0.6e0 then least(1, tr.coverage) when maj.coverage >= 0.5e0 then least(1, maj.coverage) when dom.slot is not null then 0.7e0 else coalesce(spread.confidence, 0.3e0) end, 6) as confidence,
      case when tr.coverage >= 0.6e0 or maj.coverage >= 0.5e0 or dom.slot is not null or spread.slot is not null then 'single' else 'wide_master' end as layout,
      case when tr.coverage >= 0.6e0 or maj.coverage >= 0.5e0 then 'active_speaker_slot' when dom.slot is not null then 'dense_face_dominant' else coalesce(spread.source, 'hardcoded_center') end as source
    from spans s left join tr using (job_id, seq) left join maj using (job_id, seq) left join dom using (job_id, seq) left join spread using (job_id, seq)""",
)
def resolved_slots(spark, d):
    return L.resolve(tables.spans(spark, d), _events(spark, d), _events(spark, d), _faces(spark, d))


@register("jn10_active_slots", f"with {BASE}, {_majority('maj', '0e0')} select job_id, seq, coalesce(slot, -1) as slot from spans left join maj using (job_id, seq)")
def active_slots(spark, d):
    spans = tables.spans(spark, d)
    return spans.select("job_id", "seq").join(I.slot_coverage(spans, _events(spark, d), digits=6), ["job_id", "seq"], "left").select("job_id", "seq", F.coalesce("slot", F.lit(-1)).alias("slot"))


@register("jn12_speaker_agreement", f"with {BASE}, a as (select s.job_id, s.seq, round(sum({_OV}), 6) as total, round(sum(case when slot = s.seq % 4 then {_OV} else 0 end), 6) as own from spans s join spk on s.job_id = spk.job_id and spk.t0 < s.t1 and spk.t1 > s.t0 group by all) select job_id, seq, coalesce(total > 0 and own / total >= 0.5e0, false) as agrees from spans left join a using (job_id, seq)")
def speaker_agreement(spark, d):
    return L.agreement(tables.spans(spark, d).withColumn("candidate", F.col("seq") % 4), _events(spark, d))


CROPS = f"crops as (select *, case when x + {_CROP / 2}e0 > 100 then 100 - {_CROP}e0 when x - {_CROP / 2}e0 < 0 then 0 else x - {_CROP / 2}e0 end as lo, case when x + {_CROP / 2}e0 > 100 then 100 when x - {_CROP / 2}e0 < 0 then {_CROP}e0 else x + {_CROP / 2}e0 end as hi from (select *, (seq * 13 % 101)::double as x from spans))"


def _crops(spark, d):
    return tables.spans(spark, d).withColumn("cx", (F.col("seq") * 13 % 101).cast("double"))


@register("jn14_faces_in_crop", f"with {BASE}, {CROPS}, n as (select c.job_id, c.seq, count_if(f.x between lo and hi) as n_in, count(*) as n_faces from crops c join faces f on f.job_id = c.job_id and f.t between c.t0 and c.t1 where f.slot >= 0 group by all) select job_id, seq, coalesce(n_in, 0) as n_in, coalesce(n_faces, 0) as n_faces, coalesce(n_in / n_faces >= 0.3e0, false) as inside from spans left join n using (job_id, seq)")
def faces_in_crop(spark, d):
    return L.faces_in_crop(_crops(spark, d), _faces(spark, d).select("job_id", "t", "slot", "x"), _CROP)


FEATURES = "features as (select job_id, t as f0, t + 2 as f1, x - w / 2 as f_left, x + w / 2 as f_right, 'face ' || slot as name, event_id * 10 + k as place from faces where slot >= 0 and event_id % 5 < 2)"


def _features(spark, d):
    f = _faces(spark, d).filter("slot >= 0 and event_id % 5 < 2")
    return f.select("job_id", F.col("t").alias("f0"), (F.col("t") + 2).alias("f1"), (F.col("x") - F.col("w") / 2).alias("left"), (F.col("x") + F.col("w") / 2).alias("right"), F.concat(F.lit("face "), F.col("slot").cast("string")).alias("name"), (F.col("event_id") * 10 + F.col("k")).alias("place"))


@register("jn15_clipped_features", f"with {BASE}, {CROPS}, {FEATURES}, bad as (select c.job_id, c.seq, arg_min(name, place) as clipped from crops c join features f on f.job_id = c.job_id and f1 >= c.t0 and f0 <= c.t1 where f_left < lo or f_right > hi group by all) select job_id, seq, clipped from spans left join bad using (job_id, seq)")
def clipped_features(spark, d):
    return L.first_clipped(_crops(spark, d), _features(spark, d), _CROP)


@register("jn16_face_near_middle", f"with {BASE}, {CROPS} select c.job_id, c.seq from crops c where exists (select 1 from faces f where f.job_id = c.job_id and f.slot >= 0 and abs(f.t - (c.t0 + c.t1) / 2) <= 0.5e0 and f.x between lo and hi)")
def face_near_middle(spark, d):
    return L.face_near_middle(_crops(spark, d), _faces(spark, d), _CROP).select("job_id", "seq")


SAMPLES = "samples as (select job_id, t as s, round(avg(x), 6) as x from faces group by all)"


def _samples(spark, d):
    return _faces(spark, d).groupBy("job_id", F.col("t").alias("s")).agg(rounded(F.avg("x"), 6).alias("x"))


@register(
    "jn18_sample_at",
    f"""with {BASE}, {SAMPLES}, probes as (select job_id, seq, t0 + case when seq % 3 = 0 then 0.0004e0 else 7.3e0 end as t from spans), exact as (select p.job_id, p.seq, x from probes p join samples m on m.job_id = p.job_id and m.s = round(p.t, 3)),
    near as (select p.job_id, p.seq, arg_min(x, (round(abs(m.s - p.t), 9), m.s)) as x from probes p join samples m on m.job_id = p.job_id group by all) select job_id, seq, coalesce(exact.x, near.x) as x from probes left join exact using (job_id, seq) left join near using (job_id, seq)""",
)
def sample_at(spark, d):
    """The sample of exactly that millisecond, else the nearest."""
    t = F.col("t0") + F.when(F.col("seq") % 3 == 0, 0.0004).otherwise(7.3)
    probes = tables.spans(spark, d).select("job_id", "seq", t.alias("t"))
    samples = _samples(spark, d)
    exact = samples.select("job_id", F.col("s").alias("r"), F.col("x").alias("e"))
    near = I.asof_join(probes, samples, "job_id", "t", "s", ["x"], "nearest", digits=9).withColumn("r", rounded("t", 3))
    return near.join(exact, ["job_id", "r"], "left").select("job_id", "seq", F.coalesce("e", "x").alias("x"))


@register("jn19_slot_positions", f"with {BASE} select s.job_id, s.seq, f.t, f.x, f.y, f.w, f.h from spans s join faces f on f.job_id = s.job_id and f.t between s.t0 and s.t1 where f.slot = s.seq % 4")
def slot_positions(spark, d):
    rows = L.in_spans(tables.spans(spark, d).withColumn("wanted", F.col("seq") % 4), _faces(spark, d).select("job_id", "t", "slot", "x", "y", "w", "h"))
    return rows.filter("slot = wanted").select("job_id", "seq", "t", "x", "y", "w", "h")


@register(
    "jn20_box_at",
    f"""with {BASE}, traj as (select job_id, slot, t as s, max(x) as x from faces where slot = 1 group by all), ends as (select job_id, min(s) as lo, max(s) as hi from traj group by 1), p as (select job_id, seq, t0 + 11 as t from spans)
    select p.job_id, p.seq, case when p.t between lo and hi then (select arg_min(x, (round(abs(s - p.t), 9), s)) from traj where traj.job_id = p.job_id) end as x from p left join ends on ends.job_id = p.job_id""",
)
def box_at(spark, d):
    """The nearest place of slot 1 in time, nothing outside its first and last."""
    traj = _faces(spark, d).filter("slot = 1").groupBy("job_id", F.col("t").alias("s")).agg(F.max("x").alias("x"))
    ends = traj.groupBy("job_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    p = tables.spans(spark, d).select("job_id", "seq", (F.col("t0") + 11).alias("t"))
    near = I.asof_join(p, traj, "job_id", "t", "s", ["x"], "nearest").join(ends, "job_id", "left")
    return near.select("job_id", "seq", F.when(F.col("t").between(F.col("lo"), F.col("hi")), F.col("x")).alias("x"))


@register(
    "jn37_box_iou",
    f"""with {BASE}, p as (select a.job_id, a.event_id, a.x ax, a.y ay, a.w aw, a.h ah, b.x bx, b.y by_, b.w bw, b.h bh from faces a join faces b using (job_id, event_id) where a.k = 0 and b.k = 1),
    o as (select *, greatest(0, least(ax + aw / 2, bx + bw / 2) - greatest(ax - aw / 2, bx - bw / 2)) * greatest(0, least(ay + ah / 2, by_ + bh / 2) - greatest(ay - ah / 2, by_ - bh / 2)) as i from p) select job_id, event_id, round(i / (aw * ah + bw * bh - i), 6) as iou from o""",
)
def box_iou(spark, d):
    f = _faces(spark, d)
    a = f.filter("k = 0").select("job_id", "event_id", *[F.col(c).alias(f"a{c}") for c in "xywh"])
    b = f.filter("k = 1").select("job_id", "event_id", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    return a.join(b, ["job_id", "event_id"]).select("job_id", "event_id", F.round(I.iou([F.col(f"a{c}") for c in "xywh"], [F.col(f"b{c}") for c in "xywh"]), 6).alias("iou"))


@register("jn40_hard_constraints", f"with {BASE}, {FEATURES}, c as (select job_id, place, f0 as t, greatest({_CROP / 2}e0, f_right - {_CROP / 2}e0) as min_x, least({100 - _CROP / 2}e0, f_left + {_CROP / 2}e0) as max_x from features) select job_id, place, t, round(min_x, 6) as min_x, round(max_x, 6) as max_x from c where min_x <= max_x")
def hard_constraints(spark, d):
    """Where the middle of a crop may stand so that a feature stays whole within it."""
    half = _CROP / 2
    rows = _features(spark, d).select("job_id", "place", F.col("f0").alias("t"), F.greatest(F.lit(half), F.col("right") - half).alias("a"), F.least(F.lit(100 - half), F.col("left") + half).alias("b"))
    return rows.filter("a <= b").select("job_id", "place", "t", F.round("a", 6).alias("min_x"), F.round("b", 6).alias("max_x"))


@register("jn41_segment_positions", f"with {BASE} select s.job_id, s.seq, f.t, arg_min(f.x, f.k) as x from spans s join faces f on f.job_id = s.job_id and f.t >= s.t0 and f.t < s.t1 where s.seq % 5 = 4 or f.slot = s.seq % 5 group by s.job_id, s.seq, f.event_id, f.t")
def segment_positions(spark, d):
    """Every fifth stretch has no slot of its own."""
    return L.positions_of(tables.spans(spark, d).withColumn("candidate", F.when(F.col("seq") % 5 < 4, F.col("seq") % 5)), _faces(spark, d))


@register("st10_registry", f"with {BASE}, {REG} select * from reg")
def registry(spark, d):
    return L.registry(_faces(spark, d))


@register("ag15_continuous_motion", f"with {BASE}, {REG}, g as (select job_id, count(*) as n, sum(frame_count) as frames, round(avg(x_max - x_min), 6) as mean, arg_max(x_max - x_min, (frame_count, -slot)) as top_range, max(frame_count) as top from reg group by 1) select job_id, case when n = 1 then top_range > 15 else (top / frames > 0.6e0 and top_range > 20) or mean > 15 end as moving from g")
def continuous_motion(spark, d):
    return L.continuous_motion(L.registry(_faces(spark, d)))


@register("ag19_gameplay", f"with {BASE}, n as (select job_id, count(*) as frames, count_if(event_id % 4 > 0) as with_face from ev group by 1) select job_id, case when with_face / frames > 0.3e0 then 'not_gameplay' when job_id % 10 / 10e0 > 0.6e0 or (job_id % 7 / 7e0 > 0.5e0 and with_face / frames < 0.1e0) then 'gameplay' when with_face / frames < 0.05e0 then 'unknown' else 'not_gameplay' end as kind from n")
def gameplay(spark, d):
    """Share of frames with a face; crosshair and HUD scores stand in by rule."""
    n = tables.timed_events(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("event_id") % 4 > 0).alias("with_face"))
    ratio = F.col("with_face") / F.col("frames")
    sure = (F.col("job_id") % 10 / 10 > 0.6) | ((F.col("job_id") % 7 / 7 > 0.5) & (ratio < 0.1))
    return n.select("job_id", F.when(ratio > 0.3, "not_gameplay").when(sure, "gameplay").when(ratio < 0.05, "unknown").otherwise("not_gameplay").alias("kind"))


@register(
    "ag21_facecams",
    f"""with {BASE}, {REG}, tf as (select job_id, count(distinct event_id) as total from faces group by 1), c as (select *, case when x_center < 49 and avg_y > 51 then 'bottom_left' when x_center > 51 and avg_y > 51 then 'bottom_right' when x_center < 49 and avg_y < 49 then 'top_left' when x_center > 51 and avg_y < 49 then 'top_right' end as corner from reg join tf using (job_id)
    where avg_width <= 15 and frame_count >= total * 0.02e0 and x_max - x_min <= 100 and y_dev <= 40) select job_id, arg_min(slot, slot) as slot, arg_min(corner, slot) as corner from c where corner is not null group by 1""",
)
def facecams(spark, d):
    """The first small slot that keeps to a corner; how far out that is and how much it may move are parameters (the faces here jump about)."""
    faces = _faces(spark, d)
    total = faces.groupBy("job_id").agg(F.countDistinct("event_id").alias("total"))
    slots = L.registry(faces).join(total, "job_id").withColumn("corner", L.corner_of(F.col("x_center"), F.col("avg_y"), 1.0, 1.0))
    held = slots.filter((F.col("avg_width") <= 15) & (F.col("frame_count") >= F.col("total") * 0.02) & (F.col("x_max") - F.col("x_min") <= 100) & (F.col("y_dev") <= 40) & F.col("corner").isNotNull())
    return held.groupBy("job_id").agg(F.min("slot").alias("slot"), F.min_by("corner", "slot").alias("corner"))


@register(
    "ag22_layout_votes",
    f"""with {BASE}, ids as (select job_id, event_id, slot, max(w + k * 3 - 6) as w from faces where slot >= 0 group by all), i as (select job_id, event_id, count(*) as n, list_reverse_sort(list(w)) as sizes from ids group by all), f as (select job_id, event_id, count(*) as faces, list_reverse_sort(list(w + k * 3 - 6)) as widths from faces group by all)
    select f.job_id, f.event_id, case when f.event_id % 11 = 0 then 'screenshare' when coalesce(n, 0) >= 3 then 'triple' when n = 2 then case when sizes[2] > 5 then 'split' else 'single' end when faces >= 2 and widths[2] > 5 then 'split' else 'single' end as vote from f left join i using (job_id, event_id)""",
)
def layout_votes(spark, d):
    """Every eleventh frame shows a screen."""
    faces = _faces(spark, d).withColumn("w", F.col("w") + F.col("k") * 3 - 6)
    frames = faces.groupBy("job_id", "event_id").agg(F.collect_list(F.struct("slot", "w")).alias("faces")).withColumn("screen", F.col("event_id") % 11 == 0)
    return frames.select("job_id", "event_id", L.layout_votes(frames).alias("vote"))


@register("ag34_face_y", f"with {BASE}, y as (select s.job_id, s.seq, f.event_id, coalesce(arg_min(f.y, f.k) filter (where f.slot = f.event_id % 4), arg_min(f.y, f.k)) as y from spans s join faces f on f.job_id = s.job_id and f.t between s.t0 and s.t1 group by all) select s.job_id, s.seq, round(coalesce(avg(y), 50), 6) as y from spans s left join y using (job_id, seq) group by all")
def face_y(spark, d):
    """Mean height of the speaking face of each frame (the one of slot event_id mod 4), else of its first face; 50 without."""
    rows = L.in_spans(tables.spans(spark, d), _faces(spark, d).select("job_id", "event_id", "t", "k", "slot", "y"))
    speaks = F.col("slot") == F.col("event_id") % 4
    each = rows.groupBy("job_id", "seq", "event_id").agg(F.coalesce(F.min_by(F.when(speaks, F.col("y")), F.when(speaks, F.col("k"))), F.min_by("y", "k")).alias("y"))
    mean = each.groupBy("job_id", "seq").agg(F.avg("y").alias("y"))
    return tables.spans(spark, d).select("job_id", "seq").join(mean, ["job_id", "seq"], "left").select("job_id", "seq", F.round(F.coalesce("y", F.lit(50.0)), 6).alias("y"))


@register("ag38_slot_counts", f"with {BASE}, {SEEN}, {DOMINANT}, s as (select job_id, coalesce(slot::varchar, 'wide') as slot from total left join dom using (job_id, seq)), c as (select job_id, slot, count(*) as n from s group by all) select job_id, slot, n, (100 * n // sum(n) over (partition by job_id))::int as percent from c")
def slot_counts(spark, d):
    rows = _seen(spark, d).select("job_id", F.coalesce(L.dominant().cast("string"), F.lit("wide")).alias("slot")).groupBy("job_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("job_id").agg(F.sum("n").alias("every"))
    return rows.join(total, "job_id").select("job_id", "slot", "n", F.floor(100 * F.col("n") / F.col("every")).cast("int").alias("percent"))


@register("sf28_crop_confidence", f"""with {BASE}, {CROPS}, n as (select c.job_id, c.seq, count_if(f.x between lo and hi) as n_in, count(*) as n_faces from crops c join faces f on f.job_id = c.job_id and f.t between c.t0 and c.t1 where f.slot >= 0 group by all),
    a as (select s.job_id, s.seq, round(sum({_OV}), 6) as total, round(sum(case when slot = s.seq % 4 then {_OV} else 0 end), 6) as own from spans s join spk on s.job_id = spk.job_id and spk.t0 < s.t1 and spk.t1 > s.t0 group by all),
    st as (select c.job_id, c.seq, case when count(*) >= 2 then greatest(0, 1 - stddev_pop(f.x) / 30e0) else 0.5e0 end as stab from crops c join faces f on f.job_id = c.job_id and f.t between c.t0 and c.t1 where f.slot = c.seq % 4 group by all)
    select s.job_id, s.seq, case when not coalesce(n_in / n_faces >= 0.3e0, false) then 0e0 else round(0.4e0 + case when total > 0 and own / total >= 0.5e0 then 0.2e0 else 0 end + 0.2e0 * coalesce(stab, 0.5e0) + case when s.seq % 2 = 0 then 0.2e0 else 0 end, 6) end as confidence,
      case when not coalesce(n_in / n_faces >= 0.3e0, false) then 'no_face_in_crop_window' else coalesce(nullif(concat_ws('; ', case when not coalesce(total > 0 and own / total >= 0.5e0, false) then 'speaker_disagrees' end, case when coalesce(stab, 0.5e0) < 0.5e0 then 'unstable_face' end, case when s.seq % 2 = 1 then 'no_transcript_coverage' end), ''), 'all_checks_passed') end as reason
    from spans s left join n using (job_id, seq) left join a using (job_id, seq) left join st using (job_id, seq)""")
def crop_confidence(spark, d):
    """.4 for faces in the crop (without, nothing else counts), .2 each for the speaker, a steady face and transcript cover
    (every second stretch), with the reasons of what lacks."""
    crops, faces = _crops(spark, d).withColumn("candidate", F.col("seq") % 4), _faces(spark, d).select("job_id", "t", "slot", "x")
    inside = L.faces_in_crop(crops, faces, _CROP).select("job_id", "seq", "inside")
    agrees = L.agreement(crops, _events(spark, d))
    steady = L.in_spans(crops, faces).filter("slot = candidate").groupBy("job_id", "seq").agg(F.when(F.count(F.lit(1)) >= 2, F.greatest(F.lit(0.0), 1 - F.stddev_pop("x") / 30)).otherwise(0.5).alias("stab"))
    rows = inside.join(agrees, ["job_id", "seq"]).join(steady, ["job_id", "seq"], "left").withColumns({"stab": F.coalesce("stab", F.lit(0.5)), "covered": F.col("seq") % 2 == 0})
    points = 0.4 + F.when(F.col("agrees"), 0.2).otherwise(0.0) + 0.2 * F.col("stab") + F.when(F.col("covered"), 0.2).otherwise(0.0)
    reasons = F.concat_ws("; ", F.when(~F.col("agrees"), "speaker_disagrees"), F.when(F.col("stab") < 0.5, "unstable_face"), F.when(~F.col("covered"), "no_transcript_coverage"))
    reason = F.when(~F.col("inside"), "no_face_in_crop_window").when(reasons == "", "all_checks_passed").otherwise(reasons)
    return rows.select("job_id", "seq", F.when(F.col("inside"), F.round(points, 6)).otherwise(0.0).alias("confidence"), reason.alias("reason"))


@register(
    "ts11_lip_motion",
    f"""with {BASE}, f as (select job_id, t, slot, w, (event_id % 13) / 200e0 as lip from faces where slot >= 0 and k = 0), p as (select s.job_id, s.seq, f.slot, f.t, f.lip, f.w, lag(f.t) over w as pt, lag(f.lip) over w as pl from spans s join f on f.job_id = s.job_id and f.t >= s.t0 - 0.5e0 and f.t <= s.t1 + 0.5e0 window w as (partition by s.job_id, s.seq, f.slot order by f.t)),
    g as (select job_id, seq, slot, count(*) as n, max(t) - min(t) as time, avg(lip) as lip, avg(w) as w, avg(case when t - pt > 0 then abs(lip - pl) / (t - pt) end) as v from p group by all)
    select job_id, seq, slot, round(case when n < 2 then lip when case when time > 0 then (n - 1) / greatest(time, 0.01e0) else 0 end < 4 then least(1, lip * least(2, w / 8) / 0.04e0) when v is null then 0 else 0.6e0 * least(1, v / 0.08e0) + 0.4e0 * least(1, lip / 0.04e0) end, 6) as score from g""",
)
def lip_motion(spark, d):
    """Openings of lips stand in by rule."""
    faces = _faces(spark, d).filter("slot >= 0 and k = 0").select("job_id", "t", "slot", "w", (F.col("event_id") % 13 / 200).alias("lip"))
    return L.lip_scores(tables.spans(spark, d), faces)


@register("ts62_path_violations", f"with {BASE}, {FEATURES}, path as (select distinct job_id, t, ((event_id * 29 % 101) * 19.2e0) as px from ev) select p.job_id, p.t, string_agg(name, ',' order by name) as names from path p join features f on f.job_id = p.job_id and abs(f.f0 - p.t) < 0.05e0 where f_left / 100 * 1920 < p.px - 303.5e0 - 2 or f_right / 100 * 1920 > p.px + 303.5e0 + 2 group by p.job_id, p.t")
def path_violations(spark, d):
    """A path that follows the events, in pixels of a source 1920 wide, with a crop of 607."""
    path = tables.timed_events(spark, d).select("job_id", "t", ((F.col("event_id") * 29 % 101) * 19.2).alias("px")).distinct()
    found = L.path_violations(path, _features(spark, d).select("job_id", "f0", "left", "right", "name"), 1920, 607)
    return found
