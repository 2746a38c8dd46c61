"""Queries: required regions, places on a grid of frames, the focus of shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import rules as R
from rivulet.operators import camera as C
from rivulet.operators import focus as O
from rivulet.operators import slots as L
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.plans.rule_queries import _CLASSES, _WEIGHT
from rivulet.plans.slot_queries import BASE
from rivulet.sources import tables

# Objects and blobs stand in by rule, at the times of the events: one or two objects each, and a blob at every third.
_NAMES = "[" + ", ".join(repr(c) for c in _CLASSES) + "]"
_OBJECTS = f"objects as (select job_id, event_id, t, k, {_NAMES}[(event_id // 2 + k * 3) % 8 + 1] as name, ((event_id * 37 + k * 31 + event_id % 5) % 101)::double as x, ((event_id * 53 + k * 11) % 101)::double as y, (6 + event_id % 18)::double as w, (9 + event_id % 12)::double as h, 0.5e0 + event_id % 5 / 10e0 as confidence from ev, unnest(range(0, 2)) u(k) where (event_id + k) % 3 > 0)"
_BLOBS = "blobs as (select job_id, event_id, t, 0 as k, (event_id * 29 % 80) / 100e0 as x, (event_id * 41 % 70) / 100e0 as y, (10 + event_id % 21) / 100e0 as w, (8 + event_id % 23) / 100e0 as h, (event_id % 10) / 10e0 as score from ev where event_id % 3 = 0)"


def objects(spark, d):
    e, k = F.col("event_id"), F.col("k")
    rows = tables.timed_events(spark, d).select("job_id", "event_id", "t", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).filter((e + k) % 3 > 0)
    name = F.element_at(F.array(*map(F.lit, _CLASSES)), ((F.floor(e / 2) + k * 3) % 8 + 1).cast("int"))
    return rows.select("job_id", "event_id", "t", "k", name.alias("name"), ((e * 37 + k * 31 + e % 5) % 101).cast("double").alias("x"), ((e * 53 + k * 11) % 101).cast("double").alias("y"), (6 + e % 18).cast("double").alias("w"), (9 + e % 12).cast("double").alias("h"), (0.5 + e % 5 / 10.0).alias("confidence"))


def blobs(spark, d):
    e = F.col("event_id")
    return tables.timed_events(spark, d).filter(e % 3 == 0).select("job_id", "event_id", "t", F.lit(0).alias("k"), (e * 29 % 80 / 100.0).alias("x"), (e * 41 % 70 / 100.0).alias("y"), ((10 + e % 21) / 100.0).alias("w"), ((8 + e % 23) / 100.0).alias("h"), (e % 10 / 10.0).alias("score"))



_R = "{{'cx': {cx}, 'cy': {cy}, 'hw': {hw}, 'hh': {hh}, 'score': {score}, 'tier': '{tier}', 'source': '{source}', 'slot': {slot}, 'most': {most}}}"
_W, _H = "least(r.cx + r.hw, o.cx + o.hw) - greatest(r.cx - r.hw, o.cx - o.hw)", "least(r.cy + r.hh, o.cy + o.hh) - greatest(r.cy - r.hh, o.cy - o.hh)"
_HITS = f"({_W}) > 0 and ({_H}) > 0 and ({_W}) * ({_H}) / (4 * r.hw * r.hh + 4 * o.hw * o.hh - ({_W}) * ({_H})) > r.most"


@register(
    "jn35_required_regions",
    f"""with recursive {BASE}, {_OBJECTS}, {_BLOBS}, fr as (select distinct job_id, t from faces),
    act as (select fr.job_id, fr.t, arg_min(spk.slot, spk.event_id) as active from fr join spk on spk.job_id = fr.job_id and spk.t0 <= fr.t and spk.t1 >= fr.t and spk.slot >= 0 group by all),
    c as (select faces.job_id, faces.t, 0 as o, k, {_R.format(cx="x / 100", cy="y / 100", hw="w / 100 / 2", hh="h / 100 / 2", score="case when (slot >= 0 and slot = active) or event_id % 13 > 9 then 1e0 else 0.7e0 end", tier="required", source="face", slot="slot", most="2e0")} as r from faces left join act on act.job_id = faces.job_id and act.t = faces.t where (event_id + k) % 7 > 0
      union all select fr.job_id, fr.t, 1, k, {_R.format(cx="x / 100", cy="y / 100", hw="w / 100 / 2", hh="h / 100 / 2", score="0.6e0", tier="required", source="object", slot="-1", most="0.3e0")} from fr join objects ob on ob.job_id = fr.job_id and round(ob.t, 2) = round(fr.t, 2) where name = 'person'
      union all select fr.job_id, fr.t, 2, k, {_R.format(cx="x + w / 2", cy="y + h / 2", hw="w / 2", hh="h / 2", score="score * 0.5e0", tier="preferred", source="saliency", slot="-1", most="0.5e0")} from fr join blobs b on b.job_id = fr.job_id and round(b.t, 2) = round(fr.t, 2) where w * h >= 0.02e0),
    q as (select job_id, t, list(r order by o, k, r) as q from c group by all),
    f as (select job_id, t, q, 1 as i, [q[1]] as held from q union all select job_id, t, q, i + 1, case when len(list_filter(held, lambda o: {_HITS.replace("r.", "q[i + 1].")})) > 0 then held else list_append(held, q[i + 1]) end from f where i < len(q)),
    g as (select job_id, t, unnest(range(0, len(held))) as place, unnest(held) as r from f where i = len(q))
    select job_id, t, place::int as place, round(r.cx, 6) as cx, round(r.cy, 6) as cy, round(r.hw, 6) as half_w, round(r.hh, 6) as half_h, round(r.score, 6) as score, r.tier as tier, r.source as source, r.slot as slot from g""",
)
def required_regions(spark, d):
    """Every seventh face isn't human, and every event of four in thirteen opens lips."""
    faces = tables.dense_faces(spark, d)
    e = F.col("event_id")
    faces = faces.withColumns({"lip": F.when(e % 13 > 9, 0.06).otherwise(0.01), "human": (e + F.col("k")) % 7 > 0})
    events = tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "slot", F.col("event_id").alias("rank"))
    found = O.required_regions(faces, events, objects(spark, d), blobs(spark, d))
    return found.select("job_id", "t", "place", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "half_w", "half_h", "score")], "tier", "source", "slot")


# A grid of frames five media seconds apart; faces stand at the grid's time before them, cuts where errors are.
_GRID = f"""{duck.FACES}, grid as (select job_id, k::bigint as frame, k * 5e0 as t from (select job_id, unnest(range(0, floor(max(t) / 5)::bigint + 1)) as k from ev group by job_id)),
cuts as (select distinct job_id, t from ev where event_type = 'error'),
marks as (select job_id, t, 0 as side, null::bigint as frame from cuts union all select job_id, t, 1, frame from grid),
fr as (select * from (select *, count(*) filter (where side = 0) over (partition by job_id order by t, side rows unbounded preceding) as shot from marks) where side = 1),
anchors as (select job_id, floor(t / 5) * 5e0 as t, slot, arg_min(x, (event_id, k)) as x, arg_min(y, (event_id, k)) as y, arg_min(w, (event_id, k)) as w, arg_min(h, (event_id, k)) as h from faces group by all)"""


def _grid(spark, d):
    ends = tables.timed_events(spark, d).groupBy("job_id").agg(F.floor(F.max("t") / 5).alias("n"))
    frames = ends.select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("frame")).withColumn("t", F.col("frame") * 5.0)
    first = F.struct("event_id", "k")
    faces = tables.dense_faces(spark, d).withColumn("t", F.floor(F.col("t") / 5) * 5.0)
    anchors = faces.groupBy("job_id", "t", "slot").agg(*[F.min_by(c, first).alias(c) for c in ("x", "y", "w", "h")])
    return C.numbered_by_cuts(frames, tables.cuts(spark, d)), anchors


def _between(c: str) -> str:
    return f"s.{c} + case when followed then (r.t - s.t) / (s.next.t - s.t) * (s.next.{c} - s.{c}) else 0 end"


_PLACES = f"""{_GRID}, hits as (select distinct job_id, round(t, 3) as t from anchors),
r0 as (select fr.*, hits.t is not null as is_anchor from fr left join hits on hits.job_id = fr.job_id and hits.t = round(fr.t, 3)),
r1 as (select *, sum(is_anchor::int) over (partition by job_id, shot order by t, frame rows unbounded preceding) as anchor from r0),
r2 as (select *, row_number() over (partition by job_id, shot, anchor order by t, frame) - 1 as nth from r1),
r as (select *, coalesce(lag(nth) over (partition by job_id, shot order by t, frame), 0) as since from r2),
s0 as (select r.job_id, r.shot, r.anchor, r.t, a.slot, a.x, a.y, a.w, a.h from r join anchors a on a.job_id = r.job_id and round(a.t, 3) = round(r.t, 3) where is_anchor and slot >= 0),
s1 as (select *, lead({{'anchor': anchor, 't': t, 'x': x, 'y': y, 'w': w, 'h': h}}) over v as next, lag({{'anchor': anchor, 'x': x}}) over v as before from s0 window v as (partition by job_id, shot, slot order by anchor)),
s as (select *, next is not null and next.anchor <= anchor + 2 as followed from s1),
places as (select r.job_id, r.frame, r.t, s.slot, {_between("x")} as x, {_between("y")} as y, {_between("w")} as w, {_between("h")} as h, case when r.is_anchor and r.anchor = s.anchor then 0.95e0 else greatest(0.4e0, 0.95e0 - 0.05e0 * since) end as confidence, r.is_anchor,
  r.is_anchor and r.anchor = s.anchor and coalesce(before.anchor >= s.anchor - 2 and abs(before.x - s.x) >= 8, false) as had_reset
  from r join s on s.job_id = r.job_id and s.shot = r.shot and r.anchor >= s.anchor and r.anchor <= case when followed then next.anchor - 1 else s.anchor + 1 end)"""


@register("jn42_frame_places", f"with {_PLACES} select job_id, frame, t, slot, round(x, 6) as x, round(y, 6) as y, round(w, 6) as w, round(h, 6) as h, round(confidence, 6) as confidence, is_anchor, had_reset from places")
def frame_places(spark, d):
    found = O.frame_places(*_grid(spark, d))
    return found.select("job_id", "frame", "t", "slot", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "confidence")], "is_anchor", "had_reset")


# All feeds of a shot (minutes of the job): faces, followed places between anchors, a facecam and a text per job, saliency and objects.
_MUST = f"name in ({', '.join(repr(c) for c in R.ALWAYS)}) or (moves and name in ({', '.join(repr(c) for c in R.IF_MOVING)}))"
_FEED = f"""{_PLACES}, {duck.SPANS}, {_OBJECTS}, {_BLOBS},
ob as (select s.job_id, s.seq, o.t, x, y, w, h, name, confidence, count(*) over c >= 2 and max(x) over c - min(x) over c > 5 as moves from spans s join objects o on o.job_id = s.job_id and o.t >= s.t0 and o.t < s.t1 window c as (partition by s.job_id, s.seq, name)),
feed as (select s.job_id, seq, t, x, y, w, h, 1e0 as weight, true as must, true as pulls from spans s join faces f on f.job_id = s.job_id and f.t >= s.t0 and f.t < s.t1 where (event_id + k) % 7 > 0
  union all select s.job_id, seq, p.t, x, y, w, h, confidence, true, true from spans s join places p on p.job_id = s.job_id and p.t >= s.t0 and p.t < s.t1 where not is_anchor
  union all select job_id, seq, t0, 12e0, 80e0, 14e0, 20e0, 1e0, true, true from spans where job_id % 5 = 0
  union all select job_id, seq, t0, 50e0, 95e0, 30e0, 8e0, 0.9e0, true, false from spans where job_id % 4 = 1
  union all select s.job_id, seq, b.t, (x + w / 2) * 100, 50e0, 10e0, 10e0, score, false, true from spans s join blobs b on b.job_id = s.job_id and b.t >= s.t0 and b.t < s.t1
  union all select job_id, seq, t, x, y, w, h, ({_WEIGHT.replace("case c", "case name")}) * confidence, {_MUST}, true from ob)"""
_CROP = L.crop_width()
_FOCUS = f"""{_FEED}, agg as (select job_id, seq, count(*) filter (must) as n_required, count(*) filter (not must) as n_optional, count(*) filter (must and pulls) as n_pull, min(x - w / 2) filter (must) as l, max(x + w / 2) filter (must) as r, min(y - h / 2) filter (must) as t, max(y + h / 2) filter (must) as b, sum(weight) filter (must and pulls) as total, sum(weight * x) filter (must and pulls) as wx, sum(weight * y) filter (must and pulls) as wy from feed group by all),
fo as (select s.job_id, s.seq, coalesce(n_required, 0) as n_required, coalesce(n_optional, 0) as n_optional, coalesce(n_pull, 0) as n_pull, coalesce((l + r) / 2, 50) as rect_x, coalesce((t + b) / 2, 50) as rect_y, coalesce(r - l, 0) as rect_w, coalesce(b - t, 0) as rect_h, total, wx, wy from spans s left join agg using (job_id, seq)),
fo2 as (select *, n_required = 0 or (rect_w <= {_CROP}e0 and rect_h <= 100) as fits, case when total > 0 then wx / total else 50 end as mx, case when total > 0 then wy / total else 50 end as my from fo),
focus as (select *, case when n_pull > 0 and fits then greatest({_CROP / 2}e0, least({100 - _CROP / 2}e0, mx)) when n_pull > 0 then mx else 50 end as cx, case when n_pull > 0 and fits then greatest(0, least(100, my)) when n_pull > 0 then my else 50 end as cy from fo2)"""


def _feed(spark, d):
    shots = tables.spans(spark, d)
    faces = tables.dense_faces(spark, d).filter((F.col("event_id") + F.col("k")) % 7 > 0)
    box = ["t", "x", "y", "w", "h"]
    of = lambda rows, weight, must, pulls: rows.select("job_id", *box, weight.alias("weight"), F.lit(must).alias("must"), F.lit(pulls).alias("pulls"))
    moments = of(faces, F.lit(1.0), True, True).unionByName(of(O.frame_places(*_grid(spark, d)).filter("not is_anchor"), F.col("confidence"), True, True))
    spots = blobs(spark, d).select("job_id", "t", ((F.col("x") + F.col("w") / 2) * 100).alias("x"), F.lit(50.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), "score")
    moments = moments.unionByName(of(spots, F.col("score"), False, True))
    # one pass over the shots for all that has a time; objects are told from the rest by their name
    moments = moments.withColumns({"name": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    things = objects(spark, d).select("job_id", *box, "name", "confidence")
    timed = O.shot_features(shots, moments.unionByName(things, allowMissingColumns=True))
    columns = ["job_id", "seq", *box, "weight", "must", "pulls"]
    plain = timed.filter("name is null").select(*columns)
    moving = O.moving_objects(timed.filter("name is not null"), R.class_priority).withColumn("pulls", F.lit(True)).select(*columns)
    fixed = lambda rows, x, y, w, h, weight, pulls: rows.select("job_id", "seq", F.col("t0").alias("t"), *[F.lit(float(v)).alias(c) for v, c in ((x, "x"), (y, "y"), (w, "w"), (h, "h"), (weight, "weight"))], F.lit(True).alias("must"), F.lit(pulls).alias("pulls"))
    lasting = fixed(shots.filter("job_id % 5 = 0"), 12, 80, 14, 20, 1, True).unionByName(fixed(shots.filter("job_id % 4 = 1"), 50, 95, 30, 8, 0.9, False))
    return shots, plain.unionByName(moving).unionByName(lasting)


_SHOWN = ["rect_x", "rect_y", "rect_w", "rect_h", "cx", "cy"]


@register("jn36_scene_focus", f"with {_FOCUS} select job_id, seq, n_required, n_optional, fits, {', '.join(f'round({c}, 6) as {c}' for c in _SHOWN)} from focus")
def scene_focus(spark, d):
    found = O.scene_focus(*_feed(spark, d), _CROP)
    return found.select("job_id", "seq", "n_required", "n_optional", "fits", *[F.round(c, 6).alias(c) for c in _SHOWN])


@register(
    "jn36_frame_targets",
    f"""with {_FOCUS}, tt as (select distinct s.job_id, s.seq, f.t from spans s join faces f on f.job_id = s.job_id and f.t >= s.t0 and f.t < s.t1),
    p as (select tt.job_id, tt.seq, tt.t, sum(weight) as total, sum(weight * x) as wx, sum(weight * y) as wy from tt join feed on feed.job_id = tt.job_id and feed.seq = tt.seq and must and pulls and abs(feed.t - tt.t) < 0.01e0 group by all)
    select p.job_id, p.seq, p.t, round(case when p.total > 0 then p.wx / p.total else cx end, 6) as x, round(case when p.total > 0 then p.wy / p.total else cy end, 6) as y from p join focus using (job_id, seq)""",
)
def frame_targets(spark, d):
    """For every frame with a face, known or not."""
    shots, features = _feed(spark, d)
    frames = O.shot_features(shots, tables.dense_faces(spark, d).select("job_id", "t").distinct())
    found = O.frame_targets(frames, features, O.scene_focus(shots, features, _CROP))
    return found.select("job_id", "seq", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_MISMATCH = (16 / 9 - 9 / 16) / (16 / 9)
_STILL = _CROP * 0.10 * (1.0 - min(_MISMATCH * 0.5, 0.5))


@register(
    "ts56_camera_modes",
    f"""with {_FOCUS}, tt as (select distinct s.job_id, s.seq, f.t from spans s join faces f on f.job_id = s.job_id and f.t >= s.t0 and f.t < s.t1),
    tp as (select tt.job_id, tt.seq, tt.t, sum(weight) as total, sum(weight * x) as wx from tt join feed on feed.job_id = tt.job_id and feed.seq = tt.seq and must and pulls and abs(feed.t - tt.t) < 0.01e0 group by all),
    tg as (select tp.job_id, tp.seq, tp.t, case when tp.total > 0 then tp.wx / tp.total else cx end as x from tp join focus using (job_id, seq)),
    mo as (select job_id, seq, max(reach) as reach from (select job_id, seq, t, count(*) as n, max(x + w / 2) - min(x - w / 2) as reach from feed where must group by all) where n >= 2 group by all),
    ac as (select *, t - lag(t) over v as d1, lead(t) over v - t as d2, x - lag(x) over v as e1, lead(x) over v - x as e2 from tg window v as (partition by job_id, seq order by t)),
    mv as (select job_id, seq, count(*) as n, max(x) - min(x) as range, avg(case when d1 > 0 and d2 > 0 then abs(e2 / d2 - e1 / d1) / ((d1 + d2) / 2) end) as pull, case when var_pop(t) > 0 and var_pop(x) > 0 then regr_r2(x, t) end as r2 from ac group by all)
    select s.job_id, s.seq, case when t1 - t0 < 1 then if(fits, 'stationary', 'padding') when not fits and reach is not null then 'padding' when coalesce(n, 0) < 2 then if(fits, 'stationary', 'padding') when reach > {_CROP}e0 then 'padding' when fits and range <= {_STILL}e0 then 'stationary' when n >= 3 and pull < 5 then 'tracking' when n >= 3 and r2 > 0.9e0 then 'panning' else 'padding' end as mode
    from (select spans.job_id, spans.seq, spans.t0, case when spans.seq % 9 = 0 then spans.t0 + 0.5e0 else spans.t1 end as t1 from spans) s join focus using (job_id, seq) left join mo using (job_id, seq) left join mv using (job_id, seq)""",
)
def camera_modes(spark, d):
    """Every ninth shot is taken for one of half a second."""
    shots, features = _feed(spark, d)
    focus = O.scene_focus(shots, features, _CROP)
    frames = O.shot_features(shots, tables.dense_faces(spark, d).select("job_id", "t").distinct())
    short = shots.withColumn("t1", F.when(F.col("seq") % 9 == 0, F.col("t0") + 0.5).otherwise(F.col("t1")))
    return O.camera_modes(short, focus, features, O.frame_targets(frames, features, focus), _CROP, _MISMATCH)
