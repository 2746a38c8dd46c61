"""Queries: tracks of regions and faces, position clusters, motion paths, merged stretches, kinds of content."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import folds as D
from rivulet.operators import intervals as I
from rivulet.operators import slots as L
from rivulet.operators import subjects as Z
from rivulet.plans import duck
from rivulet.plans.folded import _points
from rivulet.plans.registry import register
from rivulet.plans.slot_queries import REG, _majority
from rivulet.sources import tables

_GAP, _ALIKE = 25.0, 0.3
# saliency regions: every event one, about three places, a shot from one error to the next
REGIONS = """regions as (select job_id, event_id, t, count(*) filter (where event_type = 'error') over (partition by job_id order by t, event_id) as shot, (event_id % 3 * 30 + 20 + event_id % 7)::double as x, (50 + event_id % 5)::double as y, (24 + event_id % 4)::double as w, (30 + event_id % 6)::double as h from ev)"""
_IOU = "(greatest(0, least(o.x + o.w / 2, n.x + n.w / 2) - greatest(o.x - o.w / 2, n.x - n.w / 2)) * greatest(0, least(o.y + o.h / 2, n.y + n.h / 2) - greatest(o.y - o.h / 2, n.y - n.h / 2)))"
_LIKE = f"({_IOU} > {_ALIKE}e0 * (o.w * o.h + n.w * n.h - {_IOU}))"
_OWN = "{{'k': {k}, 't': n.t, 'shot': n.shot, 'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h}}"
_NEAR = f"list_filter(f.open_, lambda o: o.shot = n.shot and n.t - o.t <= {_GAP}e0)"
_AT = f"list_position(list_transform({_NEAR}, lambda o: {_LIKE}), true)"
TRACKS = duck.fold(
    "regions",
    "t, event_id",
    {"open_": "[" + _OWN.format(k="0") + "]", "made": "1", "track": "0"},
    {
        "open_": f"case when {_AT} is null then list_append({_NEAR}, {_OWN.format(k='f.made')}) else list_concat(list_append(({_NEAR})[:{_AT} - 1], {_OWN.format(k=f'({_NEAR})[{_AT}].k')}), ({_NEAR})[{_AT} + 1:]) end",
        "made": f"f.made + ({_AT} is null)::int",
        "track": f"case when {_AT} is null then f.made else ({_NEAR})[{_AT}].k end",
    },
)
PROMOTED = "prom as (select job_id, track, count(*) as n, round(median(h / w), 6) as aspect, round(median(w * h / 10000), 6) as area, min(t) as t0, max(t) as t1 from f group by all having count(*) >= 3 and round(median(h / w), 6) between 1 and 1.4 and round(median(w * h / 10000), 6) between 0.05 and 0.12)"


def _regions(spark, d):
    e = tables.timed_events(spark, d)
    k = F.col("event_id")
    shot = F.count_if(F.col("event_type") == "error").over(Window.partitionBy("job_id").orderBy("t", "event_id"))
    return e.select("job_id", "event_id", "t", shot.alias("shot"), (k % 3 * 30 + 20 + k % 7).cast("double").alias("x"), (50 + k % 5).cast("double").alias("y"), (24 + k % 4).cast("double").alias("w"), (30 + k % 6).cast("double").alias("h"))


def _tracks(spark, d):
    schema = "job_id long, event_id long, t double, shot long, x double, y double, w double, h double, track long"
    return D.fold(_regions(spark, d), "job_id", ["t", "event_id"], lambda r: Z.tracked(r, _GAP, _ALIKE), schema)


def _promoted(spark, d):
    return Z.promoted(_tracks(spark, d), 3, (1.0, 1.4), (0.05, 0.12))


@register("st13_region_tracks", f"with recursive {duck.EV}, {REGIONS}, {TRACKS} select job_id, event_id, track::bigint as track from f")
def region_tracks(spark, d):
    """Regions are as far apart in time as events, so a track may pause for 25."""
    return _tracks(spark, d).select("job_id", "event_id", "track")


@register("st14_promoted_tracks", f"with recursive {duck.EV}, {REGIONS}, {TRACKS}, {PROMOTED} select job_id, track::bigint as track, n, aspect, area, t0, t1 from prom")
def promoted_tracks(spark, d):
    return _promoted(spark, d)


@register("st16_subject_tracks", f"with recursive {duck.FACES}, {REGIONS}, {TRACKS}, {PROMOTED} select job_id, 'face_confirmed' as source, slot::bigint as id, count(*) as n, min(faces.t) as t0, max(faces.t) as t1 from faces where slot >= 0 group by all having count(*) >= 2 union all select job_id, 'face_like_promoted', track::bigint, n, t0, t1 from prom")
def subject_tracks(spark, d):
    """Identities seen twice and more, and regions that have the shape of a face for long enough."""
    known = Z.face_tracks(tables.dense_faces(spark, d)).select("job_id", F.lit("face_confirmed").alias("source"), F.col("slot").cast("long").alias("id"), "n", "t0", "t1")
    return known.unionByName(_promoted(spark, d).select("job_id", F.lit("face_like_promoted").alias("source"), F.col("track").alias("id"), "n", "t0", "t1"))


@register("st19_position_clusters")
def position_clusters(spark, d):
    def step(rows):
        held = list(rows)
        return ({"job_id": held[0]["job_id"], "center": c["center"], "count": c["count"]} for c in Z.position_clusters([r["x"] for r in held]))

    rows = _points(spark, d).withColumn("x", F.when(F.col("x") < 40, F.col("x") % 7 + 15).when(F.col("x") < 60, F.col("x")).otherwise(F.col("x") % 9 + 70).cast("int"))
    return D.fold(rows, "job_id", ["t"], step, "job_id long, center int, count int")


_MOVE = "(1 - exp(-(n.t - f.t) / 30e0))"
_FAR = f"sqrt({_MOVE} * (n.x - f.sx) * ({_MOVE} * (n.x - f.sx)) + {_MOVE} * (n.y - f.sy) * ({_MOVE} * (n.y - f.sy)))"
_SCALE = f"case when {_FAR} > 2e0 * (n.t - f.t) then 2e0 * (n.t - f.t) / {_FAR} else 1 end"


@register(
    "ts25_motion_paths",
    f"""with recursive {duck.EV}, {REGIONS}, {duck.fold("regions", "t, event_id", {"sx": "n.x", "sy": "n.y"}, {"sx": f"case when f.shot <> n.shot then n.x else f.sx + {_MOVE} * (n.x - f.sx) * {_SCALE} end", "sy": f"case when f.shot <> n.shot then n.y else f.sy + {_MOVE} * (n.y - f.sy) * {_SCALE} end"})}
    select job_id, event_id, round(sx, 4) as x, round(sy, 4) as y from f where not exists (select 1 from f g where g.job_id = f.job_id and g.rn = f.rn - 1 and g.t = f.t and g.shot = f.shot)""",
)
def motion_paths(spark, d):
    """Time constant 30 and two percent a second, as points are far apart here."""
    schema = "job_id long, event_id long, x double, y double"
    rows = D.fold(_regions(spark, d), "job_id", ["t", "event_id"], lambda r: Z.motion_path(r, 30.0, 2.0), schema)
    return rows.select("job_id", "event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register("ts33_merged_short")
def merged_short(spark, d):
    """Speaker events as stretches; every ninth event begins a shot."""
    cut = F.col("event_id") % 9 == 0
    rows = tables.speaker_events(spark, d).select("job_id", "event_id", "t0", "t1", "slot", cut.alias("cut"))
    return D.fold(rows, "job_id", ["t0", "event_id"], lambda r: Z.merged_short(r, 6.0), "job_id long, t0 double, t1 double, slot int, cut boolean")


_DESCRIPTIONS = ["The player on the field scores a goal, the referee looks on", "Gameplay with HUD and minimap, a kill", "An animated cartoon with a character in dialogue, a dramatic scene", "A room"]


def _signals(spark, d):
    """Events are frames, those of an even fourth without a face; every seventh job has no faces at all, and some users name
    the kind themselves."""
    faces, events = tables.dense_faces(spark, d).filter("job_id % 7 <> 3"), tables.timed_events(spark, d)
    e, none = F.col("event_id"), F.col("job_id") % 7 == 3
    n = F.when((e % 4 > 0) & ~none, e % 4)
    base = events.groupBy("job_id").agg((F.count_if(F.col("event_type") == "error") / (F.nullif(F.max("t"), F.lit(0.0)) / 60)).alias("cut_rate"), F.avg(n).alias("avg_faces"), (F.count_if(n.isNull()) / F.count(F.lit(1))).alias("no_face"), F.count(F.lit(1)).alias("frames"))
    slots = L.registry(faces)
    reg = slots.groupBy("job_id").agg(F.count(F.lit(1)).alias("slots"), F.max("frame_count").alias("top"), F.avg(F.col("x_max") - F.col("x_min")).alias("mean_range"))
    dev = faces.groupBy("job_id", "event_id").agg(F.avg("x").alias("x")).groupBy("job_id").agg(F.round(F.stddev_pop("x"), 6).alias("dev"), F.count(F.lit(1)).alias("seen"))
    rows = base.join(reg, "job_id", "left").join(L.continuous_motion(slots), "job_id", "left").join(dev, "job_id", "left")
    words = F.element_at(F.array(*map(F.lit, _DESCRIPTIONS)), (F.col("job_id") % 4 + 1).cast("int"))
    user = F.when(F.col("job_id") % 13 == 0, "podcast").when(F.col("job_id") % 13 == 1, "no such kind")
    return rows.withColumns({"top_share": F.col("top") / F.col("frames"), "x_dev": F.when((F.col("frames") >= 10) & (F.col("seen") >= 5), F.col("dev")), "ratio": 1.5 + F.col("job_id") % 9 / 10, "description": words, "user_kind": user})


_WORDS = "[" + ", ".join("'" + x + "'" for x in _DESCRIPTIONS) + "]"
_HIT = {k: f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(lower(description), w))) >= {Z.HINT_POINTS[k][0]}" for k, words in Z.HINTS.items()}
_POINTS_OF = {k: f"case when {_HIT[k]} then {Z.HINT_POINTS[k][1]}e0 else 0 end" for k in Z.HINTS}
_SIG = f"""faces0 as (select * from faces where job_id % 7 <> 3), b as (select job_id, count_if(event_type = 'error') / (nullif(max(t), 0) / 60) as c, avg(case when event_id % 4 > 0 and job_id % 7 <> 3 then event_id % 4 end) as fa, count_if(event_id % 4 = 0 or job_id % 7 = 3) / count(*) as nf, count(*) as frames from ev group by job_id), {REG.replace("from faces", "from faces0")},
r as (select job_id, count(*) as slots, max(frame_count) as top_frames, avg(x_max - x_min) as mr, case when count(*) = 1 then arg_max(x_max - x_min, (frame_count, -slot)) > 15 else (max(frame_count) / sum(frame_count) > 0.6e0 and arg_max(x_max - x_min, (frame_count, -slot)) > 20) or round(avg(x_max - x_min), 6) > 15 end as moving from reg group by 1),
dv as (select job_id, round(stddev_pop(x), 6) as dev0, count(*) as seen from (select job_id, event_id, avg(x) as x from faces0 group by all) group by 1),
s0 as (select *, top_frames / frames as top, case when frames >= 10 and seen >= 5 then dev0 end as dev, 1.5e0 + job_id % 9 / 10e0 as ratio, {_WORDS}[job_id % 4 + 1] as description, case job_id % 13 when 0 then 'podcast' when 1 then 'no such kind' end as user_kind from b left join r using (job_id) left join dv using (job_id)),
s as (select *, coalesce(slots >= 2 and top < 0.8e0 and mr < 15, false) as stable, coalesce(slots = 1 and mr < 10, false) as alone, fa is not null and nf > 0.5e0 as absent from s0),
p as (select job_id, c as rate, user_kind, case when c >= 10 then 3 when c > 2 then 1 else 0 end + case when fa >= 2 then 1 when fa >= 1 then 0.5e0 else 0 end + case when slots >= 1 and not stable and not alone and moving then 1 else 0 end + case when ratio >= 2.2e0 then 3 else 0 end + {_POINTS_OF["narrative"]} as narrative,
  case when c <= 2 then 3 else 0 end + case when fa >= 2 then 2.5e0 else 0 end + case when stable then 3 else 0 end + case when dev < 3 then 1 else 0 end as podcast, case when c <= 2 then 2 else 0 end + case when absent then 2 else 0 end + {_POINTS_OF["gaming"]} as gaming,
  case when c > 2 and c < 10 then 1.5e0 else 0 end + case when fa >= 1 and fa < 2 then 1.5e0 else 0 end + case when not stable and alone then 1.5e0 when slots >= 1 and not stable and moving then 1 else 0 end + case when dev >= 8 and dev < 15 then 0.5e0 else 0 end as vlog,
  case when c > 2 then 1 else 0 end + case when absent then 1.5e0 else 0 end + case when dev >= 15 then 0.5e0 else 0 end + {_POINTS_OF["sports"]} as sports, case when c >= 40 then 3 when c >= 20 then 1.5e0 else 0 end + {_POINTS_OF["music_video"]} as music_video, {_POINTS_OF["anime"]} as anime from s),
l as (select job_id, rate, user_kind, [narrative, podcast, gaming, vlog, sports, music_video, anime] as v from p), w as (select job_id, rate, user_kind, list_max(v) as best, list_sum(v) as total, {Z.KINDS}[list_position(v, list_max(v))] as top from l),
kinds_ as (select job_id, case when rate is null then 'unknown' when user_kind in ({", ".join(repr(k) for k in [*Z.KINDS, "unknown"])}) then user_kind when total > 0 and best / total >= 0.25e0 and best >= 2 then top else 'unknown' end as kind, case when rate is null then 0 when user_kind in ({", ".join(repr(k) for k in [*Z.KINDS, "unknown"])}) then 1 else round(least(1, case when total > 0 then best / total else 0 end), 6) end as confidence from w)"""


@register("ag16_content_kinds", f"with {duck.FACES}, {_SIG} select * from kinds_")
def content_kinds(spark, d):
    return Z.content_kinds(_signals(spark, d))


@register(
    "ag17_clip_kinds",
    f"""with {duck.FACES}, {_SIG}, base as (select job_id, case kind when 'podcast' then 'talking_head' when 'vlog' then 'talking_head' when 'anime' then 'animation' when 'music_video' then 'music_video' when 'gaming' then 'gameplay' else 'generic' end as kind from kinds_),
    corner as (select job_id, count_if(x >= 50 and y >= 40) / count(*) as share from faces0 group by 1)
    select job_id, case when job_id % 2 = 0 and (kind = 'gameplay' or share > 0.7e0) then 'stream' else kind end as kind from base left join corner using (job_id)""",
)
def clip_kinds(spark, d):
    """Every second job has a facecam, in the lower right."""
    kinds = Z.content_kinds(_signals(spark, d))
    corner = tables.dense_faces(spark, d).filter("job_id % 7 <> 3").groupBy("job_id").agg((F.count_if((F.col("x") >= 50) & (F.col("y") >= 40)) / F.count(F.lit(1))).alias("share"))
    return kinds.join(corner, "job_id", "left").select("job_id", Z.clip_kind(F.col("kind"), F.col("job_id") % 2 == 0, F.coalesce("share", F.lit(0.0))).alias("kind"))


@register("ts31_slot_boundaries", f"with {duck.SPK}, {duck.SPANS}, {_majority('maj', '0e0')}, b as (select s.job_id, s.seq, s.t0, slot, lag(slot) over (partition by s.job_id order by s.seq) as p from spans s left join maj on maj.job_id = s.job_id and maj.seq = s.seq) select job_id, seq, t0, slot from b where seq = 0 or slot is distinct from p")
def slot_boundaries(spark, d):
    """Where the slot of a job's stretches changes."""
    spans = tables.spans(spark, d)
    events = tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "slot", "confidence")
    rows = spans.join(I.slot_coverage(spans, events, digits=6).drop("coverage"), ["job_id", "seq"], "left").withColumn("p", F.lag("slot").over(Window.partitionBy("job_id").orderBy("seq")))
    return rows.filter((F.col("seq") == 0) | ~F.col("slot").eqNullSafe(F.col("p"))).select("job_id", "seq", "t0", "slot")
