"""Queries: camera paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import camera as C
from rivulet.operators.grouped import per_group
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

# Points of a job's path: one per time, with bounds where the event number says so, numbered by the cuts at or before them.
_SHOTS = "k as (select job_id, t, 0 as side from cuts union all select job_id, t, 1 from base), numbered as (select *, count(*) filter (where side = 0) over (partition by job_id order by t, side rows unbounded preceding) as shot from k)"
_BASE = f"{duck.SCENES}, cuts as (select distinct job_id, t from ev where event_type = 'error'), base as (select job_id, t, max(subject_x)::double as target, min(event_id) as e from scenes group by all), {_SHOTS}"
_POINTS = f"{_BASE}, points as (select job_id, shot, t, target, e, case when e % 4 = 0 then greatest(0, 20 + e % 50)::double else 0e0 end as low, case when e % 4 = 0 then 20e0 + e % 50 + e % 37 - 2 else 100e0 end as high from base join numbered using (job_id, t) where side = 1)"


def points(spark, d):
    rows = tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max("subject_x").alias("target"), F.min("event_id").alias("e"))
    return C.numbered_by_cuts(rows, tables.cuts(spark, d))


def bounded(spark, d):
    """Every fourth event bounds its point; of some the bounds cross."""
    e = F.col("e")
    low = F.when(e % 4 == 0, (20 + e % 50).cast("double"))
    return points(spark, d).withColumns({"low": low, "high": low + e % 37 - 2})


_CANDIDATES = "g as (select job_id, shot, list(t order by t) as t, list(target order by t) as y, list(low order by t) as lo, list(high order by t) as hi, list_sort(list_distinct(list_concat(list(target), list(low), list(high)))) as c, bool_or(low > high) as no_room from points group by all)"
_WITHIN = "case when c[j] between lo[{i}] and hi[{i}] then abs(c[j] - y[{i}]) else 'inf'::double end"


@register(
    "ts63_path_cost",
    f"""with recursive {_POINTS}, {_CANDIDATES},
    f as (select job_id, shot, y, lo, hi, c, 1 as i, list_transform(range(1, len(c) + 1), lambda j: {_WITHIN.format(i="1")}) as cost from g where len(y) > 1 and not no_room
      union all select job_id, shot, y, lo, hi, c, i + 1, list_transform(range(1, len(c) + 1), lambda j: {_WITHIN.format(i="i + 1")} + list_min(list_transform(range(1, len(c) + 1), lambda k: cost[k] + 0.3e0 * abs(c[k] - c[j])))) from f where i < len(y)),
    least as (select job_id, shot, list_min(cost) as cost from f where i = len(y)),
    kept as (select job_id, shot, 0.3e0 * coalesce(list_sum(list_transform(range(2, len(y) + 1), lambda i: abs(y[i] - y[i - 1]))), 0) as cost from g where len(y) = 1 or no_room)
    select job_id, shot, len(y) as n, no_room, round(coalesce(least.cost, kept.cost), 6) as cost from g left join least using (job_id, shot) left join kept using (job_id, shot)""",
)
def path_cost(spark, d):
    """What the best path of every shot costs; shots whose bounds cross keep their targets."""
    x = C.optimal_paths(bounded(spark, d))

    def cost(c):
        move = abs(c["x"][1:] - c["x"][:-1]).sum()
        return {"n": [len(c["x"])], "no_room": [bool((c["low"] > c["high"]).any())], "cost": [round(float(abs(c["x"] - c["target"]).sum() + 0.3 * move), 6)]}

    return per_group(x, ["job_id", "shot"], ["t"], cost, "n long, no_room boolean, cost double")


@register("ts63_camera_path")
def camera_path(spark, d):
    """The path itself; of several best ones the one that SQL would find can differ, so it is checked by its cost."""
    return C.optimal_paths(bounded(spark, d)).select("job_id", "shot", "t", F.round("x", 6).alias("x"))


_SIGN = "10e0 * sign(x[{b}] - x[{a}])"
_PULL = f"(case when i > 1 then {_SIGN.format(a='i - 1', b='i')} else 0e0 end - case when i < len(x) then {_SIGN.format(a='i', b='i + 1')} else 0e0 end)"
_STEP = f"x[i] - (1e0 / 21e0) * ((x[i] - s[i]) + {_PULL})"


@register(
    "ts59_tv_denoise",
    f"""with recursive {duck.SCENES}, p as (select job_id, t, max(subject_x)::double as x from scenes group by all), g as (select job_id, list(t order by t) as t, list(x order by t) as s from p group by 1),
    r as (select job_id, t, s, s as x, 0 as k from g union all select job_id, t, s, list_transform(range(1, len(x) + 1), lambda i: {_STEP}), k + 1 from r where k < 100)
    select job_id, unnest(t) as t, round(unnest(case when len(s) > 1 then x else s end), 6) as x from r where k = 100""",
)
def tv_denoise(spark, d):
    """A job's whole series is one problem, held by one task as an array."""
    rows = tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max("subject_x").alias("x"))
    return per_group(rows, ["job_id"], ["t"], lambda c: {"t": c["t"], "x": C.held_path(c["x"]).round(6)}, "t double, x double")


_FACES = duck.FACES.removeprefix(duck.EV + ", ")
_FEATURES = "feat as (select job_id, t as f0, greatest(0, x - w) as l, least(100, x + w) as r from faces where event_id % 3 = 0 and k < 2)"


@register(
    "ts61_camera_modes",
    f"""with recursive {_BASE}, points as (select job_id, shot, t, target * 19.2e0 as px from base join numbered using (job_id, t) where side = 1), {_FACES}, {_FEATURES},
    need as (select job_id, shot, t, min(l) / 100e0 * 1920 as nl, max(r) / 100e0 * 1920 as nr from points join feat using (job_id) where abs(f0 - t) < 0.05e0 group by all),
    b as (select job_id, shot, t, px, nl, nr, case when nr - nl <= 607 then greatest(303.5e0, nr - 303.5e0) end as lo, case when nr - nl <= 607 then least(1616.5e0, nl + 303.5e0) end as hi from points left join need using (job_id, shot, t)),
    g as (select job_id, shot, list(t order by t) as t, list(px order by t) as s, list(coalesce(lo, '-inf'::double) order by t) as lo, list(coalesce(hi, 'inf'::double) order by t) as hi, list(nl order by t) as nl, list(nr order by t) as nr, bool_or(nl is not null and lo is null) as wide from b group by all),
    r as (select job_id, shot, t, s, lo, hi, nl, nr, wide, s as x, 0 as k from g union all select job_id, shot, t, s, lo, hi, nl, nr, wide, list_transform(range(1, len(x) + 1), lambda i: least(greatest({_STEP}, lo[i]), hi[i])), k + 1 from r where k < 100),
    e as (select *, len(x) as n, list_max(x) - list_min(x) as span, list_avg(x) as m, (len(x) - 1) / 2e0 as mi, len(list_filter(range(1, len(x) + 1), lambda i: nl[i] < x[i] - 305.5e0 or nr[i] > x[i] + 305.5e0)) as out from r where k = 100),
    f as (select *, list_sum(list_transform(range(0, n), lambda i: (i - mi) * (x[i + 1] - m))) as xy, list_sum(list_transform(range(0, n), lambda i: (i - mi) * (i - mi))) as xx, list_sum(list_transform(x, lambda v: (v - m) * (v - m))) as yy, greatest((t[-1] - t[1]) / greatest(n - 1, 1), 0.001e0) as dt from e),
    h as (select *, case when n < 3 then 0e0 when yy = 0 then 1e0 else xy * xy / (xx * yy) end as r2, case when n < 3 or yy = 0 then 0e0 else xy / xx / dt end as sl from f),
    v as (select *, case when n < 2 then 'stationary' when wide or out > 0 then 'infeasible' when span < 153.6e0 then 'stationary' when r2 > 0.95e0 and abs(sl) > 50 then 'panning' else 'tracking' end as mode from h)
    select job_id, shot, n, mode, round(case when n < 2 then s[1] when mode = 'infeasible' then 960 when mode = 'tracking' then x[1] else m end, 3) as center, round(case when mode = 'panning' then sl else 0 end, 3) as slope, round(case when mode in ('panning', 'tracking') then x[-1] end, 3) as last_x from v""",
)
def camera_modes(spark, d):
    """Per shot of the subject's track: how the camera moves, with the faces of every third event as what must stay in."""
    places = points(spark, d).select("job_id", "shot", "t", (F.col("target") * 19.2).alias("px"))
    faces = tables.dense_faces(spark, d).filter("event_id % 3 = 0 and k < 2")
    features = faces.select("job_id", F.col("t").alias("f0"), F.greatest(F.lit(0.0), F.col("x") - F.col("w")).alias("left"), F.least(F.lit(100.0), F.col("x") + F.col("w")).alias("right"))
    found = C.camera_paths(C.required_bounds(places, features, 1920, 607))
    last = F.max_by("x", "t")
    return found.groupBy("job_id", "shot", "mode", F.round("center", 3).alias("center"), F.round("slope", 3).alias("slope")).agg(F.count(F.lit(1)).alias("n"), F.round(last, 3).alias("last_x"))


_HALF = 9 / 16 / (16 / 9) / 2
_IN = f"least(1 - {_HALF!r}::double, greatest({_HALF!r}::double, {{}}))"


@register(
    "ts58_shot_cameras",
    f"""with {duck.FACES}, cuts as (select distinct job_id, t from ev where event_type = 'error'), base as (select distinct job_id, t from ev), {_SHOTS},
    regions as (select faces.job_id, shot, faces.t, x / 100e0 as cx, y / 100e0 as cy, w / 200e0 as half, slot >= 0 as required from faces join numbered n on n.job_id = faces.job_id and n.t = faces.t and side = 1),
    own as (select * from (select *, bool_or(required) over (partition by job_id, shot, t) as has from regions) where required or not has),
    fr as (select job_id, shot, t, min(cx - half) as l, max(cx + half) as r, avg(cy) as cy, (min(cx - half) + max(cx + half)) / 2 as mid from own group by all),
    shots as (select job_id, shot, min(t) as t0, max(t) as t1 from numbered where side = 1 group by all),
    w as (select job_id, shot, count(*) as n, min(l) as sl, max(r) as sr, avg(cy) as sy, max(r - l) as widest, min(t) as ft, max(t) as lt, coalesce(regr_slope(mid, t), 0) as b, avg(mid) as mx, avg(t) as mt from fr group by all),
    u as (select *, {_IN.format("(sl + sr) / 2")} as still, mx + b * (ft - mt) as a from w),
    p as (select job_id, shot, bool_and(a + b * (t - ft) - {_HALF!r}::double <= l + 0.01e0 and a + b * (t - ft) + {_HALF!r}::double >= r - 0.01e0) as covered from fr join u using (job_id, shot) group by all),
    v as (select *, case when sr - sl <= {2 * _HALF!r}::double and sl >= still - {_HALF!r}::double - 0.01e0 and sr <= still + {_HALF!r}::double + 0.01e0 then 'stationary' when n >= 3 and covered then 'panning' when widest > {2 * _HALF!r}::double + 0.01e0 then 'padded' else 'tracking' end as mode from u join p using (job_id, shot)),
    q as (select job_id, shot, list(t order by t) as t, list(cy order by t) as y, list([mid, r - {_HALF!r}::double, l + {_HALF!r}::double] order by t) as c from fr join v using (job_id, shot) where mode = 'tracking' group by all),
    s1 as (select *, list_reduce(list_transform(range(1, len(c) + 1), lambda i: [c[i][1]]), lambda a, x: list_append(a, 0.35e0 * x[1] + 0.65e0 * a[-1])) as s from q),
    s2 as (select *, list_transform(range(1, len(c) + 1), lambda i: least(greatest(s[i], c[i][2]), c[i][3])) as z from s1),
    s3 as (select *, list_reduce(list_transform(range(1, len(c) + 1), lambda i: case when i = 1 then [z[1]] else [z[i], coalesce(z[i + 1], z[i]), c[i][2], c[i][3], (i = len(c))::int] end), lambda a, x: list_append(a, case when x[5] = 1 then x[1] else least(greatest((a[-1] + x[1] + x[2]) / 3, x[3]), x[4]) end)) as z2 from s2),
    s4 as (select *, list_reduce(list_transform(range(1, len(c) + 1), lambda i: case when i = 1 then [z2[1]] else [z2[i], coalesce(z2[i + 1], z2[i]), c[i][2], c[i][3], (i = len(c))::int] end), lambda a, x: list_append(a, case when x[5] = 1 then x[1] else least(greatest((a[-1] + x[1] + x[2]) / 3, x[3]), x[4]) end)) as z3 from s3),
    rows_ as (select job_id, shot, 'tracking' as mode, unnest(t) as t, unnest(list_transform(z3, lambda x: {_IN.format("x")})) as cx, unnest(y) as cy from s4
      union all select job_id, shot, coalesce(mode, 'stationary'), t0, case when n is null then 0.5e0 when mode = 'stationary' then still else {_IN.format("a")} end, coalesce(sy, 0.5e0) from shots left join v using (job_id, shot) where mode is null or mode in ('stationary', 'panning')
      union all select job_id, shot, coalesce(mode, 'stationary'), t1, case when n is null then 0.5e0 when mode = 'stationary' then still else {_IN.format("a + b * (lt - ft)")} end, coalesce(sy, 0.5e0) from shots left join v using (job_id, shot) where mode is null or mode in ('stationary', 'panning')
      union all select job_id, shot, mode, null, null, null from v where mode = 'padded')
    select job_id, shot, mode, t, round(cx, 6) as cx, round(cy, 6) as cy from rows_""",
)
def shot_cameras(spark, d):
    """The camera of every shot between two cuts, for the faces of its frames: those of known people are required."""
    cuts = tables.cuts(spark, d)
    frames = C.numbered_by_cuts(tables.timed_events(spark, d).select("job_id", "t").distinct(), cuts)
    faces = tables.dense_faces(spark, d).join(frames, ["job_id", "t"])
    regions = faces.select("job_id", "shot", "t", (F.col("x") / 100.0).alias("cx"), (F.col("y") / 100.0).alias("cy"), (F.col("w") / 200.0).alias("half"), (F.col("slot") >= 0).alias("required"))
    shots = frames.groupBy("job_id", "shot").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return C.shot_cameras(shots, regions, 16 / 9).select("job_id", "shot", "mode", "t", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


# n names the keyframe, f the one before with its state
_DT, _TURN = "(n.t - f.t)", "sign(n.x - f.hold)::int"
_BEGINS = f"({_DT} > 0.002e0 and not f.moving and abs(n.x - f.hold) >= 4)"
_FOLLOWS = f"(f.moving and not ({_TURN} <> 0 and f.heading <> 0 and {_TURN} <> f.heading))"
_GOAL = f"(case when {_BEGINS} or {_FOLLOWS} then n.x else f.goal end)"
_BEGIN = f"(case when {_BEGINS} then f.pos else f.start end)"
_DUR = 0.3 / (16 / 9 / (9 / 16)) ** 0.5
_PROGRESS = f"(case when {_BEGINS} then 0e0 else f.progress end + {_DT} / {_DUR!r}::double)"
_ON = f"(({_BEGINS} or f.moving) and {_DT} > 0.002e0)"
_THERE = f"({_ON} and {_PROGRESS} >= 1e0 - 1e-9)"
_POS = f"case when {_DT} <= 0.002e0 then n.x when {_THERE} then {_GOAL} when {_ON} then greatest(0, least(100, {_BEGIN} + ({_GOAL} - {_BEGIN}) * (1e0 - (1e0 - {_PROGRESS}) ** 3))) else f.pos end"


@register(
    "ts42_hold_then_snap",
    f"""with recursive {duck.SCENES}, keys as (select job_id, t / 16.37e0 as t, max(subject_x)::double as x from scenes group by all),
    {duck.fold("keys", "t", {"hold": "n.x", "pos": "n.x", "goal": "n.x", "start": "n.x", "moving": "false", "progress": "0e0", "heading": "0"}, {"hold": f"case when {_DT} <= 0.002e0 then n.x when {_THERE} then {_GOAL} else f.hold end", "pos": _POS, "goal": f"case when {_DT} <= 0.002e0 then f.goal else {_GOAL} end", "start": f"case when {_DT} <= 0.002e0 then f.start else {_BEGIN} end", "moving": f"{_ON} and not {_THERE}", "progress": f"case when {_ON} and not {_THERE} then {_PROGRESS} else 0e0 end", "heading": f"case when {_DT} <= 0.002e0 then 0 when {_TURN} <> 0 then {_TURN} else f.heading end"})}
    select job_id, t, round(pos, 6) as x from f""",
)
def hold_then_snap(spark, d):
    """Keyframes of the subject's place, some 60 ms apart where events were a media second apart, for a crop of a
    wide picture to an upright one."""
    keys = tables.scenes(spark, d).groupBy("job_id", (F.col("t") / 16.37).alias("t")).agg(F.max("subject_x").alias("x"))
    return C.held_keyframes(keys, 16 / 9, 9 / 16).select("job_id", "t", F.round("x", 6).alias("x"))
