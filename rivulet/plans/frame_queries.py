"""Queries: motion, keyframe repairs, cuts, places on tracks, and clips measured by their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import folds as D
from rivulet.operators import frames as M
from rivulet.operators import intervals as I
from rivulet.operators import scoring as S
from rivulet.plans import duck
from rivulet.plans.clip_queries import CLIP, SEG, candidates
from rivulet.plans.folded import _POINT, _POINTS, _points
from rivulet.plans.registry import register
from rivulet.plans.slot_queries import _majority
from rivulet.plans.zones import MOMENTS
from rivulet.sources import tables

# Words that open no hook, words that open one, and words that make curious.
HOOK_FILLERS = ["um", "uh", "like", "so", "and", "but", "well"]
HOOK_OPENERS = ["wow", "oh", "wait", "no", "what", "holy"]
CURIOUS = ["secret", "never", "always", "worst", "best", "crazy", "insane", "shocking", "truth", "actually", "honestly", "literally", "imagine"]

ENERGY = """means as (select job_id, t, avg(x) as x from faces where slot >= 0 group by all), sp as (select job_id, t, case when t - lag(t) over w > 0 then round(abs(x - lag(x) over w) / (t - lag(t) over w), 6) end as v from means window w as (partition by job_id order by t)),
mx as (select job_id, floor(t)::bigint as sec, max(v) as v from sp where v is not null group by all), tp as (select job_id, quantile_cont(v, 0.95) as p from mx where v > 0 group by 1), en as (select mx.job_id, sec, coalesce(least(1e0, v / p), 0) as motion from mx left join tp using (job_id))"""


@register("ts24_motion_energy", f"with {duck.FACES}, {ENERGY} select job_id, sec, round(motion, 6) as motion from en")
def motion_energy(spark, d):
    return M.motion_energy(tables.dense_faces(spark, d)).withColumn("motion", F.round("motion", 6))


@register("ag25_tracked_by_motion", f"with {duck.FACES}, {duck.SPANS}, {ENERGY}, g as (select s.job_id, s.seq, 61e0 as n, sum(motion) as s, sum(motion * motion) as q from spans s left join en on en.job_id = s.job_id and sec >= s.t0 and sec <= s.t1 group by all) select job_id, seq, coalesce(round(s / n, 9) >= 0.02e0 and round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 9) <= round(s / n, 9), false) as tracked from g")
def tracked_by_motion(spark, d):
    """Faces are rare here, so the energy asked for is .02."""
    return M.tracked_by_motion(tables.spans(spark, d), M.motion_energy(tables.dense_faces(spark, d)), 0.02)


@register(
    "ts34_consolidated",
    f"""with {duck.EV}, spk as {duck.SPK.split(", spk as ", 1)[1]}, {duck.SPANS}, {_majority("maj", "0e0")}, r as (select spans.job_id, t0, t1, slot from spans left join maj using (job_id, seq)), c as (select *, (slot is distinct from lag(slot) over w or lag(t0) over w is null)::int as c from r window w as (partition by job_id order by t0)), g as (select *, sum(c) over (partition by job_id order by t0) as g from c)
    select job_id, min(t0) as t0, max(t1) as t1, slot from g group by job_id, g, slot""",
)
def consolidated(spark, d):
    spans = tables.spans(spark, d)
    events = tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "slot", "confidence")
    return M.consolidated(spans.join(I.slot_coverage(spans, events).drop("coverage"), ["job_id", "seq"], "left"), ["slot"])


_USED = "list_concat(f.past, n.ahead)"
_OUTER = f"list_filter({_USED}, lambda o: not (o.x between 45 and 55))"
_NEAREST = f"list_reduce({_OUTER}, lambda a, b: case when abs(n.t - b.t) < abs(n.t - a.t) then b else a end)"
_NEW_X = f"case when n.x between 45 and 55 and len({_OUTER}) > 0 then ({_NEAREST}).x else n.x end"


@register(
    "ts36_inherited_places",
    f"""with recursive {_POINTS}, rows_ as (select job_id, t, x, list({{'t': t, 'x': x}}) over (partition by job_id order by t rows between 1 following and 5 following) as ahead from points),
    {duck.fold("rows_", "t", {"new_x": "case when n.x between 45 and 55 and len(list_filter(n.ahead, lambda o: not (o.x between 45 and 55))) > 0 then (list_reduce(list_filter(n.ahead, lambda o: not (o.x between 45 and 55)), lambda a, b: case when abs(n.t - b.t) < abs(n.t - a.t) then b else a end)).x else n.x end", "past": "[{'t': n.t, 'x': new_x}]"}, {"new_x": _NEW_X, "past": f"list_append(f.past, {{'t': n.t, 'x': {_NEW_X}}})[-5:]"})}
    select job_id, t, new_x as x from f""",
)
def inherited_places(spark, d):
    return D.fold(_points(spark, d), "job_id", ["t"], D.inherited, _POINT)


@register(
    "ts37_repaired_gaps",
    f"""with recursive {_POINTS}, rows_ as (select *, lead(x) over w as nx, lead(t) over w as nt from points window w as (partition by job_id order by t)),
    {duck.fold("rows_", "t", {"s": "n.x"}, {"s": "case when n.nx is not null and abs(f.s - n.nx) <= 10 and abs(n.x - f.s) > 10 and n.nt - n.t <= 40e0 then f.s else n.x end"})} select job_id, t, s as x from f""",
)
def repaired_gaps(spark, d):
    """Points are further apart here than frames, so the next one may come within 40."""
    return D.fold(_points(spark, d), "job_id", ["t"], lambda r: D.gap_repaired(r, 10, 40.0), _POINT)


_SMOOTHED = "(0.3e0 * n.eta + 0.7e0 * f.v)"


@register("ts38_smoothed_eta", f"with recursive {_POINTS}, rows_ as (select job_id, t, x::double + 1 as eta from points), {duck.fold('rows_', 't', {'v': 'n.eta'}, {'v': f'case when f.v <= 0 or n.t - f.t > 30 then n.eta when {_SMOOTHED} > f.v * 1.2e0 and f.v > 30 then f.v * 1.05e0 else {_SMOOTHED} end'})} select job_id, t, round(v, 6) as eta from f")
def smoothed_eta(spark, d):
    rows = _points(spark, d).select("job_id", "t", (F.col("x").cast("double") + 1).alias("eta"))
    return D.fold(rows, "job_id", ["t"], D.eta_smoothed, "job_id long, t double, eta double")


_CUT_ROWS = "cut_rows as (select distinct job_id, t + 0.5e0 as cut from ev where event_type = 'error')"


@register(
    "ts44_shot_cuts",
    f"""with {_POINTS}, {_CUT_ROWS}, b as (select c.job_id, c.cut, k.t as bt, k.x as bx from cut_rows c asof join points k on k.job_id = c.job_id and k.t < c.cut), a as (select c.job_id, c.cut, k.t as at_, k.x as ax from cut_rows c asof join points k on k.job_id = c.job_id and k.t >= c.cut),
    m as (select b.job_id, bt, at_, bx, ax, min(b.cut) as cut from b join a using (job_id, cut) where abs(ax - bx) > 3 and round(b.cut - 0.001e0, 3) > bt group by all)
    select job_id, t, x from points union all select job_id, round(cut - 0.001e0, 3), bx from m union all select job_id, cut, ax from m""",
)
def shot_cuts(spark, d):
    cuts = tables.timed_events(spark, d).filter("event_type = 'error'").select("job_id", (F.col("t") + 0.5).alias("t")).distinct()
    keys = _points(spark, d).select("job_id", "t", F.col("x").cast("double").alias("x"))
    return M.shot_cuts(keys, cuts).withColumn("x", F.col("x").cast("int"))


@register("ts49_jump_markers", f"with {_POINTS}, p as (select *, lag(t) over w as pt, lag(x) over w as px from points window w as (partition by job_id order by t)) select job_id, t, x from points union all select job_id, round(t - 0.001e0, 3), px from p where abs(x - px) > 15 and t - pt > 0.01e0 and round(t - 0.001e0, 3) > pt")
def jump_markers(spark, d):
    return M.jump_markers(_points(spark, d))


@register(
    "ts51_tracking_off",
    f"""with {_POINTS}, spk as {duck.SPK.split(", spk as ", 1)[1]}, off_ as (select job_id, t0 as r0, t1 as r1 from spk where slot = 2 and t1 > t0), kept as (select * from points p where not exists (select 1 from off_ o where o.job_id = p.job_id and p.t >= o.r0 - 0.01e0 and p.t <= o.r1 + 0.01e0)),
    every as (select job_id, r0 as t, 50e0 as x, 0 as kind from off_ union all select job_id, r1, 50e0, 0 from off_ union all select job_id, t, x::double, 1 from kept), n as (select *, lead(t) over (partition by job_id order by t, kind, x) as n from every) select job_id, t, x from n where n is null or n - t >= 0.05e0""",
)
def tracking_off(spark, d):
    """Tracking is off while slot 2 is on."""
    ranges = tables.speaker_events(spark, d).filter("slot = 2 and t1 > t0").select("job_id", F.col("t0").alias("r0"), F.col("t1").alias("r1"))
    return M.tracking_off(_points(spark, d).withColumn("x", F.col("x").cast("double")), ranges)


@register(
    "ts67_clip_places",
    f"""with {_POINTS}, {duck.SPANS}, sp as (select job_id, seq, t0, t0 + 5 as t1 from spans), m as (select s.job_id, s.seq, avg(x) as m from sp s join points p on p.job_id = s.job_id and p.t between s.t0 and s.t1 group by all),
    b as (select s.job_id, s.seq, p.t as bt, p.x as bx from sp s asof join points p on p.job_id = s.job_id and p.t <= s.t0), a as (select s.job_id, s.seq, p.t as at_, p.x as ax from sp s asof join points p on p.job_id = s.job_id and p.t >= s.t1)
    select s.job_id, s.seq, round(greatest(0, least(100, coalesce(m, case when at_ > bt then bx + (ax - bx) * ((s.t0 + s.t1) / 2 - bt) / (at_ - bt) end, bx, ax, 50))), 6) as x from sp s left join m using (job_id, seq) left join b using (job_id, seq) left join a using (job_id, seq)""",
)
def clip_places(spark, d):
    spans = tables.spans(spark, d).withColumn("t1", F.col("t0") + 5)
    return M.clip_place(spans, _points(spark, d)).withColumn("x", F.round("x", 6))


@register(
    "ts68_crop_segments",
    f"""with {_POINTS}, q as (select job_id, t, x // 25 * 25 as x from points), p as (select *, lag(x) over (partition by job_id order by t) as p from q), s as (select job_id, t, x from p where p is null or p <> x), e as (select job_id, max(t) + 1 as duration from ev group by 1),
    r as (select s.job_id, t as t0, coalesce(lead(t) over (partition by s.job_id order by t), duration) as t1, x from s join e using (job_id)) select job_id, t0, t1, x::double as x, case when abs(x - 20) <= 15 and abs(x - 20) <= abs(x - 70) then 'Speaker 1' when abs(x - 70) <= 15 then 'Speaker 2' else x || '%' end as label from r""",
)
def crop_segments(spark, d):
    keys = _points(spark, d).withColumn("x", (F.floor(F.col("x") / 25) * 25).cast("double"))
    ends = tables.timed_events(spark, d).groupBy("job_id").agg((F.max("t") + 1).alias("duration"))
    return M.crop_segments(keys, ends, [20.0, 70.0])


@register(
    "ts70_placed_items",
    f"""with {duck.seg()}, gaps as (select job_id, 0 as n, 0e0 as g0, min(t0) as g1 from seg group by 1 union all select job_id, row_number() over w, t1, coalesce(lead(t0) over w, 'infinity'::double) from seg window w as (partition by job_id order by t0, t1)),
    items as (select distinct job_id, unnest([0, 1, 2]) as item from seg), i as (select job_id, item, item * 7e0 + job_id % 9 as wanted, case item when 0 then 0.2e0 when 1 then 1.5e0 else 1e9 end as length from items),
    c as (select i.*, g.n, g1 - g0 >= length - 0.001e0 as fits, greatest(g0, least(wanted, g1 - length)) as s, case when g1 = 'infinity'::double then g0 else (g0 + g1) / 2 end as middle from i join gaps g using (job_id))
    select job_id, item, round(coalesce(arg_min(s, (round(abs(s - wanted), 9), n)) filter (where fits), arg_min(s, (round(abs(wanted + length / 2 - middle), 9), n))), 6) as start from c group by all""",
)
def placed_items(spark, d):
    segs = tables.segments(spark, d)
    items = segs.select("job_id").distinct().withColumn("item", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    items = items.withColumns({"wanted": F.col("item") * 7.0 + F.col("job_id") % 9, "length": F.when(F.col("item") == 0, 0.2).when(F.col("item") == 1, 1.5).otherwise(1e9)})
    return M.placed_on_track(items, segs.select("job_id", "t0", "t1")).withColumn("start", F.round("start", 6))


@register("jn46_remaining_length", f"with {duck.CLIPS}, i as (select job_id, clip_id as item, case clip_id % 3 when 0 then 'video' when 1 then 'audio' else 'text' end as kind, t0 as media_id, score::double as trim from clips), m as (select p_partkey::double as media_id, (p_size - 10)::double * 4 as duration from part where p_partkey % 5 <> 0) select job_id, item, case when kind <> 'text' and duration > 0 and duration - trim > 0 then duration - trim else 'infinity'::double end as longest from i left join m using (media_id)")
def remaining_length(spark, d):
    kind = F.when(F.col("clip_id") % 3 == 0, "video").when(F.col("clip_id") % 3 == 1, "audio").otherwise("text")
    items = tables.clips(spark, d).select("job_id", F.col("clip_id").alias("item"), kind.alias("kind"), F.col("t0").alias("media_id"), F.col("score").cast("double").alias("trim"))
    media = tables.load(spark, d, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("double").alias("media_id"), ((F.col("p_size") - 10).cast("double") * 4).alias("duration"))
    return M.remaining_length(items, media)


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_FIRST = r"regexp_replace(lower(regexp_extract(trim(text), '^(\S*)', 1)), '[.,!?]+$', '')"


@register(
    "jn29_better_hooks",
    f"""with {SEG}, {CLIP}, c as (select clip.job_id, clip_id, seq, t0, case when contains(left(trim(text), 60), '?') then 3 else 0 end + case when contains(left(trim(text), 60), '!') then 2 else 0 end + case when {_FIRST} in ({_in(HOOK_OPENERS)}) then 3 else 0 end as s
    from clip join seg on seg.job_id = clip.job_id and t0 >= c0 and t0 <= c0 + 5 where {_FIRST} not in ({_in(HOOK_FILLERS)})), b as (select job_id, clip_id, arg_max(t0, (s, -seq)) as better from c where s > 0 group by all) select clip.job_id, clip_id, better from clip left join b using (job_id, clip_id)""",
)
def better_hooks(spark, d):
    return M.better_hook(candidates(spark, d), tables.segments(spark, d), HOOK_FILLERS, HOOK_OPENERS)


_WORD_ROWS = "words_ as (select job_id, t0 as s0, t1 as s1, t0 + (t1 - t0) * i / n as w0, t0 + (t1 - t0) * (i + 1) / n as w1 from (select *, n_words as n, unnest(range(0, n_words)) as i from seg where seq % 3 <> 2))"


@register(
    "jn26_snapped_to_words",
    f"""with {SEG}, {CLIP}, {_WORD_ROWS}, m as (select clip.job_id, clip_id, arg_min(w0, (round(abs(w0 - c0), 6), w0)) as a, arg_min(w1, (round(abs(w1 - c1), 6), w0, w1)) as b from clip join words_ w on w.job_id = clip.job_id and s1 >= c0 - 2 and s0 <= c1 + 2 group by all),
    g as (select clip.job_id, clip_id, c0, c1, greatest(0, a - 0.3e0) as a, b + 0.5e0 as b from clip left join m using (job_id, clip_id)) select job_id, clip_id, case when a < b and round(b - a, 9) >= 15 then round(a, 3) else c0 end as c0, case when a < b and round(b - a, 9) >= 15 then round(b, 3) else c1 end as c1 from g""",
)
def snapped_to_words(spark, d):
    """Word times by even shares of their segment; every third segment has none."""
    segs = tables.segments(spark, d).filter("seq % 3 <> 2 and n_words > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1)))
    length = F.col("t1") - F.col("t0")
    words = segs.select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), (F.col("t0") + length * F.col("i") / F.col("n_words")).alias("w0"), (F.col("t0") + length * (F.col("i") + 1) / F.col("n_words")).alias("w1"))
    return M.snapped_to_words(candidates(spark, d), words)


_UNEVEN, _EVEN = "(o * 0.4e0 + m * 0.3e0 + c * 0.3e0)", "(o * 0.35e0 + m * 0.30e0 + c * 0.35e0)"


@register(
    "ag14_retention_curves",
    f"""with {SEG}, {CLIP}, {duck.EV}, {MOMENTS}, th as (select *, unnest([0, 1, 2]) as k from clip where c1 - c0 >= 10), p as (select *, c0 + (c1 - c0) / 3 * k as p0, case when k = 2 then c1 else c0 + (c1 - c0) / 3 * (k + 1) end as p1 from th),
    s as (select p.job_id, clip_id, k, sum(n_words) as words, round(sum(least(t1, p1) - greatest(t0, p0)), 6) as sec, sum(case when contains(text, '!') then 8 else 0 end + case when contains(text, '?') then 6 else 0 end) as points, count(distinct speaker) as speakers from p join seg on seg.job_id = p.job_id and t1 > p0 and t0 < p1 group by all),
    h as (select p.job_id, clip_id, k, count(*) as heard from p join moments mo on mo.job_id = p.job_id and mo.t between p0 and p1 group by all),
    e as (select p.job_id, clip_id, k, least(100, case when coalesce(sec, 0) > 0 then least(40, floor(words / sec * 12)) else 0 end + coalesce(points, 0) + case when coalesce(speakers, 0) >= 2 then 10 else 0 end + coalesce(heard, 0) * 8) as e from p left join s using (job_id, clip_id, k) left join h using (job_id, clip_id, k)),
    t as (select job_id, clip_id, max(e) filter (where k = 0) as o, max(e) filter (where k = 1) as m, max(e) filter (where k = 2) as c from e group by all)
    select clip.job_id, clip_id, coalesce(floor(round(case when m < 20 and o > 40 then {_UNEVEN} * 0.7e0 when o < 25 then {_UNEVEN} * 0.8e0 when c < 20 and o > 40 then {_UNEVEN} * 0.75e0 else {_EVEN} end, 9))::int, 50) as score,
      case when o is null then 'too_short_to_measure' when m < 20 and o > 40 then 'energy_valley' when o < 25 then 'slow_start' when c < 20 and o > 40 then 'fizzle_ending' when o > 50 and m > 30 and c > 40 then 'sustained_energy' else 'moderate' end as curve from clip left join t using (job_id, clip_id)""",
)
def retention_curves(spark, d):
    return M.retention_curve(candidates(spark, d), tables.segments(spark, d), S.audio_moments(tables.timed_events(spark, d)))


_CURIOUS = " or ".join(f"contains(lower(text), '{w}')" for w in CURIOUS)


@register(
    "ag06_hook_strength",
    f"""with {SEG}, {CLIP}, h as (select clip.job_id, clip_id, string_agg(text, ' ' order by seq) as text, sum(n_words) as n from clip join seg on seg.job_id = clip.job_id and t0 < c0 + 3 and t1 > c0 group by all)
    select clip.job_id, clip_id, case when text is null then 0.3e0 else round(least(1, 0.5e0 + case when contains(text, '?') then 0.15e0 else 0 end + case when contains(text, '!') then 0.1e0 else 0 end + case when n between 3 and 15 then 0.1e0 else 0 end + case when {_CURIOUS} then 0.15e0 else 0 end), 6) end as hook from clip left join h using (job_id, clip_id)""",
)
def hook_strength(spark, d):
    return M.hook_strength(candidates(spark, d), tables.segments(spark, d), CURIOUS)
