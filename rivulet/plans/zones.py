"""Queries: hot zones and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators import condense as C
from rivulet.operators import folds as D
from rivulet.operators import intervals as I
from rivulet.operators import scoring as S
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

PER_WORD = 0.1
_POINTS = "case kind when 'extreme_spike' then 30 when 'silence_to_loud' then 25 else 15 end"
_REACTS = " or ".join(f"contains(lower(text), '{r}')" for r in X.REACTIONS)
_FILLERS = ", ".join(f"'{f}'" for f in X.FILLERS)

SHOUTS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: length(x) > 2 and upper(x) = x and regexp_full_match(x, '\p{L}+'))) > 0"
MOMENTS = """ranked as (select *, row_number() over (partition by job_id order by value, event_id) as rn, count(*) over (partition by job_id) as n from ev where value > -60),
base as (select job_id, value as base from ranked where rn = n // 2 + 1),
delta as (select ev.*, base, round(value - base, 4) as delta, lag(value) over (partition by job_id order by t, event_id) as prev from ev join base using (job_id)),
kinds as (select *, case when prev < base - 10 and value > base + 6 then 'silence_to_loud' when delta > 12 then 'extreme_spike' when delta > 6 then 'volume_spike' end as kind from delta),
moments as (select job_id, event_id, t, value, delta, kind from (select *, row_number() over (partition by job_id order by delta desc, t, event_id) as r from kinds where kind is not null) where r <= 25)"""
ZONES = """dur as (select job_id, max(t1) as duration from seg group by job_id),
zone as (select job_id, k::int as k, k * 20e0 as w0, least(k * 20e0 + 30, duration) as w1 from (select job_id, duration, unnest(range(0, ceil(duration / 20)::bigint)) as k from dur where duration > 0))"""
FILLER = rf"""fil as (
  select job_id, seq, 'filler' as kind, t0, t1 from seg where lower(trim(regexp_replace(text, '[.,!?]', '', 'g'))) in ({_FILLERS})
  union all select job_id, seq, 'repetition', t0, t1 from (select *, list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(lower(x), '[.,!?]', '', 'g')) as w from seg)
    where lower(trim(regexp_replace(text, '[.,!?]', '', 'g'))) not in ({_FILLERS}) and len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1] and length(w[i]) > 1)) > 0
  union all select job_id, seq, 'dead_air', prev, t0 from (select *, lag(t1) over (partition by job_id order by seq) as prev from seg) where t0 - prev > 1.5e0)"""
AUDIO = f"a as (select job_id, k, least(100, sum({_POINTS})) as audio from zone join moments using (job_id) where t >= w0 and t <= w1 group by job_id, k)"
TRANSCRIPT = rf"""tr as (select job_id, k, least(100, p + case when n / greatest(1e0, (w1 - w0) / 10e0) > 2 then 10 else 0 end) as transcript from (
  select job_id, k, w0, w1, count(*) as n, sum(case when contains(text, '!') then 8 else 0 end + case when contains(text, '?') then 6 else 0 end + case when {SHOUTS} then 10 else 0 end
    + case when {_REACTS} then 12 else 0 end + case when n_words > 3 and t1 - t0 < 3 then 5 else 0 end) as p
  from zone join seg using (job_id) where t0 >= w0 and t1 <= w1 group by job_id, k, w0, w1))"""
SCENE = "sc as (select job_id, k, least(100e0, max(importance) * 6 + avg(importance) * 4 + case when max(importance) >= 9 then 20 else 0 end) as scenes from zone join scenes using (job_id) where t >= w0 and t <= w1 group by job_id, k)"
SPEAKER = """sp as (select job_id, k, case when s >= 2 then 20 else 0 end + case when c >= 3 then 25 when c >= 1 then 10 else 0 end as speakers from (
  select job_id, k, count(distinct speaker) as s, count_if(before is not null and before <> speaker) as c from (
    select job_id, k, speaker, lag(speaker) over (partition by job_id, k order by seq) as before from zone join seg using (job_id) where t0 >= w0 and t1 <= w1) group by job_id, k))"""
DENSITY = "de as (select job_id, k, count(*) / greatest((w1 - w0) / 60e0, 0.01e0) as density from zone join fil using (job_id) where t0 >= w0 and t1 <= w1 group by job_id, k, w0, w1)"
HOT = f"""with {duck.seg(PER_WORD)}, {duck.SCENES}, {MOMENTS}, {ZONES}, {FILLER}, {AUDIO}, {TRANSCRIPT}, {SCENE}, {SPEAKER}, {DENSITY},
hot as (select job_id, k, w0, w1, coalesce(audio, 0)::bigint as audio, coalesce(transcript, 0)::bigint as transcript, coalesce(scenes, 0) as scenes, coalesce(speakers, 0)::int as speakers,
  round(greatest(0e0, 0.25e0 * coalesce(audio, 0) + 0.35e0 * coalesce(transcript, 0) + 0.25e0 * coalesce(scenes, 0) + 0.15e0 * coalesce(speakers, 0)
    - case when coalesce(density, 0) > 6 then 15 when coalesce(density, 0) > 3 then 8 else 0 end), 1) as score
  from zone left join a using (job_id, k) left join tr using (job_id, k) left join sc using (job_id, k) left join sp using (job_id, k) left join de using (job_id, k))
"""


def _inputs(spark, d):
    return tables.segments(spark, d, PER_WORD), tables.scenes(spark, d), S.audio_moments(tables.timed_events(spark, d))


@register("ts01_hot_zones", HOT + "select job_id, k, w0, w1, score, audio, transcript, round(scenes, 4) as scenes, speakers from hot")
def hot_zones(spark, d):
    return S.hot_zones(*_inputs(spark, d))


@register("ts03_top_zones", HOT + "select job_id, k, w0, w1, score, rank from (select *, row_number() over (partition by job_id order by score desc, w0)::int as rank from hot) where rank <= 3")
def top_zones(spark, d):
    return S.top_zones(S.hot_zones(*_inputs(spark, d)), 3).select("job_id", "k", "w0", "w1", "score", "rank")


@register("ts02_transcript_zones", f"with {duck.seg(PER_WORD)}, {ZONES}, {TRANSCRIPT}, {SPEAKER} select job_id, k, round(0.65e0 * coalesce(transcript, 0) + 0.35e0 * coalesce(speakers, 0), 2) as score from zone left join tr using (job_id, k) left join sp using (job_id, k)")
def transcript_zones(spark, d):
    segs = tables.segments(spark, d, PER_WORD)
    zone = S.zones(S.durations(segs))
    out = zone.join(S.transcript_score(segs, zone), ["job_id", "k"], "left").join(S.speaker_score(segs, zone), ["job_id", "k"], "left").fillna(0, ["transcript", "speakers"])
    return out.select("job_id", "k", F.round(0.65 * F.col("transcript") + 0.35 * F.col("speakers"), 2).alias("score"))


@register("ag01_audio_score", f"with {duck.seg(PER_WORD)}, {duck.EV}, {MOMENTS}, {ZONES}, {AUDIO} select job_id, k, audio::bigint as audio from a")
def audio_score(spark, d):
    segs, _, moments = _inputs(spark, d)
    return S.audio_score(moments, S.zones(S.durations(segs)))


@register("ag02_transcript_score", f"with {duck.seg(PER_WORD)}, {ZONES}, {TRANSCRIPT} select job_id, k, transcript::bigint as transcript from tr")
def transcript_score(spark, d):
    segs = tables.segments(spark, d, PER_WORD)
    return S.transcript_score(segs, S.zones(S.durations(segs)))


@register("ag03_scene_score", f"with {duck.seg(PER_WORD)}, {duck.SCENES}, {ZONES}, {SCENE} select job_id, k, round(scenes, 4) as scenes from sc")
def scene_score(spark, d):
    segs, scenes, _ = _inputs(spark, d)
    return S.scene_score(scenes, S.zones(S.durations(segs))).withColumn("scenes", F.round("scenes", 4))


@register("ag04_speaker_score", f"with {duck.seg(PER_WORD)}, {ZONES}, {SPEAKER} select job_id, k, speakers::int as speakers from sp")
def speaker_score(spark, d):
    segs = tables.segments(spark, d, PER_WORD)
    return S.speaker_score(segs, S.zones(S.durations(segs)))


@register("sf01_filler_events", f"with {duck.seg(0.4)}, {FILLER} select * from fil")
def filler_events(spark, d):
    return S.filler_events(tables.segments(spark, d))


@register("ag05_filler_density", f"with {duck.seg(PER_WORD)}, {ZONES}, {FILLER}, {DENSITY} select job_id, k, round(density, 4) as density from de")
def filler_density(spark, d):
    segs = tables.segments(spark, d, PER_WORD)
    return S.filler_density(S.filler_events(segs), S.zones(S.durations(segs))).withColumn("density", F.round("density", 4))


@register("ts07_audio_spikes", f"with {duck.EV}, {MOMENTS} select job_id, event_id, t, value, delta, kind from moments")
def audio_spikes(spark, d):
    return S.audio_moments(tables.timed_events(spark, d))


@register(
    "ts04_coverage_gaps",
    HOT
    + """, found as (select * from (select *, row_number() over (partition by job_id order by score desc, w0) as rank from hot) where rank = 1),
    marks as (select distinct job_id, unnest(range(floor(w0)::bigint, floor(w1)::bigint + 1)) as sec from found),
    every as (select job_id, unnest(range(0, floor(duration)::bigint + 1)) as sec from dur),
    free as (select job_id, sec, sec - row_number() over (partition by job_id order by sec) as g from every anti join marks using (job_id, sec)),
    runs as (select job_id, min(sec) as t0, max(sec) + 1 as t1 from free group by job_id, g having count(*) >= 10),
    decent as (select * from hot where score > 20),
    near as (select r.* from runs r where not exists (select 1 from decent z where z.job_id = r.job_id) or exists (select 1 from decent z where z.job_id = r.job_id and z.w0 < r.t1 and z.w1 > r.t0))
    select job_id, t0, t1 from (select *, row_number() over (partition by job_id order by t0) as n from near) where n <= 4""",
)
def coverage_gaps(spark, d):
    """The best window of each job is its one found clip; what is left uncovered for ten seconds and more, near windows
    that score over 20 (where a job has such)."""
    zoned = S.hot_zones(*_inputs(spark, d))
    found = S.top_zones(zoned, 1).select("job_id", F.col("w0").alias("t0"), F.col("w1").alias("t1"))
    gaps = I.second_gaps(found, S.durations(tables.segments(spark, d, PER_WORD)), 10)
    decent = zoned.filter("score > 20").select("job_id", F.col("w0").alias("z0"), F.col("w1").alias("z1"))
    return I.first_gaps(I.gaps_near(gaps, decent), 4)


_LINE = "'[' || round_even(t0, 0)::bigint || '-' || round_even(t1, 0)::bigint || '] ' || speaker || ': ' || "
_BUDGET = 1500


def _greedy(tier: str, budget: int) -> str:
    return f"""n_{tier} as (select job_id, line, row_number() over (partition by job_id order by seq) as rn from lines where tier = '{tier}'),
    g_{tier} as (select job_id, rn, case when length(line) + 1 <= {budget} then length(line) + 1 else 0 end as used, case when length(line) + 1 <= {budget} then [line] else [] end as kept from n_{tier} where rn = 1 union all
      select n.job_id, n.rn, g.used + case when g.used + length(n.line) + 1 <= {budget} then length(n.line) + 1 else 0 end, case when g.used + length(n.line) + 1 <= {budget} then list_append(g.kept, n.line) else g.kept end from g_{tier} g join n_{tier} n on n.job_id = g.job_id and n.rn = g.rn + 1),
    {tier}_ as (select job_id, arg_max(kept, rn) as kept from g_{tier} group by 1)"""


@register(
    "sm08_hot_first",
    HOT.replace("with ", "with recursive ", 1)
    + f""", secs as (select job_id, score, k, unnest(range(floor(w0)::bigint, floor(w1)::bigint + 1)) as sec from hot), best as (select job_id, sec, arg_max(score, (score, -k)) as score from secs group by all),
    tiered as (select seg.*, case when score >= 50 then 'hot' when score >= 20 then 'warm' else 'cold' end as tier from seg left join best on best.job_id = seg.job_id and best.sec = floor(seg.t0)),
    lines as (select *, {_LINE} case when tier = 'hot' then text else left(text, 100) end as line from tiered),
    c1 as (select *, coalesce(lag(tier) over w <> 'cold', true) and tier = 'cold' as begins, lead(t0) over w as nxt, max(t1) over (partition by job_id) as end_ from tiered window w as (partition by job_id order by seq)),
    c2 as (select *, sum(begins::int) over (partition by job_id order by seq) as run from c1), c3 as (select job_id, run, arg_min(t0, seq) as a, arg_max(coalesce(nxt, end_), seq) as b from c2 where tier = 'cold' group by all),
    c4 as (select job_id, run, '[' || round_even(a, 0)::bigint || '-' || round_even(b, 0)::bigint || 's] (low-engagement region — ' || round_even(b - a, 0)::bigint || 's of content condensed)' as line from c3),
    cold_ as (select job_id, left(string_agg(line, chr(10) order by run) filter (where run <= 10), {_BUDGET // 10}) as cold from c4 group by 1), {_greedy("hot", _BUDGET * 6 // 10)}, {_greedy("warm", _BUDGET * 3 // 10)}
    select j.job_id, coalesce(len(h.kept), 0)::int as hot, coalesce(len(w.kept), 0)::int as warm, length(coalesce(cold, ''))::int as cold, sha256(array_to_string(list_concat(list_concat(coalesce(h.kept, []), coalesce(w.kept, [])), [coalesce(cold, '')]), chr(10))) as digest
    from (select distinct job_id from seg) j left join hot_ h using (job_id) left join warm_ w using (job_id) left join cold_ using (job_id)""",
)
def hot_first(spark, d):
    """Transcripts within 1,500 characters, hot windows first (digests)."""
    segs = tables.segments(spark, d, PER_WORD)
    found = C.hot_first(segs, S.hot_zones(*_inputs(spark, d)), _BUDGET)
    return found.select("job_id", "hot", "warm", "cold", F.sha2("text", 256).alias("digest"))


@register("st08_consolidated_segments")
def consolidated_segments(spark, d):
    rows = tables.segments(spark, d, 0.05).select("job_id", "seq", "t0", "t1", F.coalesce("text", F.lit("")).alias("text"))
    return D.fold(rows, "job_id", ["seq"], C.consolidated, "job_id long, seq long, t0 double, t1 double, text string")
