"""Queries: who speaks when, and which face is whose."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import slots as L
from rivulet.operators import speakers as K
from rivulet.plans import duck
from rivulet.plans.folded import smoothed_sql
from rivulet.plans.registry import register
from rivulet.plans.slot_queries import BASE, REG
from rivulet.sources import tables

# Openings of lips, words and labels stand in by rule: three quarters of the faces open their lips; a word every two seconds.
_LIP = "((event_id * 7 + k * 3) % 13 * (event_id % 4 + k > 1)::int) / 200e0"
_TALK = f"""{BASE}, {REG}, segs as (select job_id, seq, t0, t0 + 30 + seq % 3 * 10 as t1 from spans),
words as (select job_id, seq, i, t0 + i * 2 as w0, t0 + i * 2 + 1 as w1 from segs, unnest(range(1, 15)) u(i)),
af as (select faces.*, {_LIP} as lip from faces), far as (select af.*, arg_min(reg.slot, (abs(x_center - x), reg.slot)) as nearest, count(reg.slot) as n_slots from af left join reg on af.job_id = reg.job_id group by all),
lips as (select job_id, event_id, t, s as slot, arg_min(lip, k) as lip, arg_min(w, k) as w from (select *, unnest(list_distinct([slot, nearest])) as s from far) where s >= 0 group by job_id, event_id, t, s),
lp as (select s.job_id, s.seq, f.slot, f.t, f.lip, f.w, lag(f.t) over w as pt, lag(f.lip) over w as pl from segs s join lips f on f.job_id = s.job_id and f.t >= s.t0 - 0.5e0 and f.t <= s.t1 + 0.5e0 window w as (partition by s.job_id, s.seq, f.slot order by f.t)),
lg as (select job_id, seq, slot, count(*) as n, max(t) - min(t) as time, avg(lip) as lip, avg(w) as w, avg(case when t - pt > 0 then abs(lip - pl) / (t - pt) end) as v from lp group by all),
motion as (select job_id, seq, slot, round(case when n < 2 then lip when case when time > 0 then (n - 1) / greatest(time, 0.01e0) else 0 end < 4 then least(1, lip * least(2, w / 8) / 0.04e0) when v is null then 0 else 0.6e0 * least(1, v / 0.08e0) + 0.4e0 * least(1, lip / 0.04e0) end, 6) as motion from lg),
lt as (select s.job_id, s.seq, f.slot, f.t, f.lip from segs s join lips f on f.job_id = s.job_id and f.t >= s.t0 - 0.2e0 and f.t <= s.t1 + 0.2e0),
lw as (select job_id, seq, slot, i, avg(lip) filter (t between w0 - 0.1e0 and w1 + 0.1e0) as own, avg(lip) filter (not t between w0 - 0.1e0 and w1 + 0.1e0) as rest, count(*) as frames from lt join words using (job_id, seq) group by all),
sync as (select job_id, seq, slot, avg(case when rest > 0 then least(1, own / rest / 2) else (own > 0.02e0)::int end) filter (own is not null and rest is not null) as sync from lw group by all having max(frames) >= 3)"""


def _scored(pad: int, who: str) -> str:
    return f"""near as (select s.job_id, s.seq, far.* exclude (job_id), {who} as who from segs s join far on far.job_id = s.job_id and far.t >= s.t0 - {pad} and far.t <= s.t1 + {pad}),
    seen as (select job_id, seq, who as slot, min((t, k)) as first from near where who >= 0 group by all),
    wide as (select job_id, seq, arg_min((lip, nearest), (-lip, t, k)) as wide, max(n_slots) as n_slots from near group by all),
    cand as (select job_id, seq, list({{'score': coalesce(motion, 0) * (0.7e0 + 0.6e0 * coalesce(sync, 0.5e0)), 'slot': slot}} order by first) as c from seen left join motion using (job_id, seq, slot) left join sync using (job_id, seq, slot) group by all),
    rows_ as (select job_id, seq, t0, t1, c, wide[1] as lip, wide[2] as near_slot, coalesce(n_slots, 0) as n_slots from segs left join cand using (job_id, seq) left join wide using (job_id, seq) where job_id in (select job_id from af group by 1 having max(lip) > 0))"""


def _best(bonus: str) -> str:
    return f"list_max(list_transform(range(1, len(n.c) + 1), lambda i: {{'s': n.c[i].score + {bonus}, 'r': -i, 'slot': n.c[i].slot}}))"


_BONUS = "case when n.c[i].slot = f.slot then 0.015e0 else 0e0 end"
_PLACE = "case when n.c is not null and n.n_slots >= 2 then case when {b}.s >= 0.025e0 then {b}.slot else -1 end when n.n_slots < 2 and n.lip >= 0.025e0 and n.near_slot >= 0 then n.near_slot else -1 end"
_PLACE_SURE = "case when n.c is not null and n.n_slots >= 2 then least(1, {b}.s / 0.05e0) when n.n_slots < 2 and n.lip >= 0.025e0 and n.near_slot >= 0 then least(1, n.lip / 0.05e0) else 0e0 end"


def _joined(name: str, rows: str) -> str:
    return f"""{name} as (select job_id, min(t0) as t0, max(t1) as t1, min(slot) as slot, max(confidence) as confidence from (select *, sum(brk) over (partition by job_id order by t0) as g from (select *, (not coalesce(slot = lag(slot) over w and t0 - lag(t1) over w < 1, false))::int as brk from {rows} window w as (partition by job_id order by t0))) group by job_id, g)"""


def _inputs(spark, d):
    segs = tables.spans(spark, d).select("job_id", "seq", "t0", (F.col("t0") + 30 + F.col("seq") % 3 * 10).alias("t1"))
    words = segs.select("job_id", "seq", "t0", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("i")).select("job_id", "seq", "i", (F.col("t0") + F.col("i") * 2).alias("w0"), (F.col("t0") + F.col("i") * 2 + 1).alias("w1"))
    e, k = F.col("event_id"), F.col("k")
    faces = tables.dense_faces(spark, d).withColumn("lip", (e * 7 + k * 3) % 13 * (e % 4 + k > 1).cast("int") / 200.0)
    return segs, words, faces, L.registry(faces).select("job_id", "slot", "x_center")


_SAME, _TAKEN = "n.slot = f.s_slot", "(n.slot < 0 or n.confidence >= 0.7e0 or f.s_conf < 0.3e0)"


@register(
    "ts08_speaker_timeline",
    f"""with recursive {_TALK}, {_scored(2, "nearest")},
    {duck.fold("rows_", "seq", {"slot": _PLACE.format(b=_best("0e0")), "confidence": _PLACE_SURE.format(b=_best("0e0"))}, {"slot": _PLACE.format(b=_best(_BONUS)), "confidence": _PLACE_SURE.format(b=_best(_BONUS))})},
    {_joined("islands", "f")},
    {duck.fold("islands", "t0", {"idx": "0", "s_t0": "n.t0", "s_slot": "n.slot", "s_conf": "n.confidence"}, {"idx": f"f.idx + (not {_SAME} and {_TAKEN})::int", "s_t0": f"case when not {_SAME} and {_TAKEN} then n.t0 else f.s_t0 end", "s_slot": f"case when not {_SAME} and {_TAKEN} then n.slot else f.s_slot end", "s_conf": f"case when {_SAME} then greatest(f.s_conf, n.confidence) when {_TAKEN} then n.confidence else f.s_conf * 0.95e0 end"}, tag="2")}
    select job_id, s_t0 as t0, t1, s_slot::int as slot, round(s_conf, 6) as confidence from {duck.last_of("idx", tag="2")}""",
)
def speaker_timeline(spark, d):
    return K.timeline(*_inputs(spark, d)).select("job_id", "t0", "t1", "slot", F.round("confidence", 6).alias("confidence"))


_REVERTS = "f.slot2 = n.lead and n.slot <> n.lead and n.confidence < n.sure"


@register(
    "ts09_identity_timeline",
    f"""with recursive {_TALK}, {_scored(1, "slot")},
    {duck.fold("rows_", "seq", {"slot": f"coalesce({_best('0e0')}.slot, -1)", "confidence": f"case when n.c is null then 0e0 else least(1, {_best('0e0')}.s / 0.05e0) end"}, {"slot": f"coalesce({_best(_BONUS)}.slot, -1)", "confidence": f"case when n.c is null then 0e0 else least(1, {_best(_BONUS)}.s / 0.05e0) end"})},
    {_joined("islands", "f")},
    spoken as (select job_id, slot, sum(t1 - t0) as sec, min(t0) as since from islands where slot >= 0 group by all),
    lead_ as (select job_id, arg_max(slot, (sec, -since)) as lead, max(sec) / greatest(sum(sec), 0.1e0) as share, count_if(sec > 5) as several from spoken group by 1),
    held as (select islands.*, lead, case when several >= 4 then case when share > 0.7e0 then 0.3e0 else 0 end when share > 0.4e0 then 0.5e0 else 0 end as sure from islands left join lead_ using (job_id)),
    {duck.fold("held", "t0", {"slot2": "n.slot", "conf2": "n.confidence"}, {"slot2": f"case when {_REVERTS} then n.lead else n.slot end", "conf2": f"case when {_REVERTS} then f.conf2 * 0.9e0 else n.confidence end"}, tag="2")},
    turned as (select job_id, t0, t1, slot2 as slot, conf2 as confidence from f2), {_joined("final", "turned")}
    select job_id, t0, t1, slot::int as slot, round(confidence, 6) as confidence from final""",
)
def identity_timeline(spark, d):
    return K.identity_timeline(*_inputs(spark, d)).select("job_id", "t0", "t1", "slot", F.round("confidence", 6).alias("confidence"))


@register("ts12_lip_audio_sync", f"with {_TALK} select job_id, seq, slot, round(sync, 6) as sync from sync where sync is not null")
def lip_audio_sync(spark, d):
    segs, words, faces, slots = _inputs(spark, d)
    found = K.audio_sync(segs, words, K.lips_of_slots(K.with_nearest(faces, slots)))
    return found.select("job_id", "seq", "slot", F.round("sync", 6).alias("sync"))


_FREE = "list_filter(n.c, lambda o: not list_contains(f.used, o.slot))"


@register(
    "jn33_speaker_slots",
    f"""with recursive {_TALK}, said as (select *, 'S' || (seq * 7 + job_id) % 5 as speaker from segs where (seq * 7 + job_id) % 11 > 0),
    near as (select s.job_id, s.seq, s.t0, s.t1, speaker, lip, w, h, t, k, case when slot >= 0 then slot else nearest end as who from said s join far on far.job_id = s.job_id and far.t >= s.t0 - 0.5e0 and far.t <= s.t1 + 0.5e0),
    sums as (select job_id, seq, t0, t1, speaker, who, round(sum(lip * least(2, w / 8)), 9) as lips, round(sum(w * h), 6) as size, min((t, k)) as first from near where who >= 0 group by all),
    voted as (select job_id, seq, t0, t1, speaker, case when max(lips) > 0.01e0 then arg_min(who, (-lips, first)) else arg_min(who, (-size, first)) end as slot from sums group by all),
    votes as (select job_id, speaker, slot, round(sum(greatest(t1 - t0, 0.1e0)), 6) as votes, min(seq) as since from voted group by all),
    queue as (select job_id, speaker, sum(votes) as total, min(since) as since, list({{'slot': slot, 'votes': votes}} order by votes desc, since) as c from votes group by all),
    {duck.fold("queue", "total desc, since", {"used": "[n.c[1].slot]", "pick": "n.c[1]"}, {"used": f"case when len({_FREE}) > 0 then list_append(f.used, {_FREE}[1].slot) else f.used end", "pick": f"{_FREE}[1]"})}
    select job_id, speaker, pick.slot::int as slot, pick.votes as votes from f where pick is not null""",
)
def speaker_slots(spark, d):
    """Labels of segments stand in by rule."""
    segs, _, faces, slots = _inputs(spark, d)
    turn = F.col("seq") * 7 + F.col("job_id")
    said = segs.filter(turn % 11 > 0).withColumn("speaker", F.concat(F.lit("S"), (turn % 5).cast("string")))
    return K.speaker_slots(said, faces, slots)


_CHANGES = "(n.slot <> f.now and n.s0 - f.begin_ >= 4)"


@register(
    "ts28_turns_in_shots",
    f"""with recursive {BASE}, turns as (select job_id, seq as rank, t0 + seq % 7 as s0, t0 + seq % 7 + 20 + seq % 31 as s1, (seq * 5 + job_id) % 5 - 1 as slot from spans where (seq + job_id) % 4 > 0),
    shots as (select job_id, seq // 3 as seq, min(t0) as t0, max(t1) as t1 from spans group by all),
    spoken as (select s.*, greatest(s0, t0) as a, slot, rank from shots s join turns u on u.job_id = s.job_id and s1 > t0 and s0 < t1 and slot >= 0),
    seen as (select s.*, greatest(e.t0, s.t0) as a, slot, event_id as rank from shots s join spk e on e.job_id = s.job_id and e.t1 > s.t0 and e.t0 < s.t1 where not exists (select 1 from spoken p where p.job_id = s.job_id and p.seq = s.seq)),
    rows_ as (select job_id || '/' || seq as k, job_id, seq, t0, t1, a as s0, slot, rank from (select * from spoken union all select * from seen)),
    {duck.fold("rows_", "s0, rank", {"now": "n.slot", "begin_": "n.t0", "cut": "false", "was": "n.t0", "who": "n.slot"}, {"now": f"case when {_CHANGES} then n.slot else f.now end", "begin_": f"case when {_CHANGES} then n.s0 else f.begin_ end", "cut": _CHANGES, "was": "f.begin_", "who": "f.now"}, key="k")},
    ends2 as (select f.job_id, f.seq, max(t1) as t1, arg_max(begin_, rn) as begin_, arg_max(now, rn) as now, count_if(cut) as cuts from f group by f.job_id, f.seq),
    parts as (select f.job_id, f.seq, was as t0, s0 as t1, who as slot from f where cut union all select job_id, seq, begin_, t1, now from ends2 where t1 - begin_ >= 4 or cuts = 0),
    closed as (select p.job_id, p.seq, p.t0, case when e.t1 - e.begin_ < 4 and p.t1 = e.begin_ then e.t1 else p.t1 end as t1, slot, count(*) over (partition by p.job_id, p.seq) as n from parts p join ends2 e using (job_id, seq))
    select job_id, seq, t0, t1, slot::int as slot from closed where n > 1""",
)
def turns_in_shots(spark, d):
    """Shots of three minutes, turns of labels by rule (some of nobody known), and a hold of four seconds."""
    spans = tables.spans(spark, d)
    seq = F.col("seq")
    start = F.col("t0") + seq % 7
    turns = spans.filter((seq + F.col("job_id")) % 4 > 0).select("job_id", seq.alias("rank"), start.alias("s0"), (start + 20 + seq % 31).alias("s1"), ((seq * 5 + F.col("job_id")) % 5 - 1).alias("slot"))
    shots = spans.groupBy("job_id", F.floor(seq / 3).alias("seq")).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    events = tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), F.col("slot").cast("long").alias("slot"), F.col("event_id").alias("rank"))
    return K.turns_in_shots(shots, turns, events, 4.0)


_LAYOUTS = """ids as (select job_id, event_id, slot, max(w + k * 3 - 6) as w from faces where slot >= 0 group by all), i as (select job_id, event_id, count(*) as n, list_reverse_sort(list(w)) as sizes from ids group by all), fw as (select job_id, event_id, t, count(*) as faces, list_reverse_sort(list(w + k * 3 - 6)) as widths from faces group by all),
    votes as (select fw.job_id, fw.event_id, t / 4 as t, case when fw.event_id % 11 = 0 then 'screenshare' when coalesce(n, 0) >= 3 then 'triple' when n = 2 then case when sizes[2] > 5 then 'split' else 'single' end when faces >= 2 and widths[2] > 5 then 'split' else 'single' end as slot from fw left join i using (job_id, event_id))"""


@register(
    "ts27_layout_timeline",
    f"""with recursive {BASE}, {REG}, {smoothed_sql(_LAYOUTS)},
    final as (select job_id, min(t0) as t0, max(t1) as t1, min(slot) as layout from (select *, sum(c) over (partition by job_id order by t0) as g from (select *, (slot is distinct from lag(slot) over (partition by job_id order by t0))::int as c from backward)) group by job_id, g),
    total as (select job_id, layout, round(sum(t1 - t0), 6) as time, min(t0) as since, count(*) as n from final group by all),
    most as (select job_id, arg_min(layout, (-time, since)) as default_layout, sum(n)::bigint - 1 as changes, min(since) as first from total group by 1),
    pair as (select job_id, list(slot order by x_center, slot)[1:2] as p from reg group by 1)
    select final.job_id, t0, t1, layout, case when t0 = first then 'cut' else 'dissolve' end as transition, case when layout = 'split' and len(p) = 2 then p[1] end as left_slot, case when layout = 'split' and len(p) = 2 then p[2] end as right_slot, default_layout, changes from final join most using (job_id) left join pair using (job_id)""",
)
def layout_timeline(spark, d):
    """Frames' times are quartered, so that some layouts don't last; every eleventh frame shows a screen."""
    faces = tables.dense_faces(spark, d).withColumn("w", F.col("w") + F.col("k") * 3 - 6)
    frames = faces.groupBy("job_id", "event_id", "t").agg(F.collect_list(F.struct("slot", "w")).alias("faces")).withColumn("screen", F.col("event_id") % 11 == 0)
    votes = frames.select("job_id", "event_id", (F.col("t") / 4).alias("t"), L.layout_votes(frames).alias("slot"))
    return L.layout_timeline(votes, L.registry(tables.dense_faces(spark, d)))


def _lip_sql(points: str, ids: str, pad: str) -> str:
    return f"(select {ids}, arg_min(who, (-lip, first)) as slot from (select {ids}, who, round(avg(lip), 9) as lip, min((t, k)) as first from (select p.*, who, lip, t, k from {points} p join fw on fw.job_id = p.job_id and abs(fw.t - p.mid) <= {pad} and lip > 0.02e0 and who >= 0) group by all) group by {ids})"


_OTHER = "list_filter(case when n.gap >= 1.2e0 then n.speaking else n.visible end, lambda o: o is distinct from f.keys[f.now])"
_EFF = f"case when n.signal is not null then n.signal else list_min({_OTHER}) end"
_VOICE = f"(({_EFF}) is null and n.gap >= 1.2e0)"
_KEYS = f"case when {_VOICE} then list_append(f.keys, -1) when ({_EFF}) is not null and not list_contains(f.keys, {_EFF}) then list_append(f.keys, {_EFF}) else f.keys end"


@register(
    "jn34_face_speakers",
    f"""with recursive {_TALK}, fw as (select *, case when slot >= 0 then slot else nearest end as who from far), scn as (select job_id, t, arg_max(event_id * 37 % 101, event_id)::double as x from ev group by all),
    sg as (select job_id, seq, t0, t1, (t0 + t1) / 2 as mid from segs where job_id in (select job_id from reg group by 1 having count(*) >= 2) and job_id in (select job_id from faces group by 1 having count(distinct t) >= 3)),
    e1 as (select sg.job_id, sg.seq, arg_min(spk.slot, event_id) as by_event from sg join spk on spk.job_id = sg.job_id and spk.t0 <= sg.mid and spk.t1 >= sg.mid and event_id % 5 = 0 group by all),
    wp as (select job_id, seq, i, (w0 + w1) / 2 as mid from words semi join sg using (job_id)),
    wv as (select job_id, seq, slot, count(*) as n, min(i) as since from {_lip_sql("wp", "job_id, seq, i", "0.5e0")} group by all), e2 as (select job_id, seq, arg_min(slot, (-n, since)) as by_word from wv group by all),
    e3 as (select job_id, seq, slot as by_lips from {_lip_sql("sg", "job_id, seq", "2")}),
    sx as (select sg.job_id, sg.seq, arg_min(x, (round(abs(scn.t - mid), 9), scn.t)) as x from sg join scn on scn.job_id = sg.job_id and abs(scn.t - mid) <= 10 group by all), e4 as (select sx.job_id, sx.seq, arg_min(reg.slot, (abs(x_center - x), reg.slot)) as by_scene from sx join reg on reg.job_id = sx.job_id group by all),
    ar as (select sg.job_id, sg.seq, list(distinct who) filter (lip > 0.02e0) as speaking, list(distinct who) as visible from sg join fw on fw.job_id = sg.job_id and abs(fw.t - sg.t0) <= 3 and who >= 0 group by all),
    rows_ as (select sg.job_id, sg.seq, t0 - lag(t1) over (partition by sg.job_id order by sg.seq) as gap, coalesce(by_event, by_word, by_lips, by_scene)::int as signal, coalesce(speaking, []) as speaking, coalesce(visible, []) as visible from sg left join e1 using (job_id, seq) left join e2 using (job_id, seq) left join e3 using (job_id, seq) left join e4 using (job_id, seq) left join ar using (job_id, seq)),
    {duck.fold("rows_", "seq", {"keys": "case when n.signal is not null then [n.signal] else []::int[] end", "now": "1"}, {"keys": _KEYS, "now": f"case when {_VOICE} then len(f.keys)::int + 1 when ({_EFF}) is not null then list_position({_KEYS}, {_EFF})::int else f.now end"})}
    select job_id, seq, 'Speaker ' || now as speaker from f""",
)
def face_speakers(spark, d):
    """Every fifth speaker event is known; jobs of one place in the picture are left to the rule by pauses."""
    segs, words, faces, slots = _inputs(spark, d)
    events = tables.speaker_events(spark, d).filter("event_id % 5 = 0").select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "slot", F.col("event_id").alias("rank"))
    scenes = tables.scenes(spark, d).select("job_id", "event_id", "t", F.col("subject_x").alias("x"))
    fit = slots.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").join(faces.groupBy("job_id").agg(F.countDistinct("t").alias("m")).filter("m >= 3"), "job_id")
    return K.face_speakers(segs.join(fit, "job_id", "left_semi").withColumn("n_words", F.lit(14)), words, faces, slots, scenes, events)


@register(
    "jn32_speaking_keyframes",
    f"""with {_TALK}, sp as (select * from spk where event_id % 3 = 0 and job_id % 4 > 0), sp2 as (select job_id, t0, t1, event_id, case when event_id % 2 = 0 then -1 else slot end as slot from sp),
    fr as (select distinct job_id, t from af),
    ac as (select fr.job_id, fr.t, coalesce((select slot from sp2 where sp2.job_id = fr.job_id and sp2.t0 <= fr.t and fr.t <= sp2.t1 order by sp2.t0, event_id limit 1), (select slot from sp2 where sp2.job_id = fr.job_id and sp2.t1 <= fr.t order by sp2.t1 desc, event_id desc limit 1), (select slot from sp2 where sp2.job_id = fr.job_id order by sp2.t0, event_id limit 1)) as active from fr),
    ctx as (select ac.job_id, ac.t, active, r.x_center, exists (select 1 from segs where segs.job_id = ac.job_id and segs.t0 <= ac.t and ac.t <= segs.t1) as spoken from ac left join (select * from reg where slot <> 2) r on r.job_id = ac.job_id and r.slot = active),
    pick as (select c.job_id, c.t, coalesce(case when any_value(active) >= 0 then coalesce(arg_min(a.k, a.k) filter (where a.slot = active), arg_min(a.k, (abs(a.x - x_center), a.k)) filter (where x_center is not null)) end, arg_min(a.k, (-lip, a.k)) filter (where spoken and lip > 0.02e0), arg_min(a.k, (-a.w * a.h, a.k))) as k from ctx c join af a on a.job_id = c.job_id and a.t = c.t group by c.job_id, c.t)
    select af.job_id, af.t, round_even(af.x, 0)::int as x, af.y, af.w from pick join af on af.job_id = pick.job_id and af.t = pick.t and af.k = pick.k""",
)
def speaking_keyframes(spark, d):
    """Every third speaker event of three jobs in four, half of them of nobody; the registry doesn't know slot 2."""
    segs, _, faces, slots = _inputs(spark, d)
    known = tables.speaker_events(spark, d).filter("event_id % 3 = 0 and job_id % 4 > 0")
    events = known.select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), F.when(F.col("event_id") % 2 == 0, -1).otherwise(F.col("slot")).alias("slot"), F.col("event_id").alias("rank"))
    return K.speaking_keyframes(faces, events, segs, slots.filter("slot <> 2"))
