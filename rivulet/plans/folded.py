"""Queries: order-dependent folds. Where SQL can fold a list, it has a counterpart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import folds as D
from rivulet.operators import intervals as I
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

_SPAN = "job_id long, t0 double, t1 double, slot int, confidence double"


def _nms_sql(order: str, near: bool) -> str:
    shorter = "least(greatest(n.t0, n.t1) - least(n.t0, n.t1), k.b - k.a)"
    bad = f"({shorter} > 0 and least(greatest(n.t0, n.t1), k.b) - greatest(least(n.t0, n.t1), k.a) > 0.5e0 * {shorter})"
    if near:
        total = "(abs(n.t1 - n.t0) + (k.b - k.a))"
        bad += f" or (least(abs(least(n.t0, n.t1) - k.b), abs(k.a - greatest(n.t0, n.t1))) < 5 and {total} > 0 and greatest(greatest(n.t0, n.t1), k.b) - least(least(n.t0, n.t1), k.a) < 1.15e0 * {total})"
    gone = f"len(list_filter(f.kept, lambda k: {bad})) > 0"
    own = "{'a': least(n.t0, n.t1), 'b': greatest(n.t0, n.t1)}"
    start = {"kept": f"[{own}]", "stays": "true"}
    step = {"kept": f"case when {gone} then f.kept else list_append(f.kept, {own}) end", "stays": f"not ({gone})"}
    return f"with recursive {duck.CLIPS}, {duck.fold('clips', order, start, step)} select job_id, clip_id, least(t0, t1) as t0, greatest(t0, t1) as t1, score::bigint as score from f where stays"


_CLIP = "job_id long, clip_id int, t0 double, t1 double, score long"


@register("st01_interval_nms", _nms_sql("score desc, t0, t1, clip_id", True))
def interval_nms(spark, d):
    rows = tables.clips(spark, d).select("job_id", "clip_id", "t0", "t1", F.col("score").cast("long").alias("score"))
    return D.fold(rows, "job_id", [F.desc("score"), "t0", "t1", "clip_id"], D.nms, _CLIP)


@register("st02_interval_nms_plain", _nms_sql("score desc, clip_id, t0, t1", False))
def interval_nms_plain(spark, d):
    rows = tables.clips(spark, d).select("job_id", "clip_id", "t0", "t1", F.col("score").cast("long").alias("score"))
    return D.fold(rows, "job_id", [F.desc("score"), "clip_id", "t0", "t1"], lambda r: D.nms(r, near=0.0), _CLIP)


_ALIKE = "len(list_filter(f.kept, lambda k: len(k) + len(n.w) > 0 and len(list_intersect(k, n.w)) / len(list_distinct(list_concat(k, n.w)))::double > 0.75e0))"


@register(
    "st03_thematic_dedup",
    f"""with recursive titles as (select (p_size % 10)::bigint as job_id, p_partkey, p_name as title, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 2)) as w from part),
    {duck.fold("titles", "p_partkey", {"kept": "[n.w]", "stays": "true"}, {"kept": f"case when {_ALIKE} < 2 then list_append(f.kept, n.w) else f.kept end", "stays": f"{_ALIKE} < 2"})}
    select job_id, p_partkey, title from f where stays""",
)
def thematic_dedup(spark, d):
    rows = tables.load(spark, d, "part").select((F.col("p_size") % 10).cast("long").alias("job_id"), "p_partkey", F.col("p_name").alias("title"))
    return D.fold(rows, "job_id", ["p_partkey"], lambda r: D.thematic(r, 2), "job_id long, p_partkey long, title string")


_SAME, _TAKEN = "n.slot = f.s_slot", "(n.slot < 0 or n.confidence >= 0.7e0 or f.s_conf < 0.3e0)"


@register(
    "ts14_hysteresis",
    f"""with recursive {duck.SPK}, ev2 as (select job_id, event_id, t0, t1, case when event_id % 17 = 0 then -1 else slot end as slot, confidence::double as confidence from spk),
    {duck.fold("ev2", "t0, event_id", {"idx": "0", "s_t0": "n.t0", "s_slot": "n.slot", "s_conf": "n.confidence"}, {"idx": f"f.idx + (not {_SAME} and {_TAKEN})::int", "s_t0": f"case when not {_SAME} and {_TAKEN} then n.t0 else f.s_t0 end", "s_slot": f"case when not {_SAME} and {_TAKEN} then n.slot else f.s_slot end", "s_conf": f"case when {_SAME} then greatest(f.s_conf, n.confidence) when {_TAKEN} then n.confidence else f.s_conf * 0.95e0 end"})}
    select job_id, s_t0 as t0, t1, s_slot as slot, s_conf as confidence from {duck.last_of("idx")}""",
)
def hysteresis(spark, d):
    """Every 17th event is of nobody."""
    slot = F.when(F.col("event_id") % 17 == 0, -1).otherwise(F.col("slot")).alias("slot")
    rows = tables.speaker_events(spark, d).select("job_id", "event_id", "t0", "t1", slot, "confidence")
    return D.fold(rows, "job_id", ["t0", "event_id"], D.hysteresis, _SPAN)


_MERGES, _GAP = "(n.slot = f.s_slot and n.t0 - f.s_t1 < 3e0)", "n.t0 - f.s_t1"


@register(
    "ts10_transcript_timeline",
    f"""with recursive {duck.seg()}, turns as (select job_id, seq, t0, t1, case when speaker = 'user' then 0 else 1 end as slot from seg),
    {duck.fold("turns", "seq", {"idx": "0", "s_t0": "n.t0", "s_t1": "n.t1", "s_slot": "n.slot", "closing": "null::double"}, {"idx": f"f.idx + (not {_MERGES})::int", "s_t0": f"case when {_MERGES} then f.s_t0 when {_GAP} > 0 and {_GAP} < 1.5e0 then (n.t0 + f.s_t1) / 2e0 else n.t0 end", "s_t1": f"case when {_MERGES} then greatest(f.s_t1, n.t1) else n.t1 end", "s_slot": "n.slot", "closing": f"case when {_MERGES} then null when {_GAP} > 0 and {_GAP} < 1.5e0 then (n.t0 + f.s_t1) / 2e0 else f.s_t1 end"})},
    ends as (select job_id, idx - 1 as idx, closing from f where closing is not null)
    select l.job_id, s_t0 as t0, coalesce(ends.closing, s_t1) as t1, s_slot as slot from {duck.last_of("idx").replace(" where rn = last_rn", "")} l left join ends on ends.job_id = l.job_id and ends.idx = l.idx where rn = last_rn""",
)
def transcript_timeline(spark, d):
    rows = tables.segments(spark, d).select("job_id", "seq", "t0", "t1", F.when(F.col("speaker") == "user", 0).otherwise(1).alias("slot"))
    return D.fold(rows, "job_id", ["seq"], D.transcript_timeline, "job_id long, t0 double, t1 double, slot int")


def _signals(spark, d):
    return tables.speaker_events(spark, d).select("job_id", "event_id", F.floor("t0").cast("double").alias("t"), F.col("slot").alias("who"), "confidence").groupBy("job_id", "t", "who").agg(F.max("confidence").alias("value"))


_RAW = f"{duck.SPK}, sig as (select job_id, floor(t0) as t, slot as who, max(confidence)::double as value from spk group by all), grid as (select job_id, t, [coalesce(max(value) filter (who = 0), 0e0), coalesce(max(value) filter (who = 1), 0e0), coalesce(max(value) filter (who = 2), 0e0), coalesce(max(value) filter (who = 3), 0e0)] as raw from sig group by all)"
_KEPT = "list_transform({}, lambda x: case when x > 0.05e0 then x else 0e0 end)"
_SMOOTH = (
    _KEPT.format("list_transform(n.raw, lambda x: 0.4e0 * x)"),
    _KEPT.format("list_transform(list_zip(n.raw, f.v), lambda z: 0.4e0 * z[1] + 0.6e0 * z[2])"),
)


@register("ts15_smooth_intents", f"with recursive {_RAW}, {duck.fold('grid', 't', {'v': _SMOOTH[0]}, {'v': _SMOOTH[1]})}, u as (select job_id, t, unnest([0, 1, 2, 3]) as who, unnest(v) as value from f) select job_id, t, who, round(value, 6) as value from u where value > 0")
def smooth_intents(spark, d):
    def step(rows):
        job, rest = D.first_of(rows)
        return ({"job_id": job["job_id"], **x, "value": round(x["value"], 6)} for x in D.smoothed_intents(rest))

    return D.fold(_signals(spark, d), "job_id", ["t", "who"], step, "job_id long, t double, who int, value double")


_LEADS = "case when list_max(new_v) > 0 then list_position(new_v, list_max(new_v))::int - 1 end"
_CHANGE = "(new_lead is not null and new_lead is distinct from f.chosen and new_v[new_lead + 1] >= 0.35e0 and (f.chosen is null or new_v[new_lead + 1] - new_v[f.chosen + 1] >= 0.15e0))"


@register(
    "ts16_switches",
    f"""with recursive {_RAW}, {duck.fold("grid", "t", {"v": _SMOOTH[0], "lead": "case when list_max(v) > 0 then list_position(v, list_max(v))::int - 1 end", "chosen": "case when lead is not null and v[lead + 1] >= 0.35e0 then lead end", "changed": "lead is not null and v[lead + 1] >= 0.35e0"}, {"v": _SMOOTH[1], "lead": _LEADS, "chosen": f"case when {_CHANGE} then new_lead else f.chosen end", "changed": f"coalesce({_CHANGE}, false)"})}
    select job_id, t, chosen as who, round(v[chosen + 1], 6) as confidence from f where changed""",
)
def switches(spark, d):
    def step(rows):
        job, rest = D.first_of(rows)
        return ({"job_id": job["job_id"], **x} for x in D.ema_switches(rest))

    return D.fold(_signals(spark, d), "job_id", ["t", "who"], step, "job_id long, t double, who int, confidence double")


@register(
    "ts15_ema",
    f"""with {duck.EV}, l as (select job_id, list(value order by t, event_id) as v from ev group by 1), e as (select job_id, list_reduce(list_transform(v, lambda x: [x]), lambda a, x: list_append(a, 0.4e0 * x[1] + 0.6e0 * a[-1])) as s from l)
    select job_id, len(s)::int as n, round(s[-1], 6) as last_value from e""",
)
def ema(spark, d):
    """The smoothed series' last value: a fold of an ordered array with a number as state."""
    rows = tables.timed_events(spark, d).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))).alias("v"))
    first = F.get("v", F.lit(0))["value"]
    last = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), first, lambda a, x: 0.4 * x["value"] + 0.6 * a)
    return rows.select("job_id", F.size("v").alias("n"), F.round(last, 6).alias("last_value"))


@register("st09_pause_speakers", f"with {duck.seg()}, p as (select job_id, seq, coalesce(t0 - lag(t1) over (partition by job_id order by seq) > 1.2e0, false)::int as n from seg) select job_id, seq, 'Speaker ' || (sum(n) over (partition by job_id order by seq) % 2 + 1)::int as speaker from p")
def pause_speakers(spark, d):
    """Two speakers told by pauses; the fold is a running count of pauses."""
    w = Window.partitionBy("job_id").orderBy("seq")
    paused = F.coalesce(F.col("t0") - F.lag("t1").over(w) > 1.2, F.lit(False)).cast("int")
    rows = tables.segments(spark, d).withColumn("n", paused).withColumn("k", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("job_id", "seq", F.concat(F.lit("Speaker "), (F.col("k") % 2 + 1).cast("string")).alias("speaker"))


@register("st09_assign_speakers")
def assign_speakers(spark, d):
    """Speakers told by pauses, speech rates and what spoke before."""
    rows = tables.segments(spark, d).select("job_id", "seq", "t0", "t1", "n_words")
    return D.fold(rows, "job_id", ["seq"], D.assigned_speakers, "job_id long, seq long, speaker string")


def _points(spark, d):
    return tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max("subject_x").cast("int").alias("x"))


_POINTS = f"{duck.SCENES}, points as (select job_id, t, max(subject_x)::int as x from scenes group by all)"
_POINT = "job_id long, t double, x int"


@register(
    "ts41_rate_limited",
    f"""with recursive {_POINTS}, {duck.fold("points", "t", {"s": "n.x"}, {"s": "case when n.t - f.t <= 0 then f.s when abs(n.x - f.s) > 2e0 * (n.t - f.t) then greatest(0, least(100, trunc(f.s + case when n.x > f.s then 2e0 * (n.t - f.t) else -2e0 * (n.t - f.t) end)::int)) else n.x end"})}
    select job_id, t, s as x from f""",
)
def rate_limited(spark, d):
    return D.fold(_points(spark, d), "job_id", ["t"], lambda r: D.rate_limited(r, 2.0), _POINT)


@register(
    "ts46_dead_zone",
    f"""with recursive {_POINTS}, {duck.fold("points", "t", {"s": "n.x", "on_": "false"}, {"s": "case when case when f.on_ then abs(n.x - f.s) > 8 else abs(n.x - f.s) >= 20 end then n.x else f.s end", "on_": "case when f.on_ then abs(n.x - f.s) > 8 else abs(n.x - f.s) >= 20 end"})}
    select job_id, t, s as x from f""",
)
def dead_zone(spark, d):
    """A threshold of 20; following ends at steps of two fifths of it."""
    return D.fold(_points(spark, d), "job_id", ["t"], lambda r: D.dead_zone(r, 20, 8), _POINT)


@register("ts47_merged_holds", f"with recursive {_POINTS}, {duck.fold('points', 't', {'s': 'n.x'}, {'s': 'case when abs(n.x - f.s) <= 3 then f.s else n.x end'})} select job_id, t, s as x from f")
def merged_holds(spark, d):
    return D.fold(_points(spark, d), "job_id", ["t"], D.merged_holds, _POINT)


_ISLANDS = "select {key}, min(t0) as t0, max(t1) as t1, min(slot) as slot from (select *, sum(c) over (partition by job_id order by t0) as g from (select *, (slot is distinct from lag(slot) over (partition by job_id order by t0))::int as c from {rows})) group by job_id, g"


def smoothed_sql(votes: str) -> str:
    """CTEs from ``votes`` (job_id, event_id, t, slot), given by ``votes``, to the stretches: a select ends them."""
    return f"""{votes}, flips as (select job_id, event_id, t, slot, (slot is distinct from lag(slot) over (partition by job_id order by t, event_id))::int as c from votes),
    numbered as (select *, sum(c) over (partition by job_id order by t, event_id) as g from flips),
    starts as (select job_id, g, min(t) as t0, max(t) as t_last, min(slot) as slot from numbered group by all),
    runs as (select job_id, slot, t0, coalesce(lead(t0) over (partition by job_id order by g), t_last + 0.5e0) as t1 from starts),
    {duck.fold("runs", "t0, t1", {"idx": "0", "s_t0": "n.t0", "s_slot": "n.slot"}, {"idx": "f.idx + (n.t1 - n.t0 >= 2e0)::int", "s_t0": "case when n.t1 - n.t0 >= 2e0 then n.t0 else f.s_t0 end", "s_slot": "case when n.t1 - n.t0 >= 2e0 then n.slot else f.s_slot end"})},
    forward as (select job_id, s_t0 as t0, t1, s_slot as slot from {duck.last_of("idx")}),
    merged as ({_ISLANDS.format(key="job_id", rows="forward")}),
    m as (select *, row_number() over (partition by job_id order by t0 desc) as rn from merged),
    b as (select job_id, rn, t0, t1 as b_t1, slot as b_slot, 0 as idx from m where rn = 1 union all
      select m.job_id, m.rn, m.t0, case when m.t1 - m.t0 >= 2e0 then m.t1 else b.b_t1 end, case when m.t1 - m.t0 >= 2e0 then m.slot else b.b_slot end, b.idx + (m.t1 - m.t0 >= 2e0)::int from b join m on m.job_id = b.job_id and m.rn = b.rn + 1),
    backward as (select job_id, min(t0) as t0, any_value(b_t1) as t1, any_value(b_slot) as slot from b group by job_id, idx)"""


@register("ts26_smoothed_votes", f"with recursive {duck.SPK}, {smoothed_sql('votes as (select job_id, event_id, t0 as t, slot from spk)')} {_ISLANDS.format(key='job_id', rows='backward')}")
def smoothed_votes(spark, d):
    rows = tables.speaker_events(spark, d).select("job_id", "event_id", F.col("t0").alias("t"), "slot")
    return D.fold(rows, "job_id", ["t", "event_id"], D.smoothed_votes, "job_id long, t0 double, t1 double, slot int")


@register(
    "ts53_contiguous",
    f"""with {duck.seg()}, g as (select job_id, seq, t0, t1, t0 - lag(t1) over w as gap, lag(t1) over w as before, lead(t0) over w - t1 as after, lead(t0) over w as next from seg window w as (partition by job_id order by seq))
    select job_id, seq, case when gap < 0 or (gap > 0 and gap < 0.05e0) then before else t0 end as t0, case when after >= 0.05e0 then next else t1 end as t1 from g""",
)
def contiguous(spark, d):
    """Each row looks at its neighbours' own times only, so the fold is a window."""
    w = Window.partitionBy("job_id").orderBy("seq")
    rows = tables.segments(spark, d).select("job_id", "seq", "t0", "t1", F.lag("t1").over(w).alias("before"), F.lead("t0").over(w).alias("next"))
    gap = F.col("t0") - F.col("before")
    start = F.when((gap < 0) | ((gap > 0) & (gap < 0.05)), F.col("before")).otherwise(F.col("t0"))
    return rows.select("job_id", "seq", start.alias("t0"), F.when(F.col("next") - F.col("t1") >= 0.05, F.col("next")).otherwise(F.col("t1")).alias("t1"))


_RECENT = "list_append(list_filter(f.recent, lambda s: n.s - s <= 86400e0), n.s)"


@register(
    "rt05_breaker",
    f"""with recursive bad as (select user_id as job_id, event_id, epoch_us(ts) / 1e6 as s from events where event_type = 'error'),
    {duck.fold("bad", "s, event_id", {"recent": "[n.s]", "until": "null::double"}, {"recent": _RECENT, "until": f"case when len({_RECENT}) >= 3 then n.s + 3600e0 else f.until end"})}
    select job_id, event_id, s, len(recent)::int as n, until from f""",
)
def breaker(spark, d):
    rows = tables.load(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("job_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return D.fold(rows, "job_id", ["s", "event_id"], lambda r: D.breaker(r, 3, 86_400.0, 3600.0), "job_id long, event_id long, s double, n int, until double")


_TAKES = "not list_contains(f.used_a, n.a) and not list_contains(f.used_b, n.b)"


@register(
    "jn45_greedy_match",
    f"""with recursive {duck.SPK}, {duck.seg()}, pairs as (select seg.job_id, seq as a, event_id as b from seg join spk on seg.job_id = spk.job_id and abs(seg.t0 - spk.t0) < 3),
    {duck.fold("pairs", "a, b", {"used_a": "[n.a]", "used_b": "[n.b]", "taken": "true"}, {"used_a": f"case when {_TAKES} then list_append(f.used_a, n.a) else f.used_a end", "used_b": f"case when {_TAKES} then list_append(f.used_b, n.b) else f.used_b end", "taken": _TAKES})}
    select job_id, a, b from f where taken""",
)
def greedy_match(spark, d):
    """Speaker intervals against segments: starts within three seconds, one to one, in order."""
    segs = tables.segments(spark, d).select("job_id", F.col("seq").alias("a"), "t0")
    ev = tables.speaker_events(spark, d).select("job_id", F.col("event_id").alias("b"), F.col("t0").alias("s0"))
    pairs = I.range_join(segs, ev, ["job_id"], F.abs(F.col("t0") - F.col("s0")) < 3, (F.col("t0") - 3, F.col("t0") + 3), (F.col("s0"), F.col("s0")))
    return D.fold(pairs.select("job_id", "a", "b"), "job_id", ["a", "b"], D.greedy_match, "job_id long, a long, b long")


@register(
    "jn45_subtitle_sync",
    f"""with recursive {duck.seg()}, item as (select job_id, seq as a, t0 + (seq * 37 % 9 - 4) * 0.1e0 as s0, t1 + (seq * 53 % 7 - 3) * 0.1e0 as s1, case when seq % 5 = 0 then text || '.' else text end as subtitle, case when seq % 7 = 0 then 'other' when seq % 11 = 0 then null else speaker end as said from seg where seq % 13 <> 0),
    pairs as (select item.job_id, a, seq as b from item join seg on item.job_id = seg.job_id and abs(t0 - s0) < 0.3e0 and abs(t1 - s1) < 0.3e0),
    {duck.fold("pairs", "a, b", {"used_a": "[n.a]", "used_b": "[n.b]", "taken": "true"}, {"used_a": f"case when {_TAKES} then list_append(f.used_a, n.a) else f.used_a end", "used_b": f"case when {_TAKES} then list_append(f.used_b, n.b) else f.used_b end", "taken": _TAKES})},
    m as (select f.job_id, a, b from f where taken),
    full_ as (select coalesce(item.job_id, seg.job_id) as job_id, item.a, seg.seq as b, subtitle, said, text, speaker from item left join m using (job_id, a) full join seg on seg.job_id = m.job_id and seg.seq = m.b)
    select job_id, count_if(a is not null and b is not null) as matched, count_if(a is not null and b is not null and text is distinct from subtitle) as text_mismatches,
      count_if(a is not null and b is not null and speaker <> said and speaker <> '' and said <> '') as speaker_mismatches, count_if(b is null) as unmatched_timeline, count_if(a is null) as unmatched_transcript, count(a) as total_timeline, count(b) as total_transcript
    from full_ group by job_id""",
)
def subtitle_sync(spark, d):
    """Subtitle items (the segments, shifted and changed by rule) against the segments: each item takes the first free
    segment whose start and end lie within .3 s; counts of what matches, differs and is left on either side."""
    segs = tables.segments(spark, d).select("job_id", "seq", "text", "speaker", "t0", "t1")
    shift = lambda factor, n, middle: (F.col("seq") * factor % n - middle) * 0.1
    items = segs.filter("seq % 13 <> 0").select(
        "job_id",
        F.col("seq").alias("a"),
        (F.col("t0") + shift(37, 9, 4)).alias("s0"),
        (F.col("t1") + shift(53, 7, 3)).alias("s1"),
        F.when(F.col("seq") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("subtitle"),
        F.when(F.col("seq") % 7 == 0, F.lit("other")).when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.col("speaker")).alias("said"),
    )
    return I.subtitle_sync(items, segs)


@register(
    "st10_position_clusters",
    f"with {duck.SCENES}, v as (select distinct job_id, subject_x as x from scenes), g as (select *, coalesce(x - lag(x) over (partition by job_id order by x) > 3, false)::int as n from v), c as (select *, sum(n) over (partition by job_id order by x) as c from g) select job_id, c::int as cluster, count(*) as n, min(x) as lo, max(x) as hi from c group by all",
)
def position_clusters(spark, d):
    """Clusters of positions on a line, parted by gaps over three."""
    w = Window.partitionBy("job_id").orderBy("x")
    v = tables.scenes(spark, d).select("job_id", F.col("subject_x").alias("x")).distinct()
    v = v.withColumn("n", F.coalesce(F.col("x") - F.lag("x").over(w) > 3, F.lit(False)).cast("int")).withColumn("c", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return v.groupBy("job_id", F.col("c").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
