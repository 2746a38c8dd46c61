"""Queries: point changes on arrays of segments, layout arithmetic, rule ladders, map look-ups and small formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import intervals as I
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

SEG = duck.seg()


def _doc(spark, d):
    """One row per job: its segments as an ordered array, as a job document holds them."""
    return tables.segments(spark, d).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "speaker", "t0", "t1"))).alias("segs"))


def _rows(doc):
    return doc.select("job_id", F.posexplode("segs").alias("pos", "s")).select("job_id", "pos", F.col("s.seq").alias("seq"), F.col("s.speaker").alias("speaker"), F.col("s.t0").alias("t0"))


_POS = f"with {SEG}, p as (select job_id, (row_number() over (partition by job_id order by seq) - 1)::int as pos, seq, speaker, t0 from seg)"


@register("pf11_bulk_update", f"{_POS} select job_id, pos, seq, case when pos in (0, 2, 99) then 'Host' else speaker end as speaker, t0 from p")
def bulk_update(spark, d):
    """Positions 0, 2 and 99 get another speaker; positions out of range are ignored."""
    return _rows(_doc(spark, d)).withColumn("speaker", F.when(F.col("pos").isin(0, 2, 99), "Host").otherwise(F.col("speaker")))


@register("pf12_update_position", f"{_POS} select job_id, pos, seq, case when pos = 1 then 'Edited' else speaker end as speaker, t0 from p")
def update_position(spark, d):
    changed = F.transform("segs", lambda s, i: F.when(i == 1, s.withField("speaker", F.lit("Edited"))).otherwise(s))
    return _rows(_doc(spark, d).withColumn("segs", changed))


@register("pf13_delete_position", f"{_POS} select job_id, (case when pos > 1 then pos - 1 else pos end)::int as pos, seq, speaker, t0 from p where pos <> 1")
def delete_position(spark, d):
    return _rows(_doc(spark, d).withColumn("segs", F.filter("segs", lambda s, i: i != 1)))


@register("pf14_ordered_insert", f"{_POS}, n as (select job_id, count_if(t0 <= 20) as n_at from p group by 1) select job_id, (case when pos >= n_at then pos + 1 else pos end)::int as pos, seq, speaker, t0 from p join n using (job_id) union all select job_id, n_at::int, -1, 'New', 20e0 from n")
def ordered_insert(spark, d):
    """A segment at 20 s goes after all that start at or before it."""
    new = F.struct(F.lit(-1).cast("long").alias("seq"), F.lit("New").alias("speaker"), F.lit(20.0).alias("t0"), F.lit(21.0).alias("t1"))
    at = F.size(F.filter("segs", lambda s: s["t0"] <= 20)) + 1
    return _rows(_doc(spark, d).withColumn("segs", F.array_insert("segs", at, new)))


@register("pf25_overlap_search", f"with {SEG} select job_id, seq from seg where t0 < 60 and t1 > 30 and (contains(lower(text), 'the') or contains(lower(speaker), 'the'))")
def overlap_search(spark, d):
    rows = tables.segments(spark, d).filter("t0 < 60 and t1 > 30")
    return rows.filter(F.lower("text").contains("the") | F.lower("speaker").contains("the")).select("job_id", "seq")


@register("pf23_log_sort", "select o_orderkey, coalesce(nullif(o_custkey % 7, 0), o_orderkey % 5, 0) as k from orders where contains(lower(o_orderpriority), 'low')")
def log_sort(spark, d):
    rows = tables.load(spark, d, "orders").filter(F.lower("o_orderpriority").contains("low"))
    return rows.select("o_orderkey", F.coalesce(F.nullif(F.col("o_custkey") % 7, F.lit(0)), F.col("o_orderkey") % 5, F.lit(0)).alias("k"))


@register("jn23_fill_from_rounded_time", f"with {SEG}, {duck.SCENES}, s as (select job_id, round(t, 1) as r, min(subject_x) as x from scenes group by all) select seg.job_id, seq, coalesce(x, 50e0) as x from seg left join s on s.job_id = seg.job_id and s.r = round(t0, 1)")
def fill_from_rounded_time(spark, d):
    s = tables.scenes(spark, d).groupBy("job_id", F.round("t", 1).alias("r")).agg(F.min("subject_x").alias("x"))
    return tables.segments(spark, d).withColumn("r", F.round("t0", 1)).join(s, ["job_id", "r"], "left").select("job_id", "seq", F.coalesce("x", F.lit(50.0)).alias("x"))


@register("jn21_nearest_frame", f"with {SEG}, {duck.SCENES}, n as (select seg.job_id, seq, event_id, row_number() over (partition by seg.job_id, seq order by round(abs(t - (t0 + t1) / 2), 6), t, event_id) as r from seg join scenes on scenes.job_id = seg.job_id) select job_id, seq, event_id from n where r = 1")
def nearest_frame(spark, d):
    """The frame nearest to each segment's middle; frames of one time stand by their least id."""
    frames = tables.scenes(spark, d).groupBy("job_id", F.col("t").alias("s")).agg(F.min("event_id").alias("event_id"))
    rows = tables.segments(spark, d).withColumn("m", (F.col("t0") + F.col("t1")) / 2)
    return I.asof_join(rows, frames, "job_id", "m", "s", ["event_id"], "nearest", digits=6).filter("event_id is not null").select("job_id", "seq", "event_id")


@register("jn13_covered_share", f"with {SEG}, {duck.SPK}, o as (select seg.job_id, seq, t0 as a, t1 as b, least(seg.t1, s1) - greatest(seg.t0, s0) as sec from seg join (select job_id, t0 as s0, t1 as s1, slot from spk) k on k.job_id = seg.job_id and s0 < t1 and s1 > t0 and slot < 2) select job_id, seq, round(sum(sec) / (b - a), 4) as share, sum(sec) / (b - a) >= 0.3e0 as enough from o where b > a group by job_id, seq, a, b")
def covered_share(spark, d):
    ev = tables.speaker_events(spark, d).filter("slot < 2").select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    pairs = I.range_join(tables.segments(spark, d).filter("t1 > t0").select("job_id", "seq", "t0", "t1"), ev, ["job_id"], (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0")), (F.col("t0"), F.col("t1")), (F.col("s0"), F.col("s1")))
    share = F.sum(I.overlap(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1"))) / (F.col("t1") - F.col("t0"))
    return pairs.groupBy("job_id", "seq", "t0", "t1").agg(F.round(share, 4).alias("share"), (share >= 0.3).alias("enough")).select("job_id", "seq", "share", "enough")


@register("jn39_hard_bounds", f"with {duck.SCENES}, f as (select job_id, floor(t / 5)::bigint as w, min(subject_x - 8) as l, max(subject_x + 8) as r from scenes where importance >= 8 group by all) select job_id, w, r - l > 56.25e0 as infeasible, case when r - l <= 56.25e0 then greatest(28.125e0, r - 28.125e0) end as lo, case when r - l <= 56.25e0 then least(71.875e0, l + 28.125e0) end as hi from f")
def hard_bounds(spark, d):
    """The range of crop centres that keeps all hard boxes of a window in; none where they span more than the crop."""
    f = tables.scenes(spark, d).filter("importance >= 8").groupBy("job_id", F.floor(F.col("t") / 5).alias("w")).agg(F.min(F.col("subject_x") - 8).alias("l"), F.max(F.col("subject_x") + 8).alias("r"))
    fits = F.col("r") - F.col("l") <= 56.25
    return f.select("job_id", "w", (~fits).alias("infeasible"), F.when(fits, F.greatest(F.lit(28.125), F.col("r") - 28.125)).alias("lo"), F.when(fits, F.least(F.lit(71.875), F.col("l") + 28.125)).alias("hi"))


@register("ag20_gaze_votes", f"with {duck.SCENES}, v as (select job_id, count_if(subject_x < 35) as l, count_if(subject_x > 65) as r, count_if(subject_x between 35 and 65) as c from scenes group by 1) select job_id, case when l >= r and l >= c then 'left' when r >= c then 'right' else 'center' end as gaze from v")
def gaze_votes(spark, d):
    x = F.col("subject_x")
    v = tables.scenes(spark, d).groupBy("job_id").agg(F.count_if(x < 35).alias("l"), F.count_if(x > 65).alias("r"), F.count_if(x.between(35, 65)).alias("c"))
    return v.select("job_id", F.when((F.col("l") >= F.col("r")) & (F.col("l") >= F.col("c")), "left").when(F.col("r") >= F.col("c"), "right").otherwise("center").alias("gaze"))


@register("ag18_corner_share", f"with {duck.SCENES} select job_id, round(avg((subject_x < 20 or subject_x > 80)::int), 6) as share from scenes group by 1")
def corner_share(spark, d):
    return tables.scenes(spark, d).groupBy("job_id").agg(F.round(F.avg(((F.col("subject_x") < 20) | (F.col("subject_x") > 80)).cast("int")), 6).alias("share"))


@register("ag23_default_mode", f"with {duck.SPK}, s as (select job_id, slot, round(sum(t1 - t0), 6) as sec from spk group by all) select job_id, slot from (select *, row_number() over (partition by job_id order by sec desc, slot) as r from s) where r = 1")
def default_mode(spark, d):
    s = tables.speaker_events(spark, d).groupBy("job_id", "slot").agg(F.round(F.sum(F.col("t1") - F.col("t0")), 6).alias("sec"))
    return s.groupBy("job_id").agg(F.max_by("slot", F.struct("sec", -F.col("slot"))).alias("slot"))


@register(
    "ag26_intent",
    f"with {duck.SPK}, e as (select job_id, floor(t0)::bigint as sec, slot, confidence * 0.6e0 as v from spk union all select job_id, floor(t0)::bigint, event_id % 4, 0.2e0 from spk where event_id % 3 = 0) select job_id, sec, slot::int as slot, round(least(1e0, sum(v)), 6) as intent from e group by all",
)
def intent(spark, d):
    """Weighted contributions of signals per second and subject, summed and cut at 1."""
    ev = tables.speaker_events(spark, d).withColumn("sec", F.floor("t0"))
    a = ev.select("job_id", "sec", "slot", (F.col("confidence") * 0.6).alias("v"))
    b = ev.filter("event_id % 3 = 0").select("job_id", "sec", (F.col("event_id") % 4).cast("int").alias("slot"), F.lit(0.2).alias("v"))
    return a.unionByName(b).groupBy("job_id", "sec", "slot").agg(F.round(F.least(F.lit(1.0), F.sum("v")), 6).alias("intent"))


@register("ts29_switch_intervals", f"with {duck.SPK}, c as (select *, lag(slot) over (partition by job_id order by t0, event_id) as p from spk), s as (select job_id, t0, slot, event_id from c where p is null or p <> slot), e as (select job_id, max(t1) as last from spk group by 1) select s.job_id, t0, coalesce(lead(t0) over (partition by s.job_id order by t0, event_id), last) as t1, slot from s join e on e.job_id = s.job_id")
def switch_intervals(spark, d):
    w = Window.partitionBy("job_id").orderBy("t0", "event_id")
    ev = tables.speaker_events(spark, d)
    s = ev.withColumn("p", F.lag("slot").over(w)).filter("p is null or p <> slot")
    return s.join(ev.groupBy("job_id").agg(F.max("t1").alias("last")), "job_id").select("job_id", "t0", F.coalesce(F.lead("t0").over(w), F.col("last")).alias("t1"), "slot")


@register("ts45_snap_transitions", f"with {duck.SCENES}, k as (select job_id, t, max(subject_x) as x from scenes group by all), p as (select *, lag(x) over w as px, lag(t) over w as pt from k window w as (partition by job_id order by t)) select job_id, t, x from p union all select job_id, round((t + pt) / 2 - 0.05e0, 6), px from p where abs(x - px) >= 15 and t - pt > 0.6e0 union all select job_id, round((t + pt) / 2 + 0.05e0, 6), x from p where abs(x - px) >= 15 and t - pt > 0.6e0")
def snap_transitions(spark, d):
    """At a jump after more than .6 s, a pair of rows around the middle."""
    w = Window.partitionBy("job_id").orderBy("t")
    p = tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max("subject_x").alias("x")).withColumns({"px": F.lag("x").over(w), "pt": F.lag("t").over(w)})
    jump = (F.abs(F.col("x") - F.col("px")) >= 15) & (F.col("t") - F.col("pt") > 0.6)
    middle = (F.col("t") + F.col("pt")) / 2
    own = F.struct("t", "x")
    pair = [F.struct(F.round(middle - 0.05, 6).alias("t"), F.col("px").alias("x")), F.struct(F.round(middle + 0.05, 6).alias("t"), F.col("x").alias("x"))]
    return p.select("job_id", F.explode(F.when(jump, F.array(*pair, own)).otherwise(F.array(own))).alias("k")).select("job_id", F.col("k.t").alias("t"), F.col("k.x").alias("x"))


@register("ts35_anticipated_starts", f"with {duck.CUTS}, s as (select job_id, t, event_id from ev where event_type = 'click'), c as (select s.job_id, event_id, s.t, max(cuts.t) as cut from s left join cuts on cuts.job_id = s.job_id and cuts.t <= s.t group by all) select job_id, event_id, round(greatest(coalesce(cut, 0), t - 0.4e0), 3) as t0 from c")
def anticipated_starts(spark, d):
    """Starts moved .4 s earlier, but not over the last cut."""
    s = tables.timed_events(spark, d).filter("event_type = 'click'").select("job_id", "event_id", "t")
    c = tables.cuts(spark, d).withColumnRenamed("t", "cut").withColumn("one", F.lit(1))
    near = I.asof_join(s, c, "job_id", "t", "cut", ["one"])
    return near.select("job_id", "event_id", F.round(F.greatest(F.coalesce("cut", F.lit(0.0)), F.col("t") - 0.4), 3).alias("t0"))


@register("ts70_first_fit", f"with {SEG}, g as (select job_id, t1 as a, lead(t0) over (partition by job_id order by seq) as b from seg) select job_id, round(min(a), 3) as t0 from g where b is null or b - a >= 1.5e0 group by 1")
def first_fit(spark, d):
    """The first place on a job's track that holds 1.5 s more."""
    nxt = F.lead("t0").over(Window.partitionBy("job_id").orderBy("seq"))
    return tables.segments(spark, d).withColumn("b", nxt).filter("b is null or b - t1 >= 1.5").groupBy("job_id").agg(F.round(F.min("t1"), 3).alias("t0"))


@register("st20_snap_to_clusters", f"with {duck.SCENES} select event_id, case when abs(subject_x - 20) <= abs(subject_x - 50) then 20 when abs(subject_x - 50) < abs(subject_x - 85) then 50 else 85 end as x from scenes")
def snap_to_clusters(spark, d):
    """The nearest of three centres; of equally near ones that of more points."""
    centres = [(20, 30), (50, 10), (85, 20)]
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("subject_x") - c).alias("d"), F.lit(-n).alias("n"), F.lit(c).alias("c")) for c, n in centres]))
    return tables.scenes(spark, d).select("event_id", best["c"].alias("x"))


@register("st21_promoted_regions", f"with {duck.SCENES}, g as (select *, floor(t)::bigint as sec, max((importance >= 9)::int) over (partition by job_id, floor(t)) as any_hard, row_number() over (partition by job_id, floor(t) order by importance desc, event_id) as r from scenes) select job_id, event_id, importance >= 9 or (any_hard = 0 and r = 1) as required from g")
def promoted_regions(spark, d):
    """Required regions; in a second without any the most important becomes one."""
    w = Window.partitionBy("job_id", F.floor("t"))
    rows = tables.scenes(spark, d).withColumns({"hard": F.max((F.col("importance") >= 9).cast("int")).over(w), "r": F.row_number().over(w.orderBy(F.desc("importance"), "event_id"))})
    return rows.select("job_id", "event_id", ((F.col("importance") >= 9) | ((F.col("hard") == 0) & (F.col("r") == 1))).alias("required"))


@register("sf03_language_share", "select doc_id, case when length(regexp_replace(text, '[^äöüß]', '', 'g')) > 0.02e0 * length(text) then 'de' when length(regexp_replace(text, '[^ñóí]', '', 'g')) > 0.02e0 * length(text) then 'es' when length(regexp_replace(text, '[^éèêç]', '', 'g')) > 0.02e0 * length(text) then 'fr' else 'en' end as lang_guess from documents")
def language_share(spark, d):
    n = lambda c: F.length(F.regexp_replace("text", f"[^{c}]", "")) > 0.02 * F.length("text")
    return tables.load(spark, d, "documents").select("doc_id", F.when(n("äöüß"), "de").when(n("ñóí"), "es").when(n("éèêç"), "fr").otherwise("en").alias("lang_guess"))


@register("sf06_batch_size", "select o_orderkey, case when o_custkey % 200 > 100 then 25 when o_custkey % 200 > 40 then 15 else 10 end as size from orders")
def batch_size(spark, d):
    n = F.col("o_custkey") % 200
    return tables.load(spark, d, "orders").select("o_orderkey", F.when(n > 100, 25).when(n > 40, 15).otherwise(10).alias("size"))


@register("sf12_style_names", "select p_partkey, translate(p_name, ' ,#', '___') as style from part")
def style_names(spark, d):
    return tables.load(spark, d, "part").select("p_partkey", F.translate("p_name", " ,#", "___").alias("style"))


@register("sf18_safe_range", "select p_partkey, round(50 * c / r, 4) as lo, round(100 - 50 * c / r, 4) as hi from (select p_partkey, 9e0 / 16 as c, 1 + (p_size % 20) / 10e0 as r from part)")
def safe_range(spark, d):
    """Centres (percent of the width) of a 9:16 crop that stay inside a frame of each ratio."""
    half = 50 * (9.0 / 16) / (1 + F.col("p_size") % 20 / 10.0)
    return tables.load(spark, d, "part").select("p_partkey", F.round(half, 4).alias("lo"), F.round(100 - half, 4).alias("hi"))


@register("sf20_crop_offset", f"with {duck.SCENES} select event_id, greatest(0, least(1312, floor(subject_x / 100 * 1920 - 304)))::int as x from scenes")
def crop_offset(spark, d):
    x = F.floor(F.col("subject_x") / 100 * 1920 - 304)
    return tables.scenes(spark, d).select("event_id", F.greatest(F.lit(0), F.least(F.lit(1312), x)).cast("int").alias("x"))


@register("sf22_zoom_factor", f"with {duck.SPK} select event_id, round(greatest(1e0, least(1.6e0, 18 / greatest(1e0, confidence * 40))), 4) as zoom from spk")
def zoom_factor(spark, d):
    z = 18 / F.greatest(F.lit(1.0), F.col("confidence") * 40)
    return tables.speaker_events(spark, d).select("event_id", F.round(F.greatest(F.lit(1.0), F.least(F.lit(1.6), z)), 4).alias("zoom"))


@register("sf26_lead_room", f"with {duck.SCENES} select event_id, least(100e0, greatest(0e0, subject_x + case when subject_x < 35 then -4 when subject_x > 65 then 4 else 0 end)) as x from scenes")
def lead_room(spark, d):
    x = F.col("subject_x")
    return tables.scenes(spark, d).select("event_id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), x + F.when(x < 35, -4).when(x > 65, 4).otherwise(0))).alias("x"))


@register("sf29_face_stability", f"with {duck.SCENES} select job_id, round(greatest(0e0, 1 - stddev_pop(subject_x) / 30), 6) as stability from scenes group by 1")
def face_stability(spark, d):
    return tables.scenes(spark, d).groupBy("job_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.stddev_pop("subject_x") / 30), 6).alias("stability"))


@register("sf38_timeouts", "select o_orderkey, greatest(60e0, 30 + length(o_orderpriority) * 2.5e0 + (o_custkey % 50) * 1.5e0) as seconds from orders")
def timeouts(spark, d):
    return tables.load(spark, d, "orders").select("o_orderkey", F.greatest(F.lit(60.0), 30 + F.length("o_orderpriority") * 2.5 + (F.col("o_custkey") % 50) * 1.5).alias("seconds"))


@register("sf40_first_pattern", "select p_partkey, case when contains(lower(p_type), 'steel') then 3 when contains(lower(p_type), 'tin') then 2 when contains(lower(p_type), 'e') then 1 else 0 end as speed from part")
def first_pattern(spark, d):
    """The first of some ordered patterns that a name contains."""
    low = F.lower("p_type")
    return tables.load(spark, d, "part").select("p_partkey", F.when(low.contains("steel"), 3).when(low.contains("tin"), 2).when(low.contains("e"), 1).otherwise(0).alias("speed"))


@register("sf47_upserted_settings", "with old as (select r_name as k, 'old' as v from region), new as (select n_name as k, 'new' as v from nation where n_nationkey < 5 union all select 'ASIA', 'new') select * from old anti join new using (k) union all select * from new")
def upserted_settings(spark, d):
    old = tables.load(spark, d, "region").select(F.col("r_name").alias("k"), F.lit("old").alias("v"))
    new = tables.load(spark, d, "nation").filter("n_nationkey < 5").select(F.col("n_name").alias("k"), F.lit("new").alias("v"))
    new = new.unionByName(spark.createDataFrame([("ASIA", "new")], "k string, v string"))
    return old.join(new, "k", "left_anti").unionByName(new)


@register("sf51_lerp", f"with {duck.SCENES}, n as (select *, lead(t) over w as t2, lead(subject_x) over w as x2 from scenes window w as (partition by job_id order by t, event_id)) select job_id, event_id, round(case when t2 > t then subject_x + (x2 - subject_x) * 0.25e0 else subject_x end, 6) as x from n")
def lerp(spark, d):
    w = Window.partitionBy("job_id").orderBy("t", "event_id")
    rows = tables.scenes(spark, d).withColumns({"t2": F.lead("t").over(w), "x2": F.lead("subject_x").over(w)})
    return rows.select("job_id", "event_id", F.round(F.when(F.col("t2") > F.col("t"), F.col("subject_x") + (F.col("x2") - F.col("subject_x")) * 0.25).otherwise(F.col("subject_x")), 6).alias("x"))


@register("sk11_zone_lines", f"with {duck.SPK} select job_id, string_agg(printf('%d: slot %d', event_id, slot), chr(10) order by event_id) as lines from spk where confidence >= 0.9e0 group by 1")
def zone_lines(spark, d):
    rows = tables.speaker_events(spark, d).filter("confidence >= 0.9").select("job_id", "event_id", F.format_string("%d: slot %d", "event_id", "slot").alias("line"))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda s: s["line"]), "\n").alias("lines"))


@register("rt07_rate_limit", "with c as (select event_id, user_id, epoch_us(ts) / 1e6 as s from events), n as (select event_id, user_id, count(*) over (partition by user_id order by s range between 3600 preceding and current row) as calls, s - lag(s) over (partition by user_id order by s, event_id) as gap from c) select event_id, user_id, calls, calls > 2 or coalesce(gap < 180, false) as held from n")
def rate_limit(spark, d):
    """Calls in the sliding range before each, and whether the limit or the minimum spacing holds it back."""
    c = tables.load(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    calls = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0))
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    return c.select("event_id", "user_id", calls.alias("calls"), ((calls > 2) | F.coalesce(gap < 180, F.lit(False))).alias("held"))


@register("rt09_expired", "with l as (select user_id, max(ts) as last from events group by 1) select user_id from l where last < (select max(ts) from events) - interval 6 hour")
def expired(spark, d):
    """Sessions without a row in the last six hours of the data."""
    e = tables.load(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = last.agg(F.max("last").alias("end"))
    return last.crossJoin(F.broadcast(end)).filter(F.col("last") < F.col("end") - F.expr("interval 6 hours")).select("user_id")  # the end is one row
