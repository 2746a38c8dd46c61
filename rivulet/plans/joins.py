"""Queries: interval, as-of, nearest, tolerance and lookup joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.operators import intervals as I
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

_OV = "greatest(0e0, least(t1, s1) - greatest(t0, s0))"


def _turns(spark, d):
    return tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), F.concat(F.lit("S"), "slot").alias("label"), "slot", "confidence")


TURNS = "turns as (select job_id, t0 as s0, t1 as s1, 'S' || slot as label, slot, confidence from spk)"


@register(
    "jn01_label_by_overlap",
    f"""with {duck.seg()}, {duck.SPK}, {TURNS}, best as (select job_id, seq, label from (select seg.job_id, seq, label, row_number() over (partition by seg.job_id, seq order by round({_OV}, 6) desc, s0, label desc) as r
    from seg join turns on seg.job_id = turns.job_id and t0 < s1 and t1 > s0) where r = 1) select job_id, seq, t0, t1, coalesce(label, 'Speaker 1') as label from seg left join best using (job_id, seq)""",
)
def label_by_overlap(spark, d):
    return I.label_by_overlap(tables.segments(spark, d), _turns(spark, d).select("job_id", "s0", "s1", "label")).select("job_id", "seq", "t0", "t1", "label")


def _coverage_sql(floor: str) -> str:
    return f"""with {duck.seg()}, {duck.SPK}, {TURNS}, sums as (select seg.job_id, seq, t0, t1, slot, round(sum({_OV}), 6) as sec from seg join turns on seg.job_id = turns.job_id and s0 < t1 and s1 > t0 where confidence >= {floor} group by all)
    select job_id, seq, slot, round(sec / greatest(t1 - t0, 1e-9), 4) as coverage from (select *, row_number() over (partition by job_id, seq order by sec desc, slot) as r from sums) where r = 1"""


@register("jn02_transcript_coverage", _coverage_sql("0.6e0"))
def transcript_coverage(spark, d):
    return I.slot_coverage(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), _turns(spark, d), 0.6)


@register("jn03_speaker_majority", _coverage_sql("0e0"))
def speaker_majority(spark, d):
    return I.slot_coverage(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), _turns(spark, d))


@register("jn05_active_slots", f"with {duck.seg()}, {duck.SPK} select seg.job_id, seq, count(distinct slot) as n_slots from seg join spk on seg.job_id = spk.job_id and spk.t0 >= seg.t0 and spk.t0 <= seg.t1 group by seg.job_id, seq")
def active_slots(spark, d):
    points = tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("t"), "slot")
    pairs = I.range_join(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), points, ["job_id"], (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")), (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t")))
    return pairs.groupBy("job_id", "seq").agg(F.countDistinct("slot").alias("n_slots"))


@register(
    "jn11_slot_mode",
    f"""with {duck.seg()}, {duck.SPK}, n as (select seg.job_id, seq, slot, count(*) as n from seg join spk on seg.job_id = spk.job_id and spk.t0 >= seg.t0 and spk.t0 <= seg.t1 group by all)
    select job_id, seq, slot from (select *, row_number() over (partition by job_id, seq order by n desc, slot) as r from n) where r = 1""",
)
def slot_mode(spark, d):
    points = tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("t"), "slot")
    pairs = I.range_join(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), points, ["job_id"], (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")), (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t")))
    counts = pairs.groupBy("job_id", "seq", "slot").count()
    return counts.groupBy("job_id", "seq").agg(F.max_by("slot", F.struct("count", -F.col("slot"))).alias("slot"))


@register(
    "jn04_speaker_overlap",
    f"""with {duck.SPK}, tot as (select job_id, slot, sum(t1 - t0) as sec from spk group by all), top as (select job_id, slot, row_number() over (partition by job_id order by round(sec, 6) desc, slot) as r from tot)
    select job_id, max(slot) filter (where r = 1) as first_slot, max(slot) filter (where r = 2) as second_slot, round(max(sec) filter (where r = 1), 3) as first_sec, round(max(sec) filter (where r = 2), 3) as second_sec from top join tot using (job_id, slot) where r <= 2 group by job_id""",
)
def speaker_overlap(spark, d):
    total = tables.speaker_events(spark, d).groupBy("job_id", "slot").agg(F.sum(F.col("t1") - F.col("t0")).alias("sec"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.round("sec", 6).desc(), "slot"))).filter("r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return top.groupBy("job_id").agg(pick("slot", 1).alias("first_slot"), pick("slot", 2).alias("second_slot"), F.round(pick("sec", 1), 3).alias("first_sec"), F.round(pick("sec", 2), 3).alias("second_sec"))


@register(
    "jn17_active_slot_at",
    f"""with {duck.seg()}, {duck.SPK} select s.job_id, s.seq, coalesce(
      (select slot from spk where spk.job_id = s.job_id and spk.t0 <= s.t0 and s.t0 <= spk.t1 order by spk.t0, event_id limit 1),
      (select slot from spk where spk.job_id = s.job_id and spk.t1 <= s.t0 order by spk.t1 desc, event_id desc limit 1),
      (select slot from spk where spk.job_id = s.job_id order by spk.t0, event_id limit 1), -1) as slot from seg s""",
)
def active_slot_at(spark, d):
    """The event that contains the time (the first of them), else the last that ended before, else the first, else -1."""
    segs = tables.segments(spark, d).select("job_id", "seq", "t0")
    ev = tables.speaker_events(spark, d).select("job_id", "event_id", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "slot")
    inside = I.range_join(segs, ev, ["job_id"], (F.col("s0") <= F.col("t0")) & (F.col("t0") <= F.col("s1")), (F.col("t0"), F.col("t0")), (F.col("s0"), F.col("s1")))
    inside = inside.groupBy("job_id", "seq").agg(F.min_by("slot", F.struct("s0", "event_id")).alias("a"))
    ended = I.asof_join(segs, ev.withColumnRenamed("slot", "b"), "job_id", "t0", "s1", ["b"], tie="event_id").select("job_id", "seq", "b")
    first = ev.groupBy("job_id").agg(F.min_by("slot", F.struct("s0", "event_id")).alias("c"))
    out = segs.join(inside, ["job_id", "seq"], "left").join(ended, ["job_id", "seq"], "left").join(first, "job_id", "left")
    return out.select("job_id", "seq", F.coalesce("a", "b", "c", F.lit(-1)).alias("slot"))


@register("ts66_step_lookup", f"with {duck.seg()}, {duck.SCENES}, sc as (select job_id, t, max_by(subject_x, event_id) as x from scenes group by all) select seg.job_id, seq, sc.t as s, x from seg asof left join sc on seg.job_id = sc.job_id and seg.t0 >= sc.t")
def step_lookup(spark, d):
    """The last known value at each segment's start."""
    sc = tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max_by("subject_x", "event_id").alias("x")).withColumnRenamed("t", "s")
    return I.asof_join(tables.segments(spark, d).select("job_id", "seq", "t0"), sc, "job_id", "t0", "s", ["x"]).select("job_id", "seq", "s", "x")


@register(
    "jn22_nearest_scene",
    f"""with {duck.seg()}, {duck.SCENES}, sc as (select job_id, t, max_by(subject_x, event_id) as x from scenes group by all), near as (select seg.job_id, seq, sc.t as s, x, row_number() over (partition by seg.job_id, seq order by abs(sc.t - seg.t0), sc.t) as r
    from seg join sc on seg.job_id = sc.job_id) select job_id, seq, s, x from near where r = 1 and abs(s - (select t0 from seg where seg.job_id = near.job_id and seg.seq = near.seq)) < 1""",
)
def nearest_scene(spark, d):
    """The nearest scene within a second, the earlier of equals."""
    sc = tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max_by("subject_x", "event_id").alias("x")).withColumnRenamed("t", "s")
    near = I.asof_join(tables.segments(spark, d).select("job_id", "seq", "t0"), sc, "job_id", "t0", "s", ["x"], direction="nearest")
    return near.filter(F.abs(F.col("s") - F.col("t0")) < 1).select("job_id", "seq", "s", "x")


@register("jn24_frames_without_scene", f"with {duck.seg()}, {duck.SCENES} select job_id, seq from seg where not exists (select 1 from scenes where scenes.job_id = seg.job_id and abs(scenes.t - seg.t0) < 0.5e0)")
def frames_without_scene(spark, d):
    sc = tables.scenes(spark, d).select("job_id", "t")
    return I.range_join(tables.segments(spark, d).select("job_id", "seq", "t0"), sc, ["job_id"], F.abs(F.col("t") - F.col("t0")) < 0.5, (F.col("t0") - 0.5, F.col("t0") + 0.5), (F.col("t"), F.col("t")), how="left_anti").select("job_id", "seq")


@register(
    "jn25_scene_transcript",
    f"""with {duck.seg()}, {duck.SCENES} select scenes.job_id, event_id, count(*) as n, count(distinct speaker) as speakers, min(seq) as first_seq from scenes join seg on scenes.job_id = seg.job_id and abs(seg.t0 - scenes.t) < 10 where importance >= 7 group by all""",
)
def scene_transcript(spark, d):
    """Important scenes with the segments that start within ten seconds."""
    sc = tables.scenes(spark, d).filter("importance >= 7").select("job_id", "event_id", "t")
    pairs = I.range_join(sc, tables.segments(spark, d).select("job_id", "seq", "speaker", "t0"), ["job_id"], F.abs(F.col("t0") - F.col("t")) < 10, (F.col("t") - 10, F.col("t") + 10), (F.col("t0"), F.col("t0")))
    return pairs.groupBy("job_id", "event_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker").alias("speakers"), F.min("seq").alias("first_seq"))


@register("jn30_words_by_midpoint", f"with {duck.seg()}, {duck.SPK} select seg.job_id, seq, count(*) as n, min(event_id) as first_event from seg join spk on seg.job_id = spk.job_id and (spk.t0 + spk.t1) / 2 >= seg.t0 and (spk.t0 + spk.t1) / 2 < seg.t1 group by all")
def words_by_midpoint(spark, d):
    mid = tables.speaker_events(spark, d).select("job_id", "event_id", ((F.col("t0") + F.col("t1")) / 2).alias("m"))
    pairs = I.range_join(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), mid, ["job_id"], (F.col("m") >= F.col("t0")) & (F.col("m") < F.col("t1")), (F.col("t0"), F.col("t1")), (F.col("m"), F.col("m")))
    return pairs.groupBy("job_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@register("jn31_speaker_positions", f"with {duck.seg()}, {duck.SCENES}, f as (select scenes.job_id, event_id, subject_x, speaker, row_number() over (partition by scenes.job_id, event_id order by seq) as r from scenes join seg on scenes.job_id = seg.job_id and t >= t0 - 0.5e0 and t <= t1 + 0.5e0) select job_id, speaker, round(avg(subject_x), 4) as x, count(*) as n from f where r = 1 group by all")
def speaker_positions(spark, d):
    """Mean subject position per speaker, each scene with the first segment that holds it."""
    pairs = I.range_join(tables.scenes(spark, d), tables.segments(spark, d).select("job_id", "seq", "speaker", "t0", "t1"), ["job_id"], (F.col("t") >= F.col("t0") - 0.5) & (F.col("t") <= F.col("t1") + 0.5), (F.col("t"), F.col("t")), (F.col("t0") - 0.5, F.col("t1") + 0.5))
    first = pairs.groupBy("job_id", "event_id").agg(F.min_by(F.struct("speaker", "subject_x"), "seq").alias("f"))
    return first.groupBy("job_id", F.col("f.speaker").alias("speaker")).agg(F.round(F.avg("f.subject_x"), 4).alias("x"), F.count(F.lit(1)).alias("n"))


@register("jn44_find_by_hash", "select a.doc_id, b.first_id from (select doc_id, sha256(text) as h from documents) a join (select sha256(text) as h, min(doc_id) as first_id from documents group by 1 having count(*) > 1) b using (h)")
def find_by_hash(spark, d):
    """Documents whose whole text another one has, with the first such id."""
    docs = tables.load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return docs.join(firsts, "h").select("doc_id", "first_id")


@register("st24_lines_outside_ranges", f"with {duck.seg()}, {duck.CUTS} select job_id, seq from seg where not exists (select 1 from cuts where cuts.job_id = seg.job_id and t < t1 and t + 2 > t0)")
def lines_outside_ranges(spark, d):
    off = tables.cuts(spark, d).select("job_id", "t")
    return I.range_join(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), off, ["job_id"], (F.col("t") < F.col("t1")) & (F.col("t") + 2 > F.col("t0")), (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t") + 2), how="left_anti").select("job_id", "seq")


@register("st25_lines_inside_ranges", f"with {duck.seg()}, {duck.CUTS} select job_id, seq from seg where exists (select 1 from cuts where cuts.job_id = seg.job_id and t < t1 and t + 2 > t0)")
def lines_inside_ranges(spark, d):
    on = tables.cuts(spark, d).select("job_id", "t")
    return I.range_join(tables.segments(spark, d).select("job_id", "seq", "t0", "t1"), on, ["job_id"], (F.col("t") < F.col("t1")) & (F.col("t") + 2 > F.col("t0")), (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t") + 2), how="left_semi").select("job_id", "seq")
