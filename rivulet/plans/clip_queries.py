"""Queries: clip candidates against the transcript."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import clip_scores as K
from rivulet.operators import scoring as S
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

SEG = duck.seg(0.4)
CLIP = "clip as (select job_id, clip_id, c0, c1 from (select l_orderkey % 100 as job_id, l_orderkey * 10 + l_linenumber as clip_id, (l_partkey * 13 % 120)::double as c0, (l_partkey * 13 % 120 + l_quantity)::double as c1, row_number() over (partition by l_orderkey * 10 + l_linenumber order by l_partkey, l_suppkey, l_quantity) as r from lineitem) where r = 1)"


def candidates(spark, d):
    line = tables.load(spark, d, "lineitem")
    start = F.col("l_partkey") * 13 % 120
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = line.groupBy(key.alias("clip_id"), (F.col("l_orderkey") % 100).alias("job_id")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m"))
    start = F.col("m.l_partkey") * 13 % 120
    return first.select("job_id", "clip_id", start.cast("double").alias("c0"), (start + F.col("m.l_quantity")).cast("double").alias("c1"))


def _list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_BOLD = " or ".join(f"contains(lower(text), '{b.replace(chr(39), chr(39) * 2)}')" for b in K.BOLD)
HOOK = rf"""op as (select clip.job_id, clip_id, c0, min(t0) as first_t0, arg_min(speaker, seq) as first_speaker, string_agg(text, ' ' order by seq) as text from clip join seg on seg.job_id = clip.job_id and t0 < c0 + 3 and t1 > c0 group by all),
pv as (select clip.job_id, clip_id, arg_max(speaker, (t1, seq)) as before_speaker from clip join seg on seg.job_id = clip.job_id and t1 > c0 - 2 and t1 <= c0 + 0.5e0 group by all),
hw as (select op.*, before_speaker, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from op left join pv using (job_id, clip_id)),
hook as (select clip.job_id, clip.clip_id, (case when text is null then 15 else least(100, greatest(0, 50 - case when first_t0 - hw.c0 > 0.5e0 then 25 else 0 end - case when w[1] in ({_list(K.WEAK_OPENERS)}) then 20 else 0 end
  - case when w[1] in ({_list(K.PRONOUNS)}) and w[2] in ({_list(K.LINKING)}) then 15 else 0 end + case when contains(array_to_string(w[1:6], ' '), '?') then 25 else 0 end + case when w[1] in ({_list(K.REACTION_OPENERS)}) then 20 else 0 end
  + case when coalesce(before_speaker <> first_speaker, false) then 15 else 0 end + case when contains(text, '!') then 10 else 0 end + case when {_BOLD} then 15 else 0 end)) end)::int as hook
  from clip left join hw using (job_id, clip_id))"""


@register("ag13_hook_score", f"with {SEG}, {CLIP}, {HOOK} select * from hook")
def hook_score(spark, d):
    return K.hook_score(candidates(spark, d), tables.segments(spark, d))


_SNAP = """a as (select job_id, clip_id, t0 as s0 from (select clip.job_id, clip_id, t0, row_number() over (partition by clip.job_id, clip_id order by round(abs(t0 - c0), 6), t0) as r from clip join seg on seg.job_id = clip.job_id and abs(t0 - c0) <= 3 and t0 <= c0 + 0.5e0) where r = 1),
b as (select job_id, clip_id, t1 as s1 from (select clip.job_id, clip_id, t1, row_number() over (partition by clip.job_id, clip_id order by round(abs(t1 - c1), 6), t1) as r from clip join seg on seg.job_id = clip.job_id and abs(t1 - c1) <= 3 and t1 >= c1 - 0.5e0) where r = 1)"""


@register("jn28_snapped_clips", f"with {SEG}, {CLIP}, {_SNAP} select job_id, clip_id, case when coalesce(s1, c1) > coalesce(s0, c0) then coalesce(s0, c0) else c0 end as c0, case when coalesce(s1, c1) > coalesce(s0, c0) then coalesce(s1, c1) else c1 end as c1 from clip left join a using (job_id, clip_id) left join b using (job_id, clip_id)")
def snapped_clips(spark, d):
    return K.snapped(candidates(spark, d), tables.segments(spark, d))


@register(
    "ag09_emotional_arc",
    f"""with {SEG}, {CLIP}, e as (select clip.job_id, clip_id, list(least(1e0, case when contains(text, '!') then 0.4e0 else 0e0 end + case when contains(text, '?') then 0.3e0 else 0e0 end + n_words / 100e0) order by seq) as e from clip join seg on seg.job_id = clip.job_id and t0 >= c0 and t1 <= c1 group by all),
    f as (select *, round(list_avg(e[len(e) // 2 + 1:]) - list_avg(e[:len(e) // 2]), 9) as d from e) select job_id, clip_id, case when len(e) < 2 then 0.5e0 when d > 0.1e0 then 0.8e0 when abs(d) < 0.05e0 then 0.4e0 else 0.6e0 end as arc from f""",
)
def emotional_arc(spark, d):
    return K.emotional_arc(candidates(spark, d), tables.segments(spark, d))


@register("ag10_comprehension", f"with {SEG}, {CLIP} select clip.job_id, clip_id, count(distinct speaker) as speakers, count(*) as n, regexp_matches(lower(arg_min(text, seq)), '^(and|but|so|because|this|that|it)\\b') as dangling from clip join seg on seg.job_id = clip.job_id and t0 < c1 and t1 > c0 group by all")
def comprehension(spark, d):
    pairs = K.range_join(candidates(spark, d), tables.segments(spark, d), ["job_id"], (F.col("t0") < F.col("c1")) & (F.col("t1") > F.col("c0")), (F.col("c0"), F.col("c1")), (F.col("t0"), F.col("t1")))
    return pairs.groupBy("job_id", "clip_id").agg(F.countDistinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("n"), F.lower(F.min_by("text", "seq")).rlike(r"^(and|but|so|because|this|that|it)\b").alias("dangling"))


_CURVE = """case when p <= 0.05e0 then 100e0 when p <= 0.15e0 then 100 - d1 * (p - 0.05e0) / 0.1e0 when p <= 0.8e0 then 100 - d1 - d2 * (p - 0.15e0) / 0.65e0 else 100 - d1 - d2 + l * (p - 0.8e0) / 0.2e0 end"""


@register(
    "ag11_retention_curve",
    f"""with s as (select o_orderkey, (o_custkey % 11) / 10e0 as h, (o_custkey % 7) / 6e0 as c, (o_custkey % 5) / 4e0 as v, (o_custkey % 9) / 8e0 as a from orders),
    d as (select *, (1 - h) * 25 as d1, (1 - (c + v) / 2) * 20 as d2, case when a > 0.6e0 then (a - 0.6e0) * 10 else -(1 - a) * 10 end as l, unnest(range(0, 20)) as i from s), p as (select *, i / 19e0 as p from d)
    select o_orderkey, i::int as i, round(least(100e0, greatest(20e0, {_CURVE})), 4) as y from p""",
)
def retention_curve(spark, d):
    part = lambda n: F.col("o_custkey") % n / F.lit(float(n - 1))
    rows = tables.load(spark, d, "orders").select("o_orderkey", part(11).alias("hook"), part(7).alias("pacing"), part(5).alias("visual"), part(9).alias("arc"))
    return K.retention_curve(rows).select("o_orderkey", "i", "y")


_PARTS = "l_partkey % 11 / 10e0 as hook, case when l_suppkey % 13 > 0 then l_partkey % 7 / 6e0 end as pacing, l_suppkey % 5 / 4e0 as visual, l_partkey % 9 / 8e0 as arc, case when l_partkey % 17 > 0 then l_linenumber % 4 / 3e0 end as standalone"


@register(
    "ag12_clip_retention",
    f"""with f as (select l_orderkey as job_id, l_linenumber as clip_id, {_PARTS} from lineitem), t as (select *, hook is not null and pacing is not null and visual is not null and arc is not null and standalone is not null as told from f),
    s as (select job_id, clip_id, told, case when told then round_even(round((0.25e0 * hook + 0.15e0 * pacing + 0.15e0 * visual + 0.25e0 * arc + 0.2e0 * standalone) * 100, 9), 0)::int else 50 end as overall, case when told then round_even(round(hook * 100, 9), 0)::int end as hook, case when told then round_even(round(arc * 100, 9), 0)::int end as arc from t)
    select job_id, clip_id, overall, hook, arc, rank() over (partition by job_id order by overall desc, clip_id)::int as rank from s""",
)
def clip_retention(spark, d):
    """Parts of every clip by rule; of some one couldn't be told."""
    part = lambda c, n: F.col(c) % n / F.lit(float(n - 1))
    pacing, standalone = F.when(F.col("l_suppkey") % 13 > 0, part("l_partkey", 7)), F.when(F.col("l_partkey") % 17 > 0, part("l_linenumber", 4))
    rows = tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("clip_id"), part("l_partkey", 11).alias("hook"), pacing.alias("pacing"), part("l_suppkey", 5).alias("visual"), part("l_partkey", 9).alias("arc"), standalone.alias("standalone"))
    return K.predicted_retention(rows).select("job_id", "clip_id", "overall", "hook", "arc", "rank")


@register(
    "sm06_adjusted_scores",
    f"""with {SEG}, {CLIP}, {HOOK}, s as (select job_id, clip_id, 1 + clip_id * 7 % 100 as score, hook, 40 + clip_id % 30 as ret from hook),
    a as (select *, least(100, greatest(1, score + trunc((hook - 50) * 0.2e0)::int)) as x from s) select job_id, clip_id, least(100, greatest(1, x + trunc((ret - 50) * 0.15e0)::int))::int as score from a""",
)
def adjusted_scores(spark, d):
    rows = K.hook_score(candidates(spark, d), tables.segments(spark, d))
    score, ret = 1 + F.col("clip_id") * 7 % 100, 40 + F.col("clip_id") % 30
    return rows.select("job_id", "clip_id", K.adjusted(score, F.col("hook"), ret).cast("int").alias("score"))


@register("sm05_detection_windows", f"with {SEG}, e as (select job_id, max(t1) as duration from seg group by 1), n as (select *, greatest(1, ceil((duration - 30) / 90))::int as n from e), k as (select *, unnest(range(0, n)) as k from n) select job_id, k::int as k, k * 90e0 as w0, least(k * 90e0 + 120, duration) as w1 from k")
def detection_windows(spark, d):
    return K.detection_windows(S.durations(tables.segments(spark, d)), 120.0, 30.0, 1000)


@register("st04_chunk_midpoints", f"with {SEG}, c as (select job_id, seq // 3 as chunk, min(t0) as a, max(t1) as b from seg group by all) select job_id, chunk, round((lead(a) over w + b) / 2, 6) as cut from c window w as (partition by job_id order by chunk)")
def chunk_midpoints(spark, d):
    """Where neighbouring chunks of a transcript are cut: between the end of one and the start of the next."""
    c = tables.segments(spark, d).groupBy("job_id", F.floor(F.col("seq") / 3).alias("chunk")).agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    w = F.lead("a").over(S.Window.partitionBy("job_id").orderBy("chunk"))
    return c.select("job_id", "chunk", F.round((w + F.col("b")) / 2, 6).alias("cut"))


@register("st05_chunks", f"with {SEG}, e as (select job_id, max(t1) as duration from seg group by 1) select job_id, s::int as n, s * 50e0 as t0, least(s * 50e0 + 60, duration) as t1 from (select job_id, duration, unnest(range(0, ceil(duration / 50)::bigint)) as s from e)")
def chunks(spark, d):
    e = S.durations(tables.segments(spark, d)).withColumn("n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / 50).cast("int") - 1)))
    return e.select("job_id", "n", (F.col("n") * 50.0).alias("t0"), F.least(F.col("n") * 50.0 + 60, F.col("duration")).alias("t1"))


@register(
    "sm07_speaker_buckets",
    f"with {SEG}, r as (select *, (coalesce(lag(speaker) over (partition by job_id order by seq) <> speaker, true))::int as n from seg), g as (select *, sum(n) over (partition by job_id order by seq) as g from r) select job_id, floor(min(t0) / 60)::bigint as bucket, speaker, min(t0) as t0, max(t1) as t1, sum(length(text)) as chars from g group by job_id, g, speaker",
)
def speaker_buckets(spark, d):
    """Runs of one speaker with their minute, for a text budget per minute."""
    w = S.Window.partitionBy("job_id").orderBy("seq")
    rows = tables.segments(spark, d).withColumn("n", F.coalesce(F.lag("speaker").over(w) != F.col("speaker"), F.lit(True)).cast("int"))
    rows = rows.withColumn("g", F.sum("n").over(w.rowsBetween(S.Window.unboundedPreceding, 0)))
    return rows.groupBy("job_id", "g", "speaker").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum(F.length("text")).alias("chars")).select("job_id", F.floor(F.col("t0") / 60).alias("bucket"), "speaker", "t0", "t1", "chars")
