"""Queries: listing, filters, facets, point changes, simple aggregates and formats of jobs and clips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators import ranking as R
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

J, C = duck.JOBS, duck.CLIPS


@register("sc01_list_jobs", f"with {J} select job_id, status, created_at, cost from jobs")
def list_jobs(spark, d):
    return tables.jobs(spark, d).select("job_id", "status", "created_at", "cost").orderBy(F.desc("created_at"), "job_id")


@register("sc02_load_job", f"with {J} select * from jobs where job_id = 7")
def load_job(spark, d):
    return tables.jobs(spark, d).filter("job_id = 7")


@register("pf01_job_summaries", f"with {J}, {C} select job_id, status, count(clip_id) as n_clips from jobs left join clips using (job_id) group by all")
def job_summaries(spark, d):
    n = tables.clips(spark, d).groupBy("job_id").agg(F.count("clip_id").alias("n_clips"))
    return tables.jobs(spark, d).select("job_id", "status").join(n, "job_id", "left").fillna(0, ["n_clips"])


@register("pf02_page_of_jobs", f"with {J} select job_id, created_at, (select count(*) from jobs where status = 'O') as total from jobs where status = 'O' order by created_at, job_id limit 20 offset 40")
def page_of_jobs(spark, d):
    rows = tables.jobs(spark, d).filter("status = 'O'").select("job_id", "created_at")
    return R.page(rows, ["created_at", "job_id"], 40, 20)


@register("pf03_page_of_videos", f"with {J} select job_id, created_at, (select count(*) from jobs) as total from jobs order by created_at desc, job_id limit 10 offset 5")
def page_of_videos(spark, d):
    return R.page(tables.jobs(spark, d).select("job_id", "created_at"), [F.desc("created_at"), F.col("job_id")], 5, 10)


@register("pf04_filter_clips", f"with {C} select job_id, clip_id, score, t1 - t0 as duration from clips where score >= 60 and t1 - t0 >= 10 and t1 - t0 <= 40")
def filter_clips(spark, d):
    rows = tables.clips(spark, d).withColumn("duration", F.col("t1") - F.col("t0"))
    return R.between(rows, {"score": 60, "duration": 10}, {"duration": 40}).select("job_id", "clip_id", "score", "duration")


@register("pf05_get_clip", f"with {C} select * from clips where job_id = 3 and clip_id = 2")
def get_clip(spark, d):
    return tables.clips(spark, d).filter("job_id = 3 and clip_id = 2")


@register("pf06_tracking_debug", f"with {duck.SCENES} select count(*) as n, count_if(importance = 1) as sentinels, min(subject_x) as lo, max(subject_x) as hi, count(distinct subject_x) as n_x from scenes")
def tracking_debug(spark, d):
    return tables.scenes(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("importance") == 1).alias("sentinels"), F.min("subject_x").alias("lo"), F.max("subject_x").alias("hi"), F.countDistinct("subject_x").alias("n_x"))


@register("pf07_allocation", f"with {J}, {C} select job_id, 'job' as kind, status as what from jobs where status not in ('F', 'P') union all select job_id, 'export', platform from clips where platform = 'R' and score > 95")
def allocation(spark, d):
    a = tables.jobs(spark, d).filter(~F.col("status").isin("F", "P")).select("job_id", F.lit("job").alias("kind"), F.col("status").alias("what"))
    b = tables.clips(spark, d).filter("platform = 'R' and score > 95").select("job_id", F.lit("export").alias("kind"), F.col("platform").alias("what"))
    return a.unionByName(b)


@register("pf09_renumbered_clips", f"with {C} select job_id, clip_id, (select max(clip_id) from clips c where c.job_id = clips.job_id) + row_number() over (partition by job_id order by clip_id) as new_id from clips where t1 - t0 between 10 and 30 and score between 20 and 80")
def renumbered_clips(spark, d):
    every = tables.clips(spark, d)
    top = every.groupBy("job_id").agg(F.max("clip_id").alias("m"))
    kept = every.filter((F.col("t1") - F.col("t0")).between(10, 30) & F.col("score").between(20, 80))
    return kept.join(top, "job_id").select("job_id", "clip_id", (F.col("m") + F.row_number().over(Window.partitionBy("job_id").orderBy("clip_id"))).cast("long").alias("new_id"))


@register("pf10_rename_speakers", f"with {duck.seg()} select job_id, seq, case speaker when 'user' then 'Guest' else speaker end as speaker from seg")
def rename_speakers(spark, d):
    names = F.create_map(F.lit("user"), F.lit("Guest"))
    return tables.segments(spark, d).select("job_id", "seq", F.coalesce(F.try_element_at(names, F.col("speaker")), F.col("speaker")).alias("speaker"))


@register("pf15_clamped_importance", f"with {duck.SCENES} select event_id, least(10, greatest(1, importance * 2 - 4)) as importance, least(100, greatest(0, subject_x * 1.5e0 - 20)) as subject_x from scenes")
def clamped_importance(spark, d):
    i, x = F.col("importance") * 2 - 4, F.col("subject_x") * 1.5 - 20
    return tables.scenes(spark, d).select("event_id", F.least(F.lit(10), F.greatest(F.lit(1), i)).cast("long").alias("importance"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)).alias("subject_x"))


@register("pf18_delete_clips", f"with {C}, gone as (select job_id, clip_id from clips where score < 10) select job_id, count(*) as n from clips anti join gone using (job_id, clip_id) group by job_id")
def delete_clips(spark, d):
    every = tables.clips(spark, d)
    return every.join(every.filter("score < 10").select("job_id", "clip_id"), ["job_id", "clip_id"], "left_anti").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@register("pf19_patched_times", f"with {C} select job_id, clip_id, t0 + 1.25e0 as t0, round(t1 - (t0 + 1.25e0), 2) as duration from clips where clip_id = 1")
def patched_times(spark, d):
    return tables.clips(spark, d).filter("clip_id = 1").withColumn("t0", F.col("t0") + 1.25).select("job_id", "clip_id", "t0", F.round(F.col("t1") - F.col("t0"), 2).alias("duration"))


@register("pf20_search_jobs", f"with {J} select job_id, provider, cost from jobs where contains(lower(provider), 'urgent') or contains(lower(status), 'urgent')")
def search_jobs(spark, d):
    return R.search(tables.jobs(spark, d), ["provider", "status"], "Urgent").select("job_id", "provider", "cost")


@register("pf21_facets", f"with {J} select provider as value, count(*) as n from jobs where provider is not null and provider <> '' group by 1")
def provider_facets(spark, d):
    return R.facets(tables.jobs(spark, d), "provider")


@register("pf22_dashboard", f"with {J} select case when status in ('F', 'P') then 'done' else 'processing' end as state, count(*) as n, round(sum(cost), 2) as cost from jobs group by 1")
def dashboard(spark, d):
    state = F.when(F.col("status").isin("F", "P"), "done").otherwise("processing")
    return tables.jobs(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 2).alias("cost"))


@register("pf27_confidence_floor", f"with {duck.SPK} select event_id, case when slot <> 3 and confidence < 0.5e0 then 'padded' else 'slot' || slot end as strategy, case when slot <> 3 and confidence < 0.5e0 then 'confidence ' || confidence || ' below 0.5' else '' end as reason from spk where confidence in (0.05, 0.5, 0.75)")
def confidence_floor(spark, d):
    low = (F.col("slot") != 3) & (F.col("confidence") < 0.5)
    rows = tables.speaker_events(spark, d).filter(F.col("confidence").isin(0.05, 0.5, 0.75))
    return rows.select("event_id", F.when(low, "padded").otherwise(F.concat(F.lit("slot"), "slot")).alias("strategy"), F.when(low, F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit(" below 0.5"))).otherwise("").alias("reason"))


@register("sm01_top_clips", f"with {C} select job_id, clip_id, score from clips order by score desc, job_id, clip_id limit 25")
def top_clips(spark, d):
    return tables.clips(spark, d).select("job_id", "clip_id", "score").orderBy(F.desc("score"), "job_id", "clip_id").limit(25)


@register("sm04_every_nth", f"with {duck.SCENES}, r as (select job_id, event_id, t, row_number() over (partition by job_id order by t, event_id) - 1 as r, count(*) over (partition by job_id) as n from scenes) select job_id, event_id, t from r where r % 5 = 0 or r = n - 1")
def every_nth(spark, d):
    return R.every_nth(tables.scenes(spark, d), "job_id", ["t", "event_id"], 5).select("job_id", "event_id", "t")


@register(
    "sm03_smart_cap",
    f"""with {duck.EV}, f as (select distinct job_id, t from ev), a as (select *, row_number() over w as r, count(*) over (partition by job_id) as n, t - lag(t) over w as gap from f window w as (partition by job_id order by t)),
    b as (select *, coalesce(r = 1 or r = n or gap < 0.7e0 * 6, false) as prio from a), c as (select *, sum(prio::int) over (partition by job_id) as p, row_number() over (partition by job_id, prio order by t) - 1 as i from b),
    s as (select *, greatest(0, 40 - p) as rest, n - p as others from c), fills as (select distinct job_id, floor(j * (others / rest))::bigint as i from (select distinct job_id, rest, others, unnest(range(0, rest::bigint)) as j from s where rest > 0 and others > rest)),
    k as (select s.job_id, t, prio from s left join fills on fills.job_id = s.job_id and fills.i = s.i and not prio where n <= 40 or prio or (rest > 0 and others <= rest) or fills.i is not null)
    select job_id, t, prio from (select *, row_number() over (partition by job_id order by t) as o from k) where o <= 40""",
)
def smart_cap(spark, d):
    return R.smart_cap(tables.timed_events(spark, d).select("job_id", "t").distinct(), 6.0, 40)


@register("sm02_top_per_job", f"with {C} select job_id, clip_id, score, rank from (select *, row_number() over (partition by job_id order by score desc, clip_id)::int as rank from clips) where rank <= 2")
def top_per_job(spark, d):
    return R.top_per_key(tables.clips(spark, d), "job_id", [F.desc("score"), F.col("clip_id")], 2).select("job_id", "clip_id", "score", "rank")


@register("ag27_estimated_cost", f"with {J} select provider, round(sum(cost / 1000 * case provider when '1-URGENT' then 0.03e0 when '2-HIGH' then 0.02e0 else 0.001e0 end), 6) as cost from jobs group by 1")
def estimated_cost(spark, d):
    spark_rates = spark.createDataFrame([("1-URGENT", 0.03), ("2-HIGH", 0.02)], "provider string, rate double")
    rows = tables.jobs(spark, d).groupBy("provider").agg(F.sum("cost").alias("tokens")).join(F.broadcast(spark_rates), "provider", "left")
    return rows.select("provider", F.round(F.col("tokens") / 1000 * F.coalesce("rate", F.lit(0.001)), 6).alias("cost"))


@register("ag28_total_cost", f"with {J} select round(sum(cost), 2) as total, count(*) as n from jobs")
def total_cost(spark, d):
    return tables.jobs(spark, d).agg(F.round(F.sum("cost"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@register(
    "ag31_qa_checks",
    f"""with {C}, n as (select *, lead(t0) over (partition by job_id order by t0, t1, clip_id) as nxt from clips)
    select 'negative_length' as check_name, count_if(t1 <= t0) as failed from n union all select 'score_range', count_if(score < 1 or score > 100) from n
    union all select 'adjacent_overlap', count_if(nxt is not null and (t1 - nxt) / (t1 - t0) > 0.5e0) from n union all select 'short', count_if(t1 - t0 < 5) from n""",
)
def qa_checks(spark, d):
    rows = tables.clips(spark, d).withColumn("nxt", F.lead("t0").over(Window.partitionBy("job_id").orderBy("t0", "t1", "clip_id")))
    length = F.col("t1") - F.col("t0")
    checks = {"negative_length": length <= 0, "score_range": (F.col("score") < 1) | (F.col("score") > 100), "adjacent_overlap": F.col("nxt").isNotNull() & ((F.col("t1") - F.col("nxt")) / length > 0.5), "short": length < 5}
    one = rows.agg(*[F.count_if(v).alias(k) for k, v in checks.items()])
    return one.unpivot([], list(checks), "check_name", "failed")


@register("ag35_max_end", f"with {C} select job_id, coalesce(max(t1), 0) as end_s from clips group by 1")
def max_end(spark, d):
    return tables.clips(spark, d).groupBy("job_id").agg(F.coalesce(F.max("t1"), F.lit(0.0)).alias("end_s"))


@register("ag36_slot_shares", f"with {duck.SPK}, s as (select job_id, slot, sum(t1 - t0) as sec from spk group by all) select job_id, slot, round(sec, 3) as sec, round(100 * sec / sum(sec) over (partition by job_id), 3) as pct from s")
def slot_shares(spark, d):
    s = tables.speaker_events(spark, d).groupBy("job_id", "slot").agg(F.sum(F.col("t1") - F.col("t0")).alias("sec"))
    return s.select("job_id", "slot", F.round("sec", 3).alias("sec"), F.round(100 * F.col("sec") / F.sum("sec").over(Window.partitionBy("job_id")), 3).alias("pct"))


@register("ag37_histogram", f"with {duck.SCENES} select importance, count(*) as n from scenes group by 1")
def histogram(spark, d):
    return tables.scenes(spark, d).groupBy("importance").agg(F.count(F.lit(1)).alias("n"))


@register("ag33_speaking_rate", f"with {duck.seg()} select speaker, round(sum(n_words) / sum(t1 - t0), 6) as wps from seg where n_words > 0 and t1 > t0 group by 1")
def speaking_rate(spark, d):
    rows = tables.segments(spark, d).filter("n_words > 0 and t1 > t0")
    return rows.groupBy("speaker").agg(F.round(F.sum("n_words") / F.sum(F.col("t1") - F.col("t0")), 6).alias("wps"))


@register("sk19_cost_csv", f"""with {J} select job_id, job_id || ',"' || replace(provider, '"', '""') || '",' || status as line from jobs""")
def cost_csv(spark, d):
    return tables.jobs(spark, d).select("job_id", F.concat(F.col("job_id").cast("string"), F.lit(',"'), F.replace("provider", F.lit('"'), F.lit('""')), F.lit('",'), F.col("status")).alias("line"))


@register("sf41_duration_tier", f"with {C} select job_id, clip_id, case when t1 <= 15 * 60 / 10e0 then 'short' when t1 <= 3600 / 10e0 then 'medium' when t1 <= 10800 / 10e0 then 'long' else 'epic' end as tier from clips")
def duration_tier(spark, d):
    return tables.clips(spark, d).select("job_id", "clip_id", X.duration_tier(F.col("t1") * 10).alias("tier"))


@register("rt10_last_status", "select o_custkey as job_id, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as status, count(*) as n from orders group by 1")
def last_status(spark, d):
    o = tables.load(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("job_id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.count(F.lit(1)).alias("n"))
