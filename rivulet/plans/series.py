"""Queries: grids, windows, islands, gaps, pacing, boundaries, repairs and invariants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators import intervals as I
from rivulet.operators import scoring as S
from rivulet.operators import series as T
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

_TURN = "tu as (select job_id, floor(t0)::bigint as sec, count(*) as turns from (select *, lag(slot) over (partition by job_id order by t0, event_id) as p from spk) where p is not null and p <> slot group by all)"
_CUT = "cu as (select job_id, floor(t)::bigint as sec, count(*) as cuts from cuts group by all)"
_MOTION = """mean as (select job_id, floor(t)::bigint as sec, avg(subject_x) as x from scenes group by all), mov as (select *, round(abs(x - lag(x) over (partition by job_id order by sec)), 6) as dx from mean),
top as (select job_id, quantile_cont(dx, 0.95) as p from mov where dx > 0 group by 1), mo as (select mov.job_id, sec, coalesce(least(1e0, dx / p), 0) as motion from mov left join top using (job_id))"""
_CUTS_ONLY = duck.CUTS.split(", cuts as ", 1)[1]
_SPK_ONLY = duck.SPK.split(", spk as ", 1)[1]
_SCENES_ONLY = duck.SCENES.split(", scenes as ", 1)[1]
ALL = f"{duck.EV}, scenes as {_SCENES_ONLY}, spk as {_SPK_ONLY}, cuts as {_CUTS_ONLY}"


def _ends(spark, d):
    return tables.timed_events(spark, d).groupBy("job_id").agg(F.max("t").alias("duration"))


@register("ts05_boundaries", f"with {duck.seg()}, b as (select *, coalesce(lag(speaker) over w <> speaker, false) as changed, coalesce(t0 - lag(t1) over w > 1.5e0, false) as paused from seg window w as (partition by job_id order by seq)) select job_id, seq, t0, changed, paused from b where changed or paused")
def boundaries(spark, d):
    return T.boundaries(tables.segments(spark, d))


@register("ts13_islands", f"with {duck.SPK}, a as (select *, (coalesce(lag(slot) over w <> slot, true) or t0 - lag(t1) over w >= 1)::int as n from spk window w as (partition by job_id order by t0, event_id)), b as (select *, sum(n) over (partition by job_id order by t0, event_id) as i from a) select job_id, slot, min(t0) as t0, max(t1) as t1, count(*) as n from b group by job_id, i, slot")
def islands(spark, d):
    return I.islands(tables.speaker_events(spark, d), "job_id", ["slot"], 1.0, ["t0", "event_id"])


@register("ts17_cuts_per_second", f"with {duck.CUTS}, {_CUT} select * from cu")
def cuts_per_second(spark, d):
    return T.per_second(tables.cuts(spark, d), "t", "cuts")


@register("ts18_turns_per_second", f"with {duck.SPK}, {_TURN} select * from tu")
def turns_per_second(spark, d):
    return T.turns_per_second(tables.speaker_events(spark, d))


@register("ts19_energy_per_second", f"with {duck.EV} select job_id, floor(t)::bigint as sec, round(stddev_pop(value), 6) as sd, round(avg(value), 6) as mean from ev group by all")
def energy_per_second(spark, d):
    return tables.timed_events(spark, d).groupBy("job_id", F.floor("t").alias("sec")).agg(F.round(F.stddev_pop("value"), 6).alias("sd"), F.round(F.avg("value"), 6).alias("mean"))


@register("ts23_motion_per_second", f"with {duck.SCENES}, {_MOTION} select job_id, sec, round(motion, 5) as motion from mo")
def motion_per_second(spark, d):
    return T.motion_per_second(tables.scenes(spark, d).withColumnRenamed("subject_x", "x")).withColumn("motion", F.round("motion", 5))


_W = T.PACING_WEIGHTS["vlog"]


@register(
    "ts20_pacing",
    f"""with {ALL}, {_TURN}, {_CUT}, {_MOTION}, au as (select job_id, floor(t)::bigint as sec, case when avg(value) > 1e-6 then round(stddev_pop(value) / avg(value), 9) else 0 end as audio from ev group by all), grid as (select job_id, unnest(range(0, floor(max(t))::bigint + 1)) as sec from ev group by job_id),
    j as (select job_id, sec, coalesce(cuts, 0) as cuts, coalesce(turns, 0) as turns, coalesce(motion, 0) as motion, coalesce(audio, 0) as audio from grid left join cu using (job_id, sec) left join tu using (job_id, sec) left join mo using (job_id, sec) left join au using (job_id, sec)),
    r as (select job_id, sec, round(least(1e0, greatest(0e0, {_W[0]}e0 * least(1e0, sum(cuts) over n / count(*) over n / 2) + {_W[1]}e0 * least(1e0, sum(turns) over n / count(*) over n) + {_W[2]}e0 * least(1e0, sum(motion) over n / count(*) over n) + {_W[3]}e0 * least(1e0, sum(audio) over n / count(*) over n))), 8) as raw
      from j window n as (partition by job_id order by sec rows between 4 preceding and 4 following))
    select job_id, sec, round(case when a is null or c is null then raw else greatest(least(a, raw), least(greatest(a, raw), c)) end, 8) as pacing from (select *, lag(raw) over w as a, lead(raw) over w as c from r window w as (partition by job_id order by sec))""",
)
def pacing(spark, d):
    """Errors are cuts, and the slots of speaker intervals, from each event to the next, take turns."""
    w = Window.partitionBy("job_id").orderBy("t", "event_id")
    kind, e = F.col("event_type"), F.col("event_id")
    slot = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2).otherwise(3)
    rows = tables.timed_events(spark, d).withColumn("slot", slot)
    turn = F.lead("t").over(w).isNotNull() & (F.lag("slot").over(w) != F.col("slot"))
    moments = rows.select("job_id", "t", (kind == "error").alias("cut"), F.coalesce(turn, F.lit(False)).alias("turn"), (e * 37 % 101).cast("double").alias("x"), "value")
    return T.pacing_of(moments, "vlog").withColumn("pacing", F.round("pacing", 8))


@register("ts21_median_of_three", f"with {duck.EV}, v as (select job_id, event_id, value, lag(value) over w as a, lead(value) over w as c from ev window w as (partition by job_id order by t, event_id)) select job_id, event_id, case when a is null or c is null then value else greatest(least(a, value), least(greatest(a, value), c)) end as value from v")
def median_of_three(spark, d):
    w = Window.partitionBy("job_id").orderBy("t", "event_id")
    return tables.timed_events(spark, d).withColumn("value", T.median3("value", w)).select("job_id", "event_id", "value")


@register("ts22_min_hold", f"with {duck.SPK} select event_id, round(2 - pow(confidence, 0.75e0) * 1.75e0, 6) as hold from spk")
def min_hold(spark, d):
    return tables.speaker_events(spark, d).select("event_id", F.round(X.min_hold(F.col("confidence")), 6).alias("hold"))


@register("ts30_shots", f"with {duck.CUTS}, e as (select job_id, max(t) as duration from ev group by 1), b as (select job_id, t from cuts union select job_id, 0e0 from e) select b.job_id, (row_number() over w - 1)::int as idx, t as t0, coalesce(lead(t) over w, duration) as t1 from b join e on b.job_id = e.job_id where t < duration window w as (partition by b.job_id order by t)")
def shots(spark, d):
    return T.shots(tables.cuts(spark, d), _ends(spark, d))


@register(
    "ts32_candidate_boundaries",
    f"with {ALL}, b as (select job_id, t, 0 as priority from cuts union all select job_id, t0, 1 from spk union all select job_id, 0e0, 2 from ev), m as (select job_id, t, min(priority) as priority from b group by all) select job_id, t, priority, lead(t) over (partition by job_id order by t) as nxt from m",
)
def candidate_boundaries(spark, d):
    parts = [tables.cuts(spark, d).select("job_id", "t", F.lit(0).alias("priority")), tables.speaker_events(spark, d).select("job_id", F.col("t0").alias("t"), F.lit(1).alias("priority")), _ends(spark, d).select("job_id", F.lit(0.0).alias("t"), F.lit(2).alias("priority"))]
    best = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("job_id", "t").agg(F.min("priority").alias("priority"))
    return best.withColumn("nxt", F.lead("t").over(Window.partitionBy("job_id").orderBy("t")))


@register("ts39_change_points", f"with {duck.SPK} select job_id, event_id, t0, slot from (select *, lag(slot) over (partition by job_id order by t0, event_id) as p from spk) where p is null or p <> slot")
def change_points(spark, d):
    before = F.lag("slot").over(Window.partitionBy("job_id").orderBy("t0", "event_id"))
    return tables.speaker_events(spark, d).withColumn("p", before).filter("p is null or p <> slot").select("job_id", "event_id", "t0", "slot")


@register("ts43_hold_before_jumps", f"with {duck.SCENES}, k as (select job_id, t, max(subject_x) as x from scenes group by all), p as (select *, lag(x) over (partition by job_id order by t) as p from k) select job_id, t, x, false as held from p union all select job_id, round(t - 0.001e0, 6), p, true from p where abs(x - p) >= 15")
def hold_before_jumps(spark, d):
    return T.hold_before_jumps(tables.scenes(spark, d).groupBy("job_id", "t").agg(F.max("subject_x").alias("x")), 15.0)


@register("ts48_compressed_range", f"with {duck.SCENES}, r as (select *, row_number() over (partition by job_id order by subject_x, event_id) as rn, count(*) over (partition by job_id) as n, max(subject_x) over (partition by job_id) - min(subject_x) over (partition by job_id) as span from scenes), m as (select job_id, subject_x as med from r where rn = n // 2 + 1) select job_id, event_id, round(case when span > 50 then med + (subject_x - med) * 50 / span else subject_x end, 4) as x from r join m using (job_id)")
def compressed_range(spark, d):
    """Scale positions toward the upper median where they span more than 50."""
    w = Window.partitionBy("job_id")
    r = tables.scenes(spark, d).withColumns({"rn": F.row_number().over(w.orderBy("subject_x", "event_id")), "n": F.count(F.lit(1)).over(w), "span": F.max("subject_x").over(w) - F.min("subject_x").over(w)})
    m = r.filter(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("job_id", F.col("subject_x").alias("med"))
    x = F.when(F.col("span") > 50, F.col("med") + (F.col("subject_x") - F.col("med")) * 50 / F.col("span")).otherwise(F.col("subject_x"))
    return r.join(m, "job_id").select("job_id", "event_id", F.round(x, 4).alias("x"))


_SPEED = f"with {duck.seg()}, sp as (select job_id, t0, t1, 1 + (seq % 3) / 2e0 as speed from seg), du as (select job_id, max(t1) + 5 as duration from seg group by 1), ev2 as (select job_id, t0, t1 from sp union all select job_id, duration, duration from du), g as (select *, coalesce(max(t1) over (partition by job_id order by t0, t1 rows between unbounded preceding and 1 preceding), 0) as f from ev2), tl as (select job_id, t0, t1, speed from sp union all select job_id, f, t0, 1e0 from g where t0 - f > 0.01e0)"


def _speed(spark, d):
    segs = tables.segments(spark, d)
    rows = segs.select("job_id", "t0", "t1", (1 + F.col("seq") % 3 / 2).alias("speed"))
    return I.fill_speed(rows, segs.groupBy("job_id").agg((F.max("t1") + 5).alias("duration")))


@register("ts50_speed_timeline", _SPEED + " select job_id, round(t0, 3) as t0, round(t1, 3) as t1, speed from tl")
def speed_timeline(spark, d):
    return _speed(spark, d).select("job_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "speed")


@register("ag32_output_duration", _SPEED + " select job_id, round(sum((t1 - t0) / speed), 3) as seconds from tl group by 1")
def output_duration(spark, d):
    return _speed(spark, d).groupBy("job_id").agg(F.round(F.sum((F.col("t1") - F.col("t0")) / F.col("speed")), 3).alias("seconds"))


@register("ts52_clip_and_rebase", f"with {duck.seg()} select job_id, seq, round(greatest(t0, 10) - 10, 3) as t0, round(least(t1, 60) - 10, 3) as t1 from seg where t1 > 10 and t0 < 60")
def clip_and_rebase(spark, d):
    return I.clip_and_rebase(tables.segments(spark, d), F.lit(10.0), F.lit(60.0)).select("job_id", "seq", "t0", "t1")


@register("ts54_decimated", f"with {duck.EV} select job_id, event_id, t from (select *, row_number() over (partition by job_id order by t, event_id) - 1 as r, count(*) over (partition by job_id) as n from ev) where r % greatest(1, n // 10) = 0 or r = n - 1")
def decimated(spark, d):
    w = Window.partitionBy("job_id")
    rows = tables.timed_events(spark, d).withColumns({"r": F.row_number().over(w.orderBy("t", "event_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    return rows.filter((F.col("r") % step == 0) | (F.col("r") == F.col("n") - 1)).select("job_id", "event_id", "t")


@register("ts55_best_thumbnail", f"with {duck.SCENES} select job_id, t from (select *, row_number() over (partition by job_id order by importance desc, t, event_id) as r from scenes) where r = 1")
def best_thumbnail(spark, d):
    return tables.scenes(spark, d).groupBy("job_id").agg(F.min_by("t", F.struct(-F.col("importance"), "t", "event_id")).alias("t"))


@register("ts60_trend", f"with {duck.SCENES} select job_id, round(regr_slope(subject_x, t), 6) as slope, round(regr_r2(subject_x, t), 6) as r2, count(*) as n from scenes group by 1")
def trend(spark, d):
    return T.trend(tables.scenes(spark, d), "subject_x", "t")


@register("ts64_sessions_by_cuts", f"with {duck.CUTS}, k as (select job_id, t, 0 as side, 0 as event_id from cuts union all select job_id, t, 1, event_id from ev), s as (select *, count(*) filter (where side = 0) over (partition by job_id order by t, side, event_id rows unbounded preceding) as part from k) select job_id, part, count(*) as n, min(t) as t0, max(t) as t1 from s where side = 1 group by all")
def sessions_by_cuts(spark, d):
    """Rows numbered by the cuts at or before them."""
    k = tables.cuts(spark, d).select("job_id", "t", F.lit(0).alias("side"), F.lit(0).cast("long").alias("event_id"))
    k = k.unionByName(tables.timed_events(spark, d).select("job_id", "t", F.lit(1).alias("side"), "event_id"))
    w = Window.partitionBy("job_id").orderBy("t", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return k.withColumn("part", F.sum((F.col("side") == 0).cast("long")).over(w)).filter("side = 1").groupBy("job_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@register("ts65_moving_average", f"with {duck.SCENES} select job_id, event_id, round(avg(subject_x) over (partition by job_id order by t, event_id rows between 2 preceding and 2 following), 6) as smooth from scenes")
def moving_average(spark, d):
    return T.moving_average(tables.scenes(spark, d), "subject_x", 2, ["t", "event_id"]).select("job_id", "event_id", "smooth")


@register("ts69_push_forward", f"with {duck.CLIPS}, o as (select *, row_number() over (partition by job_id order by t0, t1, clip_id) as i from clips), b as (select *, coalesce(sum(t1 - t0) over (partition by job_id order by i rows between unbounded preceding and 1 preceding), 0) as b from o), s as (select *, max(t0 - b) over (partition by job_id order by i) + b as s from b) select job_id, s as t0, s + (t1 - t0) as t1 from s")
def push_forward(spark, d):
    return I.push_forward(tables.clips(spark, d), "job_id", ["t0", "t1", "clip_id"]).select("job_id", "t0", "t1")


@register("ts71_adjacent_overlaps", f"with {duck.CLIPS} select job_id, count(*) as n from (select *, lag(t1) over (partition by job_id order by t0, t1, clip_id) as p from clips) where p - t0 > 0.01e0 group by 1")
def adjacent_overlaps(spark, d):
    w = Window.partitionBy("job_id").orderBy("t0", "t1", "clip_id")
    return tables.clips(spark, d).withColumn("p", F.lag("t1").over(w)).filter(F.col("p") - F.col("t0") > 0.01).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


@register("ts72_plan_violations", f"with {duck.CUTS}, e as (select job_id, max(t) as duration from ev group by 1), b as (select job_id, t from cuts union select job_id, 0e0 from e), s as (select b.job_id, row_number() over w - 1 as idx, t as t0, coalesce(lead(t) over w, duration) as t1 from b join e on b.job_id = e.job_id where t < duration window w as (partition by b.job_id order by t)) select job_id, idx::int as idx, 'gap' as kind from (select *, lead(t0) over (partition by job_id order by idx) as nxt from s) where nxt - t1 > 0.001e0")
def plan_violations(spark, d):
    """Must be empty: shots join without gap or overlap."""
    return T.contiguity_violations(T.shots(tables.cuts(spark, d), _ends(spark, d)))


@register("ag24_chaotic_motion", f"with {duck.EV} select job_id, stddev_pop(value) > avg(value) as chaotic, round(avg(value), 6) as mean from ev group by 1")
def chaotic_motion(spark, d):
    return tables.timed_events(spark, d).groupBy("job_id").agg((F.stddev_pop("value") > F.avg("value")).alias("chaotic"), F.round(F.avg("value"), 6).alias("mean"))


@register(
    "ag07_pacing_variance",
    f"""with {duck.seg()} select job_id, case when n < 3 then 0.5e0 when cv < 0.1e0 then 0.4e0 when cv >= 0.2e0 and cv <= 0.5e0 then 0.8e0 when cv > 0.8e0 then 0.5e0 else 0.6e0 end as pacing
    from (select job_id, count(*) as n, round(stddev_pop(w) / avg(w), 9) as cv from (select job_id, n_words / ((t1 - t0) / 60) * (1 + seq % 3) as w from seg where t1 > t0 and n_words > 0) group by 1)""",
)
def pacing_variance(spark, d):
    w = tables.segments(spark, d).filter("t1 > t0 and n_words > 0").select("job_id", (F.col("n_words") / ((F.col("t1") - F.col("t0")) / 60) * (1 + F.col("seq") % 3)).alias("w"))
    g = w.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("w") / F.avg("w"), 9).alias("cv"))
    cv = F.col("cv")
    return g.select("job_id", F.when(F.col("n") < 3, 0.5).when(cv < 0.1, 0.4).when(cv.between(0.2, 0.5), 0.8).when(cv > 0.8, 0.5).otherwise(0.6).alias("pacing"))


@register("ag08_visual_change", f"with {duck.SCENES}, g as (select job_id, count(*) / (greatest(max(t), 1) / 60) as pm, count_if(importance >= 7) as hot from scenes group by 1) select job_id, round(least(1e0, case when pm < 1 then 0.3e0 when pm >= 3 and pm <= 8 then 0.8e0 when pm > 15 then 0.5e0 else 0.6e0 end + least(0.15e0, 0.05e0 * hot)), 4) as visual from g")
def visual_change(spark, d):
    g = tables.scenes(spark, d).groupBy("job_id").agg((F.count(F.lit(1)) / (F.greatest(F.max("t"), F.lit(1.0)) / 60)).alias("pm"), F.count_if(F.col("importance") >= 7).alias("hot"))
    pm = F.col("pm")
    base = F.when(pm < 1, 0.3).when(pm.between(3, 8), 0.8).when(pm > 15, 0.5).otherwise(0.6)
    return g.select("job_id", F.round(F.least(F.lit(1.0), base + F.least(F.lit(0.15), 0.05 * F.col("hot"))), 4).alias("visual"))


@register("rt05_degraded", "with f as (select event_id, user_id, epoch_us(ts) / 1e6 as s from events where event_type = 'error'), c as (select event_id, user_id, count(*) over (partition by user_id order by s range between 36000 preceding and current row) as n from f) select event_id, user_id, n, n >= 3 as degraded from c")
def degraded(spark, d):
    """Failures in a sliding range before each; three or more degrade the provider."""
    f = tables.load(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-36000, 0))
    return f.select("event_id", "user_id", n.alias("n"), (n >= 3).alias("degraded"))


@register("rt12_eta", f"with {duck.EV}, a as (select job_id, event_id, t, min(t) over n as f, count(*) over n as c, count(*) over (partition by job_id) - row_number() over (partition by job_id order by t, event_id) as left_n from ev window n as (partition by job_id order by t, event_id rows between 14 preceding and current row)) select job_id, event_id, case when c > 1 then round((t - f) / (c - 1) * left_n, 9) end as eta from a")
def eta(spark, d):
    """Time left by the mean step of the last fifteen rows."""
    w = Window.partitionBy("job_id").orderBy("t", "event_id")
    near = w.rowsBetween(-14, 0)
    rows = tables.timed_events(spark, d).withColumns({"f": F.min("t").over(near), "c": F.count(F.lit(1)).over(near), "left_n": F.count(F.lit(1)).over(Window.partitionBy("job_id")) - F.row_number().over(w)})
    return rows.select("job_id", "event_id", F.when(F.col("c") > 1, F.round((F.col("t") - F.col("f")) / (F.col("c") - 1) * F.col("left_n"), 9)).alias("eta"))
