"""Time series per job: second grids, centred windows, change detection, repairs and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of cuts, speaker turns, motion and audio by content.
PACING_WEIGHTS = {
    "narrative": (0.45, 0.10, 0.25, 0.20),
    "podcast": (0.05, 0.55, 0.05, 0.35),
    "gaming": (0.05, 0.0, 0.60, 0.35),
    "vlog": (0.15, 0.25, 0.35, 0.25),
    "sports": (0.20, 0.05, 0.55, 0.20),
    "music_video": (0.40, 0.0, 0.45, 0.15),
    "anime": (0.35, 0.15, 0.30, 0.20),
    "unknown": (0.25, 0.25, 0.25, 0.25),
}


def per_second(rows: DataFrame, t: str = "t", name: str = "n") -> DataFrame:
    """Rows per whole second."""
    return rows.groupBy("job_id", F.floor(t).alias("sec")).agg(F.count(F.lit(1)).alias(name))


def turns_per_second(events: DataFrame) -> DataFrame:
    """Slot changes per whole second of an interval table (job_id, event_id, t0, slot)."""
    before = F.lag("slot").over(Window.partitionBy("job_id").orderBy("t0", "event_id"))
    return per_second(events.withColumn("__p", before).filter("__p is not null and __p <> slot"), "t0", "turns")


def second_grid(ends: DataFrame) -> DataFrame:
    """(job_id, sec) for every second 0..floor(duration) of (job_id, duration)."""
    return ends.select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor("duration"))).alias("sec"))


def median3(value: str, w) -> Column:
    """The median of the row before, this and the next; the ends as they are."""
    a, b, c = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(a.isNull() | c.isNull(), b).otherwise(middle)


def peakiness_per_second(values: DataFrame) -> DataFrame:
    """Standard deviation over mean of the values of every whole second; 0 where the mean is about 0 or below."""
    found = values.groupBy("job_id", F.floor("t").alias("sec")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return found.select("job_id", "sec", F.when(F.col("mean") > 1e-6, F.round(F.col("sd") / F.col("mean"), 9)).otherwise(0.0).alias("audio"))


def pacing(grid: DataFrame, cuts: DataFrame, turns: DataFrame, motion: DataFrame, audio: DataFrame, content: str, half: int = 4) -> DataFrame:
    """Per second of the grid: cuts, turns, motion and audio dynamics in a window of ``half`` seconds each way, cut at the
    ends and divided by its real size, normalised, weighted by content, and smoothed by a median of three. The parts
    (job_id, sec, value) and the grid are one stream, added up once."""
    names = ("cuts", "turns", "motion", "audio")
    rows = grid.select("job_id", "sec", F.lit(True).alias("there"), *[F.lit(0.0).alias(n) for n in names])
    for own, part in zip(names, (cuts, turns, motion, audio), strict=True):
        rows = rows.unionByName(part.select("job_id", "sec", F.lit(False).alias("there"), *[(F.col(n).cast("double") if n == own else F.lit(0.0)).alias(n) for n in names]))
    rows = rows.groupBy("job_id", "sec").agg(F.max("there").alias("there"), *[F.sum(n).alias(n) for n in names]).filter("there")
    return _paced(rows, content, half)


def pacing_of(moments: DataFrame, content: str, half: int = 4) -> DataFrame:
    """The same from one stream of moments (job_id, t, cut, turn, x, value): everything is added up once per second, seconds
    without a moment are filled in afterwards, and all steps work on one partitioning by job. The grid goes from the first
    to the last moment's second."""
    second = moments.groupBy("job_id", F.floor("t").alias("sec")).agg(
        F.size(F.collect_set(F.when(F.col("cut"), F.col("t")))).cast("double").alias("cuts"), F.count_if("turn").cast("double").alias("turns"),
        F.avg("x").alias("x"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
    )
    w = Window.partitionBy("job_id").orderBy("sec")
    rows = second.withColumns({"dx": F.round(F.abs(F.col("x") - F.lag("x").over(w)), 6), "next": F.lead("sec").over(w)})
    rows = rows.withColumn("top", F.percentile(F.when(F.col("dx") > 0, F.col("dx")), F.lit(0.95)).over(Window.partitionBy("job_id")))
    motion = F.coalesce(F.least(F.lit(1.0), F.col("dx") / F.col("top")), F.lit(0.0))
    audio = F.when(F.col("mean") > 1e-6, F.round(F.col("sd") / F.col("mean"), 9)).otherwise(0.0)
    rows = rows.withColumns({"motion": motion, "audio": audio, "first": F.col("sec")})
    rows = rows.withColumn("sec", F.explode(F.sequence("first", F.coalesce(F.col("next") - 1, F.col("first")))))
    own = F.col("sec") == F.col("first")
    return _paced(rows.select("job_id", "sec", *[F.when(own, F.col(n)).otherwise(0.0).alias(n) for n in ("cuts", "turns", "motion", "audio")]), content, half)


def _paced(rows: DataFrame, content: str, half: int) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("sec")
    near = w.rowsBetween(-half, half)
    size = F.count(F.lit(1)).over(near)
    share = lambda n, most: F.least(F.lit(1.0), F.sum(n).over(near) / size / most)
    wc, ws, wm, wa = PACING_WEIGHTS[content]
    raw = wc * share("cuts", 2) + ws * share("turns", 1) + wm * share("motion", 1) + wa * share("audio", 1)
    rows = rows.withColumn("raw", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 8))
    return rows.withColumn("pacing", median3("raw", w)).select("job_id", "sec", "pacing")


def motion_per_second(points: DataFrame) -> DataFrame:
    """Change of the mean x against the last present second, over the 95th percentile of the positive changes, cut at 1."""
    means = points.groupBy("job_id", F.floor("t").alias("sec")).agg(F.avg("x").alias("x"))
    moved = means.withColumn("dx", F.round(F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("job_id").orderBy("sec"))), 6))
    top = moved.filter("dx > 0").groupBy("job_id").agg(F.percentile("dx", F.lit(0.95)).alias("p"))
    return moved.join(top, "job_id", "left").select("job_id", "sec", F.coalesce(F.least(F.lit(1.0), F.col("dx") / F.col("p")), F.lit(0.0)).alias("motion"))


def boundaries(segs: DataFrame, gap: float = 1.5) -> DataFrame:
    """Starts of segments at a change of speaker or after a pause."""
    w = Window.partitionBy("job_id").orderBy("seq")
    changed = F.lag("speaker").over(w) != F.col("speaker")
    paused = F.col("t0") - F.lag("t1").over(w) > gap
    return segs.withColumns({"changed": F.coalesce(changed, F.lit(False)), "paused": F.coalesce(paused, F.lit(False))}).filter("changed or paused").select("job_id", "seq", "t0", "changed", "paused")


def shots(cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """Intervals between cuts, from 0 to each job's end: (job_id, idx, t0, t1)."""
    edges = cuts.select("job_id", "t").unionByName(ends.select("job_id", F.lit(0.0).alias("t"))).distinct().join(ends, "job_id").filter("t < duration")
    w = Window.partitionBy("job_id").orderBy("t")
    return edges.select("job_id", (F.row_number().over(w) - 1).alias("idx"), F.col("t").alias("t0"), F.coalesce(F.lead("t").over(w), F.col("duration")).alias("t1"))


def moving_average(rows: DataFrame, value: str, half: int, order: list[str]) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(*order).rowsBetween(-half, half)
    return rows.withColumn("smooth", F.round(F.avg(value).over(w), 6))


def hold_before_jumps(rows: DataFrame, jump: float, lead_s: float = 0.001) -> DataFrame:
    """Keyframes (job_id, t, x) with one more row, the old value just before, at every jump of that size or more."""
    w = Window.partitionBy("job_id").orderBy("t")
    rows = rows.withColumn("__p", F.lag("x").over(w))
    prev = F.col("__p")
    made = F.when(F.abs(F.col("x") - prev) >= jump, F.array(F.struct(F.round(F.col("t") - lead_s, 6).alias("t"), prev.alias("x"), F.lit(True).alias("held")), F.struct("t", "x", F.lit(False).alias("held")))).otherwise(
        F.array(F.struct("t", "x", F.lit(False).alias("held")))
    )
    return rows.select("job_id", F.explode(made).alias("k")).select("job_id", F.col("k.t").alias("t"), F.col("k.x").alias("x"), F.col("k.held").alias("held"))


def contiguity_violations(rows: DataFrame, eps: float = 0.001) -> DataFrame:
    """Gaps, overlaps and empty intervals of consecutive rows (job_id, idx, t0, t1)."""
    w = Window.partitionBy("job_id").orderBy("idx")
    nxt = F.lead("t0").over(w)
    kind = F.when(F.col("t1") <= F.col("t0"), "empty").when(nxt - F.col("t1") > eps, "gap").when(F.col("t1") - nxt > eps, "overlap")
    return rows.withColumn("kind", kind).filter("kind is not null").select("job_id", "idx", "kind")


def trend(rows: DataFrame, value: str, at: str) -> DataFrame:
    """Slope and fit of a straight line per job."""
    return rows.groupBy("job_id").agg(F.round(F.regr_slope(value, at), 6).alias("slope"), F.round(F.regr_r2(value, at), 6).alias("r2"), F.count(F.lit(1)).alias("n"))
