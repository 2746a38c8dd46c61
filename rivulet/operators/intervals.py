"""Interval and time joins, and operations on intervals. Times are seconds in doubles.

Range predicates become equi joins: both sides are cut into time buckets, so a hot job spreads over its buckets and no
nested loop is planned. Windowed forms partition by job (and bucket), never by nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.numbers import rounded
from rivulet.operators import folds


def _buckets(t0: Column, t1: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(t0 / width), F.floor(F.greatest(t0, t1) / width)))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], on: Column, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float = 30.0, how: str = "inner") -> DataFrame:
    """Rows of equal keys whose spans touch and that meet ``on``; each pair once (in its first common bucket). ``how``:
    inner, left_semi or left_anti. Column names of the two sides must differ but for the keys."""
    both = [F.floor(left_span[0] / width), F.floor(right_span[0] / width)]
    a = left.withColumn("__b", _buckets(*left_span, width)).withColumn("__lf", both[0])
    b = right.withColumn("__rb", _buckets(*right_span, width)).withColumn("__rf", both[1]).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("__b") == F.col("__rb"), F.col("__b") == F.greatest("__lf", "__rf"), on])
    extra = ["__b", "__lf", "__rb", "__rf", *(f"__k_{k}" for k in keys)]
    if how == "inner":
        return a.join(b, match).drop(*extra)
    found = a.join(b, match).select(*left.columns).distinct()
    if how == "left_semi":
        return left.join(found, left.columns, "left_semi")
    return left.join(found, left.columns, "left_anti")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Seconds that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def label_by_overlap(segs: DataFrame, turns: DataFrame, default: str = "Speaker 1") -> DataFrame:
    """Each segment (job_id, seq, t0, t1) with the label of the turn (job_id, s0, s1, label) it shares most time with;
    of equals the earliest; without any the default."""
    pairs = range_join(segs.select("job_id", "seq", "t0", "t1"), turns, ["job_id"], (F.col("t0") < F.col("s1")) & (F.col("t1") > F.col("s0")), (F.col("t0"), F.col("t1")), (F.col("s0"), F.col("s1")))
    shared = F.round(overlap(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1")), 6)
    best = pairs.groupBy("job_id", "seq").agg(F.max_by("label", F.struct(shared, -F.col("s0"), F.col("label"))).alias("label"))
    return segs.join(best, ["job_id", "seq"], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def slot_coverage(spans: DataFrame, events: DataFrame, min_confidence: float = 0.0, digits: int = 4) -> DataFrame:
    """Per span (job_id, seq, t0, t1): the slot whose events (s0, s1, slot, confidence) cover most of it, and the share."""
    pairs = range_join(spans, events.filter(F.col("confidence") >= min_confidence), ["job_id"], (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0")), (F.col("t0"), F.col("t1")), (F.col("s0"), F.col("s1")))
    sums = pairs.groupBy("job_id", "seq", "t0", "t1", "slot").agg(rounded(F.sum(overlap(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1"))), 6).alias("sec"))
    best = sums.groupBy("job_id", "seq", "t0", "t1").agg(F.max_by(F.struct("slot", "sec"), F.struct("sec", -F.col("slot"))).alias("b"))
    return best.select("job_id", "seq", F.col("b.slot").alias("slot"), rounded(F.col("b.sec") / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-9)), digits).alias("coverage"))


def asof_join(left: DataFrame, right: DataFrame, key: str, t: str, s: str, values: list[str], direction: str = "backward", tie: str | None = None, digits: int | None = None) -> DataFrame:
    """Each left row with the values of the right row of its key that is last at or before it (``backward``), first at or
    after it (``forward``) or the closest (``nearest``; the earlier of equals), and that row's time as ``s``. With ``digits``,
    distances are compared as rounded to so many, so that equal ones are not told apart by their last bits."""
    mark = F.struct(F.col(s).alias("s"), *[F.col(v).alias(v) for v in values])
    a = left.withColumns({"__t": F.col(t), "__side": F.lit(1), "__m": F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType)})
    b = right.select(F.col(key), F.col(s).alias("__t"), F.lit(0).alias("__side"), mark.alias("__m"), *([F.col(tie).alias("__tie")] if tie else [F.lit(0).alias("__tie")]))
    rows = a.withColumn("__tie", F.lit(None).cast(b.schema["__tie"].dataType)).unionByName(b, allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("__t"), F.col("__side"), F.desc("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    if direction in ("backward", "nearest"):
        rows = rows.withColumn("__back", F.last("__m", ignorenulls=True).over(back))
    if direction in ("forward", "nearest"):
        rows = rows.withColumn("__ahead", F.last("__m", ignorenulls=True).over(ahead))
    rows = rows.filter("__side = 1")
    if direction == "nearest":
        away = lambda d: d if digits is None else rounded(d, digits)
        far = F.col("__back").isNull() | (away(F.col("__ahead.s") - F.col("__t")) < away(F.col("__t") - F.col("__back.s")))
        found = F.when(far & F.col("__ahead").isNotNull(), F.col("__ahead")).otherwise(F.col("__back"))
    else:
        found = F.col("__back" if direction == "backward" else "__ahead")
    rows = rows.withColumn("__f", found)
    return rows.select(*left.columns, F.col("__f.s").alias(s), *[F.col(f"__f.{v}").alias(v) for v in values])


def islands(rows: DataFrame, key: str, same: list[str], max_gap: float, order: list[str]) -> DataFrame:
    """Merge consecutive intervals (t0, t1) of a key that agree in ``same`` and follow within ``max_gap`` seconds:
    (key, same..., t0, t1, n)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.lag(c).over(w)) for c in same])
    new = (F.row_number().over(w) == 1) | changed | ((F.col("t0") - F.lag("t1").over(w)) >= max_gap)
    numbered = rows.withColumn("__new", new.cast("int")).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__i", *same).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n")).drop("__i")


def covered_runs(rows: DataFrame, key: str) -> DataFrame:
    """The union of a key's intervals as disjoint ones: (key, t0, t1)."""
    w = Window.partitionBy(key).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    new = rows.withColumn("__new", (F.coalesce(F.max("t1").over(w), F.lit(float("-inf"))) < F.col("t0")).cast("int"))
    upto = Window.partitionBy(key).orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, 0)
    return new.withColumn("__i", F.sum("__new").over(upto)).groupBy(key, "__i").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("__i")


def second_gaps(found: DataFrame, durations: DataFrame, min_gap: int) -> DataFrame:
    """Runs of seconds of 0..floor(duration) not marked by any interval (both ends' whole seconds inclusive) of at least
    ``min_gap``: (job_id, t0, t1)."""
    marked = covered_runs(found.select("job_id", F.floor("t0").alias("t0"), (F.floor("t1") + 1).alias("t1")), "job_id")
    last = durations.select("job_id", (F.floor("duration") + 1).alias("end"))
    edges = marked.unionByName(last.select("job_id", F.col("end").alias("t0"), F.col("end").alias("t1")))
    w = Window.partitionBy("job_id").orderBy("t0", "t1")
    gaps = edges.withColumn("g0", F.greatest(F.lit(0), F.coalesce(F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))).join(last, "job_id")
    return gaps.select("job_id", F.col("g0").alias("t0"), F.least("t0", "end").alias("t1")).filter(F.col("t1") - F.col("t0") >= min_gap)


def gaps_near(gaps: DataFrame, zones: DataFrame) -> DataFrame:
    """The gaps that overlap a zone (job_id, z0, z1); all gaps of jobs without zones."""
    touching = range_join(gaps, zones, ["job_id"], (F.col("z0") < F.col("t1")) & (F.col("z1") > F.col("t0")), (F.col("t0").cast("double"), F.col("t1").cast("double")), (F.col("z0"), F.col("z1"))).select(*gaps.columns).distinct()
    return touching.unionByName(gaps.join(zones.select("job_id").distinct(), "job_id", "left_anti"))


def first_gaps(gaps: DataFrame, most: int) -> DataFrame:
    """The first gaps of each job."""
    return gaps.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("t0", "t1"))).filter(F.col("n") <= most).drop("n")


def subtitle_sync(items: DataFrame, segs: DataFrame, near: float = 0.3) -> DataFrame:
    """Per job how subtitle items (job_id, a, s0, s1, subtitle, said) agree with segments (job_id, seq, t0, t1, text,
    speaker). Items in order take the first free segment with start and end within ``near``; the rest is a full outer
    join of items, matches and segments, counted."""
    close = (F.abs(F.col("t0") - F.col("s0")) < near) & (F.abs(F.col("t1") - F.col("s1")) < near)
    pairs = range_join(items.select("job_id", "a", "s0", "s1"), segs.select("job_id", F.col("seq").alias("b"), "t0", "t1"), ["job_id"], close, (F.col("s0") - near, F.col("s0") + near), (F.col("t0"), F.col("t0")))
    matched = folds.fold(pairs.select("job_id", "a", "b"), "job_id", ["a", "b"], folds.greedy_match, "job_id long, a long, b long")
    left = items.join(matched, ["job_id", "a"], "left")
    right = segs.select(F.col("job_id").alias("seg_job"), F.col("seq"), "text", "speaker")
    every = left.join(right, (F.col("job_id") == F.col("seg_job")) & (F.col("b") == F.col("seq")), "full")
    both = F.col("a").isNotNull() & F.col("seq").isNotNull()
    named = (F.col("speaker") != F.col("said")) & (F.col("speaker") != "") & (F.col("said") != "")
    counts = {
        "matched": both,
        "text_mismatches": both & ~F.col("text").eqNullSafe(F.col("subtitle")),
        "speaker_mismatches": both & named,
        "unmatched_timeline": F.col("seq").isNull(),
        "unmatched_transcript": F.col("a").isNull(),
        "total_timeline": F.col("a").isNotNull(),
        "total_transcript": F.col("seq").isNotNull(),
    }
    return every.groupBy(F.coalesce("job_id", "seg_job").alias("job_id")).agg(*[F.count_if(v).alias(k) for k, v in counts.items()])


def clip_and_rebase(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Cut intervals to [start, end] and count time from start; those outside go."""
    inside = rows.filter((F.col("t1") > start) & (F.col("t0") < end))
    return inside.withColumns({"t0": F.round(F.greatest(F.col("t0"), start) - start, 3), "t1": F.round(F.least(F.col("t1"), end) - start, 3)})


def fill_speed(rows: DataFrame, durations: DataFrame, global_speed: float = 1.0, eps: float = 0.01) -> DataFrame:
    """Intervals with speed, and the gaps between them and up to the job's duration at the global speed."""
    w = Window.partitionBy("job_id").orderBy("t0", "t1")
    last = durations.select("job_id", F.col("duration").alias("t0"), F.col("duration").alias("t1"), F.lit(None).cast("double").alias("speed"))
    every = rows.select("job_id", "t0", "t1", "speed").unionByName(last)
    every = every.withColumn("from", F.coalesce(F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    gaps = every.filter(F.col("t0") - F.col("from") > eps).select("job_id", F.col("from").alias("t0"), F.col("t0").alias("t1"), F.lit(global_speed).alias("speed"))
    return rows.select("job_id", "t0", "t1", "speed").unionByName(gaps)


def push_forward(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Move overlapping items of a track behind their predecessors. In closed form: an item starts at the running
    maximum of (start - lengths before it) plus those lengths."""
    w = Window.partitionBy(key).orderBy(*order)
    length = F.col("t1") - F.col("t0")
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("__before", before)
    start = F.max(F.col("t0") - F.col("__before")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    return rows.withColumn("__s", F.round(start, 6)).withColumns({"t1": F.round(F.col("__s") + length, 6), "t0": F.col("__s")}).drop("__s", "__before")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes given as centre x, centre y, width, height."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2] / 2, b[0] + b[2] / 2) - F.greatest(a[0] - a[2] / 2, b[0] - b[2] / 2))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3] / 2, b[1] + b[3] / 2) - F.greatest(a[1] - a[3] / 2, b[1] - b[3] / 2))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))
