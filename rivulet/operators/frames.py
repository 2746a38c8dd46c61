"""Series of frames and keyframes: motion energy, repairs, cuts at shot borders, places on a track, clips by their text.

Keyframes are rows (job_id, t, x). What looks at neighbours is a window per job; what depends on its own results is a
fold (``operators.folds``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import intervals as I


def _by_time():
    return Window.partitionBy("job_id").orderBy("t")


def motion_energy(faces: DataFrame) -> DataFrame:
    """(job_id, sec, motion): greatest speed of the faces' mean place in every second with any, over the 95th percentile
    of the job's positive ones, at most 1."""
    means = faces.filter("slot >= 0").groupBy("job_id", "t").agg(F.avg("x").alias("x"))
    dt = F.col("t") - F.lag("t").over(_by_time())
    speed = means.withColumn("v", F.when(dt > 0, F.round(F.abs(F.col("x") - F.lag("x").over(_by_time())) / dt, 6))).filter("v is not null")
    most = speed.groupBy("job_id", F.floor("t").alias("sec")).agg(F.max("v").alias("v"))
    top = most.filter("v > 0").groupBy("job_id").agg(F.percentile("v", F.lit(0.95)).alias("p"))
    return most.join(top, "job_id", "left").select("job_id", "sec", F.coalesce(F.least(F.lit(1.0), F.col("v") / F.col("p")), F.lit(0.0)).alias("motion"))


def tracked_by_motion(spans: DataFrame, energy: DataFrame, least: float = 0.70) -> DataFrame:
    """(job_id, seq, tracked): whether the mean energy of a span's seconds (those without count 0) reaches ``least`` and is
    not under its deviation."""
    n = F.floor("t1") - F.floor("t0") + 1
    on = (F.col("sec") >= F.floor("t0")) & (F.col("sec") <= F.floor("t1"))
    pairs = I.range_join(spans, energy, ["job_id"], on, (F.floor("t0").cast("double"), F.floor("t1").cast("double")), (F.col("sec").cast("double"), F.col("sec").cast("double")), width=60.0)
    sums = pairs.groupBy("job_id", "seq").agg(F.sum("motion").alias("s"), F.sum(F.col("motion") * F.col("motion")).alias("q"))
    rows = spans.withColumn("n", n).join(sums, ["job_id", "seq"], "left").fillna(0.0, ["s", "q"])
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return rows.select("job_id", "seq", ((F.round(mean, 9) >= least) & (F.round(deviation, 9) <= F.round(mean, 9))).alias("tracked"))


def consolidated(rows: DataFrame, same: list[str]) -> DataFrame:
    """Spans in order whose neighbours agree in ``same``, as one: (job_id, t0, t1, same)."""
    w = Window.partitionBy("job_id").orderBy("t0")
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    numbered = rows.withColumn("__i", F.sum(((F.row_number().over(w) == 1) | changed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("job_id", "__i", *same).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("__i")


def shot_cuts(keys: DataFrame, cuts: DataFrame, least: float = 3.0) -> DataFrame:
    """Keyframes and, where a cut (job_id, t) falls between two that differ by more than ``least``, the old place a
    millisecond before it and the new one at it. Of several cuts between the same two, the first does."""
    at = cuts.withColumnRenamed("t", "cut")
    rows = keys.select("job_id", "t", "x", F.lit(None).cast("double").alias("cut")).unionByName(at.select("job_id", F.col("cut").alias("t"), F.lit(None).cast("double").alias("x"), "cut"))
    # a keyframe at the time of a cut comes after it
    w = Window.partitionBy("job_id").orderBy("t", F.col("cut").isNull())
    known = F.struct("t", "x")
    before = F.last(F.when(F.col("cut").isNull(), known), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(F.col("cut").isNull(), known), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = rows.withColumns({"b": before, "a": after}).filter("cut is not null and a is not null and b is not null")
    found = found.withColumn("hold", F.round(F.col("cut") - 0.001, 3)).filter((F.abs(F.col("a.x") - F.col("b.x")) > least) & (F.col("hold") > F.col("b.t")))
    first = found.groupBy("job_id", "b", "a").agg(F.min(F.struct("cut", "hold")).alias("m"))
    made = first.select("job_id", F.explode(F.array(F.struct(F.col("m.hold").alias("t"), F.col("b.x").alias("x")), F.struct(F.col("m.cut").alias("t"), F.col("a.x").alias("x")))).alias("k"))
    return keys.select("job_id", "t", "x").unionByName(made.select("job_id", "k.t", "k.x"))


def jump_markers(keys: DataFrame, jump: float = 15.0) -> DataFrame:
    """Keyframes and, before every change of more than ``jump`` over more than 10 ms, the old place a millisecond before."""
    gap = keys.withColumns({"pt": F.lag("t").over(_by_time()), "px": F.lag("x").over(_by_time())})
    cut = F.round(F.col("t") - 0.001, 3)
    made = gap.filter((F.abs(F.col("x") - F.col("px")) > jump) & (F.col("t") - F.col("pt") > 0.01) & (cut > F.col("pt")))
    return keys.select("job_id", "t", "x").unionByName(made.select("job_id", cut.alias("t"), F.col("px").alias("x")))


def tracking_off(keys: DataFrame, ranges: DataFrame, fixed: float = 50.0, near: float = 0.05) -> DataFrame:
    """Keyframes outside the ranges (job_id, r0, r1), the fixed place at both ends of each range, and of rows within
    ``near`` of the next one the last."""
    off = (F.col("t") >= F.col("r0") - 0.01) & (F.col("t") <= F.col("r1") + 0.01)
    on = I.range_join(keys.select("job_id", "t", "x"), ranges, ["job_id"], off, (F.col("t") - 0.01, F.col("t") + 0.01), (F.col("r0"), F.col("r1")), width=60.0, how="left_anti")
    ends = ranges.select("job_id", F.explode(F.array("r0", "r1")).alias("t"), F.lit(fixed).alias("x"))
    rows = ends.withColumn("kind", F.lit(0)).unionByName(on.withColumn("kind", F.lit(1)))
    following = F.lead("t").over(Window.partitionBy("job_id").orderBy("t", "kind", "x"))
    return rows.withColumn("n", following).filter(F.col("n").isNull() | (F.col("n") - F.col("t") >= near)).select("job_id", "t", "x")


def clip_place(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(job_id, seq, x): the mean of the points (t, x) of a span, else the line between the last before and the first after
    at its middle, else the one there is, else 50; within 0 to 100."""
    inside = I.range_join(spans, points, ["job_id"], (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1")), (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t")), width=60.0)
    mean = inside.groupBy("job_id", "seq").agg(F.avg("x").alias("m"))
    marks = points.select("job_id", F.col("t").alias("s"), F.col("x"))
    before = I.asof_join(spans, marks, "job_id", "t0", "s", ["x"]).select("job_id", "seq", F.col("s").alias("bt"), F.col("x").alias("bx"))
    after = I.asof_join(spans, marks, "job_id", "t1", "s", ["x"], "forward").select("job_id", "seq", F.col("s").alias("at"), F.col("x").alias("ax"))
    rows = spans.join(mean, ["job_id", "seq"], "left").join(before, ["job_id", "seq"]).join(after, ["job_id", "seq"])
    middle = (F.col("t0") + F.col("t1")) / 2
    line = F.col("bx") + (F.col("ax") - F.col("bx")) * (middle - F.col("bt")) / (F.col("at") - F.col("bt"))
    x = F.coalesce("m", F.when(F.col("at") > F.col("bt"), line), "bx", "ax", F.lit(50.0))
    return rows.select("job_id", "seq", F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)).alias("x"))


def crop_segments(keys: DataFrame, ends: DataFrame, centres: list[float], near: float = 15.0) -> DataFrame:
    """(job_id, t0, t1, x, label): stretches of one place up to the next change, the last to the job's ``duration``, named
    by the nearest centre within ``near`` (of equally near ones the first) or by the place."""
    before = F.lag("x").over(_by_time())
    starts = keys.withColumn("p", before).filter(F.col("p").isNull() | (F.col("p") != F.col("x"))).join(ends, "job_id")
    rows = starts.select("job_id", F.col("t").alias("t0"), F.coalesce(F.lead("t").over(_by_time()), F.col("duration")).alias("t1"), "x")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("x") - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    label = F.when(best["d"] <= near, F.concat(F.lit("Speaker "), (best["i"] + 1).cast("string"))).otherwise(F.concat(F.col("x").cast("int").cast("string"), F.lit("%")))
    return rows.withColumn("label", label)


def placed_on_track(items: DataFrame, siblings: DataFrame) -> DataFrame:
    """(job_id, item, start): where an item (job_id, item, wanted, length) goes on its job's track of (job_id, t0, t1): into
    the gap that holds it nearest to where it is wanted, or, if none does, to the end of the gap whose middle is nearest."""
    w = Window.partitionBy("job_id").orderBy("t0", "t1")
    infinite = F.lit(float("inf"))
    head = siblings.groupBy("job_id").agg(F.lit(0.0).alias("g0"), F.min("t0").alias("g1")).withColumn("n", F.lit(0))
    gaps = siblings.select("job_id", F.col("t1").alias("g0"), F.coalesce(F.lead("t0").over(w), infinite).alias("g1"), F.row_number().over(w).alias("n"))
    gaps = head.unionByName(gaps).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("n", "g0", "g1"))).alias("gaps"))
    rows = items.join(gaps, "job_id", "left")
    put = lambda g: F.greatest(g["g0"], F.least(F.col("wanted"), g["g1"] - F.col("length")))
    fitting = F.filter("gaps", lambda g: g["g1"] - g["g0"] >= F.col("length") - 0.001)
    near = F.array_min(F.transform(fitting, lambda g: F.struct(F.round(F.abs(put(g) - F.col("wanted")), 9).alias("d"), g["n"].alias("n"), put(g).alias("s"))))
    middle = lambda g: F.when(g["g1"] == infinite, g["g0"]).otherwise((g["g0"] + g["g1"]) / 2)
    other = F.array_min(F.transform("gaps", lambda g: F.struct(F.round(F.abs(F.col("wanted") + F.col("length") / 2 - middle(g)), 9).alias("d"), g["n"].alias("n"), put(g).alias("s"))))
    start = F.when(F.col("gaps").isNull(), F.greatest(F.lit(0.0), F.col("wanted"))).otherwise(F.coalesce(near["s"], other["s"]))
    return rows.select("job_id", "item", start.alias("start"))


def remaining_length(items: DataFrame, media: DataFrame) -> DataFrame:
    """(job_id, item, longest): what is left of an item's medium (media_id, duration) after its trim; without end for
    others than video and audio, unknown media and none left."""
    rows = items.join(media, "media_id", "left")
    left = F.col("duration") - F.coalesce("trim", F.lit(0.0))
    known = F.col("kind").isin("video", "audio") & (F.col("duration") > 0) & (left > 0)
    return rows.select("job_id", "item", F.when(known, left).otherwise(F.lit(float("inf"))).alias("longest"))


def better_hook(clips: DataFrame, segs: DataFrame, fillers: list[str], openers: list[str]) -> DataFrame:
    """(job_id, clip_id, better): the start of the segment of highest hook score (over 0) that begins in a clip's first
    five seconds and not with a filler; of equals the earliest."""
    pairs = I.range_join(clips, segs, ["job_id"], (F.col("t0") >= F.col("c0")) & (F.col("t0") <= F.col("c0") + 5), (F.col("c0"), F.col("c0") + 5), (F.col("t0"), F.col("t0")))
    text = F.trim("text")
    first = F.regexp_replace(F.lower(F.regexp_extract(text, r"^(\S*)", 1)), r"[.,!?]+$", "")
    head = F.left(text, F.lit(60))
    score = F.when(head.contains("?"), 3).otherwise(0) + F.when(head.contains("!"), 2).otherwise(0) + F.when(first.isin(*openers), 3).otherwise(0)
    rows = pairs.filter(~first.isin(*fillers)).withColumn("s", score).filter("s > 0")
    return clips.select("job_id", "clip_id").join(rows.groupBy("job_id", "clip_id").agg(F.max_by("t0", F.struct("s", -F.col("seq"))).alias("better")), ["job_id", "clip_id"], "left")


def snapped_to_words(clips: DataFrame, words: DataFrame, margin: float = 2.0, pre: float = 0.3, post: float = 0.5, least: float = 15.0) -> DataFrame:
    """(job_id, clip_id, c0, c1): clips moved to the start of the word nearest to their start, less ``pre``, and the end of
    the one nearest to their end, plus ``post``. Words (w0, w1, s0, s1) count if their segment (s0, s1) comes within
    ``margin``. Clips without words stay, as do those that would turn round or get shorter than ``least``. Clips of equal ends
    meet the words once."""
    on = (F.col("s1") >= F.col("c0") - margin) & (F.col("s0") <= F.col("c1") + margin)
    pairs = I.range_join(clips.select("job_id", "c0", "c1").distinct(), words, ["job_id"], on, (F.col("c0") - margin, F.col("c1") + margin), (F.col("s0"), F.col("s1")))
    found = pairs.groupBy("job_id", "c0", "c1").agg(F.min_by("w0", F.struct(F.round(F.abs(F.col("w0") - F.col("c0")), 6), "w0")).alias("a"), F.min_by("w1", F.struct(F.round(F.abs(F.col("w1") - F.col("c1")), 6), "w0", "w1")).alias("b"))
    rows = clips.join(found, ["job_id", "c0", "c1"], "left")
    a, b = F.greatest(F.lit(0.0), F.col("a") - pre), F.col("b") + post
    good = F.coalesce((a < b) & (F.round(b - a, 9) >= least), F.lit(False))
    return rows.select("job_id", "clip_id", F.when(good, F.round(a, 3)).otherwise(F.col("c0")).alias("c0"), F.when(good, F.round(b, 3)).otherwise(F.col("c1")).alias("c1"))


def retention_curve(clips: DataFrame, segs: DataFrame, moments: DataFrame) -> DataFrame:
    """(job_id, clip_id, score, curve): energy of a clip's thirds (words per second of speech, exclamations, questions, two
    speakers, audio moments), and the shape they make."""
    third = (F.col("c1") - F.col("c0")) / 3
    parts = clips.filter("c1 - c0 >= 10").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"p0": F.col("c0") + third * F.col("k"), "p1": F.when(F.col("k") == 2, F.col("c1")).otherwise(F.col("c0") + third * (F.col("k") + 1))})
    key = ["job_id", "clip_id", "k"]
    said = I.range_join(parts, segs, ["job_id"], (F.col("t1") > F.col("p0")) & (F.col("t0") < F.col("p1")), (F.col("p0"), F.col("p1")), (F.col("t0"), F.col("t1")))
    points = F.sum(F.when(F.col("text").contains("!"), 8).otherwise(0) + F.when(F.col("text").contains("?"), 6).otherwise(0))
    said = said.groupBy(*key).agg(F.sum("n_words").alias("words"), F.round(F.sum(F.least("t1", "p1") - F.greatest("t0", "p0")), 6).alias("sec"), points.alias("points"), F.countDistinct("speaker").alias("speakers"))
    heard = I.range_join(parts, moments.select("job_id", "t"), ["job_id"], (F.col("t") >= F.col("p0")) & (F.col("t") <= F.col("p1")), (F.col("p0"), F.col("p1")), (F.col("t"), F.col("t"))).groupBy(*key).agg(F.count(F.lit(1)).alias("heard"))
    rows = parts.join(said, key, "left").join(heard, key, "left").fillna(0, ["words", "points", "speakers", "heard"]).fillna(0.0, ["sec"])
    rate = F.when(F.col("sec") > 0, F.least(F.lit(40), F.floor(F.col("words") / F.col("sec") * 12))).otherwise(0)
    rows = rows.withColumn("e", F.least(F.lit(100), rate + F.col("points") + F.when(F.col("speakers") >= 2, 10).otherwise(0) + F.col("heard") * 8))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("e")))
    found = rows.groupBy("job_id", "clip_id").agg(pick(0).alias("o"), pick(1).alias("m"), pick(2).alias("c"))
    o, m, c = F.col("o"), F.col("m"), F.col("c")
    uneven, even = o * 0.4 + m * 0.3 + c * 0.3, o * 0.35 + m * 0.30 + c * 0.35
    shape = [((m < 20) & (o > 40), "energy_valley", uneven * 0.7), (o < 25, "slow_start", uneven * 0.8), ((c < 20) & (o > 40), "fizzle_ending", uneven * 0.75), ((o > 50) & (m > 30) & (c > 40), "sustained_energy", even)]
    curve, score = F.lit("moderate"), even
    for condition, name, value in reversed(shape):
        curve, score = F.when(condition, name).otherwise(curve), F.when(condition, value).otherwise(score)
    found = found.select("job_id", "clip_id", F.floor(F.round(score, 9)).cast("int").alias("score"), curve.alias("curve"))
    return clips.select("job_id", "clip_id").join(found, ["job_id", "clip_id"], "left").select("job_id", "clip_id", F.coalesce("score", F.lit(50)).alias("score"), F.coalesce("curve", F.lit("too_short_to_measure")).alias("curve"))


def hook_strength(clips: DataFrame, segs: DataFrame, curious: list[str]) -> DataFrame:
    """(job_id, clip_id, hook): .3 without words in the first three seconds, else .5 and bonuses, at most 1."""
    pairs = I.range_join(clips, segs, ["job_id"], (F.col("t0") < F.col("c0") + 3) & (F.col("t1") > F.col("c0")), (F.col("c0"), F.col("c0") + 3), (F.col("t0"), F.col("t1")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    rows = pairs.groupBy("job_id", "clip_id").agg(text.alias("text"), F.sum("n_words").alias("n"))
    low = F.lower("text")
    found: Column = F.lit(False)
    for w in curious:
        found = found | low.contains(w)
    bonus = lambda condition, value: F.when(condition, value).otherwise(0.0)
    score = 0.5 + bonus(F.col("text").contains("?"), 0.15) + bonus(F.col("text").contains("!"), 0.1) + bonus(F.col("n").between(3, 15), 0.1) + bonus(found, 0.15)
    return clips.select("job_id", "clip_id").join(rows, ["job_id", "clip_id"], "left").select("job_id", "clip_id", F.when(F.col("text").isNull(), 0.3).otherwise(F.round(F.least(F.lit(1.0), score), 6)).alias("hook"))
