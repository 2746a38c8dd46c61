"""Scores and repairs of clip candidates against the transcript: hook, arc, comprehension, retention, boundary snapping.

Clips are (job_id, clip_id, c0, c1); segments (job_id, seq, speaker, text, n_words, t0, t1). Every join is a bucketed range
join per job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.intervals import range_join

# Word lists of the hook rules.
WEAK_OPENERS = ["um", "uh", "like", "so", "and", "but", "well", "yeah"]
PRONOUNS = ["that", "this", "it", "they", "he", "she", "those", "these"]
LINKING = ["is", "was", "were", "are", "'s", "thing"]
REACTION_OPENERS = ["wow", "oh", "wait", "no", "what", "holy", "damn", "yo", "bro"]
BOLD = ["never", "always", "the truth", "the real", "actually", "honestly", "people don't", "nobody", "everybody", "the best", "the worst"]
ENERGY = ["!", "?"]


def _lower_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def _in(word: Column, listed: list[str]) -> Column:
    return F.coalesce(word.isin(*listed), F.lit(False))


def opening(starts: DataFrame, segs: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Per start (job_id, c0) the segments that overlap the seconds after it: first start, first speaker, all text."""
    pairs = range_join(starts, segs, ["job_id"], (F.col("t0") < F.col("c0") + seconds) & (F.col("t1") > F.col("c0")), (F.col("c0"), F.col("c0") + seconds), (F.col("t0"), F.col("t1")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"])
    return pairs.groupBy("job_id", "c0").agg(F.min("t0").alias("first_t0"), F.min_by("speaker", "seq").alias("first_speaker"), F.array_join(texts, " ").alias("text"))


def previous_speaker(starts: DataFrame, segs: DataFrame) -> DataFrame:
    """Per start (job_id, c0) the speaker of the latest segment that ends within (start - 2, start + .5]."""
    pairs = range_join(starts, segs, ["job_id"], (F.col("t1") > F.col("c0") - 2) & (F.col("t1") <= F.col("c0") + 0.5), (F.col("c0") - 2, F.col("c0") + 0.5), (F.col("t1"), F.col("t1")))
    return pairs.groupBy("job_id", "c0").agg(F.max_by("speaker", F.struct("t1", "seq")).alias("before_speaker"))


def hook_score(clips: DataFrame, segs: DataFrame) -> DataFrame:
    """Hook strength 0-100 of every clip; 15 where nothing is said at its start. Only the start counts, so clips that start
    together are scored once."""
    starts = clips.select("job_id", "c0").distinct()
    rows = opening(starts, segs).join(previous_speaker(starts, segs), ["job_id", "c0"], "left")
    w = _lower_words(F.col("text"))
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    low = F.lower("text")
    bold = F.lit(False)
    for b in BOLD:
        bold = bold | low.contains(b)
    score = F.lit(50) - F.when(F.col("first_t0") - F.col("c0") > 0.5, 25).otherwise(0) - F.when(_in(first, WEAK_OPENERS), 20).otherwise(0)
    score = score - F.when(_in(first, PRONOUNS) & _in(second, LINKING), 15).otherwise(0) + F.when(F.array_join(F.slice(w, 1, 6), " ").contains("?"), 25).otherwise(0)
    score = score + F.when(_in(first, REACTION_OPENERS), 20).otherwise(0) + F.when(F.coalesce(F.col("before_speaker") != F.col("first_speaker"), F.lit(False)), 15).otherwise(0)
    score = score + F.when(low.contains("!"), 10).otherwise(0) + F.when(bold, 15).otherwise(0)
    hooks = rows.filter("text is not null").select("job_id", "c0", F.least(F.lit(100), F.greatest(F.lit(0), score)).alias("hook"))
    return clips.select("job_id", "clip_id", "c0").join(hooks, ["job_id", "c0"], "left").select("job_id", "clip_id", F.coalesce("hook", F.lit(15)).cast("int").alias("hook"))


def snapped(clips: DataFrame, segs: DataFrame, reach: float = 3.0) -> DataFrame:
    """Clip edges moved to the nearest segment edge within reach: the start only back or up to .5 s on, the end only on
    or up to .5 s back; of equally near edges the earlier."""
    near0 = range_join(clips, segs.select("job_id", "t0"), ["job_id"], (F.abs(F.col("t0") - F.col("c0")) <= reach) & (F.col("t0") <= F.col("c0") + 0.5), (F.col("c0") - reach, F.col("c0") + reach), (F.col("t0"), F.col("t0")))
    near1 = range_join(clips, segs.select("job_id", "t1"), ["job_id"], (F.abs(F.col("t1") - F.col("c1")) <= reach) & (F.col("t1") >= F.col("c1") - 0.5), (F.col("c1") - reach, F.col("c1") + reach), (F.col("t1"), F.col("t1")))
    a = near0.groupBy("job_id", "clip_id").agg(F.min_by("t0", F.struct(F.round(F.abs(F.col("t0") - F.col("c0")), 6), F.col("t0"))).alias("s0"))
    b = near1.groupBy("job_id", "clip_id").agg(F.min_by("t1", F.struct(F.round(F.abs(F.col("t1") - F.col("c1")), 6), F.col("t1"))).alias("s1"))
    rows = clips.join(a, ["job_id", "clip_id"], "left").join(b, ["job_id", "clip_id"], "left")
    s0, s1 = F.coalesce("s0", "c0"), F.coalesce("s1", "c1")
    sound = s1 > s0
    return rows.select("job_id", "clip_id", F.when(sound, s0).otherwise(F.col("c0")).alias("c0"), F.when(sound, s1).otherwise(F.col("c1")).alias("c1"))


def emotional_arc(clips: DataFrame, segs: DataFrame) -> DataFrame:
    """Energy (exclamations, questions, length) of the later half of a clip's segments against the earlier."""
    energy = F.least(F.lit(1.0), F.when(F.col("text").contains("!"), 0.4).otherwise(0.0) + F.when(F.col("text").contains("?"), 0.3).otherwise(0.0) + F.col("n_words") / 100.0)
    pairs = range_join(clips, segs.withColumn("e", energy), ["job_id"], (F.col("t0") >= F.col("c0")) & (F.col("t1") <= F.col("c1")), (F.col("c0"), F.col("c1")), (F.col("t0"), F.col("t1")))
    listed = pairs.groupBy("job_id", "clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda s: s["e"]).alias("e"))
    half = F.floor(F.size("e") / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    diff = F.round(mean(F.slice("e", half + 1, F.size("e") - half)) - mean(F.slice("e", F.lit(1), half)), 9)
    return listed.select("job_id", "clip_id", F.when(F.size("e") < 2, 0.5).when(diff > 0.1, 0.8).when(F.abs(diff) < 0.05, 0.4).otherwise(0.6).alias("arc"))


def retention_curve(rows: DataFrame, points: int = 20) -> DataFrame:
    """The expected share of viewers along a clip from its scores hook, pacing, visual and arc (0 to 1)."""
    p = F.col("i") / F.lit(float(points - 1))
    h, c, v, a = (F.col(x) for x in ("hook", "pacing", "visual", "arc"))
    drop1, drop2 = (1 - h) * 25, (1 - (c + v) / 2) * 20
    last = F.when(a > 0.6, (a - 0.6) * 10).otherwise(-(1 - a) * 10)
    y = F.when(p <= 0.05, F.lit(100.0)).when(p <= 0.15, 100 - drop1 * (p - 0.05) / 0.1).when(p <= 0.8, 100 - drop1 - drop2 * (p - 0.15) / 0.65).otherwise(100 - drop1 - drop2 + last * (p - 0.8) / 0.2)
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("y", F.round(F.least(F.lit(100.0), F.greatest(F.lit(20.0), y)), 4))


# What the parts of a clip's retention weigh.
RETENTION = {"hook": 0.25, "pacing": 0.15, "visual": 0.15, "arc": 0.25, "standalone": 0.20}


def predicted_retention(rows: DataFrame) -> DataFrame:
    """Clips (..., hook, pacing, visual, arc, standalone: 0 to 1) with ``overall``, of 100, their parts as whole percents, and
    their ``rank`` in the job, the best first (of equals the lower clip_id). A clip with a part that couldn't be told has no
    parts and counts 50."""
    told = F.lit(True)
    for c in RETENTION:
        told = told & F.col(c).isNotNull()
    overall = sum((F.col(c) * w for c, w in RETENTION.items()), F.lit(0.0))
    whole = lambda v: F.bround(F.round(v * 100, 9)).cast("int")
    rows = rows.withColumn("overall", F.when(told, whole(overall)).otherwise(50))
    rows = rows.withColumn("rank", F.rank().over(Window.partitionBy("job_id").orderBy(F.desc("overall"), "clip_id")))
    return rows.withColumns({c: F.when(told, whole(F.col(c))) for c in RETENTION})


def adjusted(score: Column, hook: Column, retention: Column) -> Column:
    """Score moved by parts of hook and retention above or below 50, each step cut to 1..100."""
    step = lambda s, d: F.least(F.lit(100), F.greatest(F.lit(1), s + d.cast("int")))
    return step(step(score, (hook - 50) * 0.2), (retention - 50) * 0.15)


def detection_windows(ends: DataFrame, length: float, overlap: float, cap: int) -> DataFrame:
    """Windows of a job for candidate detection, thinned evenly to ``cap`` (the last stays): (job_id, k, w0, w1)."""
    step = length - overlap
    n = F.greatest(F.lit(1), F.ceil((F.col("duration") - overlap) / step)).cast("int")
    rows = ends.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    stride = F.col("n") / F.lit(float(cap))
    kept = (F.col("n") <= cap) | (F.col("k") == F.col("n") - 1) | (F.floor(F.ceil(F.col("k") / stride) * stride) == F.col("k")) & (F.ceil(F.col("k") / stride) < cap - 1)
    return rows.filter(kept).select("job_id", "k", (F.col("k") * step).alias("w0"), F.least(F.col("k") * step + length, F.col("duration")).alias("w1"))
