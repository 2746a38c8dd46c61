"""Hot zones and the scores they are made of, over transcript segments, scenes and audio moments.

Windows start every ``step`` seconds and last ``length``, the last cut at the job's end. An item finds its windows by
arithmetic on its time (it lies in at most length / step + 1 of them), so all joins are equi joins on (job, window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.functions.numbers import rounded

#: Points of audio moments.
AUDIO_POINTS = {"extreme_spike": 30, "silence_to_loud": 25, "volume_spike": 15}


def durations(segs: DataFrame) -> DataFrame:
    return segs.groupBy("job_id").agg(F.max("t1").alias("duration"))


def zones(spans: DataFrame, length: float = 30.0, step: float = 20.0) -> DataFrame:
    """(job_id, k, w0, w1) for (job_id, duration)."""
    n = F.ceil(F.col("duration") / step).cast("int")
    rows = spans.filter("duration > 0").select("job_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select("job_id", "k", (F.col("k") * step).alias("w0"), F.least(F.col("k") * step + length, F.col("duration")).alias("w1"))


def in_zones(rows: DataFrame, zone: DataFrame, t0: Column, t1: Column, length: float = 30.0, step: float = 20.0) -> DataFrame:
    """Rows with every zone that contains [t0, t1] (closed)."""
    first = F.greatest(F.lit(0), F.ceil((t1 - length) / step)).cast("int")
    last = F.floor(t0 / step).cast("int")
    some = rows.filter(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    return some.join(zone, ["job_id", "k"]).filter((t0 >= F.col("w0")) & (t1 <= F.col("w1")))


def audio_moments(events: DataFrame, floor_db: float = -60.0, most: int = 25) -> DataFrame:
    """Spikes of a series (job_id, event_id, t, value) against its upper median: (job_id, t, value, delta, kind)."""
    job = Window.partitionBy("job_id")
    loud = F.col("value") > floor_db
    # of each job's loud rows by value the upper middle one; quiet rows are numbered after them
    rows = events.withColumns({"rn": F.row_number().over(job.orderBy(F.when(loud, 0).otherwise(1), "value", "event_id")), "n": F.count_if(loud).over(job)})
    middle = loud & (F.col("rn") == F.floor(F.col("n") / 2) + 1)
    rows = rows.withColumns({"base": F.max(F.when(middle, F.col("value"))).over(job), "prev": F.lag("value").over(job.orderBy("t", "event_id"))})
    rows = rows.withColumn("delta", F.round(F.col("value") - F.col("base"), 4))
    quiet = (F.col("prev") < F.col("base") - 10) & (F.col("value") > F.col("base") + 6)
    rows = rows.withColumn("kind", F.when(quiet, "silence_to_loud").when(F.col("delta") > 12, "extreme_spike").when(F.col("delta") > 6, "volume_spike")).filter("kind is not null")
    top = job.orderBy(F.desc("delta"), "t", "event_id")
    return rows.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= most).select("job_id", "event_id", "t", "value", "delta", "kind")


def audio_points() -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in AUDIO_POINTS.items()], F.lit(0))


def audio_score(moments: DataFrame, zone: DataFrame) -> DataFrame:
    return in_zones(moments, zone, F.col("t"), F.col("t")).groupBy("job_id", "k").agg(F.least(F.lit(100), F.sum(audio_points())).alias("audio"))


def segment_points() -> Column:
    """Points of a segment for exclamations, questions, shouting, reactions and fast speech."""
    points = X.flag(X.has("!"), 8) + X.flag(X.has("?"), 6) + X.flag(X.shouts(F.col("text")), 10) + X.flag(X.reacts(F.col("text")), 12)
    return points + X.flag((F.col("n_words") > 3) & (F.col("t1") - F.col("t0") < 3), 5)


def transcript_score(segs: DataFrame, zone: DataFrame) -> DataFrame:
    """Points of contained segments for exclamations, questions, shouting, reactions, fast speech; and density."""
    found = in_zones(segs.withColumn("__p", segment_points()), zone, F.col("t0"), F.col("t1")).groupBy("job_id", "k", "w0", "w1").agg(F.sum("__p").alias("p"), F.count(F.lit(1)).alias("n"))
    dense = F.col("n") / F.greatest(F.lit(1.0), (F.col("w1") - F.col("w0")) / 10.0) > 2
    return found.select("job_id", "k", F.least(F.lit(100), F.col("p") + F.when(dense, 10).otherwise(0)).alias("transcript"))


def scene_score(scenes: DataFrame, zone: DataFrame) -> DataFrame:
    found = in_zones(scenes, zone, F.col("t"), F.col("t")).groupBy("job_id", "k").agg(F.max("importance").alias("m"), F.avg("importance").alias("a"))
    return found.select("job_id", "k", F.least(F.lit(100.0), F.col("m") * 6 + F.col("a") * 4 + F.when(F.col("m") >= 9, 20).otherwise(0)).alias("scenes"))


def speaker_score(segs: DataFrame, zone: DataFrame) -> DataFrame:
    """Two speakers and changes among the segments of a window."""
    rows = in_zones(segs, zone, F.col("t0"), F.col("t1"))
    before = F.lag("speaker").over(Window.partitionBy("job_id", "k").orderBy("seq"))
    rows = rows.withColumn("turn", (before.isNotNull() & (before != F.col("speaker"))).cast("int"))
    found = rows.groupBy("job_id", "k").agg(F.countDistinct("speaker").alias("s"), F.sum("turn").alias("c"))
    return found.select("job_id", "k", (F.when(F.col("s") >= 2, 20).otherwise(0) + F.when(F.col("c") >= 3, 25).when(F.col("c") >= 1, 10).otherwise(0)).alias("speakers"))


def filler_events(segs: DataFrame) -> DataFrame:
    """Whole-segment fillers, immediate repetitions (the first of a segment) and dead air: (job_id, seq, kind, t0, t1)."""
    whole = F.lower(F.trim(F.regexp_replace("text", r"[.,!?]", ""))).isin(*X.FILLERS)
    w = F.transform(X.words(F.col("text")), lambda x: F.regexp_replace(F.lower(x), r"[.,!?]", ""))
    pairs = lambda v: F.zip_with(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), v, lambda a, b: F.coalesce((a == b) & (F.length(a) > 1), F.lit(False)))
    again = F.coalesce(X.bound(w, lambda v: F.exists(pairs(v), lambda same: same)), F.lit(False))
    prev = F.lag("t1").over(Window.partitionBy("job_id").orderBy("seq"))
    event = lambda kind, t0, t1: F.struct(F.lit(kind).alias("kind"), F.col(t0).alias("t0"), F.col(t1).alias("t1"))
    own = F.when(F.col("__whole"), event("filler", "t0", "t1")).when(F.col("__again"), event("repetition", "t0", "t1"))
    air = F.when(F.col("t0") - F.col("__prev") > 1.5, event("dead_air", "__prev", "t0"))
    rows = segs.select("job_id", "seq", "t0", "t1", whole.alias("__whole"), again.alias("__again"), prev.alias("__prev"))
    return rows.select("job_id", "seq", F.explode(F.array_compact(F.array(own, air))).alias("e")).select("job_id", "seq", "e.kind", "e.t0", "e.t1")


def filler_density(events: DataFrame, zone: DataFrame) -> DataFrame:
    """Contained filler events per minute of a window."""
    found = in_zones(events, zone, F.col("t0"), F.col("t1")).groupBy("job_id", "k", "w0", "w1").agg(F.count(F.lit(1)).alias("n"))
    return found.select("job_id", "k", (F.col("n") / F.greatest((F.col("w1") - F.col("w0")) / 60.0, F.lit(0.01))).alias("density"))


def _all_zones(rows: DataFrame, t0: Column, t1: Column, length: float, step: float) -> DataFrame:
    """Rows (with their job's ``duration``) with the number ``k`` of every zone that contains [t0, t1]."""
    first = F.greatest(F.lit(0), F.ceil((t1 - length) / step)).cast("int")
    last = F.least(F.floor(t0 / step), F.ceil(F.col("duration") / step) - 1).cast("int")
    return rows.filter((last >= first) & (t1 <= F.col("duration"))).withColumn("k", F.explode(F.sequence(first, last)))


def hot_zones(segs: DataFrame, scenes: DataFrame, moments: DataFrame, length: float = 30.0, step: float = 20.0) -> DataFrame:
    """Composite per window: .25 audio + .35 transcript + .25 scenes + .15 speakers, less a penalty for fillers.

    A window's ends follow from its number and the job's duration, so nothing is joined with windows: what counts for
    them (the windows themselves, segments, fillers, scenes, moments) is one stream of rows, aggregated once."""
    spans = durations(segs).filter("duration > 0")
    null = lambda kind: F.lit(None).cast(kind)
    fields = {"audio": "int", "points": "int", "importance": "long", "filler": "int", "turn": "struct<seq:long,speaker:string>"}

    def part(rows: DataFrame, **values: Column) -> DataFrame:
        return rows.select("job_id", "k", "duration", *[values.get(name, null(kind)).cast(kind).alias(name) for name, kind in fields.items()])

    def placed(rows: DataFrame, t0: str, t1: str) -> DataFrame:
        return _all_zones(rows.join(spans, "job_id"), F.col(t0), F.col(t1), length, step)

    every = part(spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / step).cast("int") - 1))))
    turn = F.struct(F.col("seq").cast("long").alias("seq"), F.col("speaker").alias("speaker"))
    for rows in (
        part(placed(segs.withColumn("p", segment_points()), "t0", "t1"), points=F.col("p"), turn=turn),
        part(placed(filler_events(segs), "t0", "t1"), filler=F.lit(1)),
        part(placed(scenes, "t", "t"), importance=F.col("importance")),
        part(placed(moments, "t", "t"), audio=audio_points()),
    ):
        every = every.unionByName(rows)
    found = every.groupBy("job_id", "k").agg(
        F.max("duration").alias("duration"),
        F.sum("audio").alias("a"),
        F.sum("points").alias("p"),
        F.count("points").alias("n"),
        F.max("importance").alias("m"),
        F.avg("importance").alias("mean"),
        F.count("filler").alias("fillers"),
        F.array_sort(F.collect_list("turn")).alias("turns"),
    )
    w0 = F.col("k") * F.lit(step)
    found = found.withColumns({"w0": w0, "w1": F.least(w0 + length, F.col("duration"))})
    turns = F.transform("turns", lambda x: x["speaker"])
    changes = F.size(F.filter(F.zip_with(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))), turns, lambda a, b: a.isNotNull() & (a != b)), lambda x: x))
    n_speakers = F.size(F.array_distinct(F.filter(turns, lambda x: x.isNotNull())))
    length_s = F.col("w1") - F.col("w0")
    dense = F.col("n") / F.greatest(F.lit(1.0), length_s / 10.0) > 2
    density = F.col("fillers") / F.greatest(length_s / 60.0, F.lit(0.01))
    found = found.withColumns(
        {
            "audio": F.least(F.lit(100), F.coalesce("a", F.lit(0))).cast("long"),
            "transcript": F.when(F.col("n") > 0, F.least(F.lit(100), F.col("p") + F.when(dense, 10).otherwise(0))).otherwise(0).cast("long"),
            "scenes": F.when(F.col("m").isNotNull(), F.least(F.lit(100.0), F.col("m") * 6 + F.col("mean") * 4 + F.when(F.col("m") >= 9, 20).otherwise(0))).otherwise(0.0),
            "speakers": F.when(n_speakers >= 2, 20).otherwise(0) + F.when(changes >= 3, 25).when(changes >= 1, 10).otherwise(0),
            "penalty": F.when(density > 6, 15).when(density > 3, 8).otherwise(0),
        }
    )
    score = F.greatest(F.lit(0.0), 0.25 * F.col("audio") + 0.35 * F.col("transcript") + 0.25 * F.col("scenes") + 0.15 * F.col("speakers") - F.col("penalty"))
    return found.select("job_id", "k", "w0", "w1", rounded(score, 1).alias("score"), "audio", "transcript", rounded("scenes", 4).alias("scenes"), "speakers")


def top_zones(zoned: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy(F.desc("score"), "w0")
    return zoned.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
