"""Which speaker's slot a stretch of time shows: visible faces, dominance, spread, and the ladder of fallbacks.

Faces are rows (job_id, event_id, t, slot, x, y, w, h), one per face of a frame; spans are (job_id, seq, t0, t1). Faces meet
spans in one range join; what follows works on one small array of (slot, frames) per span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.numbers import rounded
from rivulet.operators import folds as D
from rivulet.operators import intervals as I

#: Shares of frames: a slot that dominates, another that denies it that, and one that is there at all.
DOMINANT, RIVAL, PRESENT = 0.70, 0.30, 0.20
#: A group fits a crop if its spread is under this share of the crop's width.
FITS = 0.85


def crop_width(source: float = 16 / 9, target: float = 9 / 16) -> float:
    """Width of the crop window in percent of the source."""
    return target / source * 100 if target < source else 100.0


def crop_bounds(x: Column, width: float) -> tuple[Column, Column]:
    """Left and right end of a crop around x, moved into the frame."""
    left, right = x - width / 2, x + width / 2
    return F.when(right > 100, 100 - width).when(left < 0, 0.0).otherwise(left), F.when(right > 100, 100.0).when(left < 0, width).otherwise(right)


def in_spans(spans: DataFrame, faces: DataFrame, pad: float = 0.0) -> DataFrame:
    """Faces with every span that holds their time (both ends count)."""
    t0, t1 = F.col("t0") - pad, F.col("t1") + pad
    return I.range_join(spans, faces, ["job_id"], (F.col("t") >= t0) & (F.col("t") <= t1), (t0, t1), (F.col("t"), F.col("t")), width=60.0)


def visible(spans: DataFrame, faces: DataFrame) -> DataFrame:
    """(job_id, seq, total, seen): frames with faces in each span that has any, and [(frames, slot)] of its known slots, the
    most seen first, of equals the lower slot."""
    found = in_spans(spans, faces.select("job_id", "event_id", "t", "slot").distinct())
    per_slot = found.groupBy("job_id", "seq", "slot").agg(F.count(F.lit(1)).alias("n"))
    total = found.groupBy("job_id", "seq").agg(F.countDistinct("event_id").alias("total"))
    seen = per_slot.groupBy("job_id", "seq").agg(F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, F.struct((-F.col("n")).alias("less"), "slot", "n")))).alias("seen"))
    return total.join(seen, ["job_id", "seq"])


def dominant() -> Column:
    """The slot of a ``seen`` array that stands in 70 % of the frames and more, if no other has 30 %."""
    share = lambda s: s["n"] / F.col("total")
    best = F.get("seen", F.lit(0))
    rivals = F.exists(F.slice("seen", F.lit(2), F.greatest(F.size("seen") - 1, F.lit(0))), lambda s: share(s) >= RIVAL)
    return F.when((F.size("seen") > 0) & (share(best) >= DOMINANT) & ~rivals, best["slot"])


def present() -> Column:
    """Slots in a fifth of the frames and more."""
    return F.filter("seen", lambda s: s["n"] / F.col("total") >= PRESENT)


def registry(faces: DataFrame) -> DataFrame:
    """(job_id, slot, x_center, x_min, x_max, frame_count, avg_width, avg_y, y_dev): the known slots of a job."""
    known = faces.filter("slot >= 0")
    return known.groupBy("job_id", "slot").agg(
        rounded(F.avg("x"), 6).alias("x_center"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.countDistinct("event_id").alias("frame_count"),
        rounded(F.avg("w"), 6).alias("avg_width"),
        rounded(F.avg("y"), 6).alias("avg_y"),
        rounded(F.stddev_pop("y"), 6).alias("y_dev"),
    )


_CHOICE = "slot int, confidence double, layout string, source string"


def choice(slot: Column, confidence: Column, layout: str, source: str) -> Column:
    return F.struct(slot.cast("int").alias("slot"), rounded(confidence, 6).alias("confidence"), F.lit(layout).alias("layout"), F.lit(source).alias("source"))


def spread(seen: DataFrame, slots: DataFrame, majority: DataFrame) -> DataFrame:
    """(job_id, seq, spread_choice) of spans with two present slots or more that have places: the one nearest to the middle
    if all fit one crop, else the active speaker if it is present, else the most seen."""
    each = seen.withColumn("s", F.explode(present())).select("job_id", "seq", F.col("s.slot").alias("slot"), F.col("s.n").alias("n"))
    rows = each.join(slots.select("job_id", "slot", "x_center"), ["job_id", "slot"])
    w = Window.partitionBy("job_id", "seq")
    rows = rows.withColumns({"cx": F.avg("x_center").over(w), "k": F.count(F.lit(1)).over(w)}).filter("k >= 2")
    found = rows.groupBy("job_id", "seq").agg(
        (F.max("x_center") - F.min("x_center")).alias("span"),
        F.min_by("slot", F.struct(rounded(F.abs(F.col("x_center") - F.col("cx")), 6).alias("d"), "slot")).alias("nearest"),
        F.max_by("slot", F.struct("n", -F.col("slot"))).alias("most"),
        F.collect_set("slot").alias("there"),
    )
    found = found.join(majority.select("job_id", "seq", F.col("slot").alias("speaker"), "coverage"), ["job_id", "seq"], "left")
    fits = F.col("span") < crop_width() * FITS
    speaks = F.coalesce(F.array_contains("there", F.col("speaker")), F.lit(False))
    picked = F.when(fits, choice(F.col("nearest"), F.lit(0.75), "single", "dense_face_dominant")).when(speaks, choice(F.col("speaker"), F.least(F.lit(1.0), F.greatest(F.lit(0.6), F.col("coverage"))), "single", "active_speaker_slot"))
    return found.select("job_id", "seq", picked.otherwise(choice(F.col("most"), F.lit(0.55), "single", "dense_face_dominant")).alias("spread_choice"))


def resolve(spans: DataFrame, turns: DataFrame, events: DataFrame, faces: DataFrame) -> DataFrame:
    """(job_id, seq, slot, confidence, layout, source): transcript turns that cover 60 % and more, else the active speaker
    of half and more, else the dominant face, else what the spread of faces gives, else the wide picture."""
    seen = visible(spans, faces)
    majority = I.slot_coverage(spans, events, digits=6)
    transcript = I.slot_coverage(spans, turns, 0.6, 6).select("job_id", "seq", F.col("slot").alias("ts"), F.col("coverage").alias("tc"))
    rows = spans.select("job_id", "seq").join(transcript, ["job_id", "seq"], "left").join(majority.withColumnsRenamed({"slot": "ms", "coverage": "mc"}), ["job_id", "seq"], "left")
    rows = rows.join(seen.select("job_id", "seq", dominant().alias("ds")), ["job_id", "seq"], "left").join(spread(seen, registry(faces), majority), ["job_id", "seq"], "left")
    picked = (
        F.when(F.col("tc") >= 0.6, choice(F.col("ts"), F.least(F.lit(1.0), F.col("tc")), "single", "active_speaker_slot"))
        .when(F.col("mc") >= 0.5, choice(F.col("ms"), F.least(F.lit(1.0), F.col("mc")), "single", "active_speaker_slot"))
        .when(F.col("ds").isNotNull(), choice(F.col("ds"), F.lit(0.7), "single", "dense_face_dominant"))
        .when(F.col("spread_choice").isNotNull(), F.col("spread_choice"))
        .otherwise(choice(F.lit(None), F.lit(0.3), "wide_master", "hardcoded_center"))
    )
    return rows.select("job_id", "seq", picked.alias("c")).select("job_id", "seq", "c.*")


def agreement(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Whether half and more of a span's spoken time is of its ``candidate`` slot: (job_id, seq, agrees)."""
    on = (F.col("s0") < F.col("t1")) & (F.col("s1") > F.col("t0"))
    pairs = I.range_join(spans, events, ["job_id"], on, (F.col("t0"), F.col("t1")), (F.col("s0"), F.col("s1")), width=60.0)
    sec = I.overlap(F.col("t0"), F.col("t1"), F.col("s0"), F.col("s1"))
    found = pairs.groupBy("job_id", "seq").agg(F.round(F.sum(sec), 6).alias("total"), F.round(F.sum(F.when(F.col("slot") == F.col("candidate"), sec).otherwise(0.0)), 6).alias("own"))
    found = spans.select("job_id", "seq").join(found, ["job_id", "seq"], "left")
    return found.select("job_id", "seq", F.coalesce((F.col("total") > 0) & (F.col("own") / F.col("total") >= 0.5), F.lit(False)).alias("agrees"))


def faces_in_crop(spans: DataFrame, faces: DataFrame, width: float) -> DataFrame:
    """(job_id, seq, n_in, n_faces, inside): known faces of a span, those within its crop (at ``cx``), and whether they are
    30 % and more."""
    left, right = crop_bounds(F.col("cx"), width)
    found = in_spans(spans, faces.filter("slot >= 0")).groupBy("job_id", "seq").agg(F.count_if(F.col("x").between(left, right)).alias("n_in"), F.count(F.lit(1)).alias("n_faces"))
    found = spans.select("job_id", "seq").join(found, ["job_id", "seq"], "left").fillna(0, ["n_in", "n_faces"])
    return found.withColumn("inside", F.coalesce(F.col("n_in") / F.nullif(F.col("n_faces"), F.lit(0)) >= 0.3, F.lit(False)))


def face_near_middle(spans: DataFrame, faces: DataFrame, width: float, near: float = 0.5) -> DataFrame:
    """The spans with a known face inside their crop within half a second of their middle."""
    left, right = crop_bounds(F.col("cx"), width)
    middle = (F.col("t0") + F.col("t1")) / 2
    on = (F.abs(F.col("t") - middle) <= near) & F.col("x").between(left, right)
    return I.range_join(spans, faces.filter("slot >= 0").select("job_id", "t", "x"), ["job_id"], on, (middle - near, middle + near), (F.col("t"), F.col("t")), how="left_semi")


def first_clipped(spans: DataFrame, features: DataFrame, width: float) -> DataFrame:
    """(job_id, seq, clipped): the first feature (f0, f1, left, right, name, place) that overlaps a span in time and leaves
    its crop (at ``cx``), or null where all fit."""
    left, right = crop_bounds(F.col("cx"), width)
    on = (F.col("f1") >= F.col("t0")) & (F.col("f0") <= F.col("t1")) & ((F.col("left") < left) | (F.col("right") > right))
    bad = I.range_join(spans, features, ["job_id"], on, (F.col("t0"), F.col("t1")), (F.col("f0"), F.col("f1")), width=60.0)
    return spans.select("job_id", "seq").join(bad.groupBy("job_id", "seq").agg(F.min_by("name", "place").alias("clipped")), ["job_id", "seq"], "left")


def positions_of(spans: DataFrame, faces: DataFrame) -> DataFrame:
    """(job_id, seq, t, x): the first face of every frame in [t0, t1) that is of the span's ``candidate`` slot, or any if
    that is null."""
    on = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")) & (F.col("candidate").isNull() | (F.col("slot") == F.col("candidate")))
    rows = I.range_join(spans, faces.select("job_id", "event_id", "t", "k", "slot", "x"), ["job_id"], on, (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t")), width=60.0)
    return rows.groupBy("job_id", "seq", "event_id", "t").agg(F.min_by("x", "k").alias("x")).drop("event_id")


def continuous_motion(slots: DataFrame) -> DataFrame:
    """(job_id, moving): the slots' places range over so much that nobody keeps a place."""
    found = slots.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_count").alias("frames"), F.round(F.avg(F.col("x_max") - F.col("x_min")), 6).alias("mean"), F.max_by(F.struct("frame_count", (F.col("x_max") - F.col("x_min")).alias("range")), F.struct("frame_count", -F.col("slot"))).alias("top"))
    one = F.col("n") == 1
    return found.select("job_id", F.when(one, F.col("top.range") > 15).otherwise(((F.col("top.frame_count") / F.col("frames") > 0.6) & (F.col("top.range") > 20)) | (F.col("mean") > 15)).alias("moving"))


def corner_of(x: Column, y: Column, aside: float = 15.0, off: float = 10.0) -> Column:
    """Name of the corner of a place in percent, so far aside from the middle and so far off its height, or null."""
    side = F.when(x < 50 - aside, "left").when(x > 50 + aside, "right")
    row = F.when(y > 50 + off, "bottom").when(y < 50 - off, "top")
    return F.when(side.isNotNull() & row.isNotNull(), F.concat(row, F.lit("_"), side))


def layout_votes(frames: DataFrame) -> Column:
    """The layout of a frame with ``faces`` (slot, w) and ``screen``: screenshare, triple, split or single."""
    known = F.filter("faces", lambda f: f["slot"] >= 0)
    ids = F.array_distinct(F.transform(known, lambda f: f["slot"]))
    sizes = F.reverse(F.array_sort(F.transform(ids, lambda i: F.array_max(F.transform(F.filter(known, lambda f: f["slot"] == i), lambda f: f["w"])))))
    widths = F.reverse(F.array_sort(F.transform("faces", lambda f: f["w"])))
    second = lambda a: F.coalesce(F.get(a, F.lit(1)) > 5.0, F.lit(False))
    n = F.size(ids)
    return F.when(F.col("screen") & (F.size("faces") >= 1), "screenshare").when(n >= 3, "triple").when(n == 2, F.when(second(sizes), "split").otherwise("single")).when((F.size("faces") >= 2) & second(widths), "split").otherwise("single")


def layout_timeline(votes: DataFrame, slots: DataFrame, least: float = 2.0) -> DataFrame:
    """(job_id, t0, t1, layout, transition, left_slot, right_slot, default_layout, changes): stretches of one layout for votes
    (job_id, event_id, t, slot: the layout), none shorter than ``least`` if a neighbour can take it. The first is cut to, the
    others dissolve; split ones show the two leftmost slots of a registry (job_id, slot, x_center) of two and more. The
    default is the layout of most time, of equals the one seen first."""
    rows = D.fold(votes, "job_id", ["t", "event_id"], lambda r: D.smoothed_votes(r, least), "job_id long, t0 double, t1 double, slot string").withColumnRenamed("slot", "layout")
    time = rows.groupBy("job_id", "layout").agg(F.round(F.sum(F.col("t1") - F.col("t0")), 6).alias("time"), F.min("t0").alias("since"), F.count(F.lit(1)).alias("n"))
    most = time.groupBy("job_id").agg(F.min_by("layout", F.struct(-F.col("time"), F.col("since"))).alias("default_layout"), (F.sum("n") - 1).alias("changes"), F.min("since").alias("first"))
    pair = slots.groupBy("job_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("x_center", "slot"))), 1, 2).alias("pair"))  # a registry's slots are few
    rows = rows.join(most, "job_id").join(pair, "job_id", "left")
    shown = (F.col("layout") == "split") & (F.size("pair") == 2)
    side = lambda i: F.when(shown, F.get("pair", F.lit(i))["slot"])
    return rows.select("job_id", "t0", "t1", "layout", F.when(F.col("t0") == F.col("first"), "cut").otherwise("dissolve").alias("transition"), side(0).alias("left_slot"), side(1).alias("right_slot"), "default_layout", "changes")


def lip_scores(spans: DataFrame, faces: DataFrame, pad: float = 0.5) -> DataFrame:
    """(job_id, seq, slot, score): how much a slot's lips (t, slot, lip, w) move in a span and ``pad`` around it: from four
    frames a second on by their speed and opening, below that by opening and size of the face; a single frame gives its
    opening."""
    rows = in_spans(spans, faces, pad)
    w = Window.partitionBy("job_id", "seq", "slot").orderBy("t")
    dt = F.col("t") - F.lag("t").over(w)
    rows = rows.withColumn("v", F.when(dt > 0, F.abs(F.col("lip") - F.lag("lip").over(w)) / dt))
    found = rows.groupBy("job_id", "seq", "slot").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("time"), F.avg("lip").alias("lip"), F.avg("w").alias("w"), F.avg("v").alias("v"))
    rate = F.when(F.col("time") > 0, (F.col("n") - 1) / F.greatest(F.col("time"), F.lit(0.01))).otherwise(0.0)
    still = F.least(F.lit(1.0), F.col("lip") * F.least(F.lit(2.0), F.col("w") / 8.0) / 0.04)
    moving = 0.6 * F.least(F.lit(1.0), F.col("v") / 0.08) + 0.4 * F.least(F.lit(1.0), F.col("lip") / 0.04)
    score = F.when(F.col("n") < 2, F.col("lip")).when(rate < 4.0, still).when(F.col("v").isNull(), 0.0).otherwise(moving)
    return found.select("job_id", "seq", "slot", F.round(score, 6).alias("score"))


def path_violations(path: DataFrame, features: DataFrame, source_width: int, crop_px: int, near: float = 0.05, slack: float = 2.0) -> DataFrame:
    """(job_id, t, names): times of a path (job_id, t, px) at which features (f0, left, right in percent, name) leave the
    crop by more than ``slack`` pixels, and which."""
    half = crop_px / 2
    px = lambda c: F.col(c) / 100.0 * source_width
    out = (px("left") < F.col("px") - half - slack) | (px("right") > F.col("px") + half + slack)
    pairs = I.range_join(path, features, ["job_id"], (F.abs(F.col("f0") - F.col("t")) < near) & out, (F.col("t") - near, F.col("t") + near), (F.col("f0"), F.col("f0")))
    return pairs.groupBy("job_id", "t").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
