"""What must stay in the picture: required regions of frames, places of people on a fixed grid of frames, and the focus of
shots.

All are joins and aggregates; what looks at the regions of one frame in order is a fold of that frame's small array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.numbers import rounded
from rivulet.operators import intervals as I

_REGION = "struct<cx:double,cy:double,hw:double,hh:double,score:double,tier:string,source:string,slot:int,most:double>"


def _iou(a: Column, b: Column) -> Column:
    """Of regions given by middles and half sizes; 0 where they don't overlap."""
    w = F.least(a["cx"] + a["hw"], b["cx"] + b["hw"]) - F.greatest(a["cx"] - a["hw"], b["cx"] - b["hw"])
    h = F.least(a["cy"] + a["hh"], b["cy"] + b["hh"]) - F.greatest(a["cy"] - a["hh"], b["cy"] - b["hh"])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = 4 * a["hw"] * a["hh"] + 4 * b["hw"] * b["hh"] - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def required_regions(faces: DataFrame, events: DataFrame, objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """(job_id, t, place, cx, cy, half_w, half_h, score, tier, source, slot): the regions of every frame that has a face row.

    Faces (job_id, t, k, slot, x, y, w, h, lip, human) are required, and score 1 for who speaks (``events`` job_id, s0, s1,
    slot, rank: the first by rank that holds the frame's time, ends included) or has lips open over .05, else .7; persons among
    objects (job_id, t, k, name, x, y, w, h) at the same hundredth of a second are required too unless they overlap a region
    before by over .3; blobs (job_id, t, k, x, y, w, h as shares from the corner, score) of 2 % of the picture and more are
    preferred, unless they overlap one before by over .5."""
    frames = faces.select("job_id", "t").distinct()
    on = (F.col("s0") <= F.col("t")) & (F.col("s1") >= F.col("t"))
    talk = I.range_join(frames, events.filter("slot >= 0").select("job_id", "s0", "s1", "rank", F.col("slot").alias("active")), ["job_id"], on, (F.col("t"), F.col("t")), (F.col("s0"), F.col("s1")))
    active = talk.groupBy("job_id", "t").agg(F.min_by("active", "rank").alias("active"))

    def region(order: int, score, tier: str, source: str, slot, most: float, scale: float = 100.0) -> Column:
        half = lambda c: F.col(c) / scale / 2
        values = [F.col("x") / scale, F.col("y") / scale, half("w"), half("h"), score, F.lit(tier), F.lit(source), slot.cast("int"), F.lit(most)]
        names = ["cx", "cy", "hw", "hh", "score", "tier", "source", "slot", "most"]
        return F.struct(F.lit(order).alias("o"), F.col("k").alias("k"), F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]).cast(_REGION).alias("r"))

    speaks = ((F.col("slot") >= 0) & (F.col("slot") == F.col("active"))) | (F.col("lip") > 0.05)
    rows = faces.filter(F.coalesce("human", F.lit(True))).join(active, ["job_id", "t"], "left")
    of_faces = rows.select("job_id", "t", region(0, F.when(F.coalesce(speaks, F.lit(False)), 1.0).otherwise(0.7), "required", "face", F.col("slot"), 2.0).alias("c"))
    at = frames.select("job_id", "t", rounded("t", 2).alias("__at"))

    def timed(rows: DataFrame, c: Column) -> DataFrame:
        own = rows.select("job_id", rounded("t", 2).alias("__at"), c.alias("c"))
        return at.join(own, ["job_id", "__at"]).select("job_id", "t", "c")

    of_objects = timed(objects.filter("name = 'person'"), region(1, F.lit(0.6), "required", "object", F.lit(-1), 0.3))
    centred = blobs.filter("w * h >= 0.02").withColumns({"x": F.col("x") + F.col("w") / 2, "y": F.col("y") + F.col("h") / 2})
    of_blobs = timed(centred, region(2, F.col("score") * 0.5, "preferred", "saliency", F.lit(-1), 0.5, 1.0))
    every = of_faces.unionByName(of_objects).unionByName(of_blobs)
    queue = every.groupBy("job_id", "t").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["r"]).alias("queue"))
    kept = F.aggregate("queue", F.array().cast(f"array<{_REGION}>"), lambda held, r: F.when(F.exists(held, lambda o: _iou(r, o) > r["most"]), held).otherwise(F.concat(held, F.array(r))))
    out = queue.select("job_id", "t", F.posexplode(kept).alias("place", "r"))
    return out.select("job_id", "t", "place", "r.cx", "r.cy", F.col("r.hw").alias("half_w"), F.col("r.hh").alias("half_h"), "r.score", "r.tier", "r.source", "r.slot")


def frame_places(frames: DataFrame, anchors: DataFrame, drift: float = 8.0) -> DataFrame:
    """(job_id, frame, t, slot, x, y, w, h, confidence, is_anchor, had_reset): where every known person is in every frame.

    Frames are (job_id, frame, t, shot); anchors (job_id, t, slot, x, y, w, h) are detections at frames of equal time to the
    millisecond. A person is followed from the anchor that shows them to the next one that does, on the line between the
    two, or, if there is none in the shot, at rest, until they are missing in two anchors running. Confidence is .95 at
    anchors, less .05 for every frame since (.4 at least). Nobody is followed over a cut. ``had_reset``: at an anchor a
    person stands ``drift`` percent or more from where the last anchor had them, and is followed anew."""
    ids = ["job_id", "shot"]
    known = anchors.filter("slot >= 0").withColumn("__at", F.round("t", 3)).drop("t")
    times = anchors.select("job_id", F.round("t", 3).alias("__at")).distinct().withColumn("is_anchor", F.lit(True))
    grid = frames.withColumn("__at", F.round("t", 3)).join(times, ["job_id", "__at"], "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    by_time = Window.partitionBy(*ids).orderBy("t", "frame")
    grid = grid.withColumn("anchor", F.sum(F.col("is_anchor").cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    grid = grid.withColumn("nth", F.row_number().over(Window.partitionBy(*ids, "anchor").orderBy("t", "frame")) - 1)
    grid = grid.withColumn("since", F.coalesce(F.lag("nth").over(by_time), F.lit(0)))

    box = ["x", "y", "w", "h"]
    seen = grid.filter("is_anchor").select(*ids, "anchor", "t", "__at").join(known, ["job_id", "__at"]).drop("__at")
    by_slot = Window.partitionBy(*ids, "slot").orderBy("anchor")
    seen = seen.withColumns({"next": F.lead(F.struct("anchor", "t", *box)).over(by_slot), "before": F.lag(F.struct("anchor", *box)).over(by_slot)})
    followed = F.col("next").isNotNull() & (F.col("next.anchor") <= F.col("anchor") + 2)
    stays = F.sequence(F.col("anchor"), F.when(followed, F.col("next.anchor") - 1).otherwise(F.col("anchor") + 1))
    own = seen.withColumns({"followed": followed, "had_reset": (F.col("before.anchor") >= F.col("anchor") - 2) & (F.abs(F.col("before.x") - F.col("x")) >= drift), "since_anchor": F.col("anchor"), "t0": F.col("t")})
    own = own.drop("before", "t").withColumn("anchor", F.explode(stays))
    rows = grid.join(own, [*ids, "anchor"])
    share = F.when(F.col("followed"), (F.col("t") - F.col("t0")) / (F.col("next.t") - F.col("t0"))).otherwise(0.0)
    here = F.col("is_anchor") & (F.col("anchor") == F.col("since_anchor"))
    confidence = F.when(here, 0.95).otherwise(F.greatest(F.lit(0.4), 0.95 - 0.05 * F.col("since")))
    place = [(F.col(c) + share * F.coalesce(F.col(f"next.{c}") - F.col(c), F.lit(0.0))).alias(c) for c in box]
    return rows.select("job_id", "frame", "t", "slot", *place, confidence.alias("confidence"), "is_anchor", (here & F.coalesce("had_reset", F.lit(False))).alias("had_reset"))


def shot_features(shots: DataFrame, features: DataFrame) -> DataFrame:
    """Features (job_id, t, ...) with the shot (job_id, seq, t0, t1) whose half-open time holds them."""
    on = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
    return I.range_join(shots.select("job_id", "seq", "t0", "t1"), features, ["job_id"], on, (F.col("t0"), F.col("t1")), (F.col("t"), F.col("t")), width=60.0)


def moving_objects(features: DataFrame, priority) -> DataFrame:
    """Objects (job_id, seq, t, name, x, y, w, h, confidence) of shots as features: ``must`` and ``weight`` by the class and
    whether it moves (two detections and more over more than five percent)."""
    w = Window.partitionBy("job_id", "seq", "name")
    moves = (F.count(F.lit(1)).over(w) >= 2) & (F.max("x").over(w) - F.min("x").over(w) > 5.0)
    rows = features.withColumn("__moves", moves).withColumn("__p", priority(F.col("name"), F.col("__moves")))
    return rows.withColumns({"must": F.col("__p.must"), "weight": F.col("__p.weight") * F.col("confidence")}).drop("__moves", "__p")


def scene_focus(shots: DataFrame, features: DataFrame, crop_width: float) -> DataFrame:
    """(job_id, seq, n_required, n_optional, rect_x, rect_y, rect_w, rect_h, fits, cx, cy) of every shot, for the features
    of all sources in one stream: (job_id, seq, x, y, w, h, weight, must, pulls). The least rectangle around what must be
    in, whether a crop holds it, and where the crop's middle goes: the weighted mean of what must be in and pulls (constraints
    such as texts don't), kept inside the picture if all fits."""
    must = F.col("must")
    pulls = must & F.col("pulls")
    weight = F.when(pulls, F.col("weight"))
    found = features.groupBy("job_id", "seq").agg(
        F.count_if(must).alias("n_required"), F.count_if(~must).alias("n_optional"), F.count_if(pulls).alias("n_pull"),
        F.min(F.when(must, F.col("x") - F.col("w") / 2)).alias("l"), F.max(F.when(must, F.col("x") + F.col("w") / 2)).alias("r"),
        F.min(F.when(must, F.col("y") - F.col("h") / 2)).alias("t"), F.max(F.when(must, F.col("y") + F.col("h") / 2)).alias("b"),
        F.sum(weight).alias("total"), F.sum(weight * F.col("x")).alias("wx"), F.sum(weight * F.col("y")).alias("wy"),
    )
    found = shots.select("job_id", "seq").join(found, ["job_id", "seq"], "left").fillna(0, ["n_required", "n_optional", "n_pull"])
    some = F.col("n_required") > 0
    rect = {"rect_x": F.when(some, (F.col("l") + F.col("r")) / 2).otherwise(50.0), "rect_y": F.when(some, (F.col("t") + F.col("b")) / 2).otherwise(50.0), "rect_w": F.when(some, F.col("r") - F.col("l")).otherwise(0.0), "rect_h": F.when(some, F.col("b") - F.col("t")).otherwise(0.0)}
    found = found.withColumns(rect).withColumn("fits", ~some | ((F.col("rect_w") <= crop_width) & (F.col("rect_h") <= 100)))
    mean = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(50.0)
    half = crop_width / 2
    pulled, fits = F.col("n_pull") > 0, F.col("fits")
    cx = F.when(pulled & fits, F.greatest(F.lit(half), F.least(F.lit(100 - half), mean("wx")))).when(pulled, mean("wx")).otherwise(50.0)
    cy = F.when(pulled & fits, F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean("wy")))).when(pulled, mean("wy")).otherwise(50.0)
    return found.select("job_id", "seq", "n_required", "n_optional", *rect, "fits", cx.alias("cx"), cy.alias("cy"))


def frame_targets(frames: DataFrame, features: DataFrame, focus: DataFrame, near: float = 0.01) -> DataFrame:
    """(job_id, seq, t, x, y): the weighted mean of what must be in and pulls within ``near`` seconds of every frame
    (job_id, seq, t) of a shot; the shot's own place where weights are 0; no row where nothing is near."""
    own = features.filter("must and pulls").select("job_id", F.col("seq").alias("of"), F.col("t").alias("f"), "x", "y", "weight")
    on = (F.abs(F.col("f") - F.col("t")) < near) & (F.col("of") == F.col("seq"))
    pairs = I.range_join(frames.select("job_id", "seq", "t").distinct(), own, ["job_id"], on, (F.col("t") - near, F.col("t") + near), (F.col("f"), F.col("f")))
    found = pairs.groupBy("job_id", "seq", "t").agg(F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("x")).alias("wx"), F.sum(F.col("weight") * F.col("y")).alias("wy"))
    found = found.join(focus.select("job_id", "seq", "cx", "cy"), ["job_id", "seq"])
    mean = lambda c, other: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.col(other))
    return found.select("job_id", "seq", "t", mean("wx", "cx").alias("x"), mean("wy", "cy").alias("y"))


def camera_modes(shots: DataFrame, focus: DataFrame, features: DataFrame, targets: DataFrame, crop_width: float, mismatch: float) -> DataFrame:
    """(job_id, seq, mode): the cheapest camera for every shot (job_id, seq, t0, t1), by its focus, what must be in
    (``features`` as for ``frame_targets``) and the targets of its frames.

    Shots under a second stand still or are padded, as their regions fit. Where regions of one moment don't fit, or nothing
    fits and several are there at once, it is padded. Targets that keep within a tenth of the crop (less, the more the
    aspects differ: ``mismatch``) are stationary; those whose speed hardly changes are tracked; those on a line are panned;
    else it is padded."""
    ids = ["job_id", "seq"]
    moments = features.filter("must").groupBy(*ids, "t").agg(F.count(F.lit(1)).alias("n"), (F.max(F.col("x") + F.col("w") / 2) - F.min(F.col("x") - F.col("w") / 2)).alias("reach"))
    crowd = moments.filter("n >= 2").groupBy(*ids).agg(F.lit(True).alias("several"), F.max("reach").alias("reach"))
    w = Window.partitionBy(*ids).orderBy("t")
    before, after = F.col("t") - F.lag("t").over(w), F.lead("t").over(w) - F.col("t")
    rows = targets.withColumns({"d1": before, "d2": after, "v1": (F.col("x") - F.lag("x").over(w)) / before, "v2": (F.lead("x").over(w) - F.col("x")) / after})
    pull = F.when((F.col("d1") > 0) & (F.col("d2") > 0), F.abs(F.col("v2") - F.col("v1")) / ((F.col("d1") + F.col("d2")) / 2))
    moved = rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("range"), F.avg(pull).alias("pull"), F.when((F.var_pop("t") > 0) & (F.var_pop("x") > 0), F.regr_r2("x", "t")).alias("r2"))
    found = shots.select(*ids, "t0", "t1").join(focus.select(*ids, "fits"), ids).join(crowd, ids, "left").join(moved, ids, "left")
    fits, n = F.col("fits"), F.coalesce("n", F.lit(0))
    by_fit = F.when(fits, "stationary").otherwise("padding")
    mode = (
        F.when(F.col("t1") - F.col("t0") < 1.0, by_fit)
        .when(~fits & F.coalesce("several", F.lit(False)), "padding")
        .when(n < 2, by_fit)
        .when(F.col("reach") > crop_width, "padding")
        .when(fits & (F.col("range") <= crop_width * 0.10 * (1.0 - min(mismatch * 0.5, 0.5))), "stationary")
        .when((n >= 3) & (F.col("pull") < 5.0), "tracking")
        .when((n >= 3) & (F.col("r2") > 0.90), "panning")
        .otherwise("padding")
    )
    return found.select(*ids, mode.alias("mode"))
