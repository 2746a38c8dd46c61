"""Small rules: sizes and crops of outputs, priorities of objects, prices, tiers, user agents."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output width and height by quality and aspect ratio, and the height of a quality without one.
DIMS = {
    "720p": {"16:9": (1280, 720), "9:16": (720, 1280), "1:1": (720, 720), "4:5": (720, 900)},
    "1080p": {"16:9": (1920, 1080), "9:16": (1080, 1920), "1:1": (1080, 1080), "4:5": (1080, 1350)},
    "4k": {"16:9": (3840, 2160), "9:16": (2160, 3840), "1:1": (2160, 2160), "4:5": (2160, 2700)},
}
MAX_HEIGHT = {"720p": 720, "1080p": 1080, "4k": 2160}
# Weights of object classes; the first must be in the frame always, the second if they move.
ALWAYS = {"person": 1.0, "cat": 0.9, "dog": 0.9, "bird": 0.85, "horse": 0.9, "sheep": 0.9, "cow": 0.9, "elephant": 0.9, "bear": 0.9, "zebra": 0.9, "giraffe": 0.9, "sports ball": 0.8, "frisbee": 0.7, "skateboard": 0.7, "surfboard": 0.7}
IF_MOVING = {"bicycle": 0.7, "car": 0.7, "motorcycle": 0.7, "airplane": 0.8, "bus": 0.7, "train": 0.8, "truck": 0.7, "boat": 0.7}
OTHER_WEIGHT = 0.3
# Tokens in and out for ten minutes of video.
TOKENS = {"vision": (100_000, 15_000), "text": (15_000, 8_000)}
# Window, overlap, timeout, summary strategy, summary chunk and concurrency of tiers, and what a local model changes.
TIERS = {"short": (0, 0, 120, "single", 0, 2), "medium": (480, 90, 180, "single", 0, 2), "long": (600, 120, 240, "map_reduce", 10, 3), "marathon": (600, 120, 300, "map_reduce", 15, 3)}
LOCAL_TIERS = {"short": (180, 20, 240, "single", 0, 1), "medium": (180, 30, 300, "map_reduce", 5, 1), "long": (180, 30, 360, "map_reduce", 5, 1), "marathon": (180, 30, 420, "map_reduce", 5, 1)}
TIER_FIELDS = ["window", "overlap", "timeout", "strategy", "chunk", "concurrency"]
# Parts of the user agents of link-preview crawlers.
CRAWLERS = ["slackbot-linkexpanding", "slack-imgproxy", "twitterbot", "facebookexternalhit", "facebookcatalog", "discordbot", "linkedinbot", "whatsapp", "telegrambot", "redditbot", "applebot", "pinterest", "skypeuripreview", "embedly", "quora link preview", "outbrain", "vkshare", "w3c_validator", "googlebot"]


def lookup(table: dict, key: Column) -> Column:
    """The value of a constant table for a key, or null."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def out_dims(width: Column, height: Column, aspect: Column, quality: Column) -> Column:
    """(w, h) of an output: of the table for known aspect ratios (1080p for unknown qualities), else scaled to the
    quality's height with an even width; a source of that height stays."""
    known = F.lit(None).cast("struct<w:int,h:int>")
    for q, dims in DIMS.items():
        for ratio, (w, h) in dims.items():
            same = F.when(quality.isin(list(DIMS)), quality).otherwise("1080p") == q
            known = F.when((aspect == ratio) & same, F.struct(F.lit(w - w % 2).alias("w"), F.lit(h - h % 2).alias("h"))).otherwise(known)
    target = F.coalesce(lookup(MAX_HEIGHT, quality), F.lit(1080))
    scaled = F.when(height > 0, (F.bround(width * target / height / 2) * 2).cast("int")).otherwise(width.cast("int"))
    other = F.when(height != target, F.struct(scaled.alias("w"), target.cast("int").alias("h"))).otherwise(F.struct(width.cast("int").alias("w"), height.cast("int").alias("h")))
    return F.coalesce(known, other)


def face_offset(y: Column, source: Column, crop: Column, place: float = 0.38) -> Column:
    """Rows cut off above, so that a face at y percent stands at ``place`` of the crop; truncated, within the source."""
    wanted = (source * y / 100 - crop * place).cast("int")
    return F.when(crop >= source, 0).otherwise(F.greatest(F.lit(0), F.least(source - crop, wanted)))


def crop_rect(x: Column, y: Column, source_w: int, source_h: int, target: float) -> Column:
    """Crop (x, y, w, h) in shares of the source, around a place in percent or, above 1, in pixels."""
    cx, cy = F.when(x > 1.0, x / source_w).otherwise(x / 100.0), F.when(y > 1.0, y / source_h).otherwise(y / 100.0)
    if target < source_w / source_h:
        w, h = target * source_h / source_w, 1.0
    else:
        w, h = 1.0, min(1.0, source_w / target / source_h)
    inside = lambda c, size: F.greatest(F.lit(0.0), F.least(c - size / 2, F.lit(1.0 - size)))
    zero = F.lit(0.0)
    return F.struct((inside(cx, w) if w < 1 else zero).alias("x"), (inside(cy, h) if w == 1.0 else zero).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))


def gaze(nose: Column, centre: Column, width: Column, least: float = 0.15) -> Column:
    """left, right or center, by how far the nose is off the face's middle."""
    off = F.when(width > 0, (nose - centre) / width)
    return F.when(off > least, "right").when(off < -least, "left").otherwise("center")


def class_priority(name: Column, moving: Column) -> Column:
    """(must, weight): whether an object must be in the frame, and what it weighs."""
    weight = F.coalesce(lookup(ALWAYS, name), lookup(IF_MOVING, name), F.lit(OTHER_WEIGHT))
    must = name.isin(list(ALWAYS)) | (name.isin(list(IF_MOVING)) & F.coalesce(moving, F.lit(False)))
    return F.struct(F.coalesce(must, F.lit(False)).alias("must"), weight.alias("weight"))


def model_cost(prompt: Column, completion: Column, role: Column) -> Column:
    """Price of ten minutes of video; prices that don't read as numbers count as free."""
    cost = lambda kind: prompt.try_cast("double") * TOKENS[kind][0] + completion.try_cast("double") * TOKENS[kind][1]
    return F.coalesce(F.when(role == "vision", cost("vision")).otherwise(cost("text")), F.lit(0.0))


def tier_fields(name: Column, local: Column) -> Column:
    """A tier's fields; with a local model those it changes (of an unknown tier, as for medium), where a chunk of 0 keeps
    the tier's own."""
    kinds = ["int", "int", "int", "string", "int", "int"]

    def row(table: dict, key: Column) -> Column:
        found = F.lit(None).cast("struct<" + ",".join(f"{f}:{k}" for f, k in zip(TIER_FIELDS, kinds, strict=True)) + ">")
        for tier, values in table.items():
            found = F.when(key == tier, F.struct(*[F.lit(v).alias(f) for f, v in zip(TIER_FIELDS, values, strict=True)])).otherwise(found)
        return found

    own, changed = row(TIERS, name), row(LOCAL_TIERS, F.when(name.isin(list(LOCAL_TIERS)), name).otherwise("medium"))
    chunk = F.when(changed["chunk"] > 0, changed["chunk"]).otherwise(own["chunk"])
    return F.when(local, changed.withField("chunk", chunk)).otherwise(own)


def is_crawler(agent: Column) -> Column:
    low = F.lower(agent)
    found = F.lit(False)
    for part in CRAWLERS:
        found = found | low.contains(part)
    return F.coalesce(found, F.lit(False))


def free_tier(providers: Column) -> Column:
    """Whether any value of a map names a free provider or the local one."""
    return F.coalesce(F.exists(F.map_values(providers), lambda p: p.contains("free") | (p == "ollama")), F.lit(False))


def whole_numbers(values: Column) -> Column:
    """Numbers of any kind truncated to whole ones."""
    return F.transform(values, lambda v: v.cast("double").cast("long"))
