"""Subjects and content: tracks of regions, position clusters, motion paths, merged stretches, and what kind of video it is."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in scene descriptions that hint at a kind of content.
HINTS = {
    "narrative": ["character", "scene", "dialogue", "close-up", "wide shot", "reaction", "emotion", "dramatic", "cinematic"],
    "gaming": ["gameplay", "hud", "health", "ammo", "minimap", "crosshair", "score", "kill", "game", "level"],
    "sports": ["field", "court", "goal", "score", "referee", "player", "stadium", "match", "team"],
    "music_video": ["music", "concert", "performance", "stage", "dancing", "singer", "band", "microphone", "audience"],
    "anime": ["anime", "animation", "animated", "cartoon", "manga", "subtitles", "japanese"],
}
# Hits that count, and the points they give.
HINT_POINTS = {"narrative": (3, 2.0), "gaming": (2, 3.0), "sports": (2, 2.5), "music_video": (2, 3.0), "anime": (2, 3.0)}
KINDS = ["narrative", "podcast", "gaming", "vlog", "sports", "music_video", "anime"]


def region_iou(a: dict, b: dict) -> float:
    """Intersection over union of boxes x, y, w, h around their middles."""
    w = min(a["x"] + a["w"] / 2, b["x"] + b["w"] / 2) - max(a["x"] - a["w"] / 2, b["x"] - b["w"] / 2)
    h = min(a["y"] + a["h"] / 2, b["y"] + b["h"] / 2) - max(a["y"] - a["h"] / 2, b["y"] - b["h"] / 2)
    if w <= 0 or h <= 0:
        return 0.0
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return w * h / union if union > 0 else 0.0


def tracked(regions: Iterable[dict], gap: float = 0.5, alike: float = 0.3) -> Iterator[dict]:
    """Regions (t, shot, x, y, w, h) by time with the number of their ``track``: the first open one, of the same shot, that
    ended within ``gap`` seconds and overlaps by more than ``alike``; else a new one. Tracks out of reach are let go."""
    open_tracks: list[tuple[int, dict]] = []
    n = 0
    for r in regions:
        open_tracks = [(k, last) for k, last in open_tracks if last["shot"] == r["shot"] and r["t"] - last["t"] <= gap]
        found = next((i for i, (_, last) in enumerate(open_tracks) if region_iou(last, r) > alike), None)
        if found is None:
            open_tracks.append((n, r))
            k, n = n, n + 1
        else:
            k = open_tracks[found][0]
            open_tracks[found] = (k, r)
        yield r | {"track": k}


def promoted(regions: DataFrame, frames: int, aspect: tuple[float, float], area: tuple[float, float]) -> DataFrame:
    """(job_id, track, n, aspect, area, t0, t1): tracks of enough regions whose median shape and share of the picture fit."""
    shape = F.when(F.col("w") > 0, F.col("h") / F.col("w")).otherwise(0.0)
    found = regions.groupBy("job_id", "track").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(shape), 6).alias("aspect"), F.round(F.median(F.col("w") * F.col("h") / 10000), 6).alias("area"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return found.filter((F.col("n") >= frames) & F.col("aspect").between(*aspect) & F.col("area").between(*area))


def face_tracks(faces: DataFrame, least: int = 2) -> DataFrame:
    """(job_id, slot, n, t0, t1): faces of one identity, seen ``least`` times and more."""
    return faces.filter("slot >= 0").groupBy("job_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1")).filter(F.col("n") >= least)


def position_clusters(xs: list[int], gap: int = 10, least: int = 2) -> list[dict]:
    """Clusters (center, count) of places: parted at the widest gap, again and again, where that is ``gap`` and more and
    leaves ``least`` on both sides. Centres are means without the outer tenths. Tried with all places, without the middle
    and without a wider middle; the fewest clusters win. None if there are not two, eight apart."""

    def split(v: list[int]) -> list[list[int]]:
        done, todo = [], [v]
        while todo:
            own = todo.pop()
            width, at = max(((own[i] - own[i - 1], -i) for i in range(1, len(own))), default=(0, 0))
            at = -at
            if len(own) < 2 * least or width < gap or at < least or len(own) - at < least:
                done.append(own)
            else:
                todo += [own[at:], own[:at]]
        return done

    def build(v: list[int]) -> list[dict] | None:
        parts = split(sorted(v))
        if len(parts) < 2:
            return None
        found = []
        for p in parts:
            trim = max(1, len(p) // 10)
            inner = p[trim : len(p) - trim] if len(p) > 2 else p
            found.append({"center": round(sum(inner) / len(inner)) if inner else p[len(p) // 2], "count": len(p)})
        found.sort(key=lambda c: c["center"])
        if any(b["center"] - a["center"] < 8 for a, b in zip(found, found[1:], strict=False)):
            return None
        for i in range(len(found) - 2, 0, -1):  # one between two others, with fewer places than one of them, is a phantom
            a, b, c = found[i - 1 : i + 2]
            if abs(b["center"] - (a["center"] + c["center"]) / 2) < (c["center"] - a["center"]) * 0.3 and b["count"] < max(a["count"], c["count"]):
                found.pop(i)
        return found if len(found) >= 2 else None

    if len(xs) < 4:
        return []
    results = [build(xs)]
    for low, high, share in ((47, 53, 0.10), (44, 56, 0.15)):
        left = [x for x in xs if x < low or x > high]
        if len(xs) - len(left) > len(xs) * share and len(left) >= 2 * least and min(left) < low and max(left) > high:
            results.append(build(left))
    return min((r for r in results if r), key=len, default=[])


def motion_path(points: Iterable[dict], tau: float = 0.3, fastest: float = 25.0) -> Iterator[dict]:
    """A smooth path after points (t, shot, x, y): exponential with time constant ``tau``, at most ``fastest`` percent a
    second, starting anew in every shot. Points at the time of the one before are left out."""
    last = None
    for p in points:
        if last is None or last["shot"] != p["shot"]:
            x, y = p["x"], p["y"]
        else:
            dt = p["t"] - last["t"]
            if dt <= 0:
                continue
            alpha = 1.0 - math.exp(-dt / tau)
            dx, dy = alpha * (p["x"] - x), alpha * (p["y"] - y)
            far = math.sqrt(dx * dx + dy * dy)
            if far > fastest * dt:
                dx, dy = dx * fastest * dt / far, dy * fastest * dt / far
            x, y = x + dx, y + dy
        last = p
        yield p | {"x": x, "y": y}


def merged_short(spans: Iterable[dict], least: float) -> Iterator[dict]:
    """Stretches (t0, t1, slot, cut: whether a shot begins with it) of which short ones join a neighbour: one of their own
    slot, first the one before, else the longer (of equals the one before), never over the border of a shot. From left to
    right; a stretch that grew is looked at again."""
    rows = [dict(s) for s in spans]
    i = 0
    while i < len(rows):
        s = rows[i]
        if s["t1"] - s["t0"] >= least:
            i += 1
            continue
        left = rows[i - 1] if i and not s["cut"] else None
        right = rows[i + 1] if i + 1 < len(rows) and not rows[i + 1]["cut"] else None
        to_left = left is not None and (left["slot"] == s["slot"] or right is None or (right["slot"] != s["slot"] and left["t1"] - left["t0"] >= right["t1"] - right["t0"]))
        if to_left:
            left["t1"] = s["t1"]
            rows.pop(i)
            i -= 1
        elif right is not None:
            right |= {"t0": s["t0"], "cut": s["cut"]}
            rows.pop(i)
        else:
            i += 1
    yield from rows


def hits(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def content_kinds(signals: DataFrame) -> DataFrame:
    """(job_id, kind, confidence) by points for signals: cuts per minute (``cut_rate``), ``avg_faces`` of frames with any and
    ``no_face`` (the share of frames without, which counts only where some frame has a face), ``slots``, ``top_share`` (the
    commonest slot's frames among all frames) and ``mean_range`` of the registry, ``moving``, picture ``ratio``,
    ``description`` of scenes and ``x_dev`` of the faces' place; null where there is no such signal. The kind of most
    points, unless that is under two or a quarter of all; a known kind that the user names (``user_kind``) overrides all, and
    without a length (``cut_rate`` null) nothing is known."""
    c, f, dev = F.col("cut_rate"), F.col("avg_faces"), F.col("x_dev")
    absent = f.isNotNull() & (F.col("no_face") > 0.5)
    stable = (F.col("slots") >= 2) & (F.col("top_share") < 0.8) & (F.col("mean_range") < 15)
    alone = (F.col("slots") == 1) & (F.col("mean_range") < 10)
    moves = (F.col("slots") >= 1) & ~stable & ~alone & F.col("moving")
    rules = {
        "narrative": [(c >= 10, 3.0), ((c > 2) & (c < 10), 1.0), (f >= 2, 1.0), ((f >= 1) & (f < 2), 0.5), (moves, 1.0), (F.col("ratio") >= 2.2, 3.0)],
        "podcast": [(c <= 2, 3.0), (f >= 2, 2.5), (stable, 3.0), (dev < 3, 1.0)],
        "gaming": [(c <= 2, 2.0), (absent, 2.0)],
        "vlog": [((c > 2) & (c < 10), 1.5), ((f >= 1) & (f < 2), 1.5), (~stable & alone, 1.5), (moves, 1.0), ((dev >= 8) & (dev < 15), 0.5)],
        "sports": [(c >= 10, 1.0), ((c > 2) & (c < 10), 1.0), (absent, 1.5), (dev >= 15, 0.5)],
        "music_video": [(c >= 40, 3.0), ((c >= 20) & (c < 40), 1.5)],
        "anime": [],
    }
    scores = []
    for i, kind in enumerate(KINDS):
        given = F.lit(0.0)
        for condition, points in rules[kind]:
            given = given + F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0.0)
        if kind in HINTS:
            least, points = HINT_POINTS[kind]
            given = given + F.when(F.coalesce(hits(F.col("description"), HINTS[kind]) >= least, F.lit(False)), points).otherwise(0.0)
        scores.append(F.struct(given.alias("score"), F.lit(-i).alias("place"), F.lit(kind).alias("kind")))
    rows = signals.withColumn("scores", F.array(*scores)).withColumns({"best": F.array_max("scores"), "total": F.aggregate("scores", F.lit(0.0), lambda a, s: a + s["score"])})
    confidence = F.when(F.col("total") > 0, F.col("best.score") / F.col("total")).otherwise(0.0)
    sure = (confidence >= 0.25) & (F.col("best.score") >= 2.0)
    named = F.col("user_kind").isin([*KINDS, "unknown"]) & c.isNotNull()
    kind = F.when(c.isNull(), "unknown").when(named, F.col("user_kind")).when(sure, F.col("best.kind")).otherwise("unknown")
    certain = F.when(c.isNull(), 0.0).when(named, 1.0).otherwise(F.round(F.least(F.lit(1.0), confidence), 6))
    return rows.select("job_id", kind.alias("kind"), certain.alias("confidence"))


# Kinds of clips that kinds of content stand for.
CLIP_KINDS = {"podcast": "talking_head", "vlog": "talking_head", "anime": "animation", "music_video": "music_video", "gaming": "gameplay", "narrative": "generic", "sports": "generic", "unknown": "generic"}


def clip_kind(kind: Column, facecam: Column, corner_share: Column) -> Column:
    """The kind of clip of a kind of content; a stream where a game has a facecam, or faces keep to a corner beside one."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in CLIP_KINDS.items() for x in pair]), kind), F.lit("generic"))
    return F.when(facecam & ((base == "gameplay") | (corner_share > 0.7)), "stream").otherwise(base)
