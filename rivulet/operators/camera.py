"""Camera paths: the crop's place over time, per shot.

What a shot allows (how far its required regions reach, whether a line follows them) is aggregated by Spark; the recurrences
along the frames of one shot are numpy steps over the shot's arrays.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import intervals as I
from rivulet.operators.grouped import per_group

#: Slack by which a region may leave the crop, as a share of the picture.
SLACK = 0.01
#: Seconds by which a moving camera goes on.
TICK = 0.016


def numbered_by_cuts(rows: DataFrame, cuts: DataFrame, name: str = "shot") -> DataFrame:
    """Rows (job_id, t, ...) with the number of cuts (job_id, t) of their job at or before them."""
    columns = rows.columns
    marks = cuts.select("job_id", "t").withColumn("__row", F.lit(0))
    both = rows.withColumn("__row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("job_id").orderBy("t", "__row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum((F.col("__row") == 0).cast("long")).over(w)).filter("__row = 1").select(*columns, name)


# ---- the least absolute deviation path


def least_path(targets: np.ndarray, low: np.ndarray, high: np.ndarray, smooth: float) -> np.ndarray:
    """The x within [low, high] that minimises sum |x - target| + smooth * sum |x[i + 1] - x[i]|.

    The cost of all frames up to one, as a function of that one's x, is convex and piecewise linear; it is kept as the
    places where its slope rises. Passing it on to the next frame cuts its slopes to [-smooth, smooth]; the two places of
    the cut tell the frame's best x given the next one's, so the path is read backwards. Every place enters and leaves
    once: the work is in proportion to the frames, with no grid and no tolerance.
    """
    n = len(targets)
    left, right = np.empty(n), np.empty(n)
    places: list[float] = []
    rises: list[float] = []
    slope = 0.0  # of the function left of all places
    for i in range(n):
        y, lo, hi = float(targets[i]), float(low[i]), float(high[i])
        at = bisect.bisect_right(places, y)
        places.insert(at, y)
        rises.insert(at, 2.0)
        slope -= 1.0
        cap = smooth if i < n - 1 else 0.0  # the last x is where the slope changes its sign
        # from the left: drop what lies under lo, then what is steeper than -cap
        s, drop = slope, 0
        while drop < len(places) and (places[drop] <= lo or s + rises[drop] < -cap) and places[drop] < hi:
            s += rises[drop]
            drop += 1
        if s >= -cap:
            start, first = max(lo, places[drop - 1]) if drop and places[drop - 1] > lo else lo, s
        elif drop < len(places) and places[drop] < hi:
            start, first = places[drop], s + rises[drop]
            drop += 1
        else:
            start, first = hi, math.inf
        places, rises = places[drop:], rises[drop:]
        # from the right: drop what lies above hi, then what is steeper than cap
        s, keep = first, 0
        while keep < len(places) and places[keep] < hi and s <= cap:
            s += rises[keep]
            keep += 1
        if s > cap:
            end = places[keep - 1] if keep else start
            places, rises = places[:keep], rises[:keep]
            if keep:
                rises[-1] -= s - cap
            else:
                first = cap
        else:
            end = hi
            places, rises = [*places[:keep], hi], [*rises[:keep], cap - s]
        left[i], right[i] = start, end
        places, rises, slope = [start, *places], [first + cap, *rises], -cap
    x = np.empty(n)
    x[-1] = left[-1]
    for i in range(n - 2, -1, -1):
        x[i] = min(max(x[i + 1], left[i]), right[i])
    return x


def optimal_paths(points: DataFrame, smooth: float = 0.3) -> DataFrame:
    """(job_id, shot, t, x) for points (job_id, shot, t, target, low, high): the path of least deviation and movement per
    shot. Points without bounds (null) may lie from 0 to 100. Shots of one point, and those with a point that has no room
    (low over high), keep their targets."""

    def solve(c: dict) -> dict:
        low, high = np.nan_to_num(c["low"].astype(float), nan=0.0), np.nan_to_num(c["high"].astype(float), nan=100.0)
        x = c["target"].astype(float) if len(low) < 2 or (low > high).any() else least_path(c["target"].astype(float), low, high, smooth)
        return {"t": c["t"], "target": c["target"], "low": low, "high": high, "x": x}

    return per_group(points.select("job_id", "shot", "t", "target", "low", "high"), ["job_id", "shot"], ["t"], solve, "t double, target double, low double, high double, x double")


# ---- hold-still paths by total variation


def held_path(signal: np.ndarray, weight: float = 10.0, rounds: int = 100, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Steps against the gradient of (x - signal)**2 / 2 + weight * sum |x[i + 1] - x[i]|, each put back within the bounds
    (which may be nan: none)."""
    x = signal.astype(float).copy()
    if len(x) < 2:
        return x
    step = 1.0 / (1.0 + 2.0 * weight)
    for _ in range(rounds):
        sign = weight * np.sign(x[1:] - x[:-1])
        pull = np.zeros(len(x))
        pull[1:] += sign
        pull[:-1] -= sign
        x = x - step * ((x - signal) + pull)
        if low is not None:
            x = np.fmin(np.fmax(x, low), high)
    return x


def line_fit(values: np.ndarray) -> tuple[float, float]:
    """(r squared, slope per step) of a line through evenly spaced values."""
    n = len(values)
    if n < 3:
        return 0.0, 0.0
    at, off = np.arange(n) - (n - 1) / 2.0, values - values.mean()
    xy, xx, yy = float(at @ off), float(at @ at), float(off @ off)
    return (1.0, 0.0) if yy == 0 else (xy * xy / (xx * yy), xy / xx)


def required_bounds(points: DataFrame, features: DataFrame, source_width: int, crop_px: int, near: float = 0.05) -> DataFrame:
    """Points (job_id, shot, t, px) with the reach ``need_l`` to ``need_r``, in pixels, of the features (job_id, f0, left,
    right in percent) within ``near`` seconds, and the crop centres ``low`` to ``high`` that hold them; null without such
    features, and ``low``, ``high`` null too where the features span more than the crop."""
    half = crop_px / 2.0
    ids = ["job_id", "shot", "t"]
    pairs = I.range_join(points.select(*ids), features, ["job_id"], F.abs(F.col("f0") - F.col("t")) < near, (F.col("t") - near, F.col("t") + near), (F.col("f0"), F.col("f0")))
    reach = pairs.groupBy(*ids).agg((F.min("left") / 100.0 * source_width).alias("need_l"), (F.max("right") / 100.0 * source_width).alias("need_r"))
    fits = F.col("need_r") - F.col("need_l") <= crop_px
    bounds = {"low": F.when(fits, F.greatest(F.lit(half), F.col("need_r") - half)), "high": F.when(fits, F.least(F.lit(source_width - half), F.col("need_l") + half))}
    return points.join(reach.withColumns(bounds), ids, "left")


def camera_paths(points: DataFrame, source_width: int = 1920, crop_px: int = 607, weight: float = 10.0) -> DataFrame:
    """(job_id, shot, t, mode, center, slope, x, breach) for points as of ``required_bounds``: the held path of every shot
    and what it comes to: ``stationary`` below 8 % of the width, ``panning`` on a line of over 50 pixels a second, else
    ``tracking``; ``infeasible`` if a point's features exceed the crop or stay outside it by over two pixels (``breach``
    marks those points). ``x`` is null where the mode has no path of its own."""
    half = crop_px / 2.0

    def solve(c: dict) -> dict:
        t, target, low, high = (c[k].astype(float) for k in ("t", "px", "low", "high"))
        l_, r = c["need_l"].astype(float), c["need_r"].astype(float)
        n = len(t)
        flat = np.full(n, np.nan)
        breach = ~np.isnan(l_) & np.isnan(low)
        mode, center, slope, x = "infeasible", source_width / 2.0, 0.0, flat
        if n < 2:
            mode, center, breach = "stationary", target[0], np.zeros(n, bool)
        elif not breach.any():
            held = held_path(target, weight, 100, low, high)
            with np.errstate(invalid="ignore"):
                breach = (l_ < held - half - 2.0) | (r > held + half + 2.0)
            if not breach.any():
                r2, per_step = line_fit(held)
                slope = per_step / max((t[-1] - t[0]) / (n - 1), 0.001) if n >= 3 else 0.0
                if held.max() - held.min() < 0.08 * source_width:
                    mode, center, slope = "stationary", held.mean(), 0.0
                elif r2 > 0.95 and abs(slope) > 50.0:
                    mode, center, x = "panning", held.mean(), held
                else:
                    mode, center, slope, x = "tracking", held[0], 0.0, held
        return {"t": t, "mode": [mode] * n, "center": np.full(n, center), "slope": np.full(n, slope), "x": x, "breach": breach}

    columns = points.select("job_id", "shot", "t", "px", "need_l", "need_r", "low", "high")
    return per_group(columns, ["job_id", "shot"], ["t"], solve, "t double, mode string, center double, slope double, x double, breach boolean")


# ---- the simplest camera that keeps the required regions in


def tracked_centres(centre: np.ndarray, low: np.ndarray, high: np.ndarray, alpha: float) -> np.ndarray:
    """Exponentially smoothed, put within what every frame allows, then twice averaged with the neighbours and put back."""
    x = np.empty(len(centre))
    x[0] = centre[0]
    for i in range(1, len(x)):
        x[i] = alpha * centre[i] + (1 - alpha) * x[i - 1]
    x = np.minimum(np.maximum(x, low), high)
    for _ in range(2):
        for i in range(1, len(x) - 1):
            x[i] = min(max((x[i - 1] + x[i] + x[i + 1]) / 3, low[i]), high[i])
    return x


def shot_cameras(shots: DataFrame, regions: DataFrame, source_aspect: float, alpha: float = 0.35, slack: float = 0.0, crop_aspect: float = 9 / 16) -> DataFrame:
    """(job_id, shot, mode, t, cx, cy): the camera of every shot (job_id, shot, t0, t1) for regions (job_id, shot, t, cx, cy,
    half: half width, required; places as shares of the picture). Frames with required regions look at those alone.

    A crop that stands still if the shot's regions fit into one; else one that moves on the line through the frames'
    middles, if that keeps each in; else one that follows; ``padded`` (one row without a time) if a frame's regions don't
    fit at all. A shot without regions has its crop in the middle. Whole shots are judged by aggregates; only shots that
    must follow are worked through frame by frame."""
    half = crop_aspect / source_aspect / 2.0
    inside = lambda x: F.least(F.lit(1 - half), F.greatest(F.lit(half), x))
    ids = ["job_id", "shot"]
    tier = F.max("required").over(Window.partitionBy(*ids, "t"))
    own = regions.withColumn("__any", tier).filter(F.col("required") | ~F.col("__any"))
    frames = own.groupBy(*ids, "t").agg(F.min(F.col("cx") - F.col("half")).alias("l"), F.max(F.col("cx") + F.col("half")).alias("r"), F.avg("cy").alias("cy"))
    frames = frames.withColumn("mid", (F.col("l") + F.col("r")) / 2)
    whole = frames.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("n"), F.min("l").alias("shot_l"), F.max("r").alias("shot_r"), F.avg("cy").alias("shot_y"), F.max(F.col("r") - F.col("l")).alias("widest"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.regr_slope("mid", "t").alias("b"), F.avg("mid").alias("mean_x"), F.avg("t").alias("mean_t"),
    )
    still = inside((F.col("shot_l") + F.col("shot_r")) / 2)
    stands = (F.col("shot_r") - F.col("shot_l") <= half * 2 + slack) & (F.col("shot_l") >= still - half - SLACK) & (F.col("shot_r") <= still + half + SLACK)
    line = F.col("mean_x") + F.coalesce("b", F.lit(0.0)) * (F.col("first_t") - F.col("mean_t"))
    whole = whole.withColumns({"stands": stands, "still": still, "a": line})
    on_line = F.col("a") + F.coalesce("b", F.lit(0.0)) * (F.col("t") - F.col("first_t"))
    joined = frames.join(whole, ids)
    covered = (on_line - half <= F.col("l") + SLACK) & (on_line + half >= F.col("r") - SLACK)
    pans = joined.groupBy(*ids).agg(F.min(covered).alias("covered"))
    verdict = whole.join(pans, ids)
    mode = F.when(F.col("stands"), "stationary").when((F.col("n") >= 3) & F.col("covered"), "panning").when(F.col("widest") > 2 * half + SLACK, "padded").otherwise("tracking")
    verdict = verdict.withColumn("mode", mode)

    ends = shots.select(*ids, "t0", "t1").join(verdict, ids, "left").withColumn("mode", F.coalesce("mode", F.lit("stationary")))
    at = lambda t, x, y: F.struct(t.cast("double").alias("t"), x.cast("double").alias("cx"), y.cast("double").alias("cy"))
    end_x = F.col("a") + F.coalesce("b", F.lit(0.0)) * (F.col("last_t") - F.col("first_t"))
    nothing = F.col("n").isNull()
    pair = F.when(nothing, F.array(at(F.col("t0"), F.lit(0.5), F.lit(0.5)), at(F.col("t1"), F.lit(0.5), F.lit(0.5)))).when(F.col("mode") == "stationary", F.array(at(F.col("t0"), F.col("still"), F.col("shot_y")), at(F.col("t1"), F.col("still"), F.col("shot_y"))))
    pair = pair.when(F.col("mode") == "panning", F.array(at(F.col("t0"), inside(F.col("a")), F.col("shot_y")), at(F.col("t1"), inside(end_x), F.col("shot_y")))).otherwise(F.array(F.lit(None).cast("struct<t:double,cx:double,cy:double>")))
    fixed = ends.filter("mode <> 'tracking'").select(*ids, "mode", F.explode(pair).alias("k")).select(*ids, "mode", "k.t", "k.cx", "k.cy")

    def follow(c: dict) -> dict:
        x = tracked_centres(c["mid"], c["r"] - half, c["l"] + half, alpha)
        return {"mode": ["tracking"] * len(x), "t": c["t"], "cx": np.minimum(np.maximum(x, half), 1 - half), "cy": c["cy"]}

    moving = frames.join(verdict.filter("mode = 'tracking'").select(*ids), ids, "left_semi").join(shots.select(*ids), ids, "left_semi")
    return fixed.unionByName(per_group(moving.select(*ids, "t", "l", "r", "mid", "cy"), ids, ["t"], follow, "mode string, t double, cx double, cy double"))


# ---- hold, then snap


def hold_then_snap(t: np.ndarray, target: np.ndarray, threshold: float = 8.0, duration: float = 0.30) -> np.ndarray:
    """The place at every keyframe of a camera that rests until its target is ``threshold`` or more off, then moves there in
    ``duration`` seconds, fast first (a cubic). A target that moves on in the same direction is followed on the way, one
    that turns back isn't. Keyframes within 2 ms are cuts."""
    out = np.empty(len(t))
    hold = pos = goal = begin = float(target[0])
    out[0], moving, progress, heading = pos, False, 0.0, 0
    for i in range(1, len(t)):
        x, dt = float(target[i]), float(t[i] - t[i - 1])
        if dt <= 0.002:
            out[i] = pos = hold = x
            moving, progress, heading = False, 0.0, 0
            continue
        turn = (x > hold) - (x < hold)
        if not moving and abs(x - hold) >= threshold:
            moving, goal, begin, progress = True, x, pos, 0.0
        elif moving and not (turn and heading and turn != heading):
            goal = x
        heading = turn or heading
        gone = 0.0
        while moving and gone < dt:  # in ticks, as rounding decides whether a move of whole ticks has ended
            tick = min(TICK, dt - gone)
            gone += tick
            progress += tick / duration
            if progress >= 1.0:
                pos = hold = goal
                moving, progress = False, 0.0
        if moving:
            pos = begin + (goal - begin) * (1.0 - (1.0 - progress) ** 3)
        out[i] = pos = max(0.0, min(100.0, pos))
    return out


def snap_parameters(src_ratio: float, target_ratio: float) -> tuple[float, float]:
    """(threshold, duration) for how much a crop magnifies: narrower crops react to less, and faster."""
    r = src_ratio / target_ratio if src_ratio > 0 and target_ratio > 0 else 1.0
    if r <= 1.5:
        return 8.0, 0.30
    return float(max(3, round(8 / math.sqrt(r)))), max(0.15, 0.30 / math.sqrt(r))


def held_keyframes(keys: DataFrame, src_ratio: float = 0.0, target_ratio: float = 0.0) -> DataFrame:
    """(job_id, t, x) for keyframes (job_id, t, x)."""
    threshold, duration = snap_parameters(src_ratio, target_ratio)
    return per_group(keys.select("job_id", "t", "x"), ["job_id"], ["t"], lambda c: {"t": c["t"], "x": hold_then_snap(c["t"], c["x"], threshold, duration)}, "t double, x double")
