"""Transcripts made shorter: segments joined and repeats dropped, and a budget of characters spent on hot stretches first."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(text: str) -> int:
    return len(text.split())


def micro_joined(segs: Iterable[dict], shorter: float = 0.5, words: int = 3, gap: float = 2.0) -> Iterator[dict]:
    """Segments (t0, t1, text) shorter than ``shorter`` of few words join the next, if it follows within ``gap``, else the
    one before. A segment that has been joined to joins no other."""
    rows = iter(segs)
    held, s = None, next(rows, None)
    while s is not None:
        following, text = next(rows, None), s["text"].strip()
        tiny = s["t1"] - s["t0"] < shorter and _n(text) <= words
        if tiny and following is not None and following["t0"] - s["t1"] < gap:
            if held is not None:
                yield held
            held = following | {"t0": s["t0"], "text": text + " " + following["text"].strip()}
            following = next(rows, None)
        elif tiny and held is not None and s["t0"] - held["t1"] < gap:
            held = held | {"t1": s["t1"], "text": held["text"].strip() + " " + text}
        else:
            if held is not None:
                yield held
            held = s
        s = following
    if held is not None:
        yield held


def short_joined(segs: Iterable[dict], gap: float = 2.0, few: int = 3, words: int = 15, chars: int = 80) -> Iterator[dict]:
    """A segment of few words goes on with those after it, while they follow within ``gap`` and the whole stays within
    ``words`` and ``chars``; once it has more than few, with others of few only."""
    held = None
    for s in segs:
        text = s["text"].strip()
        if held is not None:
            so_far = held["text"].strip()
            fits = s["t0"] - held["t1"] <= gap and _n(so_far) + _n(text) <= words and len(so_far) + len(text) <= chars
            if fits and not (_n(text) > few and _n(so_far) > few):
                held = held | {"t1": s["t1"], "text": so_far + " " + text}
                continue
            yield held
            held = None
        if _n(text) <= few:
            held = s
        else:
            yield s
    if held is not None:
        yield held


def without_repeats(segs: Iterable[dict], within: float = 30.0, recent: int = 10, alike: float = 0.7) -> Iterator[dict]:
    """Segments that don't repeat one of the last ``recent`` kept ones that began within ``within`` seconds: the same text
    in it or around it, or over ``alike`` of all words shared. Texts of ten characters and less are never compared."""
    kept: deque[tuple[float, str, set]] = deque(maxlen=recent)
    for s in segs:
        text = s["text"].strip().lower()
        own = set(text.split())
        for t0, other, theirs in kept:
            if abs(s["t0"] - t0) <= within and len(text) > 10 and len(other) > 10 and (text in other or other in text or len(own & theirs) / len(own | theirs) > alike):
                break
        else:
            kept.append((s["t0"], text, own))
            yield s


def consolidated(segs: Iterable[dict]) -> Iterator[dict]:
    return without_repeats(short_joined(micro_joined(segs)))


def tiers(segs: DataFrame, zones: DataFrame, hot: float = 50.0, warm: float = 20.0) -> DataFrame:
    """Segments with ``tier``: that of the best zone (k, w0, w1, score) over the whole second they begin in, else cold."""
    seconds = zones.withColumn("sec", F.explode(F.sequence(F.floor("w0"), F.floor("w1"))))
    best = seconds.groupBy("job_id", "sec").agg(F.max_by("score", F.struct("score", -F.col("k"))).alias("score"))
    tier = F.when(F.col("score") >= hot, "hot").when(F.col("score") >= warm, "warm").otherwise("cold")
    rows = segs.withColumn("sec", F.floor("t0")).join(best, ["job_id", "sec"], "left")
    return rows.withColumn("tier", F.coalesce(tier, F.lit("cold"))).drop("sec", "score")


def _whole(t: Column) -> Column:
    return F.bround(t).cast("long").cast("string")


def _within(lines: Column, budget: int) -> Column:
    """The lines, in order, that still fit a budget of characters; one that doesn't is passed over."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda s, x: s["used"] + F.length(x) + 1 <= budget
    return F.aggregate(lines, start, lambda s, x: F.when(fits(s, x), F.struct((s["used"] + F.length(x) + 1).alias("used"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))["kept"]


def hot_first(segs: DataFrame, zones: DataFrame, most: int) -> DataFrame:
    """(job_id, hot, warm, cold, text): .6 of the characters for hot segments in full, .3 for warm ones of at most 100
    characters, .1 for a line per stretch of cold ones (the first ten), all in order."""
    rows = tiers(segs, zones)
    w = Window.partitionBy("job_id").orderBy("seq")
    line = lambda text: F.concat(F.lit("["), _whole(F.col("t0")), F.lit("-"), _whole(F.col("t1")), F.lit("] "), F.col("speaker"), F.lit(": "), text)
    rows = rows.withColumns({"line": F.when(F.col("tier") == "hot", line(F.col("text"))).when(F.col("tier") == "warm", line(F.left("text", F.lit(100)))), "is_cold": F.col("tier") == "cold"})
    begins = F.col("is_cold") & ~F.coalesce(F.lag("is_cold").over(w), F.lit(False))
    rows = rows.withColumn("run", F.when(F.col("is_cold"), F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumns({"next": F.lead("t0").over(w), "end": F.max("t1").over(Window.partitionBy("job_id"))})
    cold = rows.filter("is_cold").groupBy("job_id", "run").agg(F.min_by("t0", "seq").alias("a"), F.max_by(F.coalesce("next", "end"), "seq").alias("b"))
    # a stretch of cold ones ends where the next segment begins, the last one with the video
    text = F.concat(F.lit("["), _whole(F.col("a")), F.lit("-"), _whole(F.col("b")), F.lit("s] (low-engagement region — "), _whole(F.col("b") - F.col("a")), F.lit("s of content condensed)"))
    ordered = lambda rows, order: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), rows.alias("x")))), lambda s: s["x"])
    cold = cold.groupBy("job_id").agg(F.left(F.array_join(F.slice(ordered(text, "run"), 1, 10), "\n"), F.lit(int(most * 0.10))).alias("cold"))
    pick = lambda tier: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == tier, F.struct("seq", "line")))), lambda s: s["line"])
    found = rows.groupBy("job_id").agg(pick("hot").alias("h"), pick("warm").alias("w")).join(cold, "job_id", "left")
    found = found.select("job_id", _within(F.col("h"), int(most * 0.60)).alias("h"), _within(F.col("w"), int(most * 0.30)).alias("w"), F.coalesce("cold", F.lit("")).alias("cold"))
    return found.select("job_id", F.size("h").alias("hot"), F.size("w").alias("warm"), F.length("cold").alias("cold"), F.array_join(F.concat("h", "w", F.array("cold")), "\n").alias("text"))
