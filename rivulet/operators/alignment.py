"""Corrected words set back on their times, and transcripts without what recognisers make up.

Matching sequences word by word (longest common block, and again on both sides of it) is the standard library's, one segment
at a time. What a segment tells about itself is column expressions; what depends on the segments kept before it goes
through a job's suspicious-free segments in order, with at most the last ten kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rivulet.functions import text as X
from rivulet.operators.grouped import per_group

# Whole segments that recognisers make up at the ends of a recording.
BOILERPLATE = [
    "thank you for watching", "thanks for watching", "please subscribe", "like and subscribe", "don't forget to subscribe",
    "see you in the next video", "bye bye", "thanks for listening", "music playing", "music", "applause", "subtitles by",
    "captions by",
]
# Parts of instructions to the recogniser that come back as speech.
ECHOES = ["this is a japanese conversation", "this is a conversation translated", "translated to natural english", "translate names as-is", "use complete sentences"]
_CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"


def realigned(words: list[tuple[str, float, float]], text: str) -> list[tuple[str, float, float]]:
    """The words of a corrected text with times: words that match one of the old (case and punctuation aside) keep its time,
    replaced ones share the time of those they replace, new ones the gap they stand in; new words before all others get
    none and are left out. Without words on either side nothing changes."""
    new = text.split()
    if not words or not new:
        return words
    bare = lambda w: w.lower().strip(".,!?;:")
    out: list[tuple[str, float, float]] = []

    def spread(start: float, end: float, a: int, b: int) -> None:
        each = (end - start) / (b - a)
        out.extend((new[j], round(start + (j - a) * each, 3), round(start + (j - a + 1) * each, 3)) for j in range(a, b))

    for kind, i, i2, j, j2 in SequenceMatcher(None, [bare(w[0]) for w in words], [bare(w) for w in new]).get_opcodes():
        if kind == "equal":
            out.extend((new[b], words[a][1], words[a][2]) for a, b in zip(range(i, i2), range(j, j2), strict=True))
        elif kind == "replace":
            spread(words[i][1], words[i2 - 1][2], j, j2)
        elif kind == "insert" and out:
            spread(out[-1][2], words[i][1] if i < len(words) else out[-1][2] + 0.1, j, j2)
    return out or words


def realigned_words(segments: DataFrame) -> DataFrame:
    """(job_id, seq, i, word, w0, w1) for segments (job_id, seq, text: as corrected, words: array of word, w0, w1 as they
    were)."""
    schema = StructType([*(segments.schema[c] for c in ("job_id", "seq")), *StructType.fromDDL("i int, word string, w0 double, w1 double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (text, words) in enumerate(zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), strict=True)):
                made = realigned([(w["word"], w["w0"], w["w1"]) for w in words or []], text or "")
                rows += [k] * len(made)
                found += [(i, *w) for i, w in enumerate(made)]
            at = pa.array(rows, pa.int32())
            i, word, w0, w1 = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("job_id").take(at), batch.column("seq").take(at), pa.array(i, pa.int32()), pa.array(word, pa.string()), pa.array(w0, pa.float64()), pa.array(w1, pa.float64())], names=schema.names)

    return segments.select("job_id", "seq", "text", "words").mapInArrow(run, schema)


def most_repeated(values: Column) -> Column:
    """How often the commonest value of an array of strings stands in it."""
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(s["v"] == v, s["run"] + 1).otherwise(1)
        return F.struct(v.alias("v"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["best"])


def _grams(values: Column, size: int, joiner) -> Column:
    return X.bound(values, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - size + 1), lambda i: joiner(F.slice(v, i, size))))


def loops(text: Column, with_cjk: bool = True) -> Column:
    """Whether one run of three words (from nine words on) makes over 40 % of all; for texts that begin in Chinese, Japanese or
    Korean one run of six characters (from 18 on) over 30 %."""
    words = X.words(F.lower(text))
    many = lambda grams, share: X.bound(grams, lambda g: X.bound(most_repeated(g), lambda m: (m >= 3) & (m > share * F.size(g))))
    by_word = F.when(F.size(words) >= 9, many(_grams(words, 3, lambda w: F.array_join(w, " ")), 0.4)).otherwise(F.lit(False))
    if not with_cjk:
        return by_word
    letters = F.replace(text, F.lit(" "), F.lit(""))
    characters = F.filter(F.split(letters, ""), lambda c: c != "")
    by_letter = F.when(F.length(letters) >= 18, many(_grams(characters, 6, lambda c: F.array_join(c, "")), 0.3)).otherwise(F.lit(False))
    return F.when(F.substring(text, 1, 50).rlike(_CJK), by_letter).otherwise(by_word)


def made_up(segments: DataFrame, translated: bool = False) -> DataFrame:
    """Segments (job_id, seq, t0, t1, text, confidence, no_speech) with ``text`` trimmed and the ``reason`` why they can't be
    speech by themselves, or null: silence, an echo of the instructions, far too little text for the time, a runaway, a
    loop. Empty ones are left out."""
    text = F.trim(F.col("text"))
    rows = segments.withColumn("text", text).filter(F.length("text") > 0)
    n, length = F.length("text"), F.col("t1") - F.col("t0")
    echo = F.lit(False)
    for part in ECHOES:
        echo = echo | F.lower("text").contains(part)
    thin = (length > (60 if translated else 15)) & (n / length < (0.1 if translated else 1.0))
    ghost = (length > (300 if translated else 120)) & (n < (10 if translated else 200))
    reason = (
        F.when((F.col("no_speech") > 0.9) & (F.col("confidence") < 0.1), "silence").when(echo, "echo").when(thin | ghost, "ghost").when(n > 1500, "runaway").when(loops(F.col("text")), "loop")
    )
    return rows.withColumn("reason", reason)


def filtered(segments: DataFrame, translated: bool = False) -> DataFrame:
    """(job_id, seq, reason) for every segment with text: null if it stays, else why it goes. Besides ``made_up``: boilerplate
    of low confidence before the first or among the last two segments, starts before the last kept one's start, near copies
    of that within two seconds, copies of one of the last ten, and segments that share most words with one of these 2 to 30
    seconds away. For translations short answers may repeat."""
    by_time = Window.partitionBy("job_id")
    rows = segments.withColumn("__left", F.row_number().over(by_time.orderBy(F.desc("seq"))))
    rows = made_up(rows, translated)
    boiler = F.regexp_replace(F.lower("text"), "[.!]+$", "").isin(BOILERPLATE) & (F.col("confidence") < 0.5)
    rows = rows.withColumns({"boiler": F.coalesce(boiler, F.lit(False)), "tail": F.col("__left") <= 2})
    columns = ["seq", "t0", "t1", "text", "boiler", "tail", "reason"]

    def step(c: dict) -> dict:
        kept: deque = deque(maxlen=10)
        reasons = []
        n = 0
        for t0, t1, text, boiler, tail, reason in zip(*(c[k].tolist() for k in columns[1:]), strict=True):
            low = text.lower()
            words = low.split()
            why = reason
            if why is None and boiler and (tail or n == 0):
                why = "boilerplate"
            if why is None and n:
                why = _repeats(t0, t1, low, words, kept, n, translated)
            if why is None:
                kept.append((t0, t1, low, set(words)))
                n += 1
            reasons.append(why)
        return {"seq": c["seq"], "reason": reasons}

    return per_group(rows.select("job_id", *columns), ["job_id"], ["seq"], step, "seq long, reason string")


def _repeats(t0: float, t1: float, low: str, words: list[str], kept: deque, n: int, translated: bool) -> str | None:
    """Why a segment can't follow the last ones kept (start, end, text, words), of ``n`` in all."""
    last = kept[-1]
    if t0 < last[0]:
        return "backward"
    if len(words) > 3 and t1 - t0 < 3.0 and abs(t0 - last[0]) < 2.0:
        matcher = SequenceMatcher(None, last[2], low)
        if matcher.real_quick_ratio() > 0.92 and matcher.quick_ratio() > 0.92 and matcher.ratio() > 0.92:
            return "near copy"
    if n < 2:
        return None
    same = [k for k in kept if k[2] == low]
    if same:
        return None if translated and not any(abs(t0 - k[1]) < 5.0 for k in same) else "copy"
    if len(words) > (5 if translated else 3) and len(low) > 15:
        own, limit = set(words), 0.85 if translated else 0.7
        if any(2 <= abs(t0 - k[0]) <= 30 and len(own & k[3]) > limit * len(own | k[3]) for k in kept):
            return "alike"
    return None


def worker_filtered(segments: DataFrame, prompt: str = "", translated: bool = False) -> DataFrame:
    """(job_id, seq) of the segments that stay by the recogniser's own filter: no echoes of the prompt's sentences, no runaways,
    ghosts or loops; and, against those kept before, none that starts earlier than the last, equals it (within 5 s of speech)
    or is among the last five (for translations: equals the last within two seconds)."""
    rows = segments.withColumn("text", F.trim("text")).filter(F.length("text") > 0)
    n, length = F.length("text"), F.col("t1") - F.col("t0")
    low = F.regexp_replace(F.lower("text"), r"\.+$", "")
    echo = F.lit(False)
    for part in {p.strip().lower().rstrip(".") for p in prompt.replace(". ", ".\n").split("\n")}:
        if len(part) > 15:
            echo = echo | low.contains(part) | F.lit(part).contains(low)
    silent = (length > (45 if translated else 30)) & (n < (15 if translated else 30)) & (F.coalesce("no_speech", F.lit(0.0)) > (0.7 if translated else 0.5))
    thin = (length > (45 if translated else 15)) & (n / F.greatest(length, F.lit(0.1)) < (0.15 if translated else 1.0))
    ghost = (length > (240 if translated else 120)) & (n < (15 if translated else 200))
    rows = rows.filter(~(echo | (n > 1500) | silent | thin | ghost) & ~loops(F.col("text"), with_cjk=False))

    def step(c: dict) -> dict:
        kept: deque = deque(maxlen=5)
        stays = np.zeros(len(c["seq"]), bool)
        n = 0
        for i, (t0, t1, text) in enumerate(zip(c["t0"].tolist(), c["t1"].tolist(), c["text"].tolist(), strict=True)):
            low = text.lower()
            if n:
                last = kept[-1]
                if t0 < last[0] or (text == last[3] and t1 - t0 < 5.0):
                    continue
                if n >= 2 and (low == last[2] and abs(t0 - last[1]) < 2.0 and t1 - t0 < 3.0 if translated else any(k[2] == low for k in kept)):
                    continue
            kept.append((t0, t1, low, text))
            n += 1
            stays[i] = True
        return {"seq": c["seq"][stays]}

    return per_group(rows.select("job_id", "seq", "t0", "t1", "text"), ["job_id"], ["seq"], step, "seq long")
