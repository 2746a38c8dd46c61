"""Text, time-code and small format functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reaction substrings and segments that are nothing but a filler.
REACTIONS = ["haha", "lol", "wow", "oh my", "oh no", "omg", "damn", "holy", "crazy", "insane", "unbelievable", "incredible", "amazing"]
FILLERS = ["um", "uh", "uh huh", "you know", "i mean", "like", "basically", "literally", "actually", "right", "so yeah", "kind of", "sort of"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def bound(value: Column, f) -> Column:
    """f(value), with the value worked out once: within the functions of arrays, an expression is evaluated for every
    element, a variable is not."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def has(part: str, text: str = "text") -> Column:
    return F.col(text).contains(part)


def flag(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def shouts(text: Column) -> Column:
    """A word of three or more letters of any script, none of them small."""
    return F.exists(words(text), lambda w: (F.length(w) > 2) & (w == F.upper(w)) & ~w.rlike(r"[^\p{L}]"))


def reacts(text: Column) -> Column:
    low = F.lower(text)
    found = low.contains(REACTIONS[0])
    for r in REACTIONS[1:]:
        found = found | low.contains(r)
    return found


def srt_time(t: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds cut, not rounded, from the binary fraction."""
    whole = F.floor(t)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), (whole % 60).cast("long"), F.floor((t - whole) * 1000).cast("long"))


def vtt_time(t: Column) -> Column:
    """HH:MM:SS.mmm, rounded, so a second may print as 60.000."""
    whole = F.floor(t)
    return F.concat(F.format_string("%02d:%02d:", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long")), F.lpad(F.format_string("%.3f", t - F.floor(t / 60) * 60), 6, "0"))


def ass_time(t: Column) -> Column:
    """H:MM:SS.cc, negative times as zero."""
    t = F.greatest(F.lit(0.0), t)
    centi = F.floor(t * 100 + 1e-6).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(centi / 360000).cast("long"), F.floor(centi % 360000 / 6000).cast("long"), F.floor(centi % 6000 / 100).cast("long"), centi % 100)


def seconds_of_ass(t: Column) -> Column:
    p = F.split(t, ":")
    return F.round(F.get(p, F.lit(0)).cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double"), 2)


def ass_color(hex_color: Column) -> Column:
    """#RRGGBB to &H00BBGGRR."""
    h = F.upper(F.regexp_replace(hex_color, "^#", ""))
    return F.concat(F.lit("&H00"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def mask_key(key: Column) -> Column:
    """First ten and last four characters; of short keys the first four."""
    n = F.length(key)
    return F.when(n > 12, F.concat(F.left(key, F.lit(10)), F.lit("..."), F.right(key, F.lit(4)))).otherwise(F.concat(F.left(key, F.lit(4)), F.lit("...")))


def loops(text: Column) -> Column:
    """At least nine words, and the commonest three-word run makes over 40 % of all and occurs three times or more. The
    runs are sorted, so that equal ones stand together and one pass counts them."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    run = lambda s, g: F.when(s["last"] == g, s["run"] + 1).otherwise(1)

    def looping(w: Column) -> Column:
        n = F.size(w) - 2
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " ")))
        most = F.aggregate(grams, zero, lambda s, g: F.struct(g.alias("last"), run(s, g).alias("run"), F.greatest(s["most"], run(s, g)).alias("most")))["most"]
        return (F.size(w) >= 9) & (most >= 3) & (most > 0.4 * n)

    return bound(words(F.lower(text)), looping)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_words(title: Column) -> Column:
    """Distinct lower-cased alphanumeric words longer than two."""
    return F.array_distinct(F.filter(F.split(F.lower(title), r"[^a-z0-9]+"), lambda x: F.length(x) > 2))


def placeholder(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return value.isNull() | (v == "") | v.rlike(r"^(n/?a|none|null|todo|tbd|unknown|\.+|-+|<.*>|\[.*\])$")


def truncate_at_boundary(text: Column, most: int) -> Column:
    """Cut at the last line break or sentence end of the allowed part if that keeps over 70 % of it."""
    head = F.substring(text, 1, most)
    last = F.greatest(most + 1 - F.locate("\n", F.reverse(head)), most + 1 - F.locate(".", F.reverse(head)))
    found = (F.locate("\n", head) > 0) | (F.locate(".", head) > 0)
    only_line, only_stop = F.locate(".", head) == 0, F.locate("\n", head) == 0
    last = F.when(only_line, most + 1 - F.locate("\n", F.reverse(head))).when(only_stop, most + 1 - F.locate(".", F.reverse(head))).otherwise(last)
    return F.when(F.length(text) <= most, text).when(found & (last > 0.7 * most), F.substring(head, F.lit(1), last.cast("int"))).otherwise(head)


def position_in_text(text: Column) -> Column:
    """Horizontal place named in a text, in percent."""
    low = F.lower(text)
    return F.when(low.rlike(r"far left"), 15).when(low.rlike(r"far right"), 85).when(low.rlike(r"\bleft\b"), 30).when(low.rlike(r"\bright\b"), 70).otherwise(50)


def even_pixels(share: Column, size: int) -> Column:
    """A share of a size in pixels: rounded half to even, made even, within the size."""
    px = F.bround(share * size)
    return F.least(F.greatest(px - F.pmod(px, F.lit(2)), F.lit(0)), F.lit(size)).cast("int")


def min_hold(pacing: Column) -> Column:
    """Seconds a shot is held at least: 2.00 at pacing 0 down to 0.25 at 1."""
    return 2.0 - F.pow(pacing, F.lit(0.75)) * 1.75


def anticipation_ms(pacing: Column) -> Column:
    return F.bround(400 - 280 * pacing)


def duration_tier(seconds: Column) -> Column:
    """short (to 15 minutes), medium (60), long (180), epic."""
    m = seconds / 60.0
    return F.when(m <= 15, "short").when(m <= 60, "medium").when(m <= 180, "long").otherwise("epic")


def _in_order(line: Column, between: str, wanted: Column | None = None) -> Column:
    """The lines of a group by ``seq``, as one text; an aggregate."""
    pairs = F.struct(F.col("seq"), line.alias("line"))
    held = F.collect_list(pairs if wanted is None else F.when(wanted, pairs))
    return F.array_join(F.transform(F.array_sort(held), lambda x: x["line"]), between)


def transcript_forms() -> dict[str, Column]:
    """Aggregates of segments (seq, t0, t1, speaker, text): the whole transcript as SRT, VTT and plain text."""
    flat = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    srt = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"), srt_time(F.col("t0")), F.lit(" --> "), srt_time(F.col("t1")), F.lit("\n["), F.col("speaker"), F.lit("] "), flat)
    vtt = F.concat(vtt_time(F.col("t0")), F.lit(" --> "), vtt_time(F.col("t1")), F.lit("\n"), F.col("speaker"), F.lit(": "), F.col("text"), F.lit("\n"))
    txt = F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("text"))
    return {"srt": _in_order(srt, "\n\n", F.trim("text") != ""), "vtt": F.concat(F.lit("WEBVTT\n\n"), _in_order(vtt, "\n")), "txt": _in_order(txt, "\n")}


def energy_lines(moments: DataFrame) -> DataFrame:
    """(job_id, map): audio moments (t, kind, delta) in time order, a line each."""
    label = F.when(F.col("kind") == "volume_spike", "LOUD").when(F.col("kind") == "extreme_spike", "VERY LOUD").when(F.col("kind") == "silence_to_loud", "SILENCE->LOUD").otherwise("SPIKE")
    line = F.concat(F.lit("["), F.bround("t").cast("long").cast("string"), F.lit("s] "), label, F.lit(" (+"), F.bround("delta").cast("long").cast("string"), F.lit("dB)"))
    rows = moments.select("job_id", F.struct("t", "event_id", line.alias("line")).alias("x"))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("map"))


def reconciled_times(times: Column, n_words: Column) -> Column:
    """Word times (an array of s, e) for a text of so many words: as they are if they are as many, every so-manieth if up to
    three are too many, the longest halved (the first of equals) if up to three are missing, else null."""
    size = F.size(times)
    step = size / n_words
    sampled = F.transform(F.sequence(F.lit(0), n_words - 1), lambda i: F.get(times, F.least((i * step).cast("int"), size - 1)))

    def split(a: Column) -> Column:
        def halve(v: Column) -> Column:
            longest = F.array_max(F.transform(v, lambda t, i: F.struct((t["e"] - t["s"]).alias("d"), (-i).alias("i"))))["i"]
            return bound(-longest, lambda at: F.flatten(F.transform(v, lambda t, i: F.when(i == at, F.array(F.struct(t["s"].alias("s"), ((t["s"] + t["e"]) / 2).alias("e")), F.struct(((t["s"] + t["e"]) / 2).alias("s"), t["e"].alias("e")))).otherwise(F.array(F.struct(t["s"].alias("s"), t["e"].alias("e")))))))

        return bound(a, halve)

    grown = times
    for k in (3, 2, 1):
        grown = F.when(n_words - size >= k, split(grown)).otherwise(grown)
    return F.when(size == n_words, times).when((F.abs(size - n_words) > 3) | (n_words < 1) | (size < 1), F.lit(None)).when(size > n_words, sampled).otherwise(grown)


# Seconds that subtitles run ahead of the sound and that the sound is buffered, rest after every word, pauses
# after punctuation, and words that are spoken fast.
AHEAD, BUFFERED, REST = 0.10, 0.12, 0.04
PAUSES = {",": 0.15, ";": 0.16, ":": 0.12, ".": 0.22, "!": 0.22, "?": 0.24, "\u2014": 0.12, "\u2013": 0.10}
FAST_WORDS = ["the", "a", "an", "to", "in", "on", "at", "of", "for", "and", "but", "or", "is", "was", "are", "were", "it", "its", "this", "that"]


def active_word(text: Column, at: Column, start: Column, end: Column, times: Column, rate: Column) -> Column:
    """The number of the word that is spoken ``at`` a time, -1 before the first (or without words). By the words' ``times`` (an
    array of s, e) if there are as many; else words take time by their letters, the punctuation after them and how fast
    they are, scaled to the segment and the speaker's words a second (``rate``, null: 3)."""
    pause = F.create_map(*[F.lit(x) for pair in PAUSES.items() for x in pair])
    rests = lambda w, c: c["scale"] * (REST + F.coalesce(F.try_element_at(pause, F.substring(w, -1, 1)), F.lit(0.0)))
    now = at + AHEAD - BUFFERED

    def timed(n: Column) -> Column:
        later = F.array_position(F.transform(times, lambda t: now < t["e"]), True).cast("int")
        return F.when(now < F.get(times, F.lit(0))["s"], -1).when(later > 0, later - 1).otherwise(n - 1)

    def measured(ws: Column) -> Column:
        scale = F.greatest(F.lit(0.6), F.least(F.lit(1.6), 3.0 / F.coalesce(rate, F.lit(3.0))))
        return F.struct(F.size(ws).alias("n"), F.aggregate(ws, F.lit(0), lambda a, w: a + F.length(w)).alias("total"), scale.alias("scale"), (at - start + AHEAD * scale - BUFFERED).alias("elapsed"), (end - start).alias("length"))

    def stretched(ws: Column, c: Column) -> Column:
        resting = F.aggregate(ws, F.lit(0.0), lambda a, w: a + rests(w, c))
        return bound(resting, lambda r: bound(F.greatest(c["length"] - r, c["length"] * 0.45), lambda letters: F.struct(letters.alias("letters"), ((c["length"] - letters) / F.greatest(r, F.lit(0.01))).alias("stretch"))))

    def spoken(ws: Column, c: Column, z: Column) -> Column:
        def duration(w: Column, i: Column) -> Column:
            own = z["letters"] * (F.length(w) / c["total"]) + rests(w, c) * z["stretch"]
            fast = F.when(F.regexp_replace(F.lower(w), "[.,!?;:\u2014\u2013]+$", "").isin(FAST_WORDS), 0.75).otherwise(1.0)
            return own * fast * F.when(i == 0, 1.15).when(i == c["n"] - 1, 1.10).otherwise(1.0)

        begin = F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("i"), F.lit(-1).alias("found"))
        step = lambda a, d: F.struct((a["t"] + d).alias("t"), (a["i"] + 1).alias("i"), F.when(a["found"] >= 0, a["found"]).when(c["elapsed"] < a["t"] + d, a["i"]).otherwise(-1).alias("found"))
        return F.aggregate(F.transform(ws, duration), begin, step, lambda a: F.when(a["found"] >= 0, a["found"]).otherwise(a["i"] - 1))

    def found(ws: Column) -> Column:
        def by(c: Column) -> Column:
            letters = F.when(c["elapsed"] < 0, -1).otherwise(bound(stretched(ws, c), lambda z: spoken(ws, c, z)))
            return F.when(c["n"] <= 1, c["n"] - 1).when(F.size(times) == c["n"], timed(c["n"])).otherwise(letters)

        return bound(measured(ws), by)

    return bound(words(text), found)
