"""Alignment and filters of transcripts against plain readings of their rules."""

import random
from collections import Counter

import pytest

from rivulet.operators import alignment as A
from rivulet.plans import transcript_queries as Q

DIR = "/root/testdata/sf0.001"


def matching(a, b):
    """Opcodes by the longest common block, the earliest of equals, and again on both sides of it."""

    def longest(i, i2, j, j2):
        best = (0, 0, 0)
        for x in range(i, i2):
            for y in range(j, j2):
                n = 0
                while x + n < i2 and y + n < j2 and a[x + n] == b[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        return best

    def within(i, i2, j, j2):
        n, x, y = longest(i, i2, j, j2)
        return [] if n == 0 else [*within(i, x, j, y), (x, y, n), *within(x + n, i2, y + n, j2)]

    out, i, j = [], 0, 0
    joined = []
    for x, y, n in within(0, len(a), 0, len(b)):
        if joined and joined[-1][0] + joined[-1][2] == x and joined[-1][1] + joined[-1][2] == y:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((x, y, n))
    for x, y, n in [*joined, (len(a), len(b), 0)]:
        if i < x and j < y:
            out.append(("replace", i, x, j, y))
        elif i < x:
            out.append(("delete", i, x, j, y))
        elif j < y:
            out.append(("insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def by_rule(words, text):
    new = text.split()
    if not words or not new:
        return words
    bare = lambda w: w.lower().strip(".,!?;:")
    out = []
    for kind, i, i2, j, j2 in matching([bare(w[0]) for w in words], [bare(w) for w in new]):
        if kind == "equal":
            out += [(new[j + k], *words[i + k][1:]) for k in range(i2 - i)]
            continue
        if kind == "delete" or (kind == "insert" and not out):
            continue
        a, b = (words[i][1], words[i2 - 1][2]) if kind == "replace" else (out[-1][2], words[i][1] if i < len(words) else out[-1][2] + 0.1)
        each = (b - a) / (j2 - j)
        out += [(new[j + k], round(a + k * each, 3), round(a + (k + 1) * each, 3)) for k in range(j2 - j)]
    return out or words


def test_realigned_words():
    rng = random.Random(6)
    pool = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "home"]
    for _ in range(400):
        old = [rng.choice(pool) for _ in range(rng.randint(0, 14))]
        words = [(w, round(i * 0.4, 3), round(i * 0.4 + 0.3, 3)) for i, w in enumerate(old)]
        new = [w for w in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 3)):
            new.insert(rng.randint(0, len(new)), rng.choice([*pool, "New,"]))
        text = " ".join(w.upper() + "." if rng.random() < 0.2 else w for w in new)
        assert A.realigned(words, text) == by_rule(words, text)


def test_realigned_query(spark):
    made = {}
    for r in Q.realigned_words(spark, DIR).collect():
        made.setdefault((r.job_id, r.seq), []).append((r.i, r.word, r.w0, r.w1))
    assert len(made) > 60
    for own in made.values():
        own.sort()
        assert [w[0] for w in own] == list(range(len(own))) and all(w[2] <= w[3] + 1e-9 for w in own)
    assert sum("indeed" in {w[1] for w in own} for own in made.values()) > 20


def ratio(a, b):
    """Twice the matched characters over all; for short texts no character counts as junk."""
    same = sum(i2 - i for kind, i, i2, _, _ in matching(a, b) if kind == "equal")
    return 2 * same / (len(a) + len(b)) if a or b else 1.0


def loops(text):
    cjk = any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯" for c in text[:50])
    units, size, least, share = (text.replace(" ", ""), 6, 18, 0.3) if cjk else (text.lower().split(), 3, 9, 0.4)
    grams = [tuple(units[i : i + size]) for i in range(len(units) - size + 1)]
    most = max(Counter(grams).values(), default=0)
    return len(units) >= least and most >= 3 and most / len(grams) > share


def filter_by_rule(rows, translated=False):
    """rows: (seq, t0, t1, text, confidence, no_speech), by seq. {seq: stays}"""
    out, kept = {}, []
    for k, (seq, t0, t1, text, confidence, silence) in enumerate(rows):
        text = text.strip()
        if not text:
            continue
        out[seq] = False
        low, words, length = text.lower(), text.lower().split(), t1 - t0
        if silence > 0.9 and confidence < 0.1:
            continue
        if low.rstrip(".!") in A.BOILERPLATE and confidence < 0.5 and (not kept or k >= len(rows) - 2):
            continue
        if any(e in low for e in A.ECHOES):
            continue
        if length > (60 if translated else 15) and len(text) / length < (0.1 if translated else 1.0):
            continue
        if length > (300 if translated else 120) and len(text) < (10 if translated else 200):
            continue
        if kept and t0 < kept[-1][0]:
            continue
        if len(text) > 1500 or loops(text):
            continue
        if kept and len(words) > 3 and length < 3 and abs(t0 - kept[-1][0]) < 2 and ratio(kept[-1][2], low) > 0.92:
            continue
        if len(kept) >= 2:
            same = [r for r in kept[-10:] if r[2] == low]
            if same and not (translated and all(abs(t0 - r[1]) >= 5 for r in same)):
                continue
            if not same and not (translated and len(words) <= 5) and len(words) > 3 and len(text) > 15:
                own = set(words)
                if any(2 <= abs(t0 - r[0]) <= 30 and len(own & set(r[2].split())) / len(own | set(r[2].split())) > (0.85 if translated else 0.7) for r in kept[-10:]):
                    continue
        kept.append((t0, t1, low))
        out[seq] = True
    return out


@pytest.mark.parametrize("translated", [False, True])
def test_filtered_segments(spark, translated):
    rng = random.Random(8)
    pool = ["yes", "really", "the bridge is long", "we go on with it now", "we go on with it today", "so we go on with it now then", "Thanks for watching!", "music", "translate names as-is please", "一二三四五六" * 4, "la la la la la la la la la la", " ", "a b c d e f g h i j"]
    rows, t = [], 0.0
    for job in range(30):
        t = 0.0
        for seq in range(25):
            t += rng.choice([0.4, 1.0, 3.0, 9.0, -2.0])
            rows.append((job, seq, t, t + rng.choice([1.0, 2.0, 4.0, 20.0, 70.0, 400.0]), rng.choice(pool), rng.choice([0.05, 0.4, 0.9]), rng.choice([0.1, 0.95])))
    table = spark.createDataFrame(rows, "job_id long, seq long, t0 double, t1 double, text string, confidence double, no_speech double")
    found = {(r.job_id, r.seq): r.reason for r in A.filtered(table, translated).collect()}
    want = {(job, seq): stays for job in range(30) for seq, stays in filter_by_rule([r[1:] for r in rows if r[0] == job], translated).items()}
    assert {k: v is None for k, v in found.items()} == want
    assert len({v for v in found.values()}) >= 7 and 50 < sum(want.values()) < len(want)


def test_filtered_query(spark):
    rows = {}
    for r in Q.raw_segments(spark, DIR).orderBy("job_id", "seq").collect():
        rows.setdefault(r.job_id, []).append((r.seq, r.t0, r.t1, r.text, r.confidence, r.no_speech))
    want = {(job, seq): stays for job, own in rows.items() for seq, stays in filter_by_rule(own).items()}
    assert {(r.job_id, r.seq): r.reason is None for r in Q.filtered_segments(spark, DIR).collect()} == want
    assert 0 < sum(want.values()) < len(want)
