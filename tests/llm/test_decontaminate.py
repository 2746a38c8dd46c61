import hashlib
import random
import re

import pytest

from rivulet.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, n):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - n) + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in grams[tuple(w[i : i + size])] if x is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "bé", "c3", "Dd", "e'", "ß", "f"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", " x "]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 8, 12]))) for i in range(8)] + [(3, "A bé"), (9, None), (10, "..."), (None, "f f f f")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(50, None), (51, ""), (52, items[0][1] * 3), (52, items[0][1] * 3)]
    return docs, items


@pytest.mark.parametrize("seed,most", [(1, 10**6), (2, 10**6), (3, 5)])
def test_equals_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", most)
    docs, items = make(seed)
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, n_hit string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.report(d, b, n=4).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(docs, items, 4)


def test_passes_hold_one_block_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 5)
    docs, items = make(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.windows(b, 4).count() > 20
    plan = decontaminate.scan(d, b, n=4)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # every pass is a table by now
    assert {r.doc_id for r in decontaminate.remove_documents(d, b, n=4).collect()} == {r[0] for r in brute(docs, items, 4) if not r[5]}


def test_removal(spark):
    d = spark.createDataFrame([(1, "x A b, C d y"), (2, "a b"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.remove_spans(d, b, n=4).collect()} == {(1, "x  y"), (2, "a b"), (3, None)}
    assert {r.doc_id for r in decontaminate.remove_documents(d, b, n=4).collect()} == {2, 3}
    assert decontaminate.remove_documents(d, b.limit(0), n=4).count() == 3
    assert decontaminate.report(d.limit(0), b, n=4).count() == 0
