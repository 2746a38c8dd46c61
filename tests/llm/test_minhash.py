import random
import re
from collections import Counter

import numpy as np
import pytest

from rivulet.llm import minhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text, k=5):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    found = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else [text] if text else [])
    return Counter(found)


def similar(a, b):
    return bool(a) and sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-12


def brute(rows):
    bags = [bag(t or "") for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(bags[i], bags[j]) or (rows[i][1] and rows[i][1] == rows[j][1]):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted((doc, min(groups[find(i)])) for i, (doc, _) in enumerate(rows))


def test_registers_estimate_weighted_jaccard():
    rng = random.Random(2)
    for _ in range(6):
        a, b = Counter(), Counter()
        for x in range(60):
            a[x], b[x] = rng.choice([0, 1, 1, 3, 9]), rng.choice([0, 1, 2, 3, 20])
        want = sum((a & b).values()) / sum((a | b).values())
        hashes, weights, row = [], [], []
        for r, c in enumerate((+a, +b)):
            for x, w in c.items():
                hashes.append((x + 1) * 0x9E3779B97F4A7C15 % 2**64)
                weights.append(w)
                row.append(r)
        held = minhash.signatures(np.array(hashes, np.uint64), np.array(weights), np.array(row), 2, 4095)
        assert np.isfinite(held).all()
        assert abs((held[0] == held[1]).mean() - want) < 4 * (want * (1 - want) / 4095) ** 0.5 + 0.005
        assert abs(held[0].mean() * sum(a.values()) - 1) < 0.1  # each register waits for rate = total weight


def test_registers_do_not_depend_on_the_slice():
    rng = np.random.default_rng(4)
    sizes = [1, 3, 12, 40, 120, *[400] * 140]
    row = np.repeat(np.arange(len(sizes)), sizes)
    hashes = rng.integers(0, 2**64, len(row), np.uint64)
    weights = rng.choice([1, 1, 1, 2, 7], len(row))
    assert len(row) > 50_000
    held = minhash.signatures(hashes, weights, row, len(sizes))
    some = row < 15  # between 4 and 32 arrivals a step
    assert (minhash.signatures(hashes[some], weights[some], row[some], 15) == held[:15]).all()
    for r in range(6):
        own = row == r
        assert (minhash.signatures(hashes[own], weights[own], row[own] - r, 1)[0] == held[r]).all()


def test_banding_loses_less_than_one_pair_in_a_million():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-6


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 150]))] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", ", "]).join(w)))
    rows += [(200, None), (201, ""), (202, None), (203, "a b"), (204, "A, b"), (205, "..."), (206, "..."), (207, "x " * 400), (208, "x " * 380), (209, "x " * 200)]
    return rows + [(300, rows[0][1]), (300, rows[0][1]), (301, rows[0][1])]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    rows = make(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    real = [r for r in rows if r[1]]
    out = minhash.classes(docs.filter("text <> ''")).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, out)) == brute(real)


def test_rows_without_text_are_their_own_classes(spark):
    rows = [*make(3), (400, ""), (401, ""), (None, None), (402, ""), (402, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = minhash.classes(docs).collect()
    real = [r for r in rows if r[1]]
    bare = {200, 201, 202, 400, 401, 402, None}
    assert len(out) == len(rows)
    assert sorted((r.doc_id, r.class_id) for r in out if r.doc_id not in bare) == brute(real)
    own = [r for r in out if r.doc_id in bare]
    assert len(own) == 8 and all(r.class_id == r.doc_id and r.kept for r in own)
    only = minhash.classes(docs.filter("coalesce(text, '') = ''")).collect()
    assert len(only) == 8 and all(r.class_id == r.doc_id and r.kept for r in only)


def test_one_of_each_class_stays(spark):
    rows = make(5)
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, kept string")
    left = minhash.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in left) == sorted({c for _, c in brute([r for r in rows if r[1]])} | {200, 201, 202})
    assert minhash.deduplicate(docs.limit(0)).count() == 0


def test_a_large_group_with_a_bridge_and_strangers(spark, monkeypatch):
    """Near copies of one text, drifting away from it step by step: the chain links what the first member doesn't."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 64)
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 99999)}" for _ in range(200)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    chain = list(words)
    for i in range(30):
        chain[6 * i : 6 * i + 6] = [f"y{i}.{k}" for k in range(6)]
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(words[:100] + [f"z{i}.{k}" for k in range(100)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = minhash.classes(docs).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, out)) == brute(rows)
