import hashlib
import random

import numpy as np
import pytest

from rivulet.llm import suffixes


def brute(rows, n):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - n + 1):
            seen[d[i : i + n]] = seen.get(d[i : i + n], 0) + 1
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = [False] * len(d)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        left = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def make(seed, letters):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (39, 40, 41, 80, 150, 400)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.choice([0, 1, 3, 60]))]
        rows.append((i, "".join(parts)))
    for i in range(40):  # near copies
        t = list(rows[rng.randrange(30)][1])
        if t:
            t[rng.randrange(len(t))] = "?"
        rows.append((200 + i, "".join(t)))
    rows += [(300, rows[5][1]), (301, rows[5][1]), (302, text(39)), (303, None), (304, ""), (305, "ab" * 300), (306, passages[1]), (306, passages[1]), (None, passages[4]), (None, "x" + passages[4]), (307, "é" * 30), (308, "aé" * 40), (309, "\0" * 90)]
    return rows


def run(spark, rows, n, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in suffixes.deduplicate(docs, n=n, **more).collect()), key=str)


@pytest.mark.parametrize("seed,letters,gram,bucket", [(1, "abcdefghijklmnopqrstuvwxyzé", 16, 64), (2, "ab", 16, 3), (3, "abcd", 64, 1)])
def test_equals_brute_force(spark, seed, letters, gram, bucket):
    rows = make(seed, letters)
    assert run(spark, rows, 40, gram=gram, bucket=bucket, piece=128) == brute(rows, 40)


def test_short_windows_and_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "xabcdé"), (2, "abcdéy")], "doc_id long, text string")
    out = suffixes.deduplicate(docs, n=5, with_text=True).collect()
    assert {(r.doc_id, r.n_removed, bytes(r.kept)) for r in out} == {(1, 6, b"x"), (2, 6, b"y")}
    assert suffixes.deduplicate(docs.limit(0), n=5).count() == 0


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_500_000))
    rows = [(1, long, 1, "k"), (2, "." * 10 + long[1_048_000:1_049_000] + "-" * 10, 2, "k"), (3, "z" + long[:199], 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, copied string")
    out = {r.doc_id: r for r in suffixes.deduplicate(docs, n=200).collect()}
    assert [(out[i].n_bytes, out[i].n_removed, out[i].n_spans) for i in (1, 2, 3)] == [(1_500_000, 1000, 1), (1020, 1000, 1), (200, 0, 0)]
    assert out[1].kept_sha256 == hashlib.sha256((long[:1_048_000] + long[1_049_000:]).encode()).hexdigest()


def test_groups_are_verified(monkeypatch):
    """With digits of equal hashes, the strings themselves decide."""
    rng = np.random.default_rng(2)
    spans = [rng.integers(0, 2, 50).astype(np.uint8).tobytes() for _ in range(6)] + [bytes(50), bytes(50)]
    args = (np.array([1, 1, 1, 2, 2, 2, 3, 3]), np.full(8, 10), np.full(8, 11), spans, 40)
    want = suffixes.repeated_suffixes(*args)
    real = suffixes.tokens.mix
    monkeypatch.setattr(suffixes.tokens, "mix", lambda x: real(x) % np.uint64(2))
    found = suffixes.repeated_suffixes(*args)
    assert want[2].sum() == 22 and all((a == b).all() for a, b in zip(want, found, strict=True))
