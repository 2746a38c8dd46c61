import random
import re

import numpy as np
import pytest

from rivulet.llm import lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def line_set(line, k):
    w = WORD.findall(line.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, threshold, k):
    place = []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        place += [(doc, text, i, line_set(x, k)) for i, x in enumerate(text.split("\n"))] if text is not None else []
    gone = set()
    for j, (doc, text, i, s) in enumerate(place):
        if s and any(p and len(s & p) >= threshold * len(s | p) - 1e-12 for *_, p in place[:j]):
            gone.add((doc, text, i))
    out = []
    for doc, text in rows:
        parts = text.split("\n") if text is not None else []
        kept = [x for i, x in enumerate(parts) if (doc, text, i) not in gone]
        out.append((doc, "\n".join(kept) if text is not None else None, len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 1), (3, 2), (4, 5)])
def test_equals_brute_force(spark, seed, k):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "A1"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 12, 25]))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return rng.choice(["", " ", "- "]) + rng.choice([" ", ", "]).join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "...\n\n" + rows[3][1] + "\n"), (64, rows[3][1]), (64, rows[3][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, n_lines string").repartition(3)
    out = lines.deduplicate(docs, 0.8, shingle=k).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 0.8, k)


def test_lines_of_rows():
    texts = [b"", b"a\n", b"\n", b"a b\nc", b"x"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    first, hashes, owner, words = lines.line_tokens(np.frombuffer(b"".join(texts), np.uint8), at, 5)
    assert first.tolist() == [0, 1, 3, 5, 7, 8] and words.count[: first[-1]].tolist() == [0, 1, 0, 0, 0, 2, 1, 1]


def test_keys_tell_lines_that_one_hash_does_not(monkeypatch):
    """Short lines, of one token each: equal in one family of hashes, they are told by the other."""
    data = np.frombuffer(b"ab cd\nef gh", np.uint8)
    real = lines.tokens.Words.hashes
    for blind in (0, 1):
        monkeypatch.setattr(lines.tokens.Words, "hashes", lambda self, family=0, blind=blind: real(self, family) * np.uint64(family != blind))
        words = lines.line_tokens(data, np.array([0, len(data)]), 5)[3]
        keys = [lines.line_keys(words, family) for family in (0, 1)]
        assert keys[blind][0] == keys[blind][1] and keys[1 - blind][0] != keys[1 - blind][1]


@pytest.mark.parametrize("buckets", [3, 100_000])
def test_frequent_tokens_in_many_buckets(spark, monkeypatch, buckets):
    """Every token is frequent, so all are dealt over many buckets and mostly alone there."""
    monkeypatch.setattr(lines, "rarity", lambda counters: np.ones(len(counters), np.uint8))
    monkeypatch.setattr(lines, "BUCKET_TOKENS", buckets)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 9)}{i}" for i in range(30)]
    rows = []
    for i in range(80):
        w = list(base)
        w[rng.randrange(30)] = f"x{i}"
        rows.append((i, " ".join(w) + f"\nother line of number {i} and its words {i * 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = lines.deduplicate(docs, 0.7, shingle=3).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 0.7, 3)


def test_empty(spark):
    assert lines.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_picked_lines_are_cut_into_words():
    """The sets of chosen lines are those of the whole text, and no other line's bytes are worked on."""
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice(["Ab", "é", "c" * 9, "d" * 70, "e" * 17, "..", "7"]) for _ in range(rng.choice([0, 1, 2, 5, 9]))) for _ in range(rng.randint(1, 7))).encode() for _ in range(40)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, hashes, owner, words = lines.line_tokens(data, at, 5)
    picked = np.flatnonzero((words.count > 0) & (np.arange(len(words.count)) % 3 == 0))
    cut, line_at = lines.cut_lines(data, lines.line_bounds(data, at)[1], picked)
    own, of, some = lines.tokens_of_lines(cut, line_at, 5)
    assert 0 < len(cut) < 0.6 * len(data) and np.diff(line_at).min() > 0
    for i, line in enumerate(picked.tolist()):
        assert own[of == i].tolist() == hashes[owner == line].tolist()
    for family in (0, 1):
        assert (lines.line_keys(some, family) == lines.line_keys(words, family)[picked]).all()


def test_word_hashes_by_chunks_tell_words_apart():
    """Words of every length around the chunks' borders, unlike in one byte or in length, have hashes of their own."""
    named = {b"a" * i + b"b" * (k - i) for k in [*range(1, 20), 63, 64, 65, 66, 200] for i in range(k + 1)}
    named = sorted(named)
    data = np.frombuffer(b" ".join([*named, *named]), np.uint8)
    words = lines.tokens.Words(data, np.array([0, len(data)]), lines.tokens.NORMAL, chunked=True)
    for family in (0, 1):
        hashes = words.hashes(family)
        assert (hashes[: len(named)] == hashes[len(named) :]).all() and len(np.unique(hashes)) == len(named)
