import hashlib
import random
import re

import pytest

from rivulet.llm import substring


def brute(rows, n):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed, vocabulary):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for _ in range(n))
    passages = [text(n) for n in (11, 12, 13, 20, 40)]
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randint(0, 40)) + (rng.choice(passages) if rng.random() < 0.6 else "") + text(rng.randint(0, 20))))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, text(6)), (103, None), (104, ""), (105, "a b " * 30), (106, passages[4]), (106, passages[4]), (None, passages[3])]
    return rows + [(107, rows[62][1])]


@pytest.mark.parametrize("seed,size", [(1, 400), (2, 30), (3, 3)])
def test_equals_brute_force(spark, seed, size):
    rows = make(seed, [f"w{i}é" for i in range(size)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring.deduplicate(docs, n=12).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 12)


def test_runs_are_compacted_and_agree_with_one_batch(spark):
    rows = make(4, [f"w{i}" for i in range(100)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, substring.deduplicate(docs, n=12, batches=1).collect()), key=str)
    assert one == sorted(map(tuple, substring.deduplicate(docs, n=12, batches=7).collect()), key=str) == brute(rows, 12)


def test_kept_text_and_empty(spark):
    docs = spark.createDataFrame([(1, "x a b c d"), (2, "a b c d y")], "doc_id long, text string")
    out = substring.deduplicate(docs, n=4, with_text=True).collect()
    assert {(r.doc_id, r.n_removed, r.kept) for r in out} == {(1, 4, "x"), (2, 4, "y")}
    assert substring.deduplicate(docs.limit(0), n=4).count() == 0


def brute_in_batches(batches, n):
    """Rows of each batch, words covered by a window that occurs elsewhere in the batch or in a batch before."""
    seen, out = set(), []
    for rows in batches:
        words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
        count = {}
        for w in words:
            for i in range(len(w) - n + 1):
                count[tuple(w[i : i + n])] = count.get(tuple(w[i : i + n]), 0) + 1
        found = []
        for (doc, _), w in zip(rows, words, strict=True):
            gone = {k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 or tuple(w[i : i + n]) in seen for k in range(i, i + n)}
            left = " ".join(x for i, x in enumerate(w) if i not in gone)
            found.append((doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
        out.append(sorted(found, key=str))
        seen |= set(count)
    return out


def test_history_removes_repeats_of_new_batches(spark, tmp_path):
    rows = make(6, [f"w{i}" for i in range(200)])
    rng = random.Random(6)
    rng.shuffle(rows)
    batches = [rows[i::6] for i in range(6)]
    want = brute_in_batches(batches, 12)
    assert sum(r[2] for found in want[1:] for r in found) > 100
    for k, batch in enumerate(batches):  # more batches than an index holds runs, and a fresh index object for each
        index = substring.FingerprintIndex.open(spark, f"file://{tmp_path}/index")
        assert len(index.runs) == min(k, k % (substring.MAX_RUNS + 1) + k // (substring.MAX_RUNS + 1))
        docs = spark.createDataFrame(batch, "doc_id long, text string").repartition(2)
        out = substring.deduplicate_batch(docs, index, n=12).collect()
        assert sorted(map(tuple, out), key=str) == want[k]
    assert substring.deduplicate_batch(docs.limit(0), index, n=12).count() == 0


def test_an_unfinished_change_is_not_seen(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = substring.FingerprintIndex.open(spark, path)
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    substring.deduplicate_batch(docs, index, n=4)
    index.ingest(substring.told_apart(substring.sketch(spark.createDataFrame([(2, "p q r s")], "doc_id long, text string"), 4)))
    again = substring.FingerprintIndex.open(spark, path)
    assert again.runs == index.runs[:1] and again._made > index._made - 1
    both = spark.createDataFrame([(3, "p q r s"), (4, "b c d e")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.deduplicate_batch(both, again, n=4).collect()} == {3: 0, 4: 4}
