import itertools
import math
import random
import re

from rivulet.llm import filter_audit


def brute(docs, labels):
    """Every order run over the rows themselves; Shapley values by running all orders."""
    marked = {c: {r[0] for r in labels if r[0] is not None and r[i] == 1} for i, c in ((1, "good"), (2, "toxic"))}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, source in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        first = least.get(t)
        fails = "".join(
            f
            for f, x in zip(
                "ABCDE",
                [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), first is not None and (i is None or i > first)],
                strict=True,
            )
            if x
        )
        parts.setdefault(source or "", []).append((fails, i in marked["good"], i in marked["toxic"]))
    out = []
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*x[:9], shapley[x[9]]) for x in found]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, docs, labels):
    made = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert made.columns == COLUMNS and [t for _, t in made.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    return sorted(map(tuple, made.collect()))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)] + ["BIG", "#tag", "a|b", "é\x0bü", "nb sp"]
    text = lambda: rng.choice([" ", "\n", "\x0c  "]).join(rng.choice(pool[: rng.choice([20, 405])]) for _ in range(rng.choice([3, 49, 50, 51, 120])))
    docs = [(i, text(), f"s{i % 3}") for i in range(150)]
    docs += [(200 + i, docs[rng.randrange(150)][1], rng.choice(["s0", "s9", None, ""])) for i in range(60)]
    docs += [(400, None, "s1"), (401, "", "s1"), (402, " \n", None), (None, "", "s0"), (None, "only without an id", "s0"), (None, "only without an id", "s0"), (3, docs[3][1], "s0"), (-5, docs[7][1], "s2"), (500, "x " * 200_000, "s1")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (200, 1, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_bounds_of_the_filters(spark):
    """Exactly 50 words, 65 % distinct and 5 % capitals pass."""
    fifty = " ".join(f"w{i}" for i in range(50))
    shares = " ".join(f"v{i % 65}" for i in range(100))
    capitals = ("A" * 5 + "b" * 14 + " ") * 5
    docs = [(1, fifty, "a"), (2, shares, "b"), (3, capitals, "c"), (4, fifty, "d")]
    assert run(spark, docs, []) == brute(docs, [])


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], []) == [] and len(run(spark, [(1, "x", None)], [])) == 600
    docs = spark.createDataFrame([(1, "x", "s", 7, 8)], "doc_id long, text string, source string, mask int, least long")
    labels = spark.createDataFrame([(1, 1, 1, "z")], "doc_id long, quality int, toxic int, part string")
    made = filter_audit.audit(docs, labels).filter("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r.removed, r.good_lost, r.toxic_lost, r.shapley) for r in made] == [(1, 1, 1, math.factorial(5))]
