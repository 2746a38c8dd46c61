"""Registries of faces against plain readings of their rules."""

import numpy as np
import pytest

from rivulet.operators import face_registry as R
from rivulet.plans import registry_queries

DIR = "/root/testdata/sf0.001"


def embedding(seed):
    v = np.random.default_rng(seed).normal(size=128)
    return v / np.linalg.norm(v)


def registry_of(faces, **more):
    """faces: [(frame, x, vector)]"""
    frame, x, vectors = (list(c) for c in zip(*faces, strict=True))
    n = len(x)
    return R.identity_slots(np.array(frame), np.array(x, float), np.full(n, 8.0), np.full(n, 10.0), np.ones(n), vectors, **more)


def test_six_people_who_walk_are_six():
    people = [(100 + i, 10 + 5 * i, 60 + 5 * i) for i in range(6)]
    faces = [(i, a + (b - a) * i / 29, embedding(seed)) for i in range(30) for k, (seed, a, b) in enumerate(people) if (i + k * 3) % 5 < 3]
    slots, source = registry_of(faces)
    assert (len(slots), source) == (6, "embedding") and all(s["x_max"] - s["x_min"] > 40 for s in slots)


def test_two_people_who_cross_stay_two():
    faces = [f for i in range(20) for f in ((i, 20 + 60 * i / 19, embedding(200)), (i, 80 - 60 * i / 19, embedding(201)))]
    slots, source = registry_of(faces)
    assert (len(slots), source) == (2, "embedding") and [s["frame_count"] for s in slots] == [20, 20]


def test_alike_faces_of_one_frame_are_not_joined():
    same = embedding(1)
    faces = [f for i in range(10) for f in ((i, 20.0, same), (i, 70.0, same))]
    assert len(R.constrained_groups(np.array([f[0] for f in faces]), np.array([f[1] for f in faces]), np.array([f[2] for f in faces]))) == 2


def by_pairs(frame, x, vectors, near):
    """Every pair in order; a join is refused if any pair across the groups is of one frame and apart."""
    n = len(x)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    group = list(range(n))
    for i in range(n):
        for j in range(i + 1, n):
            if group[i] != group[j] and 1 - unit[i] @ unit[j] < near:
                a, b = ([k for k in range(n) if group[k] == group[m]] for m in (i, j))
                if not any(frame[p] == frame[q] and abs(x[p] - x[q]) > 5 for p in a for q in b):
                    for k in b:
                        group[k] = group[i]
    return sorted(tuple(k for k in range(n) if group[k] == g) for g in set(group))


@pytest.mark.parametrize("seed", range(12))
def test_constrained_groups_equal_the_pairwise_rule(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 45))
    vectors = rng.normal(size=(4, 6))[rng.integers(0, 4, n)] + rng.normal(0, 0.25, (n, 6))
    frame, x = rng.integers(0, max(2, n // 3), n), rng.uniform(0, 30, n).round(1)
    assert [tuple(g.tolist()) for g in R.constrained_groups(frame, x, vectors)] == by_pairs(frame, x, vectors, 0.20)


def test_places():
    every = lambda xs, n, jitter=0.0: [(t, x + jitter * ((t * 7 + int(x)) % 5 - 2) / 2) for t in range(n) for x in xs]

    def slots(faces, weight=None, **more):
        frame, x = (np.array(c, float) for c in zip(*faces, strict=True))
        return R.place_slots(frame.astype(int), x, np.full(len(x), 7.0), np.full(len(x), 9.0), np.ones(len(x)) if weight is None else np.array(weight), **more)

    assert [s["x_center"] for s in slots(every([12, 27, 42, 57, 72, 87], 30))] == [12, 27, 42, 57, 72, 87]
    assert len(slots(every([15, 30, 45, 60, 75, 90], 25, 2.0))) == 6
    assert slots([]+[(0, 50.0)]) == [] and [s["x_center"] for s in slots(every([25, 75], 12))] == [25, 75]
    # faces near the middle join a cluster within 15 of its mean, others belong to nobody
    assert [(s["x_center"], s["frame_count"]) for s in slots(every([30], 8) + [(20, 41.0), (21, 59.0)])] == [(30.0, 9)]
    # two people near the middle are told by a gap of eight and more
    assert [s["x_center"] for s in slots(every([44, 55], 5))] == [44, 55]
    # light faces need more frames
    assert slots(every([30], 8), [0.35] * 8) == [] and len(slots(every([30], 9), [0.35] * 9)) == 1
    # one chain of faces with two heaps
    heaps = [(t, x) for t in range(20) for x in (30.0 + t % 3, 62.0 - t % 3)] + [(30 + i, 30.0 + i * 1.0) for i in range(32)]
    assert len(slots(heaps, gap=15.0)) >= 2
    far = slots(every([25, 75], 12) + [(50, 1.0), (51, 99.0)])
    assert [s["x_min"] for s in far] == [25, 75]


def test_leaders_against_all_earlier_tracks():
    rng = np.random.default_rng(4)
    base = rng.uniform(0, 1, (5, 12))
    tracks = [None if rng.random() < 0.1 else (base[rng.integers(0, 5)] + rng.uniform(0, 0.3, 12)).tolist() for _ in range(90)] + [[1.0, 2.0]]
    want, fresh = [], 0
    for i, s in enumerate(tracks):
        best, found = 0.2, None
        for j in range(i):
            o = tracks[j]
            if s is None or o is None or len(o) != len(s):
                continue
            bc = sum((p * q) ** 0.5 for p, q in zip(s, o, strict=True)) / (sum(s) * sum(o)) ** 0.5
            far = max(0.0, 1 - bc) ** 0.5
            if far < best:
                best, found = far, want[j]
        want.append(fresh if found is None else found)
        fresh += found is None
    assert R.leaders(tracks, 0.2, block=16).tolist() == want and fresh < 60


def test_registry_queries(spark):
    """Every job's registry from one task's arrays equals the rule applied to its collected rows."""
    rows = {}
    for r in registry_queries.embedded_faces(spark, DIR).orderBy("frame", "k").collect():
        rows.setdefault(r.job_id, []).append(r)
    made = {}
    for r in registry_queries.identity_registry(spark, DIR).collect():
        made.setdefault(r.job_id, []).append(r)
    kinds = set()
    for job, own in rows.items():
        column = lambda c, own=own: np.array([r[c] for r in own])
        slots, source = R.identity_slots(column("frame"), column("x"), column("w"), column("h"), np.ones(len(own)), [r.embedding for r in own])
        assert [(r.slot, r.x_center, r.frame_count, r.source) for r in sorted(made.get(job, []), key=lambda r: r.slot)] == [(i, s["x_center"], s["frame_count"], source) for i, s in enumerate(slots)]
        kinds |= {source} if slots else set()
    assert kinds
