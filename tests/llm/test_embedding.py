import numpy as np
import pytest

from rivulet.llm import embedding
from rivulet.llm.components import components


def brute(rows, threshold):
    sound = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    near = {i: set() for i in range(len(rows))}
    for i, a in sound.items():
        for j, b in sound.items():
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                near[i].add(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((key, len(near[i]), least, key == least))
    return sorted(out, key=str)


def make(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        base = centres[rng.integers(6)] if rng.random() < 0.8 else rng.normal(size=8)
        rows.append((int(i * 3 + 1), [float(np.float32(e)) for e in base + spread * rng.normal(size=8)]))
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [float("inf")] * 8), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [-0.0, 3.0]), (2009, [0.0, 3.0])]
    return rows + [(3000 + i, rows[0][1]) for i in range(5)] + [(4000, [e * 7 for e in rows[1][1]])]


@pytest.mark.parametrize("seed,spread,cell,block", [(1, 0.4, 8192, 8192), (2, 0.5, 20, 8192), (3, 0.3, 30, 7), (4, 1.5, 10, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, spread, cell, block):
    monkeypatch.setattr(embedding, "CELL_ROWS", cell)
    rows = make(seed, 150, spread)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = embedding.deduplicate(frame, 0.9, block_rows=block).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 0.9)


@pytest.mark.parametrize("seed,spread", [(5, 0.4), (6, 1.2)])
def test_divided_cells_equal_brute_force(spark, monkeypatch, seed, spread):
    for name, value in {"CELL_ROWS": 8, "MAX_CELLS": 3, "SPLIT": 2, "_SPLIT_ROWS": 20}.items():
        monkeypatch.setattr(embedding, name, value)
    rows = make(seed, 220, spread)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = embedding.deduplicate(frame, 0.9, block_rows=16).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 0.9)


def test_null_and_repeated_ids_with_unlike_vectors(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (1, b), (2, a), (3, [0.0, 1.0, 0.1]), (None, a), (None, [5.0, -5.0, 0.0]), (None, [5.0, -5.0, 0.1]), (None, None), (7, None), (7, a)]
    out = embedding.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((tuple(r) for r in out), key=str) == brute(rows, 0.9)


def test_empty(spark):
    assert embedding.deduplicate(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(5, 5), (3, 7), (7, 3)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {i: 100 for i in range(100, 141)} | {i: 3 for i in [3, 7, *range(20, 60)]}
