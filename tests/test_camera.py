"""Camera paths against brute force."""

import numpy as np
import pytest

from rivulet.operators import camera as C


def dense_cost(y, low, high, smooth):
    """The least cost over all places that are a target or a bound: a best path runs through such places only."""
    c = np.unique(np.concatenate([y, low, high]))
    cost = np.where((c >= low[0]) & (c <= high[0]), abs(c - y[0]), np.inf)
    for i in range(1, len(y)):
        cost = (cost[None, :] + smooth * abs(c[:, None] - c[None, :])).min(axis=1)
        cost = np.where((c >= low[i]) & (c <= high[i]), cost + abs(c - y[i]), np.inf)
    return cost.min()


@pytest.mark.parametrize("seed", range(4))
def test_least_path_is_optimal_and_within_bounds(seed):
    rng = np.random.default_rng(seed)
    for k in range(300):
        n = int(rng.integers(1, 14))
        y = rng.integers(0, 101, n).astype(float) if k % 2 else rng.uniform(0, 100, n)
        low = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 60, n)).astype(float)
        high = np.where(rng.random(n) < 0.5, 100, low + rng.integers(0, 40, n)).astype(float)
        smooth = float(rng.choice([0, 0.3, 0.75, 1, 2]))
        x = C.least_path(y, low, high, smooth)
        assert (x >= low).all() and (x <= high).all()
        assert abs(x - y).sum() + smooth * abs(np.diff(x)).sum() <= dense_cost(y, low, high, smooth) + 1e-9


def test_optimal_paths_per_shot(spark):
    rows = [(1, 0, 0.0, 30.0, None, None), (1, 0, 1.0, 70.0, 40.0, 50.0), (1, 0, 2.0, 30.0, None, None), (1, 1, 3.0, 120.0, 0.0, 10.0), (1, 2, 4.0, 5.0, 20.0, 10.0), (1, 2, 5.0, 6.0, None, None), (None, 0, 0.0, 1.0, None, None)]
    out = C.optimal_paths(spark.createDataFrame(rows, "job_id long, shot long, t double, target double, low double, high double")).collect()
    assert {(r.job_id, r.t): r.x for r in out} == {(1, 0.0): 30.0, (1, 1.0): 50.0, (1, 2.0): 30.0, (1, 3.0): 120.0, (1, 4.0): 5.0, (1, 5.0): 6.0, (None, 0.0): 1.0}
    assert C.optimal_paths(spark.createDataFrame([], "job_id long, shot long, t double, target double, low double, high double")).count() == 0


def test_held_paths(spark):
    steady = [(1, 0, i / 10, 960.0 + (i % 3)) for i in range(30)]
    sweep = [(2, 0, i / 10, 300.0 + 40 * i) for i in range(30)]
    jump = [(3, 0, i / 10, 400.0 if i < 15 else 1500.0) for i in range(30)]
    points = spark.createDataFrame(steady + sweep + jump + [(4, 0, 0.0, 700.0), (5, 0, 0.0, 700.0), (5, 0, 1.0, 900.0)], "job_id long, shot int, t double, px double")
    features = spark.createDataFrame([(5, 1.0, 10.0, 80.0), (2, 1.0, 45.0, 55.0), (4, 0.0, 0.0, 100.0)], "job_id long, f0 double, left double, right double")
    found = {(r.job_id, r.t): r for r in C.camera_paths(C.required_bounds(points, features, 1920, 607)).collect()}
    modes = {k: found[k, 0.0].mode for k in range(1, 6)}
    assert modes == {1: "stationary", 2: "panning", 3: "tracking", 4: "stationary", 5: "infeasible"} and found[2, 0.0].slope > 50
    assert [found[5, t].breach for t in (0.0, 1.0)] == [False, True] and found[4, 0.0].center == 700.0 and found[5, 0.0].x is None
    # the crop at the bounded point holds the feature from 864 to 1056
    assert found[2, 1.0].x - 303.5 <= 864 and found[2, 1.0].x + 303.5 >= 1056
    for k, rows in ((2, sweep), (3, jump)):
        want = by_definition([r[3] for r in rows], 10.0, 100)
        got = [found[k, r[2]].x for r in rows]
        assert k == 2 or got == pytest.approx(want, abs=1e-9)


def by_definition(s, weight, rounds):
    x, step = list(s), 1 / (1 + 2 * weight)
    sign = lambda v: (v > 0) - (v < 0)
    for _ in range(rounds):
        pull = [weight * ((sign(x[i] - x[i - 1]) if i else 0) - (sign(x[i + 1] - x[i]) if i + 1 < len(x) else 0)) for i in range(len(x))]
        x = [v - step * ((v - a) + p) for v, a, p in zip(x, s, pull, strict=True)]
    return x


def test_shot_cameras_over_a_grid(spark):
    """The mode of every shot is the first that any crop place of a fine grid (or line, or frame by frame) allows."""
    rng = np.random.default_rng(5)
    half, rows = 9 / 16 / (16 / 9) / 2, []
    for shot in range(60):
        base, drift, spread = rng.uniform(0.2, 0.8), rng.uniform(-0.05, 0.05) * (shot % 3), 0.02 * (shot % 5)
        for k in range(int(rng.integers(1, 12))):
            for _ in range(int(rng.integers(1, 3))):
                rows.append((1, shot, float(k), float(np.clip(base + drift * k + rng.uniform(-spread, spread), 0.05, 0.95)), 0.5, float(rng.uniform(0.02, 0.1)), bool(rng.random() < 0.8)))
    regions = spark.createDataFrame(rows, "job_id long, shot long, t double, cx double, cy double, half double, required boolean")
    shots = spark.createDataFrame([(1, s, 0.0, 20.0) for s in range(61)], "job_id long, shot long, t0 double, t1 double")
    found = {}
    for r in C.shot_cameras(shots, regions, 16 / 9).collect():
        found.setdefault(r.shot, []).append(r)
    grid = np.linspace(half, 1 - half, 2001)
    seen = set()
    for shot in range(60):
        frames = {}
        for _, s, t, cx, _, h, required in rows:
            if s == shot:
                frames.setdefault(t, []).append((cx - h, cx + h, required))
        reach = {t: [(a, b) for a, b, q in v if q] or [(a, b) for a, b, _ in v] for t, v in frames.items()}
        low, high = (np.array([f(x[i] for x in reach[t]) for t in sorted(reach)]) for f, i in ((min, 0), (max, 1)))
        mode = found[shot][0].mode
        seen.add(mode)
        stands = any(((x - half <= low + 0.0101) & (x + half >= high - 0.0101)).all() for x in grid) and high.max() - low.min() <= 2 * half
        assert (mode == "stationary") == stands
        if mode == "padded":
            assert (high - low).max() > 2 * half + 0.01 and found[shot][0].t is None
        if mode == "tracking":
            keys = sorted(found[shot], key=lambda r: r.t)
            assert [k.t for k in keys] == sorted(reach)
            for k, a, b in zip(keys, low, high, strict=True):
                x = min(max(k.cx, half), 1 - half)
                assert x - half <= max(a, 0) + 0.011 and x + half >= min(b, 1) - 0.011
        if mode == "panning":
            t = np.array(sorted(reach))
            a, b = np.polyfit(t, (low + high) / 2, 1)[::-1]
            line = a + b * t
            assert (line - half <= low + 0.01 + 1e-9).all() and (line + half >= high - 0.01 - 1e-9).all()
    assert {"stationary", "panning", "tracking"} <= seen
    assert [(r.mode, r.cx) for r in found[60]] == [("stationary", 0.5)] * 2


def test_hold_then_snap_follows_the_simulation():
    """Against small steps of 16 ms."""

    def simulated(t, target, threshold, duration):
        hold = pos = goal = start = target[0]
        out, moving, progress, last = [pos], False, 0.0, 0
        for i in range(1, len(t)):
            dt, x = t[i] - t[i - 1], target[i]
            if dt <= 0.002:
                pos = hold = x
                moving, progress, last = False, 0.0, 0
            else:
                way = (x > hold) - (x < hold)
                if not moving and abs(x - hold) >= threshold:
                    moving, goal, start, progress = True, x, pos, 0.0
                elif moving and not (way != 0 and last != 0 and way != last):
                    goal = x
                last = way or last
                done = 0.0
                while done < dt:
                    step = min(0.016, dt - done)
                    if moving:
                        progress += step / duration
                        if progress >= 1.0:
                            pos = hold = goal
                            moving, progress = False, 0.0
                        else:
                            pos = start + (goal - start) * (1 - (1 - progress) ** 3)
                    done += step
                pos = max(0.0, min(100.0, pos))
            out.append(pos)
        return out

    rng = np.random.default_rng(3)
    for _ in range(50):
        t = np.cumsum(rng.choice([0.001, 0.04, 0.1, 0.37, 2.0], 60))
        target = np.clip(50 + np.cumsum(rng.normal(0, 8, 60)), 0, 100).round()
        assert C.hold_then_snap(t, target).tolist() == pytest.approx(simulated(t.tolist(), target.tolist(), 8.0, 0.30), abs=1e-6)
    assert C.snap_parameters(0, 0) == (8.0, 0.3) and C.snap_parameters(16 / 9, 1.0) == (6.0, pytest.approx(0.225)) and C.snap_parameters(16 / 9, 9 / 16)[0] == 4.0


def test_numbered_by_cuts(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (1, 2.0, "b"), (1, 3.0, "c"), (2, 9.0, "d")], "job_id long, t double, name string")
    cuts = spark.createDataFrame([(1, 2.0), (1, 2.5)], "job_id long, t double")
    assert sorted((r.name, r.shot) for r in C.numbered_by_cuts(rows, cuts).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 0)]
