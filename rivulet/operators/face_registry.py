"""Registries of the people in a video: stable places, identities by embeddings, identities of tracks by appearance.

A job's faces are dealt to one task as arrays (a registry needs them all); what grows with their square runs in rows or
blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.operators.grouped import per_group

#: Faces of one frame further apart than this, in percent, are different people.
APART = 5.0
_COLUMNS = ["x_center", "x_min", "x_max", "frame_count", "avg_width", "avg_height"]


def _median(v: np.ndarray) -> float:
    return float((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)


def _inner(v: np.ndarray, reach: float) -> tuple[float, float]:
    """The range of sorted values up to ``reach`` quartile distances beyond the quartiles."""
    a, b = v[len(v) // 4], v[3 * len(v) // 4]
    return a - reach * (b - a), b + reach * (b - a)


def _slot(x: np.ndarray, center: float, frame: np.ndarray, w: np.ndarray, h: np.ndarray) -> dict:
    one = lambda v: round(float(v), 1)
    return {"x_center": one(center), "x_min": one(x.min()), "x_max": one(x.max()), "frame_count": len(np.unique(frame)), "avg_width": one(w.mean()), "avg_height": one(h.mean())}


def _evidence(frame: np.ndarray, weight: np.ndarray) -> float:
    """Frames, each with the most weight of its faces."""
    frames, at = np.unique(frame, return_inverse=True)
    most = np.zeros(len(frames))
    np.maximum.at(most, at, weight)
    return float(most.sum())


def _peaks(frame, x, w, h, weight, least: float) -> list[dict]:
    """Slots at the local maxima of a histogram of 5 % wide bins, each with its neighbours, ten and more apart."""
    bins = np.clip((x / 5.0).astype(int), 0, 19)
    counts = np.concatenate([[0], np.bincount(bins, minlength=20), [0]])
    found: list[dict] = []
    for i in range(20):
        before, own, after = counts[i : i + 3]
        if own < max(5, len(x) * 0.02) or own < before or own < after:
            continue
        near = np.abs(bins - i) <= 1
        if _evidence(frame[near], weight[near]) < least:
            continue
        v = np.sort(x[near])
        center = float(v[len(v) // 2])
        if not any(abs(center - s["x_center"]) < 10 for s in found):
            found.append(_slot(v, center, frame[near], w[near], h[near]))
    return found


def place_slots(frame, x, w, h, weight, least: float = 3, gap: float = 15.0) -> list[dict]:
    """Slots by place, from left to right. Places far outside the quartiles go; gaps between sorted places part clusters,
    and are smaller where frames show three faces and more (by the usual distance of neighbours); otherwise faces near the
    middle join the nearest cluster afterwards, as its mean stands then. Clusters need ``least`` weighted frames. One cluster
    of many faces over a wide range is tried by a histogram."""
    if len(x) >= 20:
        low, high = _inner(np.sort(x), 2.0)
        inside = (x >= max(5.0, low)) & (x <= min(95.0, high))
        frame, x, w, h, weight = (v[inside] for v in (frame, x, w, h, weight))
    n = len(x)
    if n == 0:
        return []
    crowd = int(np.unique(frame, return_counts=True)[1].max())
    middle = (x >= 40) & (x <= 60)
    if crowd >= 3:
        order = np.lexsort((x, frame))
        steps = np.sort(np.diff(x[order])[frame[order][1:] == frame[order][:-1]])
        gap = max(5.0, min(gap, float(steps[len(steps) // 2]) * (0.4 if crowd >= 5 else 0.5)))
        middle[:] = False
    elif middle.all():
        middle[:] = False
        v = np.sort(x)
        widest = int(np.argmax(np.diff(v))) if n >= 6 else 0
        if n >= 6 and v[widest + 1] - v[widest] >= 8 and all(len(np.unique(frame[side])) >= least for side in (x <= v[widest], x >= v[widest + 1])):
            gap = float(v[widest + 1] - v[widest]) * 0.8
    outer = np.flatnonzero(~middle)
    outer = outer[np.argsort(x[outer], kind="stable")]
    label = np.full(n, -1)
    label[outer] = np.concatenate([[0], np.cumsum(np.diff(x[outer]) > gap)])
    clusters = int(label.max()) + 1
    sums, counts = np.bincount(label[outer], x[outer], clusters), np.bincount(label[outer], minlength=clusters).astype(float)
    for i in np.flatnonzero(middle):
        far = np.abs(x[i] - sums / counts)
        k = int(np.argmin(far))
        if far[k] <= 15:
            label[i] = k
            sums[k] += x[i]
            counts[k] += 1
    slots = []
    for k in range(clusters):
        own = label == k
        if _evidence(frame[own], weight[own]) < least:
            continue
        v = np.sort(x[own])
        if len(v) >= 5:
            low, high = _inner(v, 1.5)
            inner = v[(v >= low) & (v <= high)]
            v = inner if len(inner) >= least else v
        slots.append(_slot(v, _median(v), frame[own], w[own], h[own]))
    if len(slots) <= 1 and n >= 30 and crowd >= 2 and x.max() - x.min() > 25:
        peaks = _peaks(frame, x, w, h, weight, least)
        slots = peaks if len(peaks) >= 2 else slots
    return sorted(slots, key=lambda s: s["x_center"])


class _Groups:
    """Groups of faces that may be one person. Per group and frame the range of places is held: two groups hold different
    people if they are in one frame with places over ``APART`` apart, which the ranges' ends tell."""

    def __init__(self, frame: np.ndarray, x: np.ndarray):
        self.of = np.arange(len(x))
        self.members = {i: [i] for i in range(len(x))}
        self.ranges = {i: {f: (v, v)} for i, (f, v) in enumerate(zip(frame.tolist(), x.tolist(), strict=True))}

    def apart(self, a: int, b: int) -> bool:
        few, many = sorted((self.ranges[a], self.ranges[b]), key=len)
        return any(f in many and max(high - many[f][0], many[f][1] - low) > APART for f, (low, high) in few.items())

    def join(self, a: int, b: int) -> None:
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        own = self.members.pop(b)
        self.of[own] = a
        self.members[a] += own
        for f, (low, high) in self.ranges.pop(b).items():
            was = self.ranges[a].get(f, (low, high))
            self.ranges[a][f] = (min(low, was[0]), max(high, was[1]))


def constrained_groups(frame: np.ndarray, x: np.ndarray, vectors: np.ndarray, near: float = 0.20) -> list[np.ndarray]:
    """Faces joined in order of their pairs while their cosine distance is under ``near`` and no two faces of the joined group
    are of one frame and apart. A row of distances is held at a time; groups found apart stay so."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    groups = _Groups(frame, x)
    for i in range(len(x)):
        close = i + 1 + np.flatnonzero(1.0 - unit[i + 1 :] @ unit[i] < near)
        refused: set[int] = set()
        for j in close[groups.of[close] != groups.of[i]]:
            a, b = int(groups.of[i]), int(groups.of[j])
            if a == b or b in refused:
                continue
            if groups.apart(a, b):
                refused.add(b)
            else:
                groups.join(a, b)
                refused.clear()
    return sorted((np.sort(m) for m in groups.members.values()), key=lambda m: m[0])


def cohesion(vectors: np.ndarray) -> float:
    """The mean cosine of vectors with their mean direction."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)
    mean = unit.mean(axis=0)
    size = np.linalg.norm(mean)
    return float((unit @ (mean / size if size > 1e-8 else mean)).mean())


def identity_slots(frame, x, w, h, weight, vectors: list, least: float = 3, near: float = 0.20) -> tuple[list[dict], str]:
    """(slots, what they come from): groups of embeddings with ``least`` frames and, from three faces on, a cohesion of .55;
    by place instead if under half of the faces (or three) have embeddings, if no group holds together, or if there are more
    slots by place."""
    by_place = place_slots(frame, x, w, h, weight, least)
    has = np.array([v is not None for v in vectors], bool)
    if has.sum() < 0.5 * len(x) or has.sum() < 3:
        return by_place, "place"
    frame, x, w, h = frame[has], x[has], w[has], h[has]
    table = np.array([v for v in vectors if v is not None], dtype=float)
    slots, loose = [], 0
    for own in constrained_groups(frame, x, table, near):
        if len(np.unique(frame[own])) < least:
            continue
        if len(own) >= 3 and cohesion(table[own]) < 0.55:
            loose += 1
            continue
        slots.append(_slot(x[own], _median(np.sort(x[own])), frame[own], w[own], h[own]))
    if (loose and not slots) or len(by_place) > len(slots):
        return by_place, "place"
    return sorted(slots, key=lambda s: s["x_center"]), "embedding"


def _table(slots: list[dict], source: str) -> dict:
    return {"slot": list(range(len(slots))), **{c: [s[c] for s in slots] for c in _COLUMNS}, "source": [source] * len(slots)}


_SCHEMA = "slot int, x_center double, x_min double, x_max double, frame_count long, avg_width double, avg_height double, source string"


def _faces(faces: DataFrame, *more: str) -> DataFrame:
    weight = F.when(F.coalesce("human", F.lit(True)), 1.0).otherwise(0.35)
    return faces.select("job_id", "frame", "k", "x", "w", "h", weight.alias("weight"), *more)


def place_registry(faces: DataFrame, least: float = 3, gap: float = 15.0) -> DataFrame:
    """(job_id, slot, x_center, x_min, x_max, frame_count, avg_width, avg_height, source) for faces (job_id, frame, k, x, w, h,
    human: null counts as yes); jobs without a stable place have no rows."""
    return per_group(_faces(faces), ["job_id"], ["frame", "k"], lambda c: _table(place_slots(c["frame"], c["x"], c["w"], c["h"], c["weight"], least, gap), "place"), _SCHEMA)


def identity_registry(faces: DataFrame, least: float = 3, near: float = 0.20) -> DataFrame:
    """The same by embeddings (column ``embedding``, null where there is none), by place where they don't serve."""
    return per_group(_faces(faces, "embedding"), ["job_id"], ["frame", "k"], lambda c: _table(*identity_slots(c["frame"], c["x"], c["w"], c["h"], c["weight"], list(c["embedding"]), least, near)), _SCHEMA)


def leaders(signatures: list, near: float = 0.35, block: int = 512) -> np.ndarray:
    """Identities of tracks in order: that of the earlier track whose signature (a histogram) is nearest, if that is under
    ``near``, else a new one. Tracks without a signature, or with one of another length, are like no other.

    The distance is sqrt(1 - sum sqrt(p q)) of normalised histograms, so that a block of tracks meets the earlier ones in
    one product of their roots."""
    n = len(signatures)
    out, fresh = np.full(n, -1), 0
    sizes: dict[int, list[int]] = {}
    for i, s in enumerate(signatures):
        sizes.setdefault(-1 if s is None or len(s) == 0 else len(s), []).append(i)
    best, of = np.full(n, np.inf), np.full(n, -1)
    for size, own in sizes.items():
        if size < 0:
            continue
        v = np.array([signatures[i] for i in own], dtype=float)
        v = np.abs(v)
        root = np.sqrt(v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300))
        for a in range(0, len(own), block):
            for b in range(0, a + 1, block):
                far = np.sqrt(np.maximum(0.0, 1.0 - root[a : a + block] @ root[b : b + block].T))
                if a == b:
                    far[np.triu_indices(len(far))] = np.inf
                at = far.argmin(axis=1)
                least = far[np.arange(len(far)), at]
                rows = np.array(own[a : a + block])
                better = least < best[rows]
                best[rows[better]], of[rows[better]] = least[better], np.array(own)[b + at[better]]
    for i in range(n):
        if best[i] < near:
            out[i] = out[of[i]]
        else:
            out[i], fresh = fresh, fresh + 1
    return out


def persistent_identities(tracks: DataFrame, near: float = 0.35) -> DataFrame:
    """(job_id, track, identity) for tracks (job_id, track, signature), by their number."""
    return per_group(tracks.select("job_id", "track", "signature"), ["job_id"], ["track"], lambda c: {"track": c["track"], "identity": leaders(list(c["signature"]), near)}, "track long, identity int")
