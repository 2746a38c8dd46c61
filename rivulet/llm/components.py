"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum per node (partial sums map-side) and a join of the links with those minima; nothing is gathered
per node or on the driver. Each round is written to the shared scratch folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id that occurs in ``links`` (u, v) with another; component: the least id reachable.

    Links to itself and repeated links are ignored. The number of rounds needed grows with the logarithm of the longest
    path; running out of ``rounds`` is an error, never a partial answer.
    """
    links = materialize(links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = _mark(links)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        before, links = links, materialize(_small_star(_large_star(links)), "links")
        discard(before)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ids = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each the index of a root) after joining the pairs."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
