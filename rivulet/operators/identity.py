"""Identities over embeddings: centroids, nearest centroid, cosine within blocks, array distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key: components summed map-side first."""
    each = rows.select(key, F.posexplode(vector).alias("i", "e")).groupBy(key, "i").agg(F.avg(F.col("e").cast("double")).alias("e"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("centroid"))


#: Centroids that travel to the rows at once.
MAX_CENTROIDS = 4096


def nearest_centroid(rows: DataFrame, cents: DataFrame, row: str, key: str, vector: str, floor: float) -> DataFrame:
    """Each row's centroid of highest cosine (the least key of equals), -1 below ``floor``. Centroids travel as an array
    of at most about ``MAX_CENTROIDS``; more are dealt by hash into several arrays, one pass over the rows each."""
    blocks = max(1, -(-cents.count() // MAX_CENTROIDS))
    out, found = rows, []
    for b in range(blocks):
        own = cents if blocks == 1 else cents.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        table = own.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("v")))).alias("__table"))
        best = F.array_max(F.transform("__table", lambda c: F.struct(F.round(cosine(F.col(vector), c["v"]), 9).alias("s"), (-c["k"]).alias("k"))))
        out = out.crossJoin(F.broadcast(table)).withColumn(f"__best{b}", best).drop("__table")  # the table is one row
        found.append(f"__best{b}")
    out = out.withColumn("best", F.array_max(F.array(*found)))
    return out.select(row, F.when(F.col("best.s") > floor, -F.col("best.k")).otherwise(F.lit(-1)).alias("identity"), F.round("best.s", 4).alias("cosine"))


def or_nearest_slot(found: DataFrame, slots: DataFrame, row: str) -> DataFrame:
    """Rows (row, identity, x): identities below 0 give way to the slot (slot, x) of nearest place, of equals the lower."""
    marks = slots.groupBy("x").agg(F.min("slot").alias("slot")).select(F.lit(0).alias("k"), F.col("x").cast("double").alias("s"), "slot")
    rows = found.select(F.lit(0).alias("k"), row, "identity", F.col("x").cast("double").alias("x"))
    # the slots of a registry are few: they travel as one array
    table = F.broadcast(marks.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "slot"))).alias("__table")))
    near = F.array_min(F.transform("__table", lambda m: F.struct(F.abs(m["s"] - F.col("x")).alias("d"), m["slot"].alias("slot"))))
    return rows.join(table, "k", "left").select(row, F.when(F.col("identity") >= 0, F.col("identity")).otherwise(F.coalesce(near["slot"], F.lit(-1))).alias("identity"))


def pairs_within(rows: DataFrame, block: str, row: str, vector: str, least: float) -> DataFrame:
    """Pairs of a block (a frame, a shot) with at least that cosine."""
    other = rows.select(F.col(block).alias("__b"), F.col(row).alias("other"), F.col(vector).alias("__v"))
    both = rows.join(other, (F.col(block) == F.col("__b")) & (F.col(row) < F.col("other")))
    return both.withColumn("cosine", F.round(cosine(F.col(vector), F.col("__v")), 4)).filter(F.col("cosine") >= least).select(block, row, "other", "cosine")


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - both / F.sqrt(total(a) * total(b))))
