"""Listing, paging, facets, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset..offset+limit of a total order, with the number of all rows as ``total``. The sort is a top-k of
    offset + limit rows per task; the total is an aggregate of its own, so nothing is sorted whole."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(*order).offset(offset).limit(max(1, min(limit, 100)))
    return top.crossJoin(F.broadcast(total))  # the total is one row


def facets(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values with their numbers."""
    return rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def between(rows: DataFrame, low: dict, high: dict) -> DataFrame:
    """Inclusive bounds; None is no bound."""
    for c, v in low.items():
        rows = rows if v is None else rows.filter(F.col(c) >= v)
    for c, v in high.items():
        rows = rows if v is None else rows.filter(F.col(c) <= v)
    return rows


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows of which some column contains the text, letter case aside."""
    found: Column = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False))
    return rows.filter(found)


def top_per_key(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def every_nth(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """Each n-th row of a key, and its first and last."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumns({"__r": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    return rows.filter((F.col("__r") % n == 0) | (F.col("__r") == F.col("__n") - 1)).drop("__r", "__n")


def smart_cap(rows: DataFrame, rate: float, cap: int) -> DataFrame:
    """Frames (job_id, t): first, last and those sooner than .7 of the rate after the one before are kept; evenly spaced
    others fill up to ``cap``; what is over the cap is cut at the end."""
    w = Window.partitionBy("job_id").orderBy("t")
    all_of = Window.partitionBy("job_id")
    rows = rows.withColumns({"r": F.row_number().over(w), "n": F.count(F.lit(1)).over(all_of), "gap": F.col("t") - F.lag("t").over(w)})
    rows = rows.withColumn("prio", (F.col("r") == 1) | (F.col("r") == F.col("n")) | F.coalesce(F.col("gap") < 0.7 * rate, F.lit(False)))
    rows = rows.withColumns({"p": F.sum(F.col("prio").cast("int")).over(all_of), "i": F.row_number().over(Window.partitionBy("job_id", "prio").orderBy("t")) - 1})
    rest = F.greatest(F.lit(0), F.lit(cap) - F.col("p"))
    others = F.col("n") - F.col("p")
    step = others / rest
    j = F.ceil(F.col("i") / step)  # the fill index that would pick this row
    picked = (rest > 0) & ((others <= rest) | ((j < rest) & (F.floor(j * step) == F.col("i"))))
    kept = rows.filter((F.col("n") <= cap) | F.col("prio") | picked).withColumn("o", F.row_number().over(w))
    return kept.filter(F.col("o") <= cap).select("job_id", "t", "prio")
