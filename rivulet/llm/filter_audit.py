"""Filter interaction audit: which filter removes what, in every order in which the filters could run.

A row's failures are a mask of as many bits as there are filters. Per part and label, Spark sums one sign per subset of
the filters: +1 where the row fails an even number of the subset's filters, -1 where an odd number (32 parity sums for
five filters). These are the Walsh-Hadamard coefficients of the table of masks; the transform is its own inverse but for
a factor, so integer sums give the number of rows of every mask exactly. All orders, steps and Shapley values are then
arithmetic on 32 numbers per part, whatever the number of rows: a filter's removals, summed over all orders, are
orders / (number of failures) for every row that fails it, as each of a row's failing filters comes first equally often.

``failures`` states the five filters of the registered query. Copies are told by a 128-bit key of the text; the least id
per text comes from an aggregation that is partial on the map side, and meets the rows in a join of two plain scans, which
Spark's skew split divides, so a text or an id that a third of all rows have is no bottleneck. Texts are read once and
never shuffled. Everything is DataFrame expressions.

Defined results: a null text is empty, a null source the part ''. Rows repeated whole are rows of their own; of rows with
equal text only those of the least id that isn't null are first (repeats of that id too), and rows with null ids fail the
copy filter if any row with an id has the text, else none of them does. Several label rows of one id count as labelled if
any is; ids without labels are neither good nor toxic. Very long texts are worked on whole. An empty table has no parts
and so gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import content_keys, materialize, text_or_empty

#: What the words of the filters consist of: everything but the blank and the control characters 9 to 13.
_SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) per document; bit k of the mask says that the k-th of the filters ABCDE fails:
    A under 50 words, B less than 65 % of the words distinct, C more than 5 % capitals A-Z, D any of #$%&*|, E a text
    that a smaller id has too."""
    text = text_or_empty("text")
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    tests = [n < 50, F.lit(100) * distinct < F.lit(65) * n, F.lit(100) * capitals > F.lit(5) * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    mask = sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))
    rows = materialize(rows.select("doc_id", "part", mask.alias("mask"), *[v.alias(k) for k, v in content_keys("text").items()]), "audit-failures")

    least = materialize(rows.groupBy("c", "c2").agg(F.min("doc_id").alias("least")).filter("least is not null"), "audit-least")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    marks = materialize(marks.filter("quality + toxic > 0").withColumnRenamed("doc_id", "__id"), "audit-labels")
    rows = rows.join(least, ["c", "c2"], "left").select("doc_id", "part", "mask", (F.col("least") != F.coalesce("doc_id", F.col("least") + 1)).alias("copy"))
    rows = rows.join(marks, F.col("doc_id") == F.col("__id"), "left")
    copy = F.coalesce(F.col("copy"), F.lit(False)).cast("int") * 16
    return rows.select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(F.col(c), F.lit(0)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])


def cells(rows: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """(part, all, *labels): per part, arrays of how many rows have each mask, over all rows and over those whose label
    column is 1; by signed parity sums and their exact inverse."""
    subsets = range(1 << filters)
    sign = [F.lit(1) - F.lit(2) * (F.bit_count(F.col("mask").bitwiseAND(F.lit(u))) % 2) for u in subsets]
    weights = {"all": F.lit(1), **{c: F.col(c) for c in labels}}
    sums = rows.groupBy("part").agg(*[F.sum((sign[u] * w).cast("long")).alias(f"{c}_{u}") for c, w in weights.items() for u in subsets])
    spectra = sums.select("part", *[F.array(*[f"{c}_{u}" for u in subsets]).alias(c) for c in weights])
    return spectra.select("part", *[_inverse(c, filters).alias(c) for c in weights])


def _inverse(spectrum: str, filters: int) -> Column:
    """The transform again: every mask's signed sum of the spectrum is 2**filters times its count."""
    sign = lambda m, u: F.lit(1) - F.lit(2) * (F.bit_count(m.bitwiseAND(u)) % 2)
    signed = lambda m: F.aggregate(F.transform(spectrum, lambda y, u: y * sign(m, u)), F.lit(0).cast("long"), lambda a, y: a + y)
    return F.transform(spectrum, lambda x, m: F.shiftright(signed(m), filters))


def _total(counts: str, test, weigh=None) -> Column:
    """The sum of the counts of all masks that pass the test, weighed."""
    picked = F.transform(counts, lambda x, m: F.when(test(m), x if weigh is None else x * weigh(m)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)


def orders(counts: DataFrame, filters: str, labels: dict[str, str]) -> DataFrame:
    """Per part, order of the filters and step: rows kept, removed, redundant, failing this filter only, removed by label
    (``labels``: output column to column of ``counts``), and the filter's Shapley value times the number of orders."""
    every = ["".join(p) for p in itertools.permutations(filters)]
    rows = counts.withColumn("filter_order", F.explode(F.lit(every))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    letter, before = F.expr("substring(filter_order, step, 1)"), F.expr("substring(filter_order, 1, step - 1)")
    own = sum((F.when(letter == f, 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    gone = sum((F.when(F.instr(before, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumns({"own": own, "gone": gone})
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    reached = lambda m: m.bitwiseAND(F.col("gone")) == 0
    return rows.select(
        "part",
        "filter_order",
        "step",
        _total("all", lambda m: ~fails(m) & reached(m)).alias("kept"),
        _total("all", lambda m: fails(m) & reached(m)).alias("removed"),
        _total("all", lambda m: fails(m) & ~reached(m)).alias("redundant"),
        _total("all", lambda m: m == F.col("own")).alias("unique_fails"),
        *[_total(c, lambda m: fails(m) & reached(m)).alias(name) for name, c in labels.items()],
        _total("all", fails, lambda m: F.floor(F.lit(math.factorial(len(filters))) / F.bit_count(m))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters ABCDE and step."""
    counts = cells(failures(docs, labels), len(FILTERS), ["good", "toxic"])
    return orders(counts, FILTERS, {"good_lost": "good", "toxic_lost": "toxic"})
