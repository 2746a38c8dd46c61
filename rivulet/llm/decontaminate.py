"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words: A-Z lower-cased, then runs of digits, letters a-z and non-ASCII characters. A window is ``n`` consecutive words of
a benchmark item; an item of fewer words, but not none, is one window. The windows' hashes are broadcast; training texts
are scanned window by window in the raw bytes, hits are verified word for word, and every document word inside an
occurrence of a window is hit.

The broadcast is bounded: the distinct windows are counted first, and if they exceed ``MAX_WINDOWS`` they are dealt by
hash into blocks of at most about that many. Each block is then a pass of its own over the rows: it is broadcast, the rows
are written with what it hit, and it is let go before the next one is gathered, so neither the driver nor a worker holds
more than one. No pass shuffles rows.

Defined results: null texts have no words, on both sides; null item ids are scanned and hit words, but name no item.
Repeated items count once; repeated documents each give a row. A very long text is scanned whole, alone. An empty
benchmark hits nothing, an empty table gives an empty result. Extra columns are kept, but for those with the names of the
new columns, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import tokens
from rivulet.llm.common import discard, materialize, slices, text_bytes, text_or_empty

#: Windows that one broadcast holds at most, about: ten words and a few numbers each, some 200 bytes.
MAX_WINDOWS = 200_000
#: Bits of the first filter; the slots of a window are looked up only if its bit is set.
_FILTER_BITS = 22
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def windows(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of the items: ``gram`` (words joined by a blank), ``n`` words, ``items`` (sorted texts)."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORDS), F.lit(0))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words.alias("w"))
    size = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice(F.col("w"), i, size), " "))
    rows = rows.filter(F.size("w") > 0).select("item", size.alias("n"), F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.groupBy("gram", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Grams:
    """A hash set of windows, by number of words."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        self.grams = [g.encode("utf-8") for g, _, _ in rows]
        self.items = [tuple(i) for _, _, i in rows]
        for n in sorted({n for _, n, _ in rows}):
            own = [k for k, (_, m, _) in enumerate(rows) if m == n]
            data = np.frombuffer(b"".join(self.grams[k] for k in own), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(self.grams[k]) for k in own])]).astype(np.int64)
            words = tokens.Words(data, at, tokens.NORMAL)
            hashes = tokens.window_hashes(words.hashes(), words.first[:-1], n)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_length[n] = (hashes[order], bits, [own[i] for i in order])

    def scan(self, data: np.ndarray, at: np.ndarray) -> tuple[tokens.Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words of the rows and the verified hits: first word, end word, number of the window."""
        lower = tokens.LOWER[data]
        words = tokens.Words(lower, at, tokens.NORMAL)
        hashes = words.hashes()
        first: list[int] = []
        last: list[int] = []
        which: list[int] = []
        raw = None
        for n, (held, bits, own) in self.by_length.items():
            starts = words.windows(n)
            found = tokens.window_hashes(hashes, starts, n)
            maybe = np.flatnonzero(bits[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            left = np.searchsorted(held, found[maybe], side="left")
            right = np.searchsorted(held, found[maybe], side="right")
            for i in np.flatnonzero(right > left):
                start = int(starts[maybe[i]])
                raw = lower.tobytes() if raw is None else raw
                gram = b" ".join(raw[words.start[k] : words.end[k]] for k in range(start, start + n))
                for k in range(left[i], right[i]):
                    if self.grams[own[k]] == gram:
                        first.append(start)
                        last.append(start + n)
                        which.append(own[k])
        return words, np.array(first, np.int64), np.array(last, np.int64), np.array(which, np.int64)


_HITS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("items", T.ArrayType(T.StringType()))]))
_ARROW_HIT = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.string()))])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", hits: str = "hits", count: str = "n_words") -> DataFrame:
    """Add ``n_words`` and ``hits``: word ranges [first, last) of the occurrences, with the item ids."""
    spark = docs.sparkSession
    found = windows(benchmark, n, item)
    total = found.count()
    blocks = max(1, -(-total // MAX_WINDOWS))
    rows = docs.drop(hits, count).withColumns({"__text": text_or_empty(text), count: F.lit(0).cast("long"), hits: F.lit(None).cast(_HITS)})
    if blocks > 1:
        found = materialize(found, "benchmark-windows")
    for block in range(blocks):
        own = found if blocks == 1 else found.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r["gram"], r["n"], list(r["items"])) for r in own.collect()])
        before, rows = rows, _pass(rows, held, hits, count)
        if blocks > 1:
            rows = materialize(rows, "benchmark-pass")
            held.unpersist()
            if block:
                discard(before)
    return rows.drop("__text")


def _pass(rows: DataFrame, held, hits: str, count: str) -> DataFrame:
    names, schema = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(held.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                words, first, last, which = grams.scan(*text_bytes(part.column("__text")))
                found: list[list | None] = part.column(hits).to_pylist()
                for a, b, k in zip(first.tolist(), last.tolist(), which.tolist(), strict=True):
                    row = int(words.row[a])
                    zero = int(words.first[row])
                    found[row] = (found[row] or []) + [{"first": a - zero, "last": b - zero, "items": list(grams.items[k])}]
                new = {count: pa.array(words.count, pa.int64()), hits: pa.array(found, pa.list_(_ARROW_HIT))}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names=names)

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to every row, less the text."""
    new = ("n_hit", "n_items", "items_sha256", "contaminated")
    rows = scan(docs.drop(*new, "__covered", "__items"), benchmark, n, text, item).drop(text)
    # the ranges come in word order per length; sorted here, each range counts its words beyond what came before
    ordered = F.array_sort(F.coalesce(F.transform("hits", lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last"))), F.array().cast("array<struct<first:int,last:int>>")))
    total = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["last"] - F.greatest(h["first"], s["to"]))).alias("n"), F.greatest(s["to"], h["last"]).alias("to")),
    )["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.coalesce(F.transform("hits", lambda h: h["items"]), F.array().cast("array<array<string>>")))))
    rows = rows.withColumns({"n_hit": total.cast("long"), "__items": items}).drop("hits")
    return rows.withColumns({"n_items": F.size("__items").cast("long"), "items_sha256": F.sha2(F.array_join("__items", ","), 256), "contaminated": F.col("n_hit") > 0}).drop("__items")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents in which no window occurs, unchanged."""
    rows = scan(docs.withColumn("__kept", F.lit(True)), benchmark, n, text, item, hits="__hits", count="__n")
    return rows.filter(F.col("__hits").isNull()).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents without the words of occurring windows: each run of hit words goes, with all between them."""
    spark = docs.sparkSession
    rows = scan(docs, benchmark, n, text, item, hits="__hits", count="__n")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, hits in zip(batch.column(text), batch.column("__hits").to_pylist(), strict=True):
                value = value.as_py()
                if hits:
                    raw = value.encode("utf-8")
                    words = tokens.Words(tokens.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), tokens.NORMAL)
                    kept, end = [], 0
                    for a, b in sorted((h["first"], h["last"]) for h in hits):
                        start, stop = int(words.start[a]), int(words.end[b - 1])
                        if start > end:
                            kept.append(raw[end:start])
                        end = max(end, stop)
                    value = b"".join([*kept, raw[end:]]).decode("utf-8")
                found.append(value)
            new = {text: pa.array(found, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType, True) for f in docs.schema])
    return rows.mapInArrow(run, schema)
