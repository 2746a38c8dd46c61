"""Substring deduplication with a log-structured fingerprint index.

Every window of ``n`` consecutive words that occurs more than once in the corpus is removed, in all its places. A window's
fingerprint is the smallest hash of its ``GRAM``-word grams (neighbouring windows mostly share it, so a text has few):
equal windows have equal fingerprints, and only windows whose fingerprint recurs need a look.

The index holds sorted immutable runs of fingerprints. Each batch becomes a new run, merge-joined with the older runs to
flag what recurs; runs are compacted into one when there are too many. The windows behind recurring fingerprints are
then verified by 96-bit digests of all their words, taken from the texts, and the recurring ones are removed.

An index in a folder of its own serves corpora that grow: ``deduplicate_batch`` removes from a new batch the windows that
occur again in it or anywhere in the index's history, then adds the batch as a run. Such runs also hold the digests of
all windows, against which history is verified (the earlier texts aren't needed again), and every change ends with a
manifest that names the live runs, so ``FingerprintIndex.open`` finds the state of the last change that was finished.

Scale: the corpus is reduced to some 7 % of its word count in 64-bit values before the first shuffle. Copies of one text
are told by a 128-bit content key, and only one representative takes part in verification; frequent fingerprints and
digests collapse map-side, and where rows meet them again both sides are plain scans, which Spark's skew split divides.
Texts are shuffled only to meet their own flags.

Defined results: null texts have no words; texts of fewer words than a window lose nothing, however often they occur.
Repeated rows are occurrences of their own. Documents keep their id whatever it is (null ids too). A very long text is
worked on whole, alone. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import tokens
from rivulet.llm.common import content_keys, listed, materialize, release, scratch_path, shuffles_cleaned, slices, text_bytes, text_or_empty, told_apart

#: Words of a gram. Every window of n words has n - GRAM + 1 of them.
GRAM = 8
#: Runs that an index holds before they are compacted into one.
MAX_RUNS = 4


def window_prints(words: tokens.Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fingerprints, gram positions) of all windows; of equal smallest grams the first counts."""
    starts = words.windows(n)
    gram = min(GRAM, n)
    wide = n - gram + 1
    if len(starts) == 0:
        return starts, np.zeros(0, np.uint64), starts
    values = tokens.window_hashes(hashes, np.arange(len(hashes) - gram + 1), gram)
    places = np.arange(len(values))
    span = 1
    while span * 2 <= wide:  # smallest of span grams from each place, doubling
        values, places = _smaller(values, places, span)
        span *= 2
    if span < wide:
        values, places = _smaller(values, places, wide - span)
    return starts, values[starts], places[starts]


def _smaller(values: np.ndarray, places: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(values) - step
    right = values[step:] < values[:n]
    return np.where(right, values[step:], values[:n]), np.where(right, places[step:], places[:n])


_ARROW_SKETCH = pa.struct([("print", pa.int64()), ("multi", pa.bool_())])


def sketch(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, content keys, ``n_words``, the digest of all words and the distinct fingerprints, each flagged
    if it stands at two places of the text. Row-wise."""
    rows = docs.select(F.col(key), *[v.alias(k) for k, v in content_keys(text).items()], text_or_empty(text).alias("__text"))
    kept = [key, "c", "c2"]
    schema = T.StructType(
        [
            *(rows.schema[c] for c in kept),
            T.StructField("n_words", T.LongType(), False),
            T.StructField("all_sha256", T.StringType(), False),
            T.StructField("prints", T.ArrayType(T.StructType([T.StructField("print", T.LongType()), T.StructField("multi", T.BooleanType())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, at = text_bytes(part.column("__text"))
                words = tokens.Words(data, at, tokens.PLAIN)
                starts, prints, places = window_prints(words, words.hashes(), n)
                row = words.row[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (places[1:] != places[:-1]) | (row[1:] != row[:-1])
                row, prints = row[new], prints[new]
                order = np.lexsort((prints, row))
                row, prints = row[order], prints[order]
                head = np.ones(len(row), bool)
                head[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
                first = np.flatnonzero(head)
                multi = np.diff(np.append(first, len(row))) > 1
                offsets = np.searchsorted(row[first], np.arange(part.num_rows + 1))
                flat = pa.StructArray.from_arrays([pa.array(prints[first].view(np.int64)), pa.array(multi)], fields=list(_ARROW_SKETCH))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                # bytes.split() parts words at the blank and the characters 9 to 13, and nowhere else
                digests = [hashlib.sha256(b" ".join(value.encode("utf-8").split())).hexdigest() for value in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(words.count, pa.int64()), pa.array(digests), lists], names=[*kept, "n_words", "all_sha256", "prints"])

    return rows.mapInArrow(run, schema)


class FingerprintIndex:
    """Sorted immutable runs under one folder. A run has fingerprints (``print``, the least and greatest content that has
    it, and ``again``: it recurs in a text or between texts, as far as known when the run was written) and, in an index
    that serves growing corpora, the digests of all windows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.runs, self._made = spark, path.rstrip("/"), [], 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as the folder's newest finished manifest names it; an empty one where there is none."""
        found = cls(spark, path)
        names = listed(spark, found.path)
        found._made = 1 + max((int(x.rsplit("-", 1)[1]) for x in names), default=-1)
        for name in reversed([x for x in names if x.startswith("manifest-")]):
            if "_SUCCESS" in listed(spark, f"{found.path}/{name}"):
                found.runs = [r[0] for r in spark.read.schema("run string").json(f"{found.path}/{name}").orderBy("run").collect()]
                break
        return found

    def publish(self) -> None:
        """Write a manifest of the live runs."""
        rows = self.spark.createDataFrame([(r,) for r in self.runs], "run string")
        rows.coalesce(1).write.json(f"{self.path}/manifest-{self._made:06d}")
        self._made += 1

    def _write(self, prints: DataFrame, windows: DataFrame | None = None) -> str:
        name = f"run-{self._made:06d}"
        self._made += 1
        with shuffles_cleaned(self.spark):
            prints.sortWithinPartitions("print").write.parquet(f"{self.path}/{name}/prints")
            if windows is not None:
                windows.distinct().sortWithinPartitions("d1", "d2").write.parquet(f"{self.path}/{name}/windows")
        return name

    def _union(self, table: str, schema: str) -> DataFrame | None:
        found = None
        for name in self.runs:
            own = self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{table}")
            found = own if found is None else found.unionByName(own)
        return found

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        """One row per fingerprint; map-side first, so a frequent one is a row per task in the shuffle."""
        found = rows.groupBy("print").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("again").alias("again"))
        return found.withColumn("again", F.col("again") | (F.col("low") != F.col("high")))

    @classmethod
    def prints(cls, sketches: DataFrame) -> DataFrame:
        rows = sketches.select("id", F.explode("prints").alias("p")).select(F.col("p.print").alias("print"), F.col("id").alias("low"), F.col("id").alias("high"), F.col("p.multi").alias("again"))
        return cls.merged(rows)

    def history(self) -> DataFrame | None:
        return self._union("prints", "print long, low long, high long, again boolean")

    def windows(self) -> DataFrame | None:
        """The digests of history's windows, for an index that holds them."""
        return self._union("windows", "d1 long, d2 int")

    def ingest(self, sketches: DataFrame, windows: DataFrame | None = None) -> None:
        """Add a batch of sketches as a run, flagging what the older runs hold of other texts. Where that makes too
        many runs, compact them."""
        batch = self.prints(sketches)
        history = self.history()
        if history is not None:
            old = history.select("print", F.col("low").alias("old_low"), F.col("high").alias("old_high"))
            if len(self.runs) > 1:
                old = old.groupBy("print").agg(F.min("old_low").alias("old_low"), F.max("old_high").alias("old_high"))
            batch = batch.join(old.hint("merge"), "print", "left")
            other = F.coalesce((F.col("old_low") != F.col("high")) | (F.col("old_high") != F.col("low")), F.lit(False))
            batch = batch.select("print", "low", "high", (F.col("again") | other).alias("again"))
        self.runs.append(self._write(batch, windows))
        release(self.spark)
        if len(self.runs) > MAX_RUNS:
            self.compact(windows is not None)

    def compact(self, with_windows: bool = False) -> None:
        """Merge all runs into one; the old ones stay on disk until the folder goes, for readers that hold them."""
        if len(self.runs) > 1:
            self.runs = [self._write(self.merged(self.history()), self.windows() if with_windows else None)]
            release(self.spark)

    def recurring(self) -> DataFrame:
        """The fingerprints known to recur."""
        found = self.history().filter("again").select("print")
        return found if len(self.runs) == 1 else found.distinct()


def _candidates(docs: DataFrame, flagged: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """For the representatives of texts with recurring fingerprints: the text and the windows behind them."""
    rows = docs.select(*[v.alias(k) for k, v in content_keys(text).items()], _row_key(key).alias("k"), text_or_empty(text).alias("text"))
    rows = rows.join(flagged.hint("shuffle_hash"), ["c", "c2", "k"]).select("id", "copied", "text", "recurring")
    schema = "id long, copied boolean, text string, at array<int>, d1 array<long>, d2 array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = text_bytes(part.column("text"))
                words = tokens.Words(data, at, tokens.PLAIN)
                hashes = words.hashes()
                starts, prints, _ = window_prints(words, hashes, n)
                bounds = np.searchsorted(words.row[starts], np.arange(part.num_rows + 1))
                chosen = np.zeros(len(starts), bool)
                lists = part.column("recurring")
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
                for i in range(part.num_rows):
                    own = np.sort(flat[ends[i] : ends[i + 1]])
                    mine = prints[bounds[i] : bounds[i + 1]]
                    if len(own) and len(mine):
                        found = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                        chosen[bounds[i] : bounds[i + 1]] = own[found] == mine
                picked = starts[chosen]
                row = words.row[picked]
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                columns = [(picked - words.first[row]).astype(np.int32), *_window_digests(words, hashes, picked, n)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copied"), part.column("text"), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in columns)], names=["id", "copied", "text", "at", "d1", "d2"])

    return rows.mapInArrow(run, schema)


def _digests(docs: DataFrame, n: int, text: str) -> DataFrame:
    """(d1, d2) of every window of every text. Row-wise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = tokens.Words(*text_bytes(part.column("text")), tokens.PLAIN)
                d1, d2 = _window_digests(words, words.hashes(), words.windows(n), n)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2)], names=["d1", "d2"])

    return docs.select(text_or_empty(text).alias("text")).mapInArrow(run, "d1 long, d2 int")


def _window_digests(words: tokens.Words, hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the n words from every start, by two independent families."""
    d1 = tokens.window_hashes(hashes, starts, n, 0).view(np.int64)
    d2 = (tokens.window_hashes(words.hashes(1), starts, n, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return d1, d2


def _row_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("\0null"))


def _cut(rows: DataFrame, n: int) -> DataFrame:
    """(id, n_removed, kept_sha256, kept) for texts and their removed windows' starts."""
    schema = "id long, n_removed long, kept_sha256 string, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, kept = [], [], []
            for value, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = np.array(value.encode("utf-8").split(), dtype=object)
                at = np.asarray(starts, np.int64)
                gone = tokens.covered(len(words), at, at + n)
                left = b" ".join(words[~gone].tolist())
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept)], names=["id", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, schema)


def _without_repeats(docs: DataFrame, rows: DataFrame, recurring: DataFrame, known: DataFrame | None, n: int, key: str, text: str, with_text: bool) -> DataFrame:
    """The result for sketched ``rows`` of ``docs``, given the fingerprints that need a look and history's digests."""
    spark = docs.sparkSession
    contents = rows.groupBy("id", "c", "c2").agg(F.min(_row_key(key)).alias("k"), (F.count(F.lit(1)) > 1).alias("copied"))
    prints = rows.select("id", F.explode("prints.print").alias("print")).join(recurring, "print", "left_semi")
    prints = prints.groupBy("id").agg(F.collect_set("print").alias("recurring"))
    flagged = materialize(contents.join(prints, "id"), "substring-flagged")
    release(spark)
    windows = materialize(_candidates(docs, flagged, n, key, text), "substring-windows")
    release(spark)

    each = windows.select("id", "copied", F.explode(F.arrays_zip("at", "d1", "d2")).alias("w")).select("id", "copied", F.col("w.at").alias("at"), F.col("w.d1").alias("d1"), F.col("w.d2").alias("d2"))
    counts = each.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max("copied").alias("copied"))
    again = (F.col("n") > 1) | F.col("copied")
    if known is not None:
        old = known.distinct().withColumn("old", F.lit(True))
        counts, again = counts.join(old.hint("merge"), ["d1", "d2"], "left"), again | F.coalesce("old", F.lit(False))
    repeated = materialize(counts.filter(again).select("d1", "d2"), "substring-repeated")
    starts = each.filter(~F.col("copied")).drop("copied").join(repeated, ["d1", "d2"], "left_semi").groupBy("id").agg(F.collect_list("at").alias("starts"))
    starts = materialize(starts, "substring-starts")
    release(spark)
    cut = _cut(windows.filter(~F.col("copied")).select("id", "text").join(starts.hint("shuffle_hash"), "id"), n)
    cut = materialize(cut if with_text else cut.drop("kept"), "substring-cut")

    copied = contents.filter("copied").select("id", F.lit(True).alias("copied"))
    out = rows.drop("prints").join(copied, "id", "left").join(cut, "id", "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= n)
    found = {
        "n_removed": F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"),
        "kept_sha256": F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")),
    }
    if with_text:
        found["kept"] = F.when(whole, F.lit("")).otherwise(F.col("kept"))
    return out.select(key, "n_words", *[v.alias(k) for k, v in found.items()])


def deduplicate(docs: DataFrame, n: int = 35, batches: int = 2, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: key, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept`` (the words left, one blank
    between; null if nothing was removed).

    The corpus is fed to an index of its own in ``batches`` batches (dealt by content, so copies arrive together), which
    is compacted before it is asked.
    """
    spark = docs.sparkSession
    rows = told_apart(materialize(sketch(docs, n, key, text), "substring-sketch"))
    index = FingerprintIndex(spark, scratch_path(spark, "substring-index"))
    for b in range(batches):
        index.ingest(rows.filter(F.pmod("id", F.lit(batches)) == b))
    index.compact()
    return _without_repeats(docs, rows, index.recurring(), None, n, key, text, with_text)


def deduplicate_batch(docs: DataFrame, index: FingerprintIndex, n: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """As ``deduplicate``, for a batch of a growing corpus: windows also go if they occur in the batches before. The batch
    is then part of the index, which is saved in its folder."""
    rows = told_apart(materialize(sketch(docs, n, key, text), "substring-sketch"))
    own, history = FingerprintIndex.prints(rows), index.history()
    recurring = own.filter("again").select("print")
    if history is not None:
        recurring = recurring.unionByName(own.select("print").join(history.select("print").hint("merge"), "print", "left_semi")).distinct()
    recurring = materialize(recurring, "substring-recurring")
    out = materialize(_without_repeats(docs, rows, recurring, index.windows(), n, key, text, with_text), "substring-batch")
    index.ingest(rows, _digests(docs, n, text))
    index.publish()
    return out
