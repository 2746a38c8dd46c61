"""Line deduplication by an exact set-similarity join.

A line's tokens are its runs of ``SHINGLE`` normalised words (of all its words if it has fewer). Two lines match if the
Jaccard similarity of their token sets reaches the threshold. A line is removed if any earlier line of the corpus matches
it, in the order of document id, then line number; whether that earlier line is removed itself doesn't matter.

Lines of the same words are told by a 128-bit key, of two independent families of hashes, and handled as one: its earliest line stands for it. Tokens are ordered by rarity classes (from hashed counts over the whole
corpus, so a token of a large share of all lines comes last), then by hash; any global order gives the same result. Of m
ordered tokens the first m - ceil(t m) + k (k about a twentieth of m at t = 0.8, but one at least) are the line's prefix,
and matching lines share k prefix tokens or more:

1. prefix tokens are dealt over buckets by hash, packed, to find those that stand in lines of different keys; frequent
   ones, by their class, are spread over many buckets, and what is alone in its bucket there is looked up among all;
2. lines with fewer than k of them are out; the others' whole sets are read from their texts, once per key;
3. each is compared with one line first: the one that most of its prefix tokens name, each naming the earliest and the
   commonest line of its group. That settles most members of large groups; lines not removed by it are compared with all
   earlier members of their groups, under the length and positional filters and the number of prefix tokens that two
   lines of their sizes must share. Candidates are verified on the whole sets.

Nothing is broadcast but the rarity classes (one byte for each of ``BUCKETS`` counters, whatever the corpus).

Defined results: null texts stay null and have no lines; lines without words are kept; a text whose lines all go becomes
the empty text. Rows repeated with equal id and text count as one document and get the same result each. Null ids come
first. A very long text or line is worked on whole, one at a time. An empty table gives an empty result. Extra columns
are kept, but for those with the names of the new columns, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens
from rivulet.llm.common import discard, materialize, shuffles_cleaned, slices, text_bytes

#: Words of a token.
SHINGLE = 5
#: Hashed counters of token frequency. Tokens of a share of some 1 / BUCKETS of all tokens and more are told as frequent.
BUCKETS = 1 << 21
#: A line's prefix is longer than one shared token needs by this share of t (1 - t) m, so that it must share as many more.
#: With this share or less, the number follows from the larger of two matching lines for every threshold t.
EXTRA = 0.32
#: Tokens of lines for each bucket of prefix tokens; a quarter of them, about, are prefix tokens.
BUCKET_TOKENS = 1_000_000
#: Entries that a task packs at once.
_PACK = 500_000
#: Keys that a task remembers, so as to emit the prefix of a common line once.
_SEEN = 1 << 18


def line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line of every row, and one more; where the lines start, and the end)."""
    breaks = np.flatnonzero(data == 10) + 1
    line_at = np.sort(np.concatenate([at, breaks]), kind="stable")  # a break at a row's end starts a last, empty line
    first = np.arange(len(at)) + np.searchsorted(breaks, at, side="left")
    # a break that ends a row sorts with the next row's start; the row still owns the empty line after it
    ends_here = np.zeros(len(at), np.int64)
    if len(breaks):
        ends_here = np.isin(at, breaks[np.isin(breaks, at)]).astype(np.int64)
    return first + ends_here * (at > 0), line_at


def cut_lines(data: np.ndarray, line_at: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the picked lines (in order) alone, and where those lines start in them, and the end."""
    length = np.diff(line_at)
    chosen = np.zeros(len(length), bool)
    chosen[picked] = True
    return data[line_at[0] : line_at[-1]][np.repeat(chosen, length)], np.append(0, np.cumsum(length[picked]))


def tokens_of_lines(data: np.ndarray, line_at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, tokens.Words]:
    """(lines' token hashes; the tokens' lines; words, a row of them per line) of lines with their bounds."""
    words = tokens.Words(tokens.LOWER[data], line_at, tokens.NORMAL, chunked=True)
    starts = words.windows(shingle)
    short = np.flatnonzero((words.count > 0) & (words.count < shingle))
    begin = np.concatenate([starts, words.first[short]])
    end = np.concatenate([starts + shingle, words.first[short] + words.count[short]])
    owner = np.concatenate([words.row[starts], short])
    order = np.argsort(owner, kind="stable")
    return tokens.run_hashes(words.hashes(), begin[order], end[order]), owner[order], words


def line_tokens(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tokens.Words]:
    """(first line of every row, and one more; lines' token hashes; the tokens' lines; words, a row of them per line)."""
    first, line_at = line_bounds(data, at)
    return first, *tokens_of_lines(data, line_at, shingle)


def ordered_sets(hashes: np.ndarray, owner: np.ndarray, n_lines: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets per line): each line's distinct tokens, by rarity class, then by hash."""
    found = hashes.copy()
    bounds = np.searchsorted(owner, np.arange(n_lines + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            found[a:b].sort()
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.concatenate([[0], np.cumsum(fresh)])[bounds]
    found = found[fresh]
    if classes is not None:
        own = classes[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]
        if own.any():
            line = np.repeat(np.arange(n_lines), np.diff(at))
            found = found[np.argsort(line * 256 + own, kind="stable")]
    return found, at


def line_keys(words: tokens.Words, family: int) -> np.ndarray:
    """A 64-bit key of each line's words in their order."""
    run = tokens.run_hashes(words.hashes(family), words.first[:-1], words.first[1:], family)
    return tokens.mix(run + words.count.astype(np.uint64)).view(np.int64)


def rarity(counters: np.ndarray) -> np.ndarray:
    """Class of every counter: 0 up to twice the mean, then one more for every doubling."""
    often = counters / max(1.0, 2 * counters.mean())
    return np.where(often > 1, np.ceil(np.log2(np.maximum(often, 1))), 0).astype(np.uint8)


def must_share(m: Column, threshold: float) -> Column:
    """Prefix tokens that a line of m tokens shares with any line that matches it."""
    return F.greatest(F.lit(1), F.floor(F.lit(EXTRA * threshold * (1 - threshold)) * m)).cast("int")


def prefix_length(m: np.ndarray, threshold: float) -> np.ndarray:
    k = np.maximum(1, np.floor(EXTRA * threshold * (1 - threshold) * m)).astype(np.int64)
    return np.minimum(m, m - np.ceil(threshold * m - 1e-9).astype(np.int64) + k)


def _prefix_column(m: Column, threshold: float) -> Column:
    return F.least(m, m - F.ceil(F.lit(threshold) * m - 1e-9).cast("int") + must_share(m, threshold))


def _scan_lines(rows: DataFrame, key: str, shingle: int) -> DataFrame:
    """Per row the keys of its lines (nulls for lines without words); per task a row of token counters."""
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, c long, c2 long, l1 array<long>, l2 array<long>, counters binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(BUCKETS, np.int64)
        held, size = [], 0
        names = [key, "c", "c2", "l1", "l2", "counters"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(key).type
            for part in slices(batch, "__text"):
                first, hashes, owner, words = line_tokens(*text_bytes(part.column("__text")), shingle)
                held.append((hashes & np.uint64(BUCKETS - 1)).astype(np.int32))
                size += len(hashes)
                if size >= BUCKETS:
                    counters += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
                offsets, none = pa.array(first, pa.int32()), (words.count == 0)[: first[-1]]
                keys = line_keys(words, 0), line_keys(words, 1)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(k[: first[-1]], mask=none)) for k in keys]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("c"), part.column("c2"), *lists, pa.nulls(part.num_rows, pa.binary())], names=names)
        if held:
            counters += np.bincount(np.concatenate(held), minlength=BUCKETS)
        nulls = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*nulls, _packed(counters)], names=names)

    return rows.mapInArrow(run, schema)


def _packed(counters: np.ndarray) -> pa.Array:
    return pa.array([zstandard.compress(counters.tobytes(), 1)], pa.binary())


def _added(total: np.ndarray, packed: bytes) -> None:
    total += np.frombuffer(zstandard.decompress(packed), np.int64)


def _summed(scanned: DataFrame) -> np.ndarray:
    """The tasks' counters added up: within every partition, then in a few tasks, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                _added(total, x.as_py())
        yield pa.RecordBatch.from_arrays([_packed(total)], names=["counters"])

    parts = scanned.filter(F.col("counters").isNotNull()).select("counters").mapInArrow(run, "counters binary")
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.repartition(4).mapInArrow(run, "counters binary").collect():
        _added(total, bytes(r[0]))
    return total


def _pieces(bucket: np.ndarray, token: np.ndarray, l1: np.ndarray, i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """A row per bucket: its entries' tokens, keys, places and sizes, block after block, in 24 bytes each."""
    order = np.argsort(bucket, kind="stable")
    held, n = np.unique(bucket[order], return_counts=True)
    start = np.cumsum(n) - n
    size, begin = np.repeat(n, n), np.repeat(start, n)
    at = np.arange(len(order)) - begin
    words = np.empty(6 * len(order), "<u4")
    wide = words.view("<i8")
    wide[3 * begin + at], wide[3 * begin + size + at] = token[order], l1[order]
    words[6 * begin + 4 * size + at], words[6 * begin + 5 * size + at] = i[order], m[order]
    offsets = np.append(24 * start, 24 * len(order)).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), packed], names=["bucket", "entries"])


def _entries(pieces: list[memoryview]) -> tuple[np.ndarray, ...]:
    """(token, l1, i, m) of packed pieces."""
    held = []
    for x in pieces:
        n = len(x) // 24
        held.append((np.frombuffer(x, "<i8", n), np.frombuffer(x, "<i8", n, 8 * n), np.frombuffer(x, "<i4", n, 16 * n), np.frombuffer(x, "<i4", n, 20 * n)))
    return tuple(np.concatenate(parts) for parts in zip(*held, strict=True))


def _prefixes(rows: DataFrame, classes, shingle: int, threshold: float, buckets: int) -> DataFrame:
    """(bucket, entries): the prefix tokens of all lines, with their key and place among the line's m tokens, packed by
    bucket for every ``_PACK`` entries of a task. A token of a class above 0 is dealt over an eighth of the buckets. A task
    emits a key it remembers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ~np.arange(_SEEN)  # no key is in the slot of its complement
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "__text"):
                _, hashes, owner, words = line_tokens(*text_bytes(part.column("__text")), shingle)
                l1 = line_keys(words, 0)
                new = np.zeros(len(l1), bool)
                new[np.unique(l1, return_index=True)[1]] = True
                slot = l1 & (_SEEN - 1)
                new &= (words.count > 0) & (seen[slot] != l1)
                seen[slot[new]] = l1[new]
                wanted = new[owner]
                found, at = ordered_sets(hashes[wanted], owner[wanted], len(words.count), classes.value)
                m = np.diff(at)
                take = prefix_length(m, threshold)
                line = np.repeat(np.arange(len(m)), take)
                i = np.arange(len(line)) - np.repeat(np.cumsum(take) - take, take)
                token = found[at[:-1][line] + i]
                own = l1[line].view(np.uint64)
                salt = np.where(classes.value[(token & np.uint64(BUCKETS - 1)).astype(np.int64)] > 0, tokens.mix(own) % np.uint64(max(1, buckets // 8)), np.uint64(0))
                bucket = (tokens.mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)
                held.append((bucket, token.view(np.int64), l1[line], i.astype(np.int32), m[line].astype(np.int32)))
                size += len(line)
                if size >= _PACK:
                    yield _pieces(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield _pieces(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("__text").mapInArrow(run, "bucket int, entries binary")


def _recurring(packed: DataFrame, classes) -> DataFrame:
    """(token, l1, i, m, sure): in each bucket, the entries of tokens of two keys or more, and, not sure, those of tokens
    of a class above 0 that have one key there."""

    def run(table: pa.Table) -> pa.Table:
        token, l1, i, m = _entries([x.as_buffer() for x in table.column("entries")])
        order = np.argsort(token)
        token, l1, i, m = (x[order] for x in (token, l1, i, m))
        again = token[1:] == token[:-1]
        several = np.append(again, False) | np.append(False, again)
        # most tokens stand alone: only frequent ones of them are kept, and only the others are ordered by their keys
        some = np.flatnonzero(several | (classes.value[token & (BUCKETS - 1)] > 0))
        some = some[np.lexsort((l1[some], token[some]))]
        token, l1, i, m = (x[some] for x in (token, l1, i, m))
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        fresh = ~same | np.concatenate([[False], l1[1:] != l1[:-1]])[: len(token)]
        token, l1, i, m, head = (x[fresh] for x in (token, l1, i, m, ~same))
        start = np.flatnonzero(head)
        n = np.repeat(np.diff(np.append(start, len(token))), np.diff(np.append(start, len(token))))
        often = classes.value[token & (BUCKETS - 1)] > 0
        kept = (n > 1) | often
        return pa.table({"token": token[kept], "l1": l1[kept], "i": i[kept], "m": m[kept], "sure": n[kept] > 1})

    return packed.groupBy("bucket").applyInArrow(run, "token long, l1 long, i int, m int, sure boolean")


def _hits(entries: DataFrame) -> DataFrame:
    """The entries of tokens that recur: those sure of it, and of the others those whose token another bucket holds too.
    A token has at most one unsure entry for each of its buckets."""
    unsure = entries.filter("not sure")
    every = unsure.groupBy("token").agg(F.min("l1").alias("a"), F.max("l1").alias("b"))
    several = every.filter("a <> b").select("token")
    # a token that is sure in one bucket recurs for all; few are, so they are looked up by the tokens that are unsure
    known = entries.filter("sure").join(every.select("token"), "token", "left_semi").select("token").distinct()
    found = unsure.join(several.unionByName(known).distinct(), "token", "left_semi")
    return entries.filter("sure").unionByName(found).drop("sure")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(l1, l2, tokens) of the lines named by ``lines`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, at = text_bytes(part.column("__text"))
                first, line_at = line_bounds(data, at)
                named = part.column("lines")
                picked = np.sort(np.repeat(first[:-1], np.asarray(named.value_lengths())) + named.flatten().to_numpy())
                hashes, owner, words = tokens_of_lines(*cut_lines(data, line_at, picked), shingle)
                found, offsets = ordered_sets(hashes, owner, len(picked))
                l1, l2 = line_keys(words, 0), line_keys(words, 1)
                yield pa.RecordBatch.from_arrays([pa.array(l1), pa.array(l2), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64)))], names=["l1", "l2", "tokens"])

    return texts.select("__text", "lines").mapInArrow(run, "l1 long, l2 long, tokens array<long>")


def _matched(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(l1, l2) of the x of those pairs (x, y) whose y stands earlier and is similar enough. A pair names lines by l1
    alone; were two keys to share it, both are looked at."""
    x = sets.select(F.col("l1").alias("x"), "l2", F.col("place").alias("px"), F.col("tokens").alias("tx"))
    y = sets.select(F.col("l1").alias("y"), F.col("place").alias("py"), F.col("tokens").alias("ty"))
    able = (F.col("py") < F.col("px")) & (F.size("tx") >= F.lit(threshold) * F.size("ty") - 1e-9) & (F.size("ty") >= F.lit(threshold) * F.size("tx") - 1e-9)
    both = F.size(F.array_intersect("tx", "ty"))
    least = threshold - 1e-12  # of the union; as a share of both sizes, so that the intersection is worked out once
    found = pairs.join(x, "x").join(y, "y").filter(able).filter(both >= F.lit(least / (1 + least)) * (F.size("tx") + F.size("ty")))
    return found.select(F.col("x").alias("l1"), "l2").distinct()


def similar_to_earlier(sets: DataFrame, threshold: float) -> DataFrame:
    """(l1, l2) of the keys (l1, l2, place, copies, m, hits, tokens) that match one with an earlier place."""
    prefix = sets.select("l1", F.col("place.d").alias("d"), "copies", "m", F.size("hits").alias("h"), F.explode("hits").alias("e")).select(F.col("e.token").alias("token"), "l1", "d", "copies", "m", "h", F.col("e.i").alias("i"))
    prefix = materialize(prefix, "line-prefixes")
    groups = prefix.groupBy("token").agg(F.min("l1").alias("a"), F.max("l1").alias("b"), F.min_by("l1", "d").alias("early"), F.max_by("l1", "copies").alias("common")).filter("a <> b")
    groups = materialize(groups.select("token", F.coalesce("early", "a").alias("early"), "common"), "line-groups")
    votes = prefix.join(groups, "token").select(F.col("l1").alias("x"), F.explode(F.array_distinct(F.array("early", "common"))).alias("y")).filter("x <> y")
    votes = votes.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    stars = materialize(votes.groupBy("x").agg(F.max_by("y", "n").alias("y")), "line-star-pairs")
    first = materialize(_matched(stars, sets, threshold), "line-star-matches")

    rest = prefix.join(first.select("l1").distinct(), "l1", "left_anti")
    y = prefix.select(F.col("token").alias("token_y"), F.col("l1").alias("y"), F.col("d").alias("dy"), F.col("m").alias("my"), F.col("h").alias("hy"), F.col("i").alias("iy"))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("m") + F.col("my")) - 1e-9)
    close = (F.col("token") == F.col("token_y")) & (F.col("l1") != F.col("y")) & (F.col("dy").isNull() | (F.col("dy") <= F.col("d")))
    close = close & (F.col("my") >= F.lit(threshold) * F.col("m") - 1e-9) & (F.col("m") >= F.lit(threshold) * F.col("my") - 1e-9)
    # from the first shared token on, no more can be shared than either has left
    close = close & (F.least(F.col("m") - F.col("i"), F.col("my") - F.col("iy")) >= need)
    # what two lines share lies in both prefixes, among the hits, or in the rest of the one whose prefix ends first
    beyond = F.greatest(F.col("m") - _prefix_column(F.col("m"), threshold), F.col("my") - _prefix_column(F.col("my"), threshold))
    close = close & (F.least("h", "hy") >= need - beyond)
    pairs = rest.join(y, close).select(F.col("l1").alias("x"), "y").distinct()
    pairs = pairs.join(stars, ["x", "y"], "left_anti")
    matched = materialize(first.unionByName(_matched(pairs, sets, threshold)), "line-matches")
    discard(prefix, groups, stars, first)
    return matched


def deduplicate(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows with ``text`` less its removed lines, and ``n_lines`` and ``n_removed`` (of the text given)."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key), F.xxhash64(value).alias("c"), F.xxhash64(F.lit("second"), value).alias("c2"), value.alias("__text"))
    scanned = materialize(_scan_lines(rows, key, shingle), "lines")
    total = _summed(scanned)
    classes = spark.sparkContext.broadcast(rarity(total))
    each = scanned.filter(F.col("counters").isNull()).select(key, "c", "c2", F.posexplode(F.arrays_zip("l1", "l2")).alias("line", "l")).filter(F.col("l.l1").isNotNull()).select(key, "c", "c2", "line", F.col("l.l1").alias("l1"), F.col("l.l2").alias("l2"))
    place = F.struct(F.col(key).alias("d"), F.col("c").alias("c"), F.col("c2").alias("c2"), F.col("line").alias("line"))
    firsts = materialize(each.groupBy("l1", "l2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies")), "line-keys")

    buckets = max(16, -(-int(total.sum()) // BUCKET_TOKENS))
    entries = materialize(_recurring(_prefixes(rows, classes, shingle, threshold, buckets), classes), "line-entries")
    # a key has one entry for a token, as both name its bucket
    hits = _hits(entries).groupBy("l1").agg(F.collect_list(F.struct("token", "i")).alias("hits"), F.first("m").alias("m"))
    hits = hits.filter(F.size("hits") >= must_share(F.col("m"), threshold))
    chosen = materialize(hits.join(firsts, "l1"), "line-chosen")
    discard(entries)

    named = chosen.groupBy(F.col("place.d").alias("__d"), F.col("place.c").alias("__c"), F.col("place.c2").alias("__c2")).agg(F.collect_set("place.line").alias("lines"))
    texts = rows.join(named.hint("shuffle_hash"), rows[key].eqNullSafe(named["__d"]) & (rows["c"] == named["__c"]) & (rows["c2"] == named["__c2"]))
    tokens_of = _sets(texts, shingle).groupBy("l1", "l2").agg(F.first("tokens").alias("tokens"))
    sets = materialize(chosen.join(tokens_of, ["l1", "l2"]), "line-sets")
    matched = similar_to_earlier(sets, threshold)
    discard(chosen, sets)

    firsts = firsts.join(matched.withColumn("matched", F.lit(True)), ["l1", "l2"], "left").filter((F.col("copies") > 1) | F.col("matched")).withColumnRenamed("place", "first")
    gone = each.join(firsts.drop("copies"), ["l1", "l2"]).filter((place != F.col("first")) | F.coalesce("matched", F.lit(False)))
    gone = materialize(gone.groupBy(F.col(key).alias("__k"), F.col("c").alias("__c"), F.col("c2").alias("__c2")).agg(F.collect_set("line").alias("__gone")), "lines-removed")

    out = docs.drop("n_lines", "n_removed", "__gone", "__c", "__c2", "__k")
    same = out[key].eqNullSafe(gone["__k"]) & (F.xxhash64(value) == gone["__c"]) & (F.xxhash64(F.lit("second"), value) == gone["__c2"])
    out = out.join(gone.hint("shuffle_hash"), same, "left")
    # the inner function gets the parts as a value: within it, an expression would be worked out for every line
    parts = F.array(F.split(F.col(text), "\n", -1))
    left = F.transform(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("__gone")), lambda i: F.get(p, i)), "\n"))
    some = F.col(text).isNotNull() & F.col("__gone").isNotNull()
    kept = F.when(some, F.get(left, F.lit(0))).otherwise(F.col(text))
    sizes = {"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1), "n_removed": F.when(some, F.size("__gone")).otherwise(0)}
    out = out.select(*[c for c in docs.columns if c not in (text, "n_lines", "n_removed")], kept.alias(text), *[v.cast("long").alias(k) for k, v in sizes.items()])
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*order, "n_lines", "n_removed")
