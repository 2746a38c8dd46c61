"""Suffix-array deduplication of byte strings: what a string of ``n`` bytes covers that also starts anywhere else goes.

Suffixes are ordered only as deep as the threshold, by most-significant-digit passes; a group of suffixes that is left
together after the last digit is a repeated string, and every repeated string is such a group. A pass costs a shuffle of
what it orders, so the digits are chosen for how much they settle:

1. The first digit is sampled: of the ``GRAM``-byte grams in a suffix's first n bytes, the one of least hash. Neighbouring
   suffixes mostly share it, so a text has few (about two in 140 bytes), and suffixes that are equal to depth n have it at
   equal distance. Digits that occur once in the corpus are done.
2. The suffixes that share one gram in place are a block, and a block's bytes (the n bytes of all its suffixes) are the
   second digit: blocks of equal bytes recur with all their suffixes. A gram with blocks of one kind only is done.
3. Of grams with several kinds of blocks, one block of every kind is cut out of its text, dealt to a task by gram, and
   its suffixes are ordered there in numpy by ``DIGIT``-byte digits down to depth n; suffixes alone in their group
   leave after each digit. Digits are compared by 64-bit hashes, and groups that are left are verified byte by byte.
4. A gram with more than ``BUCKET`` kinds of blocks isn't gathered: its blocks are cut into runs of ``RUN`` suffixes, whose
   bytes are the next digit in the same way; of runs with several kinds, one of every kind is counted suffix by suffix,
   all n bytes as one digit. These digits are 128-bit hashes, counted with partial sums first, so that a string which a
   third of all blocks hold is a row per task.

Copies of one text, told by a 128-bit key, are one text that repeats; they are removed whole without looking inside. Texts
meet their flags in joins of plain scans; what is collected per text is bounded by that text. All phases are written to the
shared scratch folder.

Defined results: null texts are empty; texts of fewer than n bytes lose nothing, however often they occur. Repeated rows
are occurrences of their own. Documents keep their id whatever it is (null ids too). A very long text is worked on whole,
in pieces of 1 MB for the first two digits (a block that a piece ends is two blocks, which the later digits bring together). An
empty table gives an empty result. Extra columns are left out. What is left needn't be valid UTF-8: ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import tokens
from rivulet.llm.common import content_keys, discard, materialize, release, slices, text_bytes, text_or_empty, told_apart

#: Bytes of a gram, of a digit, and of a piece of a long text.
GRAM = 64
DIGIT = 40
PIECE = 1 << 20
#: Kinds of blocks of a gram that one task orders; suffixes of a run of blocks of other grams; suffixes that a task orders at
#: once, about.
BUCKET = 64
RUN = 8
_SUFFIXES = 1 << 20


def _hashes(values: np.ndarray, width: int, family: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from every place, of mixed byte values."""
    power, inverse = tokens._powers(family, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    found = sums[width:] - sums[:-width]
    found *= inverse[: len(found)]
    return tokens.mix(found)


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``width`` values from every place, and where it stands first."""
    places, span = np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        values, places = np.where(right, values[step:], values[:-step]), np.where(right, places[step:], places[:-step])
        span += step
    return values, places


def blocks(data: np.ndarray, at: np.ndarray, n: int, gram: int = GRAM, size: int = PIECE) -> tuple[np.ndarray, ...]:
    """(row, start, suffixes, distance to the gram, gram's hash) of the blocks of all texts, starts within their texts."""
    gram = min(gram, n)
    found = []
    for low in range(0, max(len(data) - n + 1, 0), size):
        piece = data[low : low + size + n - 1]
        prints, places = _least(_hashes(tokens._BYTE_VALUES[0][piece], gram, 0), n - gram + 1)
        high = low + len(prints)
        first, last = np.clip(at[:-1], low, high), np.clip(at[1:] - n + 1, low, high)
        rows = np.flatnonzero(last > first)
        starts = np.concatenate([np.arange(a, b) for a, b in zip(first[rows] - low, last[rows] - low, strict=True)] or [np.zeros(0, np.int64)])
        row = np.repeat(rows, last[rows] - first[rows])
        prints, places = prints[starts], places[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (places[1:] != places[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        found.append((row[head], starts[head] + low - at[row[head]], np.diff(np.append(head, len(starts))), places[head] - starts[head], prints[head]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def span_digests(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes from every start, by two independent families, piece by piece."""
    out = np.zeros((2, len(start)), np.uint64)
    piece_of = start // PIECE
    for k in np.unique(piece_of):
        own = piece_of == k
        base, most = int(k) * PIECE, int((start[own] + length[own]).max())
        for family in (0, 1):
            values = tokens._BYTE_VALUES[family][data[base:most]]
            found = tokens._runs(values, start[own] - base, start[own] - base + length[own], family)
            out[family, own] = tokens.mix(found + length[own].astype(np.uint64) * np.uint64(tokens._SEED[family] | 1))
    return out[0].view(np.int64), out[1].view(np.int64)


def sketch(docs: DataFrame, n: int, key: str, text: str, gram: int, piece: int) -> DataFrame:
    """Per row: the key, content keys, ``n_bytes``, the text's digest and the distinct first digits, flagged if they stand
    at two places of the text. Row-wise."""
    rows = docs.select(F.col(key), *[v.alias(k) for k, v in content_keys(text).items()], text_or_empty(text).alias("__text"))
    kept = [key, "c", "c2"]
    pair = T.StructType([T.StructField("print", T.LongType()), T.StructField("multi", T.BooleanType())])
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("n_bytes", T.LongType(), False), T.StructField("all_sha256", T.BinaryType(), False), T.StructField("prints", T.ArrayType(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, at = text_bytes(part.column("__text"))
                row, _, _, _, prints = blocks(data, at, n, gram, piece)
                order = np.lexsort((prints, row))
                row, prints = row[order], prints[order]
                head = np.ones(len(row), bool)
                head[1:] = (row[1:] != row[:-1]) | (prints[1:] != prints[:-1])
                first = np.flatnonzero(head)
                multi = np.diff(np.append(first, len(row))) > 1
                offsets = np.searchsorted(row[first], np.arange(part.num_rows + 1))
                flat = pa.StructArray.from_arrays([pa.array(prints[first].view(np.int64)), pa.array(multi)], names=["print", "multi"])
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [pa.array(np.diff(at)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, "n_bytes", "all_sha256", "prints"])

    return rows.mapInArrow(run, schema)


def _row_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("\0null"))


def _with_blocks(docs: DataFrame, flagged: DataFrame, n: int, key: str, text: str, gram: int, piece: int) -> DataFrame:
    """For one row of every content with recurring first digits: its text and the blocks behind them."""
    rows = docs.select(*[v.alias(k) for k, v in content_keys(text).items()], _row_key(key).alias("k"), text_or_empty(text).alias("text"))
    rows = rows.join(flagged.hint("shuffle_hash"), ["c", "c2", "k"]).select("id", "copied", "text", "recurring")
    lists = {"at": "int", "n": "int", "off": "int", "p": "bigint", "s1": "bigint", "s2": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                row, start, count, off, prints = blocks(data, offsets, n, gram, piece)
                chosen = np.zeros(len(row), bool)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                recurring = part.column("recurring")
                flat = recurring.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.asarray(recurring.value_lengths().fill_null(0)))])
                for i in range(part.num_rows):
                    own, mine = np.sort(flat[ends[i] : ends[i + 1]]), prints[bounds[i] : bounds[i + 1]]
                    if len(own) and len(mine):
                        chosen[bounds[i] : bounds[i + 1]] = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
                row, start, count, off, prints = (x[chosen] for x in (row, start, count, off, prints))
                s1, s2 = span_digests(data, offsets[row] + start, count - 1 + n)
                at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                columns = [start.astype(np.int32), count.astype(np.int32), off.astype(np.int32), prints.view(np.int64), s1, s2]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copied"), part.column("text"), *(pa.ListArray.from_arrays(at, pa.array(x)) for x in columns)], names=["id", "copied", "text", *lists])

    return rows.mapInArrow(run, "id long, copied boolean, text string, " + ", ".join(f"{k} array<{t}>" for k, t in lists.items()))


def _cut_out(rows: DataFrame, n: int) -> DataFrame:
    """A row per chosen block, with its bytes."""
    schema = "p long, k long, again boolean, id long, at int, n int, off int, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                chosen = part.column("refs")
                sizes = np.asarray(chosen.value_lengths())
                flat = chosen.flatten()
                at, count = (flat.field(c).to_numpy() for c in ("at", "n"))
                start = np.repeat(offsets[:-1], sizes) + at
                cut = [data[a : a + c - 1 + n].tobytes() for a, c in zip(start, count, strict=True)]
                ids = part.column("id").take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                made = pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("p", "k", "again")), ids, *(flat.field(c) for c in ("at", "n", "off")), pa.array(cut, pa.binary())], names=["p", "k", "again", "id", "at", "n", "off", "bytes"])
                yield from (made.slice(i, 4096) for i in range(0, made.num_rows, 4096))

    return rows.mapInArrow(run, schema)


def repeated_suffixes(bucket: np.ndarray, off: np.ndarray, count: np.ndarray, spans: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, suffix of the block, repeated) for all suffixes of the blocks: which have an equal to depth n elsewhere in
    their bucket. Equal suffixes stand at equal distance from their gram, so that distance is a digit too."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    base = np.cumsum([0, *map(len, spans)])[:-1]
    block = np.repeat(np.arange(len(spans)), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    start = base[block] + nth
    values = tokens._BYTE_VALUES[0][data]
    power, inverse = tokens._powers(0, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])

    def split(live: np.ndarray, group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes not alone in their (group, digit), in order, and their new groups."""
        order = np.argsort(tokens.mix(group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ digit)
        live, group, digit = live[order], group[order], digit[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        numbers = np.cumsum(new) - 1
        several = np.bincount(numbers)[numbers] > 1 if len(live) else new
        return live[several], numbers[several]

    live, group = split(np.arange(len(block)), np.unique(bucket, return_inverse=True)[1][block], (off[block] - nth).astype(np.uint64))
    for depth in range(0, n, DIGIT):
        a, b = start[live] + depth, start[live] + min(depth + DIGIT, n)
        live, group = split(live, group, tokens.mix((sums[b] - sums[a]) * inverse[a]))
    repeated = np.zeros(len(block), bool)
    repeated[live] = True
    same = np.flatnonzero(group[1:] == group[:-1])
    for depth in range(0, n, 8):  # verify neighbours; the last eight bytes may overlap the ones before
        step = min(depth, n - 8) if n >= 8 else depth
        wide = np.ndarray((max(len(data) - 7, 0),), np.dtype(">u8"), data, 0, (1,)) if n >= 8 else data
        if not (wide[start[live[same]] + step] == wide[start[live[same + 1]] + step]).all():
            return block, nth, _by_bytes(bucket, off, block, nth, spans, n)
    return block, nth, repeated


def _by_bytes(bucket: np.ndarray, off: np.ndarray, block: np.ndarray, nth: np.ndarray, spans: list[bytes], n: int) -> np.ndarray:
    """The same by the strings themselves, should two digits ever share a hash."""
    names = [(bucket[b], spans[b][i : i + n]) for b, i in zip(block.tolist(), nth.tolist(), strict=True)]
    seen: dict[tuple, int] = {}
    for name in names:
        seen[name] = seen.get(name, 0) + 1
    return np.array([seen[name] > 1 for name in names], bool)


def _ordered(rows: DataFrame, n: int) -> DataFrame:
    """(id, a, b): ranges of repeated suffixes of the blocks that occur once, whole buckets dealt to tasks."""

    def ranges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        bucket, off, count, at, again, ids = (own.column(c).to_numpy() for c in ("p", "off", "n", "at", "again", "id"))
        block, nth, repeated = repeated_suffixes(bucket, off, count, own.column("bytes").to_pylist(), n)
        picked = np.flatnonzero(repeated & ~again[block])
        block, nth = block[picked], nth[picked]
        new = np.ones(len(picked), bool)
        new[1:] = (block[1:] != block[:-1]) | (nth[1:] != nth[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(picked)) - 1
        first = at[block[head]] + nth[head]
        return pa.RecordBatch.from_arrays([pa.array(ids[block[head]]), pa.array(first.astype(np.int32)), pa.array((first + (tail - head) + 1).astype(np.int32))], names=["id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            p = batch.column("p").to_numpy()
            if size > _SUFFIXES:  # hand over all whole buckets
                before = held[-1].column("p")[-1].as_py()
                end = int(np.searchsorted(p != before, True)) if (p != before).any() else len(p)
                if end:
                    held.append(batch.slice(0, end))
                if end < len(p):
                    yield ranges(held)
                    held, size, batch = [], 0, batch.slice(end)
                else:
                    continue
            held.append(batch)
            size += int(batch.column("n").to_numpy().sum())
        if held:
            yield ranges(held)

    return rows.repartition("p").sortWithinPartitions("p").mapInArrow(run, "id long, a int, b int")


def _sub_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Blocks as runs of ``RUN`` suffixes, by their distance to the gram: where they stand, and 128 bits of their bytes."""
    schema = "p long, q int, g1 long, g2 long, id long, at int, a int, b int, again boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            spans = batch.column("bytes").to_pylist()
            data = np.frombuffer(b"".join(spans), np.uint8)
            base = np.cumsum([0, *map(len, spans)])[:-1]
            off, count, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("off", "n", "at"))
            block = np.repeat(np.arange(len(spans)), count)
            nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
            q = (off[block] - nth) // RUN
            new = np.ones(len(block), bool)
            new[1:] = (block[1:] != block[:-1]) | (q[1:] != q[:-1])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(block)))
            block, nth, q = block[head], nth[head], q[head]
            g1, g2 = span_digests(data, base[block] + nth, length - 1 + n)
            first = (at[block] + nth).astype(np.int32)
            take = pa.array(block)
            same = [batch.column(c).take(take) for c in ("p", "id", "at", "again")]
            made = pa.RecordBatch.from_arrays([same[0], pa.array(q.astype(np.int32)), pa.array(g1), pa.array(g2), same[1], same[2], pa.array(first), pa.array(first + length.astype(np.int32)), same[3]], names=["p", "q", "g1", "g2", "id", "at", "a", "b", "again"])
            yield from (made.slice(i, 1 << 16) for i in range(0, made.num_rows, 1 << 16))

    return rows.mapInArrow(run, schema)


def _single(rows: DataFrame, n: int) -> DataFrame:
    """The suffixes of the chosen runs of blocks, with 128 bits of all n bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            spans = batch.column("bytes").to_pylist()
            data = np.frombuffer(b"".join(spans), np.uint8)
            base = np.cumsum([0, *map(len, spans)])[:-1]
            off, count, at = (batch.column(c).to_numpy().astype(np.int64) for c in ("off", "n", "at"))
            runs = batch.column("runs")
            of = np.repeat(np.arange(len(spans)), np.asarray(runs.value_lengths()))
            q, again = (runs.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("q", "again"))
            first = np.maximum(off[of] - q * RUN - RUN + 1, 0)  # a run's suffixes have distances from q * RUN on
            last = np.minimum(off[of] - q * RUN, count[of] - 1)
            length = last - first + 1
            which = np.repeat(np.arange(len(of)), length)
            nth = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)
            block = of[which]
            g1, g2 = (_hashes(tokens._BYTE_VALUES[f][data], n, f)[base[block] + nth].view(np.int64) for f in (0, 1))
            made = pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(block)), pa.array((at[block] + nth).astype(np.int32)), pa.array(again[which].astype(bool)), pa.array(g1), pa.array(g2)], names=["id", "a", "again", "g1", "g2"])
            yield from (made.slice(i, 1 << 16) for i in range(0, made.num_rows, 1 << 16))

    return rows.mapInArrow(run, "id long, a int, again boolean, g1 long, g2 long")


def _counted(rows: DataFrame, n: int) -> DataFrame:
    """(id, a, b): ranges of repeated suffixes of the blocks that occur once, of grams with very many kinds of blocks. The
    blocks are cut into runs, whose bytes are a digit as the blocks' were; of runs with several kinds, one of every kind
    is counted suffix by suffix."""
    names = ["p", "q", "g1", "g2"]
    runs = materialize(_sub_blocks(rows, n), "suffix-runs")
    kinds = materialize(runs.groupBy(*names).agg(((F.count(F.lit(1)) > 1) | F.max("again")).alias("again"), F.min(F.struct("id", "at")).alias("ref")), "suffix-run-kinds")
    crowded = materialize(kinds.groupBy("p", "q").agg(F.count(F.lit(1)).alias("k"), F.min("again").alias("all")).filter("k > 1 and not all").select("p", "q"), "suffix-run-crowded")
    whole = runs.filter("not again").join(kinds.filter("again").select(*names), names, "left_semi").select("id", "a", "b")
    refs = kinds.join(crowded, ["p", "q"]).select("ref.id", "ref.at", F.struct("q", "again").alias("r")).groupBy("id", "at").agg(F.collect_list("r").alias("runs"))
    each = materialize(_single(rows.drop("again").join(materialize(refs, "suffix-run-refs"), ["id", "at"]), n), "suffix-single")
    groups = each.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
    groups = materialize(groups.filter("n > 1 or again").select("g1", "g2"), "suffix-single-groups")
    alone = each.filter("not again").join(groups, ["g1", "g2"], "left_semi").select("id", "a", (F.col("a") + 1).alias("b"))
    return whole.unionByName(alone)


def _removed(rows: DataFrame, n: int) -> DataFrame:
    """(id, n_removed, n_spans, kept_sha256, kept) of texts and the ranges of their repeated suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for value, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges"), strict=True):
                data = value.encode("utf-8")
                a, b = (ranges.values.field(c).to_numpy().astype(np.int64) for c in ("a", "b"))
                order = np.argsort(a)
                a, ends = a[order], np.maximum.accumulate(b[order] + n - 1)
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > ends[:-1]  # runs that touch are one
                head = np.flatnonzero(new)
                first, last = a[head], ends[np.append(head[1:], len(a)) - 1]
                left = b"".join(data[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(data)], strict=True))
                removed.append(len(data) - len(left))
                spans.append(len(head))
                digests.append(hashlib.sha256(left).digest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], names=["id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "id long, n_removed long, n_spans long, kept_sha256 binary, kept binary")


def deduplicate(docs: DataFrame, n: int = 200, key: str = "doc_id", text: str = "text", with_text: bool = False, gram: int = GRAM, piece: int = PIECE, bucket: int = BUCKET) -> DataFrame:
    """Per row: key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and, if asked,
    ``kept`` (the bytes left; null if nothing was removed). The sizes change costs, not results."""
    spark = docs.sparkSession
    rows = told_apart(materialize(sketch(docs, n, key, text, gram, piece), "suffix-sketch"))

    # the first digit
    prints = rows.select("id", F.explode("prints").alias("p")).select("id", "p.print", "p.multi")
    recurring = prints.groupBy("print").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("multi").alias("multi")).filter("multi or low <> high").select("print")
    recurring = materialize(recurring, "suffix-first")
    contents = rows.groupBy("id", "c", "c2").agg(F.min(_row_key(key)).alias("k"), (F.count(F.lit(1)) > 1).alias("copied"))
    flagged = prints.select("id", "print").join(recurring, "print", "left_semi").groupBy("id").agg(F.collect_set("print").alias("recurring"))
    flagged = materialize(contents.join(flagged, "id"), "suffix-flagged")
    release(spark)
    texts = materialize(_with_blocks(docs, flagged, n, key, text, gram, piece), "suffix-texts")
    discard(recurring, flagged)
    release(spark)

    # the second: whole blocks
    names = ["at", "n", "off", "p", "s1", "s2"]
    each = texts.select("id", "copied", F.explode(F.arrays_zip(*names)).alias("w")).select("id", "copied", *[F.col(f"w.{c}").alias(c) for c in names])
    kinds = each.groupBy("p", "s1", "s2").agg(((F.count(F.lit(1)) > 1) | F.max("copied")).alias("again"), F.min(F.struct("id", "at", "n", "off")).alias("ref"))
    kinds = materialize(kinds, "suffix-kinds")
    crowded = materialize(kinds.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.min("again").alias("all")).filter("k > 1 and not all").select("p", "k"), "suffix-crowded")
    whole = each.filter("not copied").join(kinds.filter("again").select("p", "s1", "s2"), ["p", "s1", "s2"], "left_semi")
    whole = materialize(whole.select("id", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")), "suffix-whole")
    release(spark)

    # the rest, digit by digit
    refs = kinds.join(crowded, "p").select("ref.id", F.struct("p", "k", "again", "ref.at", "ref.n", "ref.off").alias("r")).groupBy("id").agg(F.collect_list("r").alias("refs"))
    refs = materialize(refs, "suffix-refs")
    cut = materialize(_cut_out(texts.select("id", "text").join(refs.hint("shuffle_hash"), "id"), n), "suffix-blocks")
    discard(kinds, crowded, refs)
    release(spark)
    some = materialize(_ordered(cut.filter(F.col("k") <= bucket), n).unionByName(_counted(cut.filter(F.col("k") > bucket), n)), "suffix-some")
    discard(cut)
    release(spark)

    ranges = whole.unionByName(some).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    gone = _removed(texts.filter("not copied").select("id", "text").join(materialize(ranges, "suffix-ranges").hint("shuffle_hash"), "id"), n)
    gone = materialize(gone if with_text else gone.drop("kept"), "suffix-removed")
    copied = contents.filter("copied").select("id", F.lit(True).alias("copied"))
    out = rows.drop("prints").join(copied, "id", "left").join(gone, "id", "left")
    all_ = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= n)
    found = {
        "n_removed": F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"),
        "n_spans": F.when(all_, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long"),
        "kept_sha256": F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha256", "all_sha256")))),
    }
    if with_text:
        found["kept"] = F.when(all_, F.lit(b"")).otherwise(F.col("kept"))
    return out.select(key, "n_bytes", *[v.alias(k) for k, v in found.items()])
