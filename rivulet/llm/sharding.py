"""Sharding by minimax contiguous partition.

Rows with equal texts form an atomic group. Groups lie in a fixed order (by a 64-bit hash of the text), and the smallest
capacity for which a greedy left-to-right cut needs at most ``shards`` shards is found by binary search; the order is
then cut there. Law ``bytes``: shard sizes are as near equal as that order and the groups allow.

The group sizes never meet on one machine. The driver sees prefix sums at a bounded number of block boundaries of the
hash order; groups larger than a block are boundaries of their own. Only the blocks in which a cut can still fall are
then read again at a finer resolution, until the cuts lie between single groups. A group larger than the mean load of
what is left takes a shard of its own, as it alone decides the capacity; the rest is cut among the other shards.

Defined results: a null text has no bytes (size 1, checksum of the empty text) and forms one group with the empty text.
Repeated rows are each placed. A very long text counts with all its bytes and is only measured and hashed, never moved. An
empty table gives an empty result. Extra columns are kept, but for those with the
names of the new columns, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialize

#: Blocks of one resolution; what the driver sees of the group sizes is a few times as many rows.
BLOCKS = 4096
#: Rows of a slot bucket, about; one task numbers a few buckets.
SLOT_ROWS = 50_000
_BITS = 12


@dataclass(frozen=True)
class Piece:
    """Consecutive groups, keys ``first`` to ``last``, of ``size`` together; ``one`` if it is a single group."""

    first: int
    last: int
    size: int
    one: bool


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of the shards that a left-to-right cut fills up to ``capacity``; None if they don't suffice."""
    ends, load = [], 0
    for at, size in enumerate(sizes):
        if size > capacity:
            return None
        if load + size > capacity:
            ends.append(at)
            load = 0
        load += size
    ends.append(len(sizes))
    return ends if len(ends) <= shards else None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """By binary search; the greedy check decides feasibility."""
    low, high = max([0, max(sizes, default=0), -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _pieces(groups: DataFrame, heavy: list[tuple[int, int]], shift: int, spans: list[tuple[int, int]] | None) -> list[Piece]:
    """Sums of the groups by block of 2**shift keys, split at heavy groups; of the blocks within ``spans`` if given."""
    rows = groups
    if spans is not None:
        inside = F.lit(False)
        for first, last in spans:
            inside = inside | F.col("h").between(F.lit(first), F.lit(last))
        rows = rows.filter(inside)
    keys = sorted(k for k, _ in heavy)
    alone, after = F.lit(False), F.lit(0)
    if keys:
        held = F.array(*[F.lit(k).cast("long") for k in keys])
        alone = F.array_contains(held, F.col("h"))
        after = F.size(F.filter(held, lambda k: k < F.col("h")))
    found = rows.groupBy(F.shiftright("h", shift).alias("block"), alone.alias("one"), after.alias("after")).agg(F.min("h").alias("first"), F.max("h").alias("last"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((Piece(r["first"], r["last"], int(r["size"]), r["n"] == 1) for r in found), key=lambda p: p.first)


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(first keys of the shards after the first, keys of groups with a shard of their own) for groups (h, size)."""
    total = groups.agg(F.sum("size").alias("s")).first()["s"] or 0
    floor = max(1, int(total) // BLOCKS)
    heavy = [(r["h"], int(r["size"])) for r in groups.filter(F.col("size") > F.lit(floor)).collect()]  # fewer than BLOCKS
    own, rest, left = [], int(total), shards
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        if left > 1 and size * left >= rest:
            own.append(key)
            rest, left = rest - size, left - 1
    groups = groups.filter(~F.col("h").isin(own)) if own else groups
    heavy = [x for x in heavy if x[0] not in set(own)]
    shift = 64 - _BITS
    pieces = _pieces(groups, heavy, shift, None)
    while True:
        sizes = [p.size for p in pieces]
        capacity = smallest_capacity(sizes, left)
        ends = greedy(sizes, capacity, left) or [len(sizes)]
        # a cut of any feasible capacity up to this one lies here
        open_pieces, start = set(), 0
        for i, p in enumerate(pieces):
            end = start + p.size
            if not p.one and any(start < k * capacity and end > rest - (left - k) * capacity for k in range(1, left)):
                open_pieces.add(i)
            start = end
        if not open_pieces or capacity <= max([-(-rest // left), *(p.size for p in pieces if p.one)]) or shift == 0:
            return [pieces[e].first for e in ends[:-1]], own
        shift = max(0, shift - _BITS // 2 if len(open_pieces) > 64 else shift - _BITS)
        spans: list[list[int]] = []
        for i in sorted(open_pieces):
            if spans and i - 1 in open_pieces:
                spans[-1][1] = pieces[i].last
            else:
                spans.append([pieces[i].first, pieces[i].last])
        finer = _pieces(groups, [x for x in heavy if any(a <= x[0] <= b for a, b in spans)], shift, [tuple(s) for s in spans])
        pieces = sorted([p for i, p in enumerate(pieces) if i not in open_pieces] + finer, key=lambda p: p.first)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard) to every row, less the text.

    One narrow copy of the rows (no text) is written to the shared scratch folder; the group sizes are summed map-side
    first, so a text with very many copies is one row per task in the shuffle. Slots are numbered within buckets of rows
    hashed by key, so a large group spreads over buckets.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    new = ("size", "text_crc32", "shard", "slot")
    rows = docs.withColumns({"__size": F.octet_length(value).cast("long") + 1, "__crc": F.crc32(value.cast("binary")), "__h": F.xxhash64(value)}).drop(text, *new)
    rows = materialize(rows.withColumnsRenamed({"__size": "size", "__crc": "text_crc32"}), "shard-rows")
    groups = rows.groupBy(F.col("__h").alias("h")).agg(F.sum("size").alias("size"))
    groups = materialize(groups, "shard-groups")
    cuts, own = cut_keys(groups, shards)
    return _numbered(rows, _shard_column(cuts, own), key).drop("__h", "__bucket")


def _shard_column(cuts: list[int], own: list[int]) -> Column:
    """The number of cuts at or before the key; shards of single groups come after the others."""
    found = F.lit(0)
    for cut in cuts:
        found = found + (F.col("__h") >= F.lit(cut)).cast("int")
    for i, key in enumerate(own):
        found = F.when(F.col("__h") == F.lit(key), F.lit(len(cuts) + 1 + i)).otherwise(found)
    return found.cast("int")


def _numbered(rows: DataFrame, number: Column, key: str) -> DataFrame:
    n = rows.count()
    buckets = max(64, -(-n // SLOT_ROWS))
    rows = rows.withColumns({"shard": number, "__bucket": F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(buckets)).cast("int")})
    counts = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy("shard", "__bucket").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "__h")
    placed = rows.withColumn("__rank", F.row_number().over(within) - 1).join(offsets, ["shard", "__bucket"])
    return placed.withColumn("slot", (F.col("__offset") + F.col("__rank")).cast("long")).drop("__offset", "__rank")
