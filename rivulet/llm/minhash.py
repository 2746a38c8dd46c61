"""Near-duplicate documents by BagMinHash signatures.

A document is the multiset of its runs of ``SHINGLE`` normalised words (all its words if it has fewer; its raw text if it
has none); two documents link if the sum of minima over the sum of maxima of their counts reaches the threshold.

A signature has ``REGISTERS`` registers. Every shingle of weight w feeds them with a Poisson process over the discretised
weights [0, w): the weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on, each with a process of its own whose
rate is its length; a process over a longer interval is split in halves hierarchically, the half with the arrival keeping
its time and the other going on from there, and halves beyond w or later than all registers are dropped. A register
keeps its earliest arrival. Two documents agree in a register with the probability of their weighted Jaccard similarity.

Documents that agree in all ``ROWS`` registers of one of ``BANDS`` bands are candidates (at a similarity of 0.8 one pair
in 400 million is missed). Copies of a text, told by a 128-bit key, are one node. Candidates are verified on their whole
multisets, in two steps:

1. every node of a band's group is compared with one of them, the group's least. What links is joined to classes, which
   settles groups of near copies;
2. in groups that still hold several classes, the nodes outside the commonest class are compared with all nodes of
   other classes, as products of incidence matrices over blocks of bounded size. Groups of equal members in several
   bands are compared once. Of a block's links only a spanning forest leaves it, never the pairs. A large group is dealt
   over many tasks, block pair by block pair; small ones share tasks.

Defined results: null and empty texts link with nothing, each row is kept as a class of its own. A class is named by its
least document id. Rows repeated with equal id and text are copies. Null ids form classes like others; a class of null ids
alone has a null name. A very long text is worked on whole, alone. An empty table gives an empty result. Extra columns are
left out by ``classes`` and kept by ``deduplicate``; names beginning with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens
from rivulet.llm.common import content_keys, materialize, slices, text_bytes, text_or_empty, told_apart
from rivulet.llm.components import components, joined

SHINGLE = 5
BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
#: Bounds of a block: nodes, and shingles of all of them.
BLOCK_NODES, BLOCK_SHINGLES = 512, 250_000
#: Columns of an incidence matrix at a time.
STRIPE = 4096
_STEP_BYTES = 1 << 20


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets per row), sorted within each row."""
    words = tokens.Words(tokens.LOWER[data], at, tokens.NORMAL)
    hashes = words.hashes()
    starts = words.windows(k)
    found, owner = [tokens.window_hashes(hashes, starts, k)], [words.row[starts]]
    for n in range(1, k):
        short = np.flatnonzero(words.count == n)
        found.append(tokens.window_hashes(hashes, words.first[short], n))
        owner.append(short)
    bare = np.flatnonzero((words.count == 0) & (np.diff(at) > 0))
    if len(bare):
        whole = tokens._runs(tokens._BYTE_VALUES[1][data], at[:-1][bare], at[1:][bare], 1)
        found.append(tokens.mix(whole + np.diff(at)[bare].astype(np.uint64)))
        owner.append(bare)
    every, row = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(row, kind="stable")
    every, row = every[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(at)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            every[a:b].sort()
    return every, bounds


def _uniform(h: np.ndarray, node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64 random bits that depend on the shingle, the interval and the arrival's number only."""
    return tokens.mix(h ^ tokens.mix(node * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))


def _waiting(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(hashes: np.ndarray, weights: np.ndarray, row: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (rows x registers) of the weighted shingles; a row without any has infinite registers."""
    held = np.full((n_rows, registers), np.inf)
    flat = held.reshape(-1)
    # one node per shingle and dyadic interval that begins below its weight: [0, 1), then [2**i, 2**(i + 1))
    h, r, w = [hashes], [row], [weights]
    low, size = [np.zeros(len(hashes), np.int64)], [np.ones(len(hashes), np.int64)]
    begin, more = 1, np.flatnonzero(weights > 1)
    while len(more):
        h.append(hashes[more])
        r.append(row[more])
        w.append(weights[more])
        low.append(np.full(len(more), begin, np.int64))
        size.append(np.full(len(more), begin, np.int64))
        begin *= 2
        more = more[weights[more] > begin]
    h, r, w, low, size = (np.concatenate(x) for x in (h, r, w, low, size))
    node = (low.astype(np.uint64) << np.uint64(1)) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    count = np.zeros(len(h), np.int64)
    t = _waiting(_uniform(h, node, count)) / (size * registers)
    while len(h):
        limit = held.max(axis=1)
        on = t <= limit[r]
        h, r, w, low, size, node, count, t = (x[on] for x in (h, r, w, low, size, node, count, t))
        leaf = size == 1
        parts = []
        if leaf.any():
            lh, lr, ln, lc, lt = h[leaf], r[leaf], node[leaf], count[leaf], t[leaf]
            k = 1 if len(lh) > 50_000 else 4 if len(lh) > 5_000 else 32
            steps = np.arange(1, k + 1)
            bits = _uniform(lh[:, None], ln[:, None], lc[:, None] + steps)
            # the pending arrival and those after it, each added to the one before: the same bits for any k
            times = np.cumsum(np.concatenate([lt[:, None], _waiting(bits) / registers], axis=1), axis=1)
            where = (tokens.mix(_uniform(lh[:, None], ln[:, None], lc[:, None] + steps - 1)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(flat, (lr[:, None] * registers + where).ravel(), times[:, :-1].ravel())
            parts.append((lh, lr, w[leaf], low[leaf], size[leaf], ln, lc + k, times[:, -1]))
        if not leaf.all():
            deep = ~leaf
            dh, dr, dw, dl, dn, dt = h[deep], r[deep], w[deep], low[deep], node[deep], t[deep]
            half = size[deep] // 2
            bits = _uniform(dh, dn, np.full(len(dh), 1 << 40))
            left = (bits & np.uint64(1)) == 0
            wait = dt + _waiting(tokens.mix(bits)) / (half * registers)
            for side, has in ((0, left), (1, ~left)):
                lows = dl + side * half
                name = (lows.astype(np.uint64) << np.uint64(1)) + half.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                keep = lows < dw
                parts.append(tuple(x[keep] for x in (dh, dr, dw, lows, half, name, np.zeros(len(dh), np.int64), np.where(has, dt, wait))))
        h, r, w, low, size, node, count, t = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (h, r, w, low, size, node, count, t)
    return held


def band_keys(held: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(held).view(np.uint64).reshape(len(held), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(bits.shape[2]):
        key = tokens.mix(key ^ tokens.mix(bits[:, :, i] + np.uint64(i)))
    return key.view(np.int64)


def _counted(every: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, counts, rows, number of each occurrence among its equals)."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:] != every[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(every)))
    return every[first], counts, row[first], np.arange(len(every)) - np.repeat(first, counts)


def _sketches(rows: DataFrame, key: str, k: int) -> DataFrame:
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, c long, c2 long, some boolean, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", _STEP_BYTES):
                every, bounds = shingles(*text_bytes(part.column("__text")), k)
                distinct, counts, row, _ = _counted(every, bounds)
                keys = band_keys(signatures(distinct, counts, row, part.num_rows))
                some = np.diff(bounds) > 0
                offsets = np.concatenate([[0], np.cumsum(some)]) * BANDS
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("c"), part.column("c2"), pa.array(some), lists], names=[key, "c", "c2", "some", "bands"])

    return rows.mapInArrow(run, schema)


def _multisets(rows: DataFrame, k: int) -> DataFrame:
    """(id, m, set): shingles numbered by occurrence, so that the overlap of multisets is that of sets, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", _STEP_BYTES):
                every, bounds = shingles(*text_bytes(part.column("__text")), k)
                number = _counted(every, bounds)[3]
                numbered = np.where(number > 0, tokens.mix(every + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), every)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(numbered.view(np.int64)))], names=["id", "m", "set"])

    return rows.select("id", "__text").mapInArrow(run, "id long, m long, set array<long>")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, left x right."""
    if len(sets) == 2:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts[column] > 1
    row, column = row[often], (np.cumsum(counts > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = int((counts > 1).sum())
    for start in range(0, width, STRIPE):
        a, b = np.searchsorted(column, [start, start + STRIPE])
        held = np.zeros((len(sets), min(STRIPE, width - start)), np.float32)
        held[row[a:b], column[a:b] - start] = 1
        total += held[left] @ held[right].T
    return total.astype(np.int64)


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, label: np.ndarray | None = None) -> np.ndarray:
    """A root per set, joining all similar pairs of left x right (of unlike labels, where there are labels)."""
    both = overlaps(sets, left, right)
    size = np.array([len(x) for x in sets])
    near = both >= (threshold - 1e-12) * (size[left][:, None] + size[right][None, :] - both)
    if label is not None:
        near &= label[left][:, None] != label[right][None, :]
    u, v = np.nonzero(near)
    return joined(np.arange(len(sets)), left[u], right[v])


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose multisets are similar."""
    u = sets.select(F.col("id").alias("u"), F.col("m").alias("mu"), F.col("set").alias("su"))
    v = sets.select(F.col("id").alias("v"), F.col("m").alias("mv"), F.col("set").alias("sv"))
    able = (F.col("mu") >= F.lit(threshold) * F.col("mv") - 1e-9) & (F.col("mv") >= F.lit(threshold) * F.col("mu") - 1e-9)
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(u, "u").join(v, "v").filter(able).filter(both >= F.lit(threshold - 1e-12) * (F.col("mu") + F.col("mv") - both)).select("u", "v")


def _undecided(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, id, label, main): the members of groups of several classes, ``main`` being the commonest class. Of groups
    with equal members one is left."""
    rows = met.select("band", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = materialize(rows, "minhash-labelled")
    mixed = rows.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("y"))
    mixed = materialize(mixed.filter("a <> b").groupBy("least", "n", "x", "y").agg(F.min("band").alias("band")).select("band"), "minhash-mixed")
    rows = materialize(rows.join(mixed, "band"), "minhash-undecided")
    main = materialize(rows.groupBy("band", "label").count().groupBy("band").agg(F.max_by("label", "count").alias("main")), "minhash-main")
    return rows.join(main, "band")


def _forests(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v) links that join the similar nodes of unlike classes in each group; ``groups`` is (band, id, label, main),
    ``sets`` (id, m, set)."""
    rows = materialize(groups.join(sets.select("id", "m"), "id"), "minhash-members")
    rest = (F.col("label") != F.col("main")).cast("int")
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("s"), F.sum(rest).alias("rn"), F.sum(rest * F.col("m")).alias("rs"))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_NODES), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(sizes.select("band", "s", blocks("n", "s").alias("na"), blocks("rn", "rs").alias("nr")), "minhash-groups")
    small = sizes.filter("na = 1").agg(F.sum("s")).first()[0] or 0
    bins = max(1, -(-small // (2 * BLOCK_SHINGLES)))
    rows = rows.join(sizes.select("band", "na", "nr"), "band")
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    # in a large group every node stands on the right of each left block, and one of the rest on the left of each right block
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    right = F.transform(upto("nr"), lambda i: place(i, own("na", 3), False))
    left = F.when(F.col("label") != F.col("main"), F.transform(upto("na"), lambda j: place(own("nr", 4), j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    one = F.array(place(F.lit(0), F.lit(0), False))
    rows = rows.withColumn("p", F.explode(F.when(F.col("na") == 1, one).otherwise(F.concat(right, left))))
    rows = rows.withColumns({"large": F.col("na") > 1, "bin": F.when(F.col("na") == 1, F.pmod(F.xxhash64("band"), F.lit(bins))).otherwise(F.col("band"))})
    rows = rows.select("bin", "large", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.left").alias("left"), "band", "label", "main", "id").join(sets.select("id", "set"), "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        band, label, main, ids = (table.column(x).to_numpy() for x in ("band", "label", "main", "id"))
        is_left = np.asarray(table.column("left").to_numpy(zero_copy_only=False), bool)
        large = table.column("large")[0].as_py()
        lists = table.column("set").combine_chunks()
        flat, at = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        order = np.argsort(band, kind="stable")
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            left = np.flatnonzero(is_left[part] if large else label[part] != main[part])
            right = np.flatnonzero(~is_left[part])
            if len(left) == 0 or len(right) == 0:
                continue
            roots = forest([np.sort(flat[at[k] : at[k + 1]]) for k in part], left, right, threshold, label[part])
            moved = np.flatnonzero(roots != np.arange(len(part)))
            u.append(ids[part[moved]])
            v.append(ids[part[roots[moved]]])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return rows.groupBy("bin", "large", "i", "j").applyInArrow(run, "u long, v long")


def classes(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: key, the content keys ``c`` and ``c2``, ``class_id`` and ``kept``: of each class one row
    stays, of those with the least id one (the least content key first)."""
    rows = docs.select(F.col(key), *[v.alias(k) for k, v in content_keys(text).items()], text_or_empty(text).alias("__text"))
    every = materialize(_sketches(rows, key, shingle), "minhash")
    found, bare = told_apart(every.filter("some")), every.filter("not some")
    nodes = materialize(found.groupBy("id", "c", "c2").agg(F.min(key).alias("least"), F.first("bands").alias("bands")), "minhash-nodes")
    banded = nodes.select("id", F.explode("bands").alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("b")).filter("first <> b").select("band", "first"), "minhash-bands")
    met = materialize(banded.join(shared, "band"), "minhash-met")
    wanted = met.select("id").distinct().join(nodes.select("id", "c", "c2", "least"), "id").withColumnsRenamed({"c": "wc", "c2": "wc2"})
    same = (rows["c"] == wanted["wc"]) & (rows["c2"] == wanted["wc2"]) & rows[key].eqNullSafe(wanted["least"])
    sets = materialize(_multisets(rows.join(wanted.hint("shuffle_hash"), same), shingle).dropDuplicates(["id"]), "minhash-sets")

    stars = met.filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    near = materialize(_similar(stars, sets, threshold), "minhash-stars")
    labels = materialize(components(near).select("id", F.col("component").alias("label")), "minhash-star-classes")
    more = materialize(_forests(_undecided(met, labels), sets, threshold), "minhash-links")
    label = materialize(components(near.unionByName(more)).select("id", F.col("component").alias("label")), "minhash-classes")

    named = nodes.select("id", "c", "c2", "least").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    names = named.groupBy("label").agg(F.min(F.struct(F.col("least").isNull(), "least", "id")).alias("m")).select("label", F.col("m.least").alias("class_id"), F.col("m.id").alias("kept_id"))
    named = named.join(names, "label").select("c", "c2", "class_id", (F.col("id") == F.col("kept_id")).alias("stays"))
    kept = F.col("stays") & F.col(key).eqNullSafe(F.col("class_id"))
    grouped = every.filter("some").select(key, "c", "c2").join(named, ["c", "c2"]).select(key, "c", "c2", "class_id", kept.alias("kept"))
    return grouped.unionByName(bare.select(key, "c", "c2", F.col(key).alias("class_id"), F.lit(True).alias("kept")))


def deduplicate(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents less all but one of each class; rows without text all stay."""
    found = classes(docs.filter(text_or_empty(text) != ""), threshold, key, text, shingle)
    name = [F.col(key).alias("__k"), F.col("c").alias("__c"), F.col("c2").alias("__c2")]
    rows = docs.withColumns({"__own": content_keys(text)["c"], "__own2": content_keys(text)["c2"]})

    def meets(other: DataFrame):
        return rows[key].eqNullSafe(other["__k"]) & (rows["__own"] == other["__c"]) & (rows["__own2"] == other["__c2"])

    gone = found.filter(~F.col("kept")).select(*name).distinct()
    left = rows.join(gone, meets(gone), "left_anti")
    # of rows repeated with equal id and text one stays: they are numbered by key, a group being such repeats alone
    again = found.filter("kept").groupBy(*name).count().filter("count > 1").select("__k", "__c", "__c2", F.lit(True).alias("__again"))
    left = left.join(again, meets(again), "left").drop("__k", "__c", "__c2")
    repeats = left.filter("__again").dropDuplicates([key, "__own", "__own2"])
    return left.filter(F.col("__again").isNull()).unionByName(repeats).select(*docs.columns)
