"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Vectors are assigned to the cell of their nearest centroid on the unit sphere. A vector is also shown to every cell that
can hold a partner: if y belongs to cell d and x to cell c, then x lies within the angle of the threshold of the half
sphere nearer to d than to c, so x.c - x.d <= sin(angle) * |c - d|. No linked pair is missed by that rule, and cells
beyond it are never compared. Within a cell, rows meet in blocks of bounded size, as matrix products in double
precision; of a block's links only counts per row and a spanning forest leave it, never the pairs.

Equal vectors, told by a 128-bit key, are one class with a weight, so copies cost nothing. Components come from the
forests' links.

Centroids are fitted on bounded samples (about ``SAMPLE`` vectors), at most ``MAX_CELLS`` of them, which are broadcast. A
cell with more than ``SPLIT`` times ``CELL_ROWS`` vectors is divided again, by centroids of a sample of its own vectors,
under the same rule; these centroids travel with their cell's rows and are never gathered. So the number of cells follows
the number of vectors, up to MAX_CELLS squared. How much the cells prune depends on the data: vectors without any cluster
structure are near to no centroid, and then all cells are visited.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths don't link. Repeated rows are vectors of their own (and linked), also those of one id with unlike
vectors. A component is named by its least id that isn't null; rows with null ids are linked as others are, and kept if
their component has no name. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialize, release, told_apart
from rivulet.llm.components import components, joined

#: Vectors that the centroids are fitted on, at most about.
SAMPLE = 16_384
#: Vectors of a cell, about; cells of one division at most; how many times CELL_ROWS a cell holds before it is divided.
CELL_ROWS = 8192
MAX_CELLS = 1024
SPLIT = 8
#: Rows of one cell that go to a task to be divided, about.
_SPLIT_ROWS = 500_000
#: Rows of a block; a product holds two blocks, and similarities for ``STRIPE`` rows at a time.
BLOCK_ROWS = 8192
STRIPE = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; starts from evenly spaced rows, so the same rows give the same centroids."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        norms = np.sqrt((sums * sums).sum(axis=1))
        full = norms > 1e-12
        centroids = centroids.copy()
        centroids[full] = sums[full] / norms[full][:, None]
    return centroids


def visits(vectors: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of every unit vector, and which other cells can hold vectors of that cosine or more with it."""
    dots = vectors @ centroids.T
    home = np.argmax(dots, axis=1)
    own = dots[np.arange(len(vectors)), home]
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else 2.0
    seen = own[:, None] - dots <= reach * gaps[home] + 1e-9
    seen[np.arange(len(vectors)), home] = False
    return home, seen


def _classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the id of their content or null, one row per distinct valid vector)."""
    x = F.col("x")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(x, lambda e: e != 0)
    x = F.transform(x, lambda e: e + F.lit(0.0))  # minus zero is zero
    rows = told_apart(rows.withColumn("c", F.when(sound, F.xxhash64(x))).withColumn("c2", F.when(sound, F.xxhash64(F.lit("second"), x))))
    distinct = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x"))
    return rows.select("vec_id", "id"), distinct


def _fitted(sample: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, x): the centroids of each group of a sample (keys, k, id, x)."""
    schema = f"{', '.join(f'{c} int' for c in keys)}, n int, x array<double>"

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)[order]
        found = spherical_kmeans(unit(scaled(x)), min(table.column("k")[0].as_py(), len(x)))
        group = [pa.array(np.full(len(found), table.column(c)[0].as_py(), np.int32)) for c in keys]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
        return pa.table([*group, pa.array(np.arange(len(found), dtype=np.int32)), lists], names=[*keys, "n", "x"])

    return sample.groupBy(*keys).applyInArrow(run, schema)


def _share(size: Column, sample: int) -> Column:
    """Whether a row is in the sample of about that many of its group's ``size`` rows."""
    modulus = 1_000_003
    return F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(modulus)) <= F.least(F.lit(1.0), F.lit(float(sample)) / size) * modulus


def _fit(distinct: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Centroids per vector length, for lengths with vectors for more than one cell."""
    rows = distinct.withColumn("length", F.size("x"))
    sizes = rows.groupBy("length").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CELL_ROWS)
    sizes = sizes.withColumn("k", F.least(F.lit(MAX_CELLS), F.ceil(F.col("size") / CELL_ROWS)).cast("int"))
    picked = rows.join(materialize(sizes, "vector-lengths"), "length").filter(_share(F.col("size"), sample))
    found: dict[int, list] = {}
    for r in _fitted(picked.select("length", "k", "id", "x"), ["length"]).orderBy("length", "n").toLocalIterator():
        found.setdefault(r["length"], []).append(r["x"])
    return {length: np.array(own) for length, own in found.items()}


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by the largest component, so that squares neither overflow nor vanish."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


_SHOWN = "length int, cell int, sub int, home boolean, id long, weight long, x array<double>"


def _show(classes: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            lengths = np.asarray(lists.value_lengths())
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(rows))
                flat = part.column("x").flatten().to_numpy().reshape(len(rows), int(length))
                x = unit(scaled(flat))
                own = shared.value.get(int(length))
                if own is None:
                    home, at, cell = np.zeros(len(rows), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    home, seen = visits(x, own, threshold)
                    at, cell = np.nonzero(np.triu(np.ones((len(own),) * 2, bool), 1)[home] & seen)  # a pair meets once
                index = np.concatenate([np.arange(len(rows)), at])
                cells = np.concatenate([home, cell]).astype(np.int32)
                yield from _placed(part, x, int(length), cells, np.zeros(len(cells), np.int32), np.arange(len(index)) < len(rows), index)

    return classes.select("id", "weight", "x").mapInArrow(run, _SHOWN)


def _placed(part: pa.RecordBatch, x: np.ndarray, length: int, cells: np.ndarray, subs: np.ndarray, home: np.ndarray, index: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SHOWN`` for the rows of ``part`` at ``index``, in batches of bounded size."""
    for start in range(0, len(index), 4096):
        i = index[start : start + 4096]
        end = start + len(i)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * length, pa.int32()), pa.array(x[i].ravel()))
        taken = part.take(pa.array(i))
        columns = [np.full(len(i), length, np.int32), cells[start:end].astype(np.int32), subs[start:end].astype(np.int32), home[start:end]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), taken.column("id"), taken.column("weight"), values], names=["length", "cell", "sub", "home", "id", "weight", "x"])


def _divided(shown: DataFrame, threshold: float, sample: int) -> DataFrame:
    """The rows of large cells dealt over the cells of their own division (``sub``); those of others as they are."""
    sizes = shown.filter("home").groupBy("length", "cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > SPLIT * CELL_ROWS)
    sizes = sizes.withColumns({"k": F.least(F.lit(MAX_CELLS), F.ceil(F.col("size") / CELL_ROWS)).cast("int"), "salts": F.ceil(F.col("size") / _SPLIT_ROWS).cast("int")})
    sizes = materialize(sizes, "vector-large-cells")
    if sizes.isEmpty():
        return shown
    cell = ["length", "cell"]
    large = shown.join(sizes, cell)
    picked = large.filter("home").filter(_share(F.col("size"), sample)).select(*cell, "k", "id", "x")
    centroids = materialize(_fitted(picked, cell), "vector-centroids").join(sizes, cell)
    centroids = centroids.select(*cell, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("data"), "n", F.lit(False).alias("home"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("weight"), "x")
    rows = large.select(*cell, F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("data"), F.lit(0).alias("n"), "home", "id", "weight", "x")
    # a cell's centroids come before its rows in each of its parts
    dealt = centroids.unionByName(rows).repartition(*cell, "salt").sortWithinPartitions(*cell, "salt", "data", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, own = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*cell, "salt")] + [batch.column("data").to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1):
                if len(rows) == 0:
                    continue
                part = batch.slice(int(rows[0]), len(rows))
                length, number, _, data = keys[rows[0]].tolist()
                x = part.column("x").flatten().to_numpy().reshape(len(rows), length)
                if tuple(keys[rows[0]][:3]) != group:
                    group, held, own = tuple(keys[rows[0]][:3]), [], None
                if not data:
                    held.append(x)
                    continue
                own = np.concatenate(held) if own is None else own
                nearest, seen = visits(x, own, threshold)
                at_home = np.asarray(part.column("home").to_numpy(zero_copy_only=False), bool)
                # rows at home in the cell meet once, in the later one of their divisions; visitors meet all that can hold a partner
                later = np.triu(np.ones((len(own),) * 2, bool), 1)[nearest] & seen
                i, sub = np.nonzero(np.where(at_home[:, None], later, seen))
                index = np.concatenate([np.arange(len(rows)), i])
                subs = np.concatenate([nearest, sub])
                home = np.concatenate([at_home, np.zeros(len(i), bool)])
                yield from _placed(part, x, length, np.full(len(index), number), subs, home, index)

    others = shown.join(sizes.select(*cell), cell, "left_anti").select(*shown.columns)
    return others.unionByName(dealt.mapInArrow(run, _SHOWN))


def compare(reps: np.ndarray, weights: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights linked to each row, spanning labels) over the pairs of rows left x right, or within left if right is it."""
    links, labels = np.zeros(len(reps), np.int64), np.arange(len(reps))
    same = left is right
    for start in range(0, len(left), STRIPE):
        rows = left[start : start + STRIPE]
        columns = right[start:] if same else right
        near = x[rows] @ x[columns].T >= threshold
        if same:
            near &= np.arange(len(columns))[None, :] > np.arange(len(rows))[:, None]
        if not near.any():
            continue
        u, v = np.nonzero(near)
        u, v = rows[u], columns[v]
        np.add.at(links, u, weights[v])
        np.add.at(links, v, weights[u])
        labels = joined(labels, u, v)
    return links, labels


def _blocks(shown: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(id, links, root) rows: partial counts, and the root of the id in a block's forest."""
    cell = ["length", "cell", "sub"]
    sizes = shown.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("h"), F.sum((~F.col("home")).cast("int")).alias("v"))
    sizes = sizes.select(*cell, F.greatest(F.lit(1), F.ceil(F.col("h") / block_rows)).cast("int").alias("nh"), F.ceil(F.col("v") / block_rows).cast("int").alias("nv"))
    rows = shown.join(materialize(sizes, "vector-cell-sizes"), cell)
    own = F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("nh"))).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.greatest("nv", F.lit(1)))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    among = F.transform(upto(F.col("nh")), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    across = F.transform(upto(F.col("nv")), lambda j: F.struct(F.col("own").alias("i"), (-1 - j).alias("j")))
    meets = F.when(F.col("home"), F.concat(among, across)).otherwise(F.transform(upto(F.col("nh")), lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j"))))
    tasks = rows.withColumn("m", F.explode(meets)).select(*cell, F.col("m.i").alias("i"), F.col("m.j").alias("j"), "own", "home", "id", "weight", "x")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, length = table.num_rows, table.column("length")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(n, length)
        own, home = table.column("own").to_numpy(), np.asarray(table.column("home").to_numpy(zero_copy_only=False), bool)
        left = np.flatnonzero(home & (own == i))
        right = left if i == j else np.flatnonzero(~home) if j < 0 else np.flatnonzero(home & (own == j))
        links, labels = compare(ids, weights, x, left, right, threshold)
        some = np.flatnonzero(links > 0)
        return pa.table({"id": ids[some], "links": links[some], "root": ids[labels[some]]})

    return tasks.groupBy(*cell, "i", "j").applyInArrow(run, "id long, links long, root long")


def deduplicate(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, block_rows: int | None = None) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept`` (it stands for its component)."""
    rows, distinct = _classes(vectors, key, column)
    rows, distinct = materialize(rows, "vector-rows"), materialize(distinct, "vector-classes")
    shown = materialize(_show(distinct, _fit(distinct, sample), threshold), "vector-cells")
    found = materialize(_blocks(_divided(shown, threshold, sample), threshold, block_rows or BLOCK_ROWS), "vector-links")
    release(vectors.sparkSession)
    of_class = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = distinct.drop("x").join(links, "id", "left").join(of_class, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = classes.groupBy("component").agg(F.min("least").alias("name"))
    classes = classes.join(names, "component").select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "name", F.lit(True).alias("named"))
    out = rows.join(classes, "id", "left")
    component = F.when(F.col("named"), F.col("name")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
