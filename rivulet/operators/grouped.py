"""Functions over the column arrays of one group: rows are dealt by key and sorted by Spark, and handed over group by group.

A group (a shot, a track list, a job) is held by one task as numpy arrays, so this is for rules that need a whole group and
for groups that a task can hold; rows are never turned into Python objects here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of results that are sent on at once, about.
_BATCH = 16_384


def per_group(rows: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[dict[str, np.ndarray]], dict[str, object]], schema: str) -> DataFrame:
    """Apply ``step`` to the columns of every group, in order: it returns columns of equal length, whatever that is. The
    result has the keys and the columns of ``schema`` (DDL, without the keys)."""
    out_schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(schema)])
    made = to_arrow_schema(out_schema)
    names = made.names[len(keys) :]

    def result(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(parts).combine_chunks()
        found = step({c: table.column(c).to_numpy() for c in table.column_names if c not in keys})
        n = len(found[names[0]])
        if n == 0:
            return None
        key = [pa.repeat(table.column(k)[0], n).cast(made.field(k).type) for k in keys]
        value = [pa.array(found[c], made.field(c).type, from_pandas=True) for c in names]
        return pa.RecordBatch.from_arrays([*key, *value], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        ready: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = now is not None and first != now
            starts = np.flatnonzero(new)
            for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if a in starts and held:
                    if (one := result(held)) is not None:
                        ready.append(one)
                        size += one.num_rows
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            now = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
            if size >= _BATCH:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches(_BATCH)
                ready, size = [], 0
        if held and (one := result(held)) is not None:
            ready.append(one)
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches(_BATCH)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)
