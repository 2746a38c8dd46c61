"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut by the split pattern into pieces, and each piece is merged by rank on its own. The library's own regex
engine runs out of stack on very long runs of one character class, so long texts are first cut at *safe boundaries*,
where the pattern always ends one match and starts the next; a single piece that is itself very long goes to the
library's merge routine directly. Ids are therefore those of the library on the whole text.

Defined results: a null text counts as empty (no ids). Repeated rows each give a row. A very long text is worked on whole,
alone in its step; an empty table gives an empty result. Extra columns are kept, but for those with the names of the new
columns, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rank file holds some ten thousand short entries; anything larger than this is no vocabulary and isn't broadcast.
MAX_RANK_BYTES = 64 << 20
#: Texts (and stretches of them) of more characters than this are cut at safe boundaries first.
LONG_TEXT = 1 << 16
#: After a word of ASCII letters or digits the pattern ends a match wherever another ASCII class begins. No match looks
#: behind its start, and the one look-ahead concerns white space, which never ends a stretch cut here.
_SAFE = regex.compile(r"(?<=[A-Za-z])(?=[0-9 \t\r\n!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z \t\r\n!-/:-@\[-`{-~])")

_CODECS: dict = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 text and a number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=parse_ranks(data), special_tokens={})
        self._pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_TEXT:
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in safe_pieces(text):
            if len(piece) <= 2 * LONG_TEXT:
                ids.extend(self._encoding.encode_ordinary(piece))
            else:
                for match in self._pattern.finditer(piece):
                    ids.extend(self._encoding._core_bpe.encode_single_piece(match.group().encode("utf-8")))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)


def safe_pieces(text: str, most: int = LONG_TEXT) -> Iterator[str]:
    """Cut a text at the first safe boundary after every ``most`` characters; without one, the rest is one piece."""
    start = 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + most)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def codec(data: bytes, pattern: str) -> Codec:
    """One codec per vocabulary and Python process."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, read on the driver and bounded, so that executors need no copy of the file."""
    if "://" in path:
        row = spark.read.format("binaryFile").load(path).select("length", "content").first()
        data = bytes(row["content"])
    else:
        with open(path, "rb") as f:
            data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes: not a rank file")
    return data


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add ``ids`` (array<int>), the ids of the whole text. Row-wise: no shuffle, memory bounded by an Arrow batch."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks))
    rows = docs.drop(ids).withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    if not keep_text:
        rows = rows.drop(text)
    kept = [c for c in rows.columns if c != "__text"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            found, at = [], [0]
            for value in batch.column("__text"):
                got = coder.encode(value.as_py())
                found.append(np.asarray(got, dtype=np.int32))
                at.append(at[-1] + len(got))
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, ids])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids; null ids count as none. Bytes need not be valid UTF-8."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks))
    rows = rows.drop(data)
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(data, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            found = [coder.decode(value.as_py() or []) for value in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=kept + [data])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to every row and drop the text: encoding, decoding and
    both digests in one pass, so that neither ids nor bytes travel between the JVM and Python."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks))
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rows = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(text, *new)
    kept = [c for c in rows.columns if c != "__text"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(new[0], T.LongType(), False), *(T.StructField(c, T.StringType(), False) for c in new[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column("__text"):
                got = coder.encode(value.as_py())
                counts.append(len(got))
                encoded.append(hashlib.sha256(np.asarray(got, dtype="<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(got)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=kept + new)

    return rows.mapInArrow(run, schema)
