"""Uploads in chunks: checks, retries and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(chunks: DataFrame) -> DataFrame:
    """Chunks (upload_id, chunk, data, crc, sha) with ``ok``: a CRC that reads as a number decides, else a SHA-256 if one is
    given, else nothing is checked."""
    crc = F.col("crc").try_cast("long")
    given = F.col("crc").isNotNull() & (F.col("crc") != "")
    ok = F.when(given, F.coalesce(F.crc32(F.col("data").cast("binary")) == crc, F.lit(True))).when(F.col("sha").isNotNull() & (F.col("sha") != ""), F.sha2("data", 256) == F.col("sha")).otherwise(True)
    return chunks.withColumn("ok", ok)


def received(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """(upload_id, n, bytes, percent, complete): the chunks that passed, each number once however often it came (the bytes
    of its first row by ``seq``), of the uploads' ``total``."""
    first = checked(chunks).filter("ok").groupBy("upload_id", "chunk").agg(F.min_by(F.octet_length("data"), "seq").alias("size"))
    found = first.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))
    rows = totals.join(found, "upload_id", "left").fillna(0, ["n", "bytes"])
    return rows.select("upload_id", "n", "bytes", F.round(F.col("n") / F.col("total") * 100, 1).alias("percent"), (F.col("n") == F.col("total")).alias("complete"))
