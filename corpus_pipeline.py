"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, tokenisation.

Every stage works on all that its predecessor kept, as written to Parquet and read again. The columns of ``documents``
(doc_id, text, lang, source, n_chars) go through all stages but the last; ``lang`` becomes the predicted language and
``n_chars`` follows the text. The last stage adds token counts and digests and drops the text.

Defined results, for every stage: null ids are ids like any other; rows repeated with equal id and text are judged alike
(and near-dedup leaves one of them); an empty table gives an empty one; other columns than those of ``documents`` are left
out, so their names can't clash; very long texts are worked on whole, one at a time. Null texts go at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, decontaminate, langid, lines, minhash
from rivulet.llm.common import materialize, small_batches

#: What words consist of, in all stages that look at words: digits, letters and every character beyond ASCII.
WORD_CHARACTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``und`` (no text or no letter in it) goes. ``lang`` is the prediction."""
    small_batches(spark)
    found = langid.identify(docs.select(*COLUMNS), keep_text=True)
    kept = found.filter(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that match an earlier line of the corpus; a document that loses its last line with a
    word in it goes, as its whole content stands in earlier ones. Documents without words from the start stay."""
    small_batches(spark)
    found = lines.deduplicate(docs.select(*COLUMNS), threshold=0.8)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD_CHARACTER)
    return _counted(found.filter(~F.coalesce(emptied, F.lit(False))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; a document without text is in no group."""
    small_batches(spark)
    return minhash.deduplicate(docs.select(*COLUMNS), threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove_documents(docs.select(*COLUMNS), benchmark, n=10)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, for every document left."""
    small_batches(spark)
    found = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

#: Suffix automata, signatures and byte-pair merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
