"""Tables and the views derived from them: transcript segments, scenes, audio moments, cuts, speaker intervals, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters used later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """White-space words without empties."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def segments(spark: SparkSession, sf_dir: str, per_word: float = 0.4) -> DataFrame:
    """(job_id, seq, speaker, text, n_words, t0, t1): turns laid out on a time line, with pauses by rule."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text")
    turns = turns.withColumn("n_words", F.size(words(F.col("text"))).cast("long"))
    gap = F.when((F.col("seq") * 7 + F.col("job_id") * 3) % 5 == 0, F.lit(2.0)).when((F.col("seq") + F.col("job_id")) % 3 == 0, F.lit(0.3)).otherwise(F.lit(0.0))
    turns = turns.withColumns({"dur": F.col("n_words") * F.lit(per_word), "gap": gap})
    before = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0.0)) + F.col("gap")
    return turns.withColumn("u", start).select("job_id", "seq", "speaker", "text", "n_words", F.round("u", 3).alias("t0"), F.round(F.col("u") + F.col("dur"), 3).alias("t1"))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, event_id, t, event_type, value): events per user, an hour of event time as a media second."""
    raw = load(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"))
    first = F.min("s").over(Window.partitionBy("job_id"))
    return raw.withColumn("t", F.round((F.col("s") - first) / 3600.0, 3)).drop("s")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, event_id, t, importance 1-10, subject_x 0-100)."""
    e = timed_events(spark, sf_dir)
    return e.select("job_id", "event_id", "t", (1 + F.col("event_id") % 10).alias("importance"), (F.col("event_id") * 37 % 101).cast("double").alias("subject_x"))


def speaker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, t0, t1, slot, confidence): from each event to the next of the user; the slot is the event's type."""
    e = timed_events(spark, sf_dir)
    nxt = F.lead("t").over(Window.partitionBy("job_id").orderBy("t", "event_id"))
    slot = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return e.withColumn("t1", nxt).filter("t1 is not null").select("job_id", "event_id", F.col("t").alias("t0"), "t1", slot.alias("slot"), F.round(F.col("event_id") % 20 / 20.0, 2).alias("confidence"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).filter("event_type = 'error'").select("job_id", "t").distinct()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("provider"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, clip_id, t0, t1, score, platform, title): line items as clip candidates of their order."""
    line = load(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 600
    return line.select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("clip_id"),
        start.cast("double").alias("t0"),
        (start + F.col("l_quantity")).cast("double").alias("t1"),
        (1 + F.col("l_suppkey") * 7 % 100).alias("score"),
        F.col("l_returnflag").alias("platform"),
        F.col("l_linestatus").alias("kind"),
    )


def dense_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, event_id, t, k, slot, x, y, w, h): up to three faces of every event's frame; a slot of -1 is nobody known."""
    e = timed_events(spark, sf_dir).filter("event_id % 4 > 0")
    k = F.col("k")
    rows = e.select("job_id", "event_id", "t", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 4 - 1).cast("int"))).alias("k"))
    slot = F.when((F.col("event_id") + k) % 19 == 0, -1).otherwise((F.col("event_id") % 3 + k) % 4).cast("int")
    at = lambda a, b: ((F.col("event_id") * a + k * b) % 101).cast("double")
    return rows.select("job_id", "event_id", "t", "k", slot.alias("slot"), at(37, 29).alias("x"), at(53, 17).alias("y"), (4 + F.col("event_id") % 20).cast("double").alias("w"), (6 + F.col("event_id") % 15).cast("double").alias("h"))


def spans(spark: SparkSession, sf_dir: str, width: float = 60.0) -> DataFrame:
    """(job_id, seq, t0, t1): the jobs' time in pieces of equal length."""
    ends = timed_events(spark, sf_dir).groupBy("job_id").agg(F.floor(F.max("t") / width).alias("n"))
    rows = ends.select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("seq"))
    return rows.select("job_id", "seq", (F.col("seq") * F.lit(width)).alias("t0"), (F.col("seq") * F.lit(width) + width).alias("t1"))
