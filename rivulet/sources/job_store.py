"""Job documents as JSON under one folder, a partition per job: read with bad files set aside, replaced whole, patched, deleted;
and the side files of a job (upload sessions, media, presets)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
# Kinds of media by file extension.
MEDIA_KINDS = {"mp4": "video", "webm": "video", "mov": "video", "mkv": "video", "avi": "video", "mp3": "audio", "wav": "audio", "ogg": "audio", "m4a": "audio", "aac": "audio", "flac": "audio", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "svg": "image"}


def _absent(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _side_file(spark: SparkSession, path: str) -> str:
    """A small file whose name Spark's readers skip."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _parsed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """The JSON objects of the column ``value`` that fit the schema, as columns beside the others."""
    whole = T.StructType([*schema, T.StructField(BAD, T.StringType())])
    rows = text.withColumn("__d", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    rows = rows.filter(F.col("__d").isNotNull() & F.col(f"__d.{BAD}").isNull())
    return rows.select(*[c for c in text.columns if c != "value"], *[F.col(f"__d.{f.name}").alias(f.name) for f in schema])


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _documents(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    text = spark.read.option("basePath", path).text(folders)
    return text.withColumn("job_id", F.col("job_id").cast("string")) if "job_id" in text.columns else text.withColumn("job_id", F.lit(None).cast("string"))


def _jobs(text: DataFrame, schema: T.StructType) -> DataFrame:
    rows = _parsed(text, T.StructType([f for f in schema if f.name != "job_id"]))
    return rows.filter("job_id is not null").select(*schema.names)


def list_jobs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All jobs that can be read, the newest first. Files that aren't JSON or don't fit the schema are left out
    (``unreadable`` has them)."""
    if _absent(spark, path):
        return _empty(spark, schema)
    return _jobs(_documents(spark, path, [path]), schema).orderBy(F.desc("created_at"), "job_id")


def unreadable(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(job_id, file, line) of what ``list_jobs`` leaves out."""
    if _absent(spark, path):
        return _empty(spark, T.StructType.fromDDL("job_id string, file string, line string"))
    whole = T.StructType([*[f for f in schema if f.name != "job_id"], T.StructField(BAD, T.StringType())])
    text = _documents(spark, path, [path]).withColumn("file", F.col("_metadata.file_path"))
    rows = text.withColumn("__d", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    return rows.filter(F.col("__d").isNull() | F.col(f"__d.{BAD}").isNotNull() | F.col("job_id").isNull()).select("job_id", "file", F.col("value").alias("line"))


def load_jobs(spark: SparkSession, path: str, schema: T.StructType, job_ids: list[str]) -> DataFrame:
    """The rows of some jobs: only their folders are listed and read. Missing and unreadable ones have none."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f for f in (f"{path}/job_id={escaped(i)}" for i in sorted(set(job_ids)) if i) if not _absent(spark, f)]
    return _jobs(_documents(spark, path, folders), schema) if folders else _empty(spark, schema)


def load_job(spark: SparkSession, path: str, schema: T.StructType, job_id: str) -> DataFrame:
    """One row, or none if the job is missing or can't be read."""
    return load_jobs(spark, path, schema, [job_id])


def save_jobs(jobs: DataFrame, path: str) -> None:
    """Replace the documents of these jobs and leave all others: each job's partition is written aside and swapped in when
    the whole write has succeeded."""
    jobs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("job_id").json(path)


def patch_jobs(jobs: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Set known fields (others are ignored) and stamp ``updated_at``."""
    known = {k: v for k, v in changes.items() if k in jobs.columns and k != "job_id"}
    if "updated_at" in jobs.columns:
        known.setdefault("updated_at", F.current_timestamp().cast(jobs.schema["updated_at"].dataType))
    return jobs.withColumns(known) if known else jobs


def delete_jobs(spark: SparkSession, path: str, job_ids: list[str]) -> None:
    """Delete the documents of these jobs; unknown ids are ignored."""
    for job_id in job_ids:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/job_id={job_id}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rescued_media(media: DataFrame, library: DataFrame) -> DataFrame:
    """Media (id, ...) of deleted jobs that the library doesn't hold under their id."""
    return media.join(library.select("id").distinct(), "id", "left_anti")


def recover_sessions(spark: SparkSession, pattern: str) -> DataFrame:
    """Upload sessions (upload_id, chunks): the map's keys, text in JSON, are numbers again. None if no file matches."""
    schema = T.StructType([T.StructField("upload_id", T.StringType()), T.StructField("chunks", T.MapType(T.StringType(), T.StringType()))])
    try:
        text = spark.read.text(pattern, wholetext=True)
    except AnalysisException:  # nothing matches the pattern
        text = _empty(spark, T.StructType([T.StructField("value", T.StringType())]))
    found = _parsed(text, schema).filter("upload_id is not null")
    return found.select("upload_id", F.transform_keys("chunks", lambda k, _: k.try_cast("int")).alias("chunks"))


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """(id, filename, kind, size): the media files of a folder but those beginning with an underscore, with their kind by
    extension (others are left out) and the name they came with by ``_meta.json``, a map, where it has one. Contents
    aren't read."""
    if _absent(spark, folder):
        return _empty(spark, T.StructType.fromDDL("id string, filename string, kind string, size long"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*").load(folder).select("path", F.col("length").alias("size"))
    files = files.withColumn("name", F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)))
    stem, extension = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA_KINDS.items() for x in pair]), extension)
    meta = _empty(spark, T.StructType.fromDDL("id string, original string"))
    if not _absent(spark, f"{folder}/_meta.json"):
        text = spark.createDataFrame([(_side_file(spark, f"{folder}/_meta.json"),)], "value string")
        meta = text.select(F.explode(F.from_json("value", "map<string,struct<original_filename:string>>")).alias("id", "m")).select("id", F.col("m.original_filename").alias("original"))
    found = files.withColumns({"id": stem, "kind": kind}).filter("kind is not null").join(meta, "id", "left")
    return found.select("id", F.coalesce("original", "name").alias("filename"), "kind", "size")


def load_presets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a JSON array; none if the file is missing or broken."""
    if _absent(spark, path):
        return _empty(spark, schema)
    text = spark.read.text(path, wholetext=True)
    whole = text.filter(F.try_parse_json("value").isNotNull())
    return whole.select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("p")).select("p.*")
