"""File readers: incident documents, markdown corpora, render lists (CSV),
conversion lists, scripts, and local job folders. All use declared schemas
and Spark's file sources (listing, globs, recursive lookup, _metadata)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.operators import render as rd

INCIDENT_SCHEMA = (
    "incident_id string, title string, severity string, start_time string, end_time string, "
    "symptoms array<string>, alerts array<struct<name:string,fired_at:string,source:string>>, logs string, "
    "recent_changes array<struct<timestamp:string,description:string,source:string,component:string>>, "
    "related_incidents array<struct<start_time:string,title:string>>")
RENDER_LIST_COLS = ["A", "B", "C", "D", "E", "F", "G"]


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident JSON documents (one per file, or JSON lines) with a declared
    schema; unreadable records are dropped; file time kept for ordering."""
    return (spark.read.schema(INCIDENT_SCHEMA).option("mode", "DROPMALFORMED")
            .option("multiLine", "true").json(path)
            .withColumn("file_time", F.col("_metadata.file_modification_time"))
            .withColumn("file", F.col("_metadata.file_path")))


def _iso_ts(c):
    """ISO-8601 text -> timestamp; missing or unreadable -> now."""
    return F.coalesce(F.try_to_timestamp(c), F.current_timestamp()).cast("timestamp_ntz")


def incident_parts(incidents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested incidents -> (alerts, changes, related) flat frames for
    ``operators.timeline.timeline`` (input position kept as in_ord)."""
    a = incidents.select("incident_id", F.posexplode_outer("alerts").alias("in_ord", "x")).where("x IS NOT NULL")
    c = incidents.select("incident_id", F.posexplode_outer("recent_changes").alias("in_ord", "x")).where("x IS NOT NULL")
    r = incidents.select("incident_id", F.posexplode_outer("related_incidents").alias("in_ord", "x")).where(
        "x IS NOT NULL")
    alerts = a.select("incident_id", _iso_ts(F.col("x.fired_at")).alias("fired_at"), F.col("x.name").alias("name"),
                      F.col("x.source").alias("source"), F.col("in_ord").cast("long").alias("in_ord"))
    changes = c.select("incident_id", _iso_ts(F.col("x.timestamp")).alias("timestamp"),
                       F.col("x.description").alias("description"), F.col("x.source").alias("source"),
                       F.col("x.component").alias("component"), F.col("in_ord").cast("long").alias("in_ord"))
    related = r.select("incident_id", _iso_ts(F.col("x.start_time")).alias("start_time"),
                       F.col("x.title").alias("title"), F.col("in_ord").cast("long").alias("in_ord"))
    return alerts, changes, related


def incident_history(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """Most recently written incidents first, at most ``limit`` (the cap is the feature)."""
    return read_incidents(spark, path).orderBy(F.col("file_time").desc(), F.col("file")).limit(limit)


def _whole_texts(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    """A row a file, its bytes taken as text. The reader of whole binary files opens a file at once, where
    that of whole texts sets up a Hadoop record reader for each."""
    d = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
         .option("recursiveFileLookup", str(recursive).lower()).load(path))
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
                    F.col("_metadata.file_modification_time").alias("mtime"), F.col("content").cast("string").alias("text"))


def read_documents(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Markdown files as whole texts with name and modification time; an
    optional category sub-folder."""
    p = f"{path.rstrip('/')}/{category}" if category else path
    return _whole_texts(spark, p, "*.md", recursive=True)


def read_scripts(spark: SparkSession, path: str, glob: str = "*.ms") -> DataFrame:
    """Script files as whole texts, carriage returns removed."""
    d = _whole_texts(spark, path, glob)
    return d.select("path", F.regexp_replace("text", "\r", "").alias("text"))


def read_render_list(spark: SparkSession, path: str) -> DataFrame:
    """Render list sheet exported as CSV: columns A..G as strings, the header
    row skipped, empty rows dropped."""
    schema = ", ".join(f"{c} string" for c in RENDER_LIST_COLS)
    d = spark.read.schema(schema).option("header", "true").csv(path)
    return d.where(F.coalesce(*[F.col(c) for c in RENDER_LIST_COLS]).isNotNull())


def read_conversion_list(spark: SparkSession, path: str) -> DataFrame:
    """'input|output' lines -> (input, output)."""
    return rd.conversion_list(spark.read.text(path), "value")


def scan_local_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Local queue folder: every .blend file becomes a job row (project
    'local', variation 'v1', file:// URIs, id local_<stem>_<epoch>); the
    listing reads no file content."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", "*.blend").load(path)
         .select("path", "modificationTime"))
    local = F.regexp_replace("path", "^file:", "")
    st = rd.stem(local)
    epoch = F.unix_seconds(F.col("modificationTime")).cast("string")
    return f.select(F.concat(F.lit("local_"), st, F.lit("_"), epoch).alias("job_id"),
                    F.lit("local").alias("project"), F.lit("v1").alias("variation"), F.lit("local").alias("artist"),
                    F.element_at(F.split(local, "/"), -1).alias("filename"),
                    F.concat(F.lit("file://"), local).alias("input_uri"),
                    F.concat(F.lit("file:///output/"), st).alias("output_uri"), F.lit(0).alias("priority"))
