"""Registered scans of real files: rows derived from the driver's tables are written one file a
row to the shared folder and read back by the library's file sources."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators import filesig, inventory
from opslens.plans.registry import register
from opslens.session import ensure_checkpoint_dir
from opslens.sinks.rowfiles import write_files
from opslens.sources import files, responses
from opslens.streaming import monitor as sm
from opslens.tables import table


def _folder(spark, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{tag}-{uuid.uuid4().hex[:12]}"


def _written(rows: DataFrame, tag: str) -> str:
    folder = _folder(rows.sparkSession, tag)
    write_files(rows, folder)
    return folder


def _below(column: str, folder: str):
    """A file's path below the folder it was read from."""
    return F.regexp_extract(column, folder.rstrip("/").rpartition("/")[2] + "/(.*)$", 1)


@register("local_jobs", """
SELECT 'local_scene_' || s_suppkey AS job, true AS timed, 'local' AS project, 'v1' AS variation, 'local' AS artist,
  'scene_' || s_suppkey || '.blend' AS filename, 'scene_' || s_suppkey || '.blend' AS input,
  'file:///output/scene_' || s_suppkey AS output_uri, 0 AS priority FROM supplier WHERE s_suppkey % 3 <> 0""")
def local_jobs(spark, sf_dir):
    """A queue folder of scene files (every third file is something else) read as jobs."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("scene_"), k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".blend")).alias("path"),
        F.concat(F.lit("BLENDER-v300"), "s_name").alias("content"))
    folder = _written(rows, "queue")
    job = r"^(.*)_(\d+)$"
    return files.scan_local_jobs(spark, folder).select(
        F.regexp_extract("job_id", job, 1).alias("job"), (F.regexp_extract("job_id", job, 2).cast("long") > 1_700_000_000).alias("timed"),
        "project", "variation", "artist", "filename", _below("input_uri", folder).alias("input"), "output_uri", "priority")


@register("markdown_documents", """
SELECT 'doc_' || doc_id || '.md' AS name, sha256(text) AS text_sha256, true AS timed FROM documents
WHERE lang = 'en' AND text <> ''""")
def markdown_documents(spark, sf_dir):
    """Whole markdown texts of one category of a corpus folder, with name and time."""
    rows = table(spark, sf_dir, "documents").where(F.col("text") != "").select(
        F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    found = files.read_documents(spark, _written(rows, "markdown"), "en")
    return found.select("name", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.col("mtime").isNotNull().alias("timed"))


@register("script_files", """
SELECT 's_' || s_suppkey || '.ms' AS path, '-- ' || s_name || chr(10) || 'render ' || s_nationkey AS text FROM supplier WHERE s_suppkey % 4 <> 0""")
def script_files(spark, sf_dir):
    """Script files with carriage returns, read without them; files of other kinds are left."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s_"), k.cast("string"), F.when(k % 4 == 0, ".py").otherwise(".ms")).alias("path"),
        F.concat(F.lit("-- "), "s_name", F.lit("\r\nrender "), F.col("s_nationkey").cast("string")).alias("content"))
    folder = _written(rows, "scripts")
    return files.read_scripts(spark, folder).select(_below("path", folder).alias("path"), "text")


ASSET_KINDS = ["blend", "OBJ", "stl", "txt", "glb", "fbx"]


@register("asset_scan", """
SELECT 'n' || s_nationkey || '/a_' || s_suppkey || '.' || (['blend', 'OBJ', 'stl', 'txt', 'glb', 'fbx'])[s_suppkey % 6 + 1] AS path,
  length(s_name)::bigint AS length FROM supplier WHERE s_suppkey % 6 NOT IN (1, 3)""")
def asset_scan(spark, sf_dir):
    """Files of the known asset extensions (in lower case) under nested folders."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ASSET_KINDS)), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/a_"), k.cast("string"), F.lit("."), kind).alias("path"),
        F.col("s_name").alias("content"))
    folder = _written(rows, "assets")
    return filesig.scan_assets(spark, folder).select(_below("path", folder).alias("path"), "length")


@register("file_inventory", """
SELECT CASE s_suppkey % 5 WHEN 0 THEN 'top_' || s_suppkey WHEN 1 THEN 'src/a/b/f_' || s_suppkey || '.py' WHEN 2 THEN 'src/' || s_suppkey || '.tf'
    WHEN 3 THEN 'docs/' || s_suppkey || '.md' ELSE 'empty/e_' || s_suppkey END AS path,
  CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE length(s_name) END::bigint AS length, true AS timed FROM supplier""")
def file_inventory(spark, sf_dir):
    """Every file of a tree, empty ones included, without its content."""
    k, at = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    path = (F.when(at == 0, F.concat(F.lit("top_"), k)).when(at == 1, F.concat(F.lit("src/a/b/f_"), k, F.lit(".py")))
            .when(at == 2, F.concat(F.lit("src/"), k, F.lit(".tf"))).when(at == 3, F.concat(F.lit("docs/"), k, F.lit(".md")))
            .otherwise(F.concat(F.lit("empty/e_"), k)))
    rows = table(spark, sf_dir, "supplier").select(path.alias("path"), F.when(at != 4, F.col("s_name")).alias("content"))
    found = inventory.file_inventory(spark, _written(rows, "tree"))
    return found.select("path", "length", F.col("modificationTime").isNotNull().alias("timed"))


def incident_folder(spark, sf_dir) -> str:
    """One incident file for three customers each (its alerts; every tenth without a time). The eight
    last incidents by number are written last, the twelve before them a moment earlier."""
    c = table(spark, sf_dir, "customer")
    at = F.date_format(F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 300 as int))"),
                       "yyyy-MM-dd'T'HH:mm:ss")
    alert = F.struct(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"),
                     F.when(F.col("c_custkey") % 10 != 0, at).alias("fired_at"),
                     F.when(F.col("c_acctbal") > 0, "pager").alias("source"))
    docs = c.groupBy(F.floor(F.col("c_custkey") / 3).alias("i")).agg(F.sort_array(F.collect_list(alert)).alias("alerts"))
    number = F.col("i").cast("string")
    docs = docs.select("i", F.concat(F.lit("incident_"), number, F.lit(".json")).alias("path"),
                       F.to_json(F.struct(F.concat(F.lit("i"), number).alias("incident_id"), "alerts")).alias("content"))
    folder = _folder(spark, "incidents")
    top = c.agg(F.floor(F.max("c_custkey") / 3)).scalar()
    for part in (F.col("i") <= top - 20, (F.col("i") > top - 20) & (F.col("i") <= top - 8), F.col("i") > top - 8):
        write_files(docs.where(part), folder)
        time.sleep(0.05)  # file times tell thousandths of a second
    return folder


@register("incident_alerts", """
SELECT 'i' || (c_custkey // 3) AS incident_id, 'customer ' || c_custkey AS name, CASE WHEN c_acctbal > 0 THEN 'pager' END AS source,
  c_custkey % 10 = 0 AS time_missing,
  CASE WHEN c_custkey % 10 <> 0 THEN strftime(DATE '2024-01-01' + CAST(c_custkey % 300 AS INT), '%Y-%m-%d') END AS day FROM customer""")
def incident_alerts(spark, sf_dir):
    """Incident files read with the declared schema and flattened; a missing time is the time of reading."""
    alerts, _, _ = files.incident_parts(files.read_incidents(spark, incident_folder(spark, sf_dir)))
    now = F.col("fired_at") > F.expr("timestamp_ntz '2025-06-01 00:00:00'")
    return alerts.select("incident_id", "name", "source", now.alias("time_missing"),
                         F.when(~now, F.date_format("fired_at", "yyyy-MM-dd")).alias("day"))


@register("incident_history", """
SELECT 'i' || i AS incident_id, CASE WHEN i > top - 8 THEN 1 ELSE 2 END AS batch
FROM (SELECT DISTINCT c_custkey // 3 AS i FROM customer), (SELECT max(c_custkey) // 3 AS top FROM customer) WHERE i > top - 20""")
def incident_history(spark, sf_dir):
    """The 20 incidents written last (the cap is the feature), with the place of their batch in the order returned."""
    found = files.incident_history(spark, incident_folder(spark, sf_dir))
    newest = Window.orderBy(F.col("file_time").desc(), "file")  # 20 rows
    return found.select("incident_id", F.when(F.row_number().over(newest) <= 8, 1).otherwise(2).alias("batch"))


RESPONSES_SQL = """
SELECT 'r' || lpad((event_id // 200)::VARCHAR, 9, '0') || '.json' AS file, 'chunk-' || (event_id // 200) AS instance,
  make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS ts, value FROM events WHERE (event_id // 200) % 7 <> 3"""


def response_folder(spark, sf_dir) -> str:
    """A range response for 200 events each, in a file of its own; every seventh file is cut short."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 200).alias("chunk"), F.array(
        seconds.cast("string"), F.col("value").cast("string")).alias("sample"))
    c = e.groupBy("chunk").agg(F.collect_list("sample").alias("values"))  # 200 samples
    series = F.struct(F.struct(F.concat(F.lit("chunk-"), F.col("chunk").cast("string")).alias("instance")).alias("metric"), "values")
    text = F.when(F.col("chunk") % 7 == 3, F.expr("substring(text, 1, 40)")).otherwise(F.col("text"))
    rows = c.withColumn("text", F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(series).alias("result")).alias("data"))))
    return _written(rows.select(F.format_string("r%09d.json", "chunk").alias("path"), text.alias("content")), "responses")


@register("metric_responses", RESPONSES_SQL)
def metric_responses(spark, sf_dir):
    """Saved responses read by the data source; unreadable ones are skipped."""
    responses.register(spark)
    found = spark.read.format("metric_responses").option("filesPerPartition", 8).load(response_folder(spark, sf_dir))
    return found.select("file", F.col("labels")["instance"].alias("instance"), "ts", "value")


@register("stream_metric_responses", RESPONSES_SQL)
def stream_metric_responses(spark, sf_dir):
    """The same as a stream."""
    responses.register(spark)
    found = spark.readStream.format("metric_responses").load(response_folder(spark, sf_dir))
    rows = found.select("file", F.col("labels")["instance"].alias("instance"), "ts", "value")
    return sm.run_until_caught_up(rows, "responses")
