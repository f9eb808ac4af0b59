"""Registered queries of sources, sinks and runners: they write tables derived from
the driver's with the sinks, to the shared folder, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opslens.operators import anomaly, risk
from opslens.operators import findings as fo
from opslens.plans import anomaly_q, derive, runner
from opslens.plans.registry import register
from opslens.session import ensure_checkpoint_dir
from opslens.sinks import writers
from opslens.sinks.commitlog import CommitLog
from opslens.sources.metrics import MetricRegistry
from opslens.streaming import monitor as sm
from opslens.tables import table


def _folder(spark, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/out/{tag}-{uuid.uuid4().hex[:12]}"


def _round(df):
    return df.withColumn("expected_value", F.round("expected_value", 6)).withColumn("deviation", F.round("deviation", 6))


@register("detect_by_name", f"""SELECT 'ewma' AS method, * FROM ({anomaly_q.EWMA_SQL})
UNION ALL SELECT 'sigma', * FROM ({anomaly_q.SIGMA_SQL}) UNION ALL SELECT 'other', * FROM ({anomaly_q.SIGMA_SQL})""")
def detect_by_name(spark, sf_dir):
    """Detector chosen by name; an unknown name is the rolling sigma."""
    pts = derive.rough_points(spark, sf_dir)
    out = None
    for name, kw in (("ewma", {"alpha": 0.3, "threshold": 2.0}), ("sigma", {}), ("other", {})):
        rows = _round(anomaly.detect(pts, name, **kw)).select(F.lit(name).alias("method"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("tool_sets", """SELECT 'checkov,gitleaks,govuln,npm,semgrep,trivy' AS successful, 'pip' AS failed,
  (SELECT count(*) FROM pages) AS pip_unreadable""")
def tool_sets(spark, sf_dir):
    """Scanners whose reports all parse and those with unreadable ones (pip's gets raw pages here)."""
    reports = derive.all_reports(spark, sf_dir)
    raw = table(spark, sf_dir, "pages").select(F.col("html").alias("report"))
    status = fo.tool_status({**reports, "pip": reports["pip"].select("report").unionByName(raw)})
    sets = fo.tool_sets(status)
    bad = status.where(F.col("tool") == "pip").agg(F.max("unreadable").alias("n")).scalar()
    return sets.select(F.array_join("successful", ",").alias("successful"), F.array_join("failed", ",").alias("failed"),
                       bad.alias("pip_unreadable"))


@register("iac_files", """
SELECT path FROM (SELECT CASE s_suppkey % 7 WHEN 0 THEN 'infra/sg_' || s_suppkey || '.tf' WHEN 1 THEN 'svc/' || s_suppkey || '/Dockerfile'
  WHEN 2 THEN 'svc/' || s_suppkey || '/Dockerfile.dev' END AS path FROM supplier) WHERE path IS NOT NULL""")
def iac_files(spark, sf_dir):
    """Infrastructure files of a tree with tests, vendored and unrelated files among them."""
    k = F.col("s_suppkey").cast("string")
    at = F.col("s_suppkey") % 7
    path = (F.when(at == 0, F.concat(F.lit("infra/sg_"), k, F.lit(".tf")))
            .when(at == 1, F.concat(F.lit("svc/"), k, F.lit("/Dockerfile")))
            .when(at == 2, F.concat(F.lit("svc/"), k, F.lit("/Dockerfile.dev")))
            .when(at == 3, F.concat(F.lit("infra/test_"), k, F.lit(".tf")))
            .when(at == 4, F.concat(F.lit("node_modules/m"), k, F.lit("/main.tf")))
            .when(at == 5, F.concat(F.lit("x/.git/"), k, F.lit(".tf"))).otherwise(F.concat(F.lit("app_"), k, F.lit(".py"))))
    return fo.iac_files(table(spark, sf_dir, "supplier").select(path.alias("path")))


@register("metric_registry", """
SELECT event_type || 's' AS metric, ts, event_id AS id, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n_labels
FROM events WHERE event_type IN ('error', 'view')""")
def metric_registry(spark, sf_dir):
    """Providers by name: two collected; one that fails when it is built, one that fails when it is
    executed and one that is unknown are skipped."""
    ev = table(spark, sf_dir, "events")

    def provider(kind, labels):
        def points(s):
            rows = ev.where(F.col("event_type") == kind).select("ts", F.col("event_id").alias("id"), "value")
            return rows.withColumn("labels", F.create_map(F.lit("kind"), F.lit(kind))) if labels else rows
        return points

    reg = MetricRegistry()
    reg.register_metric("errors", provider("error", True))
    reg.register_metric("views", provider("view", False))
    reg.register_metric("broken", lambda s: s.read.parquet(f"{sf_dir}/no_such_table.parquet"))
    reg.register_metric("stops", lambda s: ev.select("ts", F.col("event_id").alias("id"), F.when(
        F.col("event_id") % 7 == 3, F.raise_error(F.lit("no answer")).cast("double")).otherwise(F.col("value")).alias("value")))
    reg.register_metric("clicks", provider("click", False))
    points, failed = reg.collect(spark, ["errors", "views", "broken", "stops", "unknown"])
    if failed != ["broken", "stops"]:
        raise RuntimeError(f"skipped: {failed}")
    return points.select("metric", "ts", "id", "value", F.size("labels").alias("n_labels"))


@register("alert_channel_payloads", f"""WITH s AS ({anomaly_q.SIGMA_PLAIN_SQL})
SELECT id, 'webhook' AS channel, metric || ' anomaly' AS title, severity AS level, description AS message, true AS dedup_ok FROM s
UNION ALL SELECT id, 'pagerduty', metric || ' anomaly', CASE severity WHEN 'critical' THEN 'critical' ELSE 'warning' END,
  'trigger', true FROM s""")
def alert_channel_payloads(spark, sf_dir):
    """Pager and webhook payloads of the sigma anomalies, read back from their JSON; the
    pager's dedup key is 'aiops-<source>-<0..9999>' and the same for equal titles."""
    a = anomaly.rolling_sigma(derive.metric_points(spark, sf_dir)).select(
        "id", "severity", F.concat("metric", F.lit(" anomaly")).alias("title"), F.col("description").alias("message"),
        F.lit("aiops-agent").alias("source"))
    p = risk.payloads(a.withColumn("channel", F.explode(F.array(F.lit("pagerduty"), F.lit("webhook")))))
    get = lambda path: F.get_json_object("payload", path)
    pager = F.col("channel") == "pagerduty"
    key = get("$.dedup_key")
    same = key == risk.dedup_key(F.col("source"), F.col("title"))
    return p.select("id", "channel", F.when(pager, get("$.payload.summary")).otherwise(get("$.event_type")).alias("title"),
                    F.when(pager, get("$.payload.severity")).otherwise(get("$.data.severity")).alias("level"),
                    F.when(pager, get("$.event_action")).otherwise(get("$.data.message")).alias("message"),
                    F.when(pager, key.rlike(r"^aiops-aiops-agent-\d{1,4}$") & same).otherwise(F.lit(True)).alias("dedup_ok"))


@register("incident_round_trip", """
SELECT 'i' || c_custkey AS incident_id, 'Customer ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN ' again' ELSE '' END AS title
FROM customer""")
def incident_round_trip(spark, sf_dir):
    """Incidents written twice (every third with a new title) and read as last written."""
    k = F.col("c_custkey").cast("string")
    first = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("i"), k).alias("incident_id"), F.concat(F.lit("Customer "), k).alias("title"),
        F.date_format(F.expr("date '2024-01-01' + cast(c_custkey % 30 as int)"), "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"))
    path = _folder(spark, "incidents")
    writers.write_incidents(first, path)
    third = F.regexp_extract("incident_id", r"\d+", 0).cast("long") % 3 == 0
    writers.write_incidents(first.where(third).withColumn("title", F.concat("title", F.lit(" again"))), path)
    return writers.latest_incidents(spark, path).select("incident_id", "title")


@register("incident_upserts", """
SELECT 'i' || c_custkey AS incident_id, CASE WHEN c_custkey % 5 = 0 THEN 'closed' WHEN c_custkey % 3 = 0 THEN 'open again' ELSE 'open' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS version FROM customer""")
def incident_upserts(spark, sf_dir):
    """Incidents upserted by three batches through the commit log: one runs twice (the second time with other
    rows), one stops before its commit, and the log is compacted in between."""
    log = CommitLog(spark, _folder(spark, "incident-log"))
    c = table(spark, sf_dir, "customer")

    def batch(status: str, version: int, every: int):
        return c.where(F.col("c_custkey") % every == 0).select(
            F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("incident_id"), F.lit(status).alias("status"),
            F.lit(version).alias("version"))

    log.write(batch("open", 0, 1), 0)
    log.write(batch("open again", 1, 3), 1)
    log.write(batch("never seen", 9, 1), 1)
    batch("half written", 9, 1).write.parquet(f"{log.path}/data/batch-stopped")
    log.compact(["incident_id"])
    log.write(batch("never seen", 9, 1), 0)
    log.write(batch("closed", 2, 5), 2)
    return log.read(["incident_id"])


@register("report_sink", """SELECT event_type AS metric, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS y FROM events GROUP BY ALL""")
def report_sink(spark, sf_dir):
    """Daily means written by day and read back."""
    path = _folder(spark, "reports")
    writers.write_reports(derive.daily_metric(spark, sf_dir), path)
    return spark.read.parquet(path).select("metric", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("y", 6).alias("y"))


@register("artifact_sink", "SELECT n_nationkey, n_name FROM nation")
def artifact_sink(spark, sf_dir):
    """A JSON artifact written under its timed name and read back."""
    at = writers.write_artifact(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nations", _folder(spark, "artifacts"))
    return spark.read.schema("n_nationkey long, n_name string").json(at).withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@register("run_log", f"""SELECT 'check_status' AS job, 'success' AS status, 'check_status: ' || count(*) || ' rows' AS summary,
  count(*) AS n_rows, true AS timed FROM ({anomaly_q.CHECK_SQL})
UNION ALL SELECT 'no_such_job', 'failed', 'no_such_job: 0 rows', 0, true""")
def run_log(spark, sf_dir):
    """Two jobs run through the runner, one of which does not exist; their run log read back."""
    log = _folder(spark, "run-log")
    for job in ("check_status", "no_such_job"):
        runner.run_job(job, spark, sf_dir, sink=_folder(spark, "job"), run_log=log)
    return spark.read.parquet(log).select("job", "status", "summary", F.coalesce("rows", F.lit(0)).alias("n_rows"), (F.col("duration_s") >= 0).alias("timed"))


def _stream_points(spark, sf_dir):
    return derive.rough(sm.table_stream(spark, sf_dir, "events"))


@register("stream_monitor", anomaly_q.SIGMA_SQL)
def stream_monitor(spark, sf_dir):
    """The continuous monitor, stopped once it has caught up; its sink writes a folder a batch."""
    out = _folder(spark, "monitor")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")

    query = sm.start_monitor(_stream_points(spark, sf_dir), sink, _folder(spark, "monitor-state"), trigger="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return _round(spark.read.option("recursiveFileLookup", "true").schema(sm.OUT_SCHEMA).parquet(out))


@register("stream_clear_control", """
WITH c AS (SELECT *, event_id % 100 = 0 AS clear,
             sum(CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS part FROM events),
p AS (SELECT event_type AS metric, ts, event_id AS id, value, row_number() OVER w0 AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std
  FROM c WHERE NOT clear
  WINDOW w0 AS (PARTITION BY event_type, part ORDER BY ts, event_id),
         w AS (PARTITION BY event_type, part ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
SELECT metric, ts, id, value, round(round(mean, 9), 6) AS expected_value, round(abs(value - mean) / std, 6) AS deviation,
  CASE WHEN abs(value - mean) / std > 4 THEN 'critical' ELSE 'warning' END AS severity
FROM p WHERE n >= 10 AND std > 0 AND abs(value - mean) / std > 2""")
def stream_clear_control(spark, sf_dir):
    """Streaming sigma (threshold 2) with clear rows (every hundredth event), after which a metric starts afresh."""
    pts = sm.table_stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("id"), "value",
        F.when(F.col("event_id") % 100 == 0, "clear").alias("control"))
    out = sm.run_until_caught_up(sm.detect_stream(pts, threshold=2.0), "clear")
    # a mean of 32 prices can end in 5 at the seventh digit, where the last bit of either engine's mean would
    # decide: nine digits first, on both sides
    return _round(out.withColumn("expected_value", F.round("expected_value", 9))).drop("description")
