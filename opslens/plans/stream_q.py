"""Registered streaming queries: each runs a Structured Streaming job over a
driver table as a file stream (trigger availableNow) and returns what the
sink received. With the whole table in one micro-batch the results equal the
batch twins, so the batch oracles apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import risk as rk
from opslens.plans import alerts_q, anomaly_q, derive, render_q
from opslens.plans.registry import register
from opslens.streaming import monitor as sm


def _points(spark, sf_dir):
    return derive.rough(sm.table_stream(spark, sf_dir, "events"))


def _plain_points(spark, sf_dir):
    ev = sm.table_stream(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("id"), "value")


def _round(df):
    return df.withColumn("expected_value", F.round("expected_value", 6)).withColumn(
        "deviation", F.round("deviation", 6))


@register("stream_sigma_anomalies", anomaly_q.SIGMA_SQL)
def stream_sigma_anomalies(spark, sf_dir):
    """Stateful streaming sigma detector over the events stream."""
    out = sm.run_until_caught_up(sm.detect_stream(_points(spark, sf_dir)), "sigma")
    return _round(out)


@register("stream_cooldown_alerts", anomaly_q.COOLDOWN_SQL)
def stream_cooldown_alerts(spark, sf_dir):
    """Streaming sigma (threshold 1.5) with the per-metric cooldown kept in state."""
    d = sm.detect_stream(_points(spark, sf_dir), threshold=1.5, cooldown=21600)
    return _round(sm.run_until_caught_up(d, "cooldown")).drop("description")


@register("stream_ewma_anomalies", anomaly_q.EWMA_SQL)
def stream_ewma_anomalies(spark, sf_dir):
    d = sm.detect_stream(_points(spark, sf_dir), method="ewma", alpha=0.3, threshold=2.0)
    return _round(sm.run_until_caught_up(d, "ewma"))


@register("stream_period_stats", """
SELECT event_type AS metric,
       strftime(make_timestamp((epoch_us(ts) // 300000000) * 300000000), '%Y-%m-%d %H:%M:%S') AS period,
       round(avg(value), 6) AS average, max(value) AS maximum, min(value) AS minimum,
       round(sum(value), 6) AS total, count(*) AS samples
FROM events GROUP BY ALL""")
def stream_period_stats(spark, sf_dir):
    """Tumbling 300 s statistics per metric (update mode, upserted)."""
    ev = sm.table_stream(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "ts", "value")
    agg = sm.period_stats_stream(ev).withColumn("period", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).drop("w")
    res = sm.run_until_caught_up(agg, "periods", "update", keys=["metric", "period"])
    return res.select("metric", "period", F.round("average", 6).alias("average"), "maximum", "minimum",
                      F.round("total", 6).alias("total"), "samples")


@register("stream_session_clusters", """
WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts, event_id FROM events),
s AS (SELECT *, sum(CASE WHEN pts IS NULL OR epoch_us(ts) - epoch_us(pts) >= 300000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cl FROM o)
SELECT user_id, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, cl""")
def stream_session_clusters(spark, sf_dir):
    """Session windows per user with a gap just under 300 s (strict '<' as the batch clustering)."""
    ev = sm.table_stream(spark, sf_dir, "events").select("user_id", "ts")
    s = sm.session_clusters_stream(ev, "user_id").withColumn("start", F.col("s.start")).drop("s")
    res = sm.run_until_caught_up(s, "sessions", "complete")
    return res.select("user_id", "count", "first_ts", "last_ts")


@register("stream_progress_latest", render_q.PROGRESS_CTE.join(["WITH ", ""]) +
          " SELECT job_id, status, frames_rendered, ts, events FROM ls")
def stream_progress_latest(spark, sf_dir):
    """Render progress events (line items) as a stream; latest state per job."""
    li = sm.table_stream(spark, sf_dir, "lineitem")
    failed = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    st = F.when(failed, "failed").when(F.col("l_linestatus") == "F", "completed").otherwise("running")
    ts_ = F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_linenumber").cast("decimal(18,6)"))
    ev = li.select(F.col("l_orderkey").alias("job_id"), ts_.alias("ts"), "l_linenumber", "l_suppkey", "l_partkey",
                   (F.col("l_linenumber") * 10).alias("frames_rendered"), st.alias("status"))
    latest = sm.latest_state_stream(ev, "job_id", ["ts", "l_linenumber", "l_suppkey", "l_partkey", "status"],
                                    ["status", "frames_rendered", "ts"])
    return sm.run_until_caught_up(latest, "progress", "update", keys=["job_id"])


@register("stream_dead_letters", """
SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber) AS attempts, count(DISTINCT l_linenumber) > 3 AS dead_letter
FROM lineitem GROUP BY 1""")
def stream_dead_letters(spark, sf_dir):
    """Line items as deliveries of job l_orderkey (redelivered copies of a line
    are duplicates); more than 3 receives -> dead letter."""
    li = sm.table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("delivery_id"),
        F.col("l_shipdate").alias("ts"))
    res = sm.run_until_caught_up(sm.dead_letters_stream(li), "deadletters", "update", keys=["job_id"])
    return res.select("job_id", "attempts", "dead_letter")


EXPIRING_SQL = """
WITH e AS (SELECT l_orderkey AS job_id, l_shipdate AS ts, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate IS NOT NULL),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {ttl}000000 THEN 1 ELSE 0 END AS cut FROM e
      WINDOW w AS (PARTITION BY job_id ORDER BY ts, l_linenumber)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY job_id ORDER BY ts, l_linenumber ROWS UNBOUNDED PRECEDING) AS life FROM g),
a AS (SELECT job_id, life, count(DISTINCT l_linenumber) AS attempts, max((ts, l_linenumber, l_quantity)) AS l FROM i GROUP BY ALL),
z AS (SELECT job_id, arg_max(attempts, life) AS attempts, arg_max(l, life) AS l FROM a GROUP BY 1)
SELECT job_id, l[1] AS ts, l[2] AS l_linenumber, l[3] AS l_quantity, attempts, attempts > 3 AS dead_letter FROM z"""


def _expiring(spark, sf_dir, days: int, tag: str):
    li = sm.table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_quantity", F.col("l_shipdate").alias("shipped"))
    jobs = sm.ExpiringState(li, "job_id", "shipped", ["l_linenumber"], ["l_linenumber", "l_quantity"], "l_linenumber", days * 86400)
    return sm.run_expiring(jobs, tag)


@register("stream_expiring_attempts", EXPIRING_SQL.replace("{ttl}", str(4 * 86400)))
def stream_expiring_attempts(spark, sf_dir):
    """Receives per job (line items of an order) with a time to live of 4 days, and its latest event."""
    return _expiring(spark, sf_dir, 4, "attempts")


@register("stream_expiring_states", EXPIRING_SQL.replace("{ttl}", str(14 * 86400)))
def stream_expiring_states(spark, sf_dir):
    """Latest state per job with a time to live of 14 days."""
    return _expiring(spark, sf_dir, 14, "states")


@register("stream_canary_gate", """
SELECT strftime(make_timestamp((epoch_us(ts) // 60000000) * 60000000), '%Y-%m-%d %H:%M:%S') AS period,
       CASE WHEN user_id % 2 = 0 THEN 'stable' ELSE 'canary' END AS version,
       count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio,
       count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.01 AS failed
FROM events GROUP BY ALL""")
def stream_canary_gate(spark, sf_dir):
    """Per minute and version: error share, gate fails above 1 %."""
    ev = sm.table_stream(spark, sf_dir, "events").select(
        "ts", F.when(F.col("user_id") % 2 == 0, "stable").otherwise("canary").alias("version"),
        (F.col("event_type") == "error").alias("is_error"))
    g = sm.canary_gate_stream(ev).withColumn("period", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).drop("w")
    res = sm.run_until_caught_up(g, "canary", "update", keys=["period", "version"])
    return res.select("period", "version", "total", "errors", F.round("ratio", 6).alias("ratio"), "failed")


@register("stream_alert_payloads", f"""WITH s AS ({anomaly_q.SIGMA_PLAIN_SQL})
SELECT metric, id, 'slack' AS channel,
       '{{"text":"' || CASE severity WHEN 'critical' THEN '🔴' ELSE '⚠️' END || ' *' || metric || ' anomaly*\\n'
         || description || '"}}' AS payload
FROM s""")
def stream_alert_payloads(spark, sf_dir):
    """Alert stream: streaming anomalies -> slack payload rows (delivery not built)."""
    def routed(d):
        d = d.select("metric", "id", "severity", F.array(F.lit("slack")).alias("channels"),
                     F.concat("metric", F.lit(" anomaly")).alias("title"), F.col("description").alias("message"),
                     F.lit("aiops-agent").alias("source"))
        return rk.payloads(rk.route(d)).select("metric", "id", "channel", "payload")

    out = sm.run_until_caught_up(sm.detect_stream(_plain_points(spark, sf_dir)).transform(routed), "alerts")
    return out


@register("stream_approval_expiry", """
WITH rq AS (SELECT o_orderkey AS request_id, o_orderdate AS requested_at,
                   o_orderdate + INTERVAL 5184000 SECOND AS deadline FROM orders),
d AS (SELECT l_orderkey AS request_id, l_shipdate AS decided_at,
             CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END AS status
      FROM lineitem WHERE l_linestatus = 'F'),
now AS (SELECT least((SELECT max(o_orderdate) FROM orders),
                      (SELECT max(l_shipdate) FROM lineitem WHERE l_linestatus = 'F')) AS now),
f AS (SELECT d.request_id, arg_min(d.status, (d.decided_at, d.status)) AS status, min(d.decided_at) AS decided_at
      FROM d JOIN rq USING (request_id) WHERE d.decided_at <= rq.deadline AND d.decided_at >= rq.requested_at GROUP BY 1),
r AS (SELECT rq.request_id, rq.requested_at,
             CASE WHEN f.status IS NOT NULL THEN f.status WHEN now.now > rq.deadline THEN 'expired' END AS status,
             f.decided_at FROM rq LEFT JOIN f USING (request_id), now)
SELECT CAST(request_id AS VARCHAR) AS request_id, status, requested_at, decided_at FROM r WHERE status IS NOT NULL""")
def stream_approval_expiry(spark, sf_dir):
    """Requests (orders) and decisions (finished line items) as two streams;
    a 60-day deadline enforced by a stream-stream outer join on event time;
    expiry is final. The join advances on the slower input's watermark
    (Spark's default policy), so 'now' is the earlier of the two latest
    event times."""
    o = sm.table_stream(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderdate").alias("requested_at"))
    li = sm.table_stream(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_shipdate").alias("decided_at"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("status"))
    emitted = sm.run_until_caught_up(sm.approval_expiry_stream(o, li, timeout_seconds=60 * 86400), "expiry")
    return sm.settle_expiry(emitted)
