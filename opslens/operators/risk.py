"""Risk classification, approvals, incident classes and response plans,
notification routing and payload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's) ----
RISK_MATRIX = [  # action, environment, level
    ("read", "any", "none"), ("query", "any", "none"), ("list", "any", "none"),
    ("status", "any", "none"),
    ("create", "dev", "low"), ("create", "staging", "medium"), ("create", "production", "high"),
    ("update", "dev", "low"), ("update", "staging", "medium"), ("update", "production", "high"),
    ("deploy", "dev", "low"), ("deploy", "staging", "medium"), ("deploy", "production", "critical"),
    ("delete", "any", "critical"), ("terminate", "any", "critical"), ("drop", "any", "critical"),
    ("restart", "any", "high"), ("rollback", "any", "high"), ("scale_down", "any", "medium"),
    ("production_change", "any", "critical"), ("security_change", "any", "critical"),
    ("config_change", "production", "high"),
]
HIGH_RISK_KEYWORDS = ["delete", "drop", "terminate", "kill", "remove",
                      "destroy", "truncate", "shutdown", "critical", "production"]
DESTRUCTIVE = ["delete", "terminate", "drop"]
APPROVAL_TIMEOUT_SECONDS = 3600

# incident class: ordered keyword tests (first match wins); "5.." is literal
CLASS_RULES = [
    ("high_latency", ["latency", "slow", "p99"]),
    ("high_error_rate", ["error", "5..", "exception"]),
    ("queue_backup", ["queue", "backlog", "pending"]),
    ("resource_exhaustion", ["memory", "disk", "cpu", "resource"]),
]

PLAYBOOKS = {  # type -> (checks, [(action, description, automated, risk or None)])
    "high_latency": (
        ["Check current CPU/memory utilization", "Review recent deployments",
         "Check database connection pool", "Review slow queries"],
        [("scale_up", "Scale up service", False, None),
         ("restart_pods", "Restart affected pods", True, "low"),
         ("rollback", "Rollback recent deployment", False, None)]),
    "high_error_rate": (
        ["Check application logs", "Review recent config changes", "Check dependency health"],
        [("restart_service", "Restart service", True, "medium"),
         ("failover", "Failover to backup", False, None)]),
    "queue_backup": (
        ["Check worker health", "Review job processing rate", "Check for dead letters"],
        [("scale_workers", "Scale up workers", True, "low"),
         ("drain_queue", "Drain and retry failed jobs", False, None)]),
    "resource_exhaustion": (
        ["Check disk space", "Review log rotation", "Check for memory leaks"],
        [("cleanup_logs", "Clean up old logs", True, "low"),
         ("restart_service", "Restart affected service", True, "medium")]),
}
DEFAULT_ACTION_RISK = "medium"
DEFAULT_DURATION = "5-10 min"

SEVERITY_EMOJI = {"debug": "🔍", "info": "ℹ️", "warning": "⚠️", "error": "🚨", "critical": "🔴"}
PD_SEVERITY = {"debug": "info", "info": "info", "warning": "warning", "error": "error",
               "critical": "critical"}


def matrix(spark) -> DataFrame:
    return spark.createDataFrame(RISK_MATRIX, "action string, environment string, level string")


def with_risk_level(df: DataFrame, matrix_df: DataFrame, action: str = "action",
                    environment: str = "environment") -> DataFrame:
    """Adds ``risk_level``: exact (action, env) -> (action, 'any') -> a
    high-risk keyword in the action -> medium. The matrix is a fixed 22-row
    table, so both lookups are broadcast."""
    a, e = F.lower(F.col(action)), F.lower(F.col(environment))
    m = F.broadcast(matrix_df)
    exact = m.select(F.col("action").alias("_ma"), F.col("environment").alias("_me"),
                     F.col("level").alias("_l1"))
    generic = m.where(F.col("environment") == "any").select(F.col("action").alias("_ga"),
                                                            F.col("level").alias("_l2"))
    j = (df.withColumn("_a", a).withColumn("_e", e)
         .join(exact, (F.col("_a") == F.col("_ma")) & (F.col("_e") == F.col("_me")), "left")
         .join(generic, F.col("_a") == F.col("_ga"), "left"))
    kw = F.col("_a").rlike("|".join(HIGH_RISK_KEYWORDS))
    level = F.coalesce(F.col("_l1"), F.col("_l2"), F.when(kw, F.lit("high")), F.lit("medium"))
    return j.withColumn("risk_level", level).drop("_a", "_e", "_ma", "_me", "_l1", "_ga", "_l2")


def requires_approval(level: Column) -> Column:
    return level != "none"


def auto_approve(level: Column, environment: Column) -> Column:
    """none/info always; low only in dev or local (environment as given)."""
    return level.isin("none", "info") | ((level == "low") & environment.isin("dev", "local"))


def request_id(action: Column, target: Column, ts_iso: Column) -> Column:
    return F.substring(F.md5(F.concat(action, target, ts_iso)), 1, 8)


def iso(ts: Column) -> Column:
    """ISO text of a timestamp like datetime.isoformat (micros only when non-zero)."""
    us = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return F.when(us == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def class_flags(text: Column) -> list[Column]:
    """One boolean per incident class: does the lower-cased text mention it."""
    t = F.lower(text)
    out = []
    for _, words in CLASS_RULES:
        c = None
        for w in words:
            x = t.contains(w)
            c = x if c is None else (c | x)
        out.append(c)
    return out


def classify_parts(parts: DataFrame, key: str, text: str) -> DataFrame:
    """parts(key, text) -> key, incident_type.

    The classifier tests keywords on the space-joined texts of an incident;
    no keyword contains a space, so testing each part and OR-ing the flags
    per incident is the same test and needs no concatenation."""
    flags = class_flags(F.col(text))
    agg = parts.groupBy(key).agg(*[F.bool_or(f).alias(f"_c{i}") for i, f in enumerate(flags)])
    cls = F.lit("unknown")
    for i in reversed(range(len(CLASS_RULES))):
        cls = F.when(F.col(f"_c{i}"), F.lit(CLASS_RULES[i][0])).otherwise(cls)
    return agg.select(key, cls.alias("incident_type"))


def playbook_actions(spark) -> DataFrame:
    rows = [(t, i, a, d, auto, r) for t, (_, acts) in PLAYBOOKS.items()
            for i, (a, d, auto, r) in enumerate(acts)]
    return spark.createDataFrame(
        rows, "incident_type string, seq int, action string, description string, "
              "automated boolean, risk string")


def response_plan(incidents: DataFrame, actions: DataFrame, key: str = "incident_id") -> DataFrame:
    """incidents(key, incident_type) -> one row per playbook action (none for
    unknown types). Destructive actions or high/critical risk need approval
    and are never automated. Ranks give the first three of each list."""
    j = incidents.join(F.broadcast(actions), "incident_type")  # 4 playbooks, fixed
    risk = F.coalesce(F.col("risk"), F.lit(DEFAULT_ACTION_RISK))
    destructive = None
    for w in DESTRUCTIVE:
        c = F.col("action").contains(w)
        destructive = c if destructive is None else (destructive | c)
    high = risk.isin("high", "critical")
    needs = destructive | high
    reason = (F.when(destructive, F.lit("Requires explicit approval (destructive action)"))
              .when(high, F.concat(F.lit("Risk level: "), risk)))
    p = j.select(key, "incident_type", "seq", "action", "description",
                 (F.col("automated") & ~needs).alias("automated"), risk.alias("risk_level"),
                 needs.alias("needs_approval"), reason.alias("reason"),
                 F.lit(DEFAULT_DURATION).alias("estimated_duration"))
    w = Window.partitionBy(key, "automated").orderBy("seq")
    return p.withColumn("list_rank", F.row_number().over(w))


def route(alerts: DataFrame, channels: str = "channels", severity: str = "severity") -> DataFrame:
    """Explode the requested channels (default slack); pagerduty only for
    error/critical."""
    ch = F.when(F.col(channels).isNull() | (F.size(channels) == 0),
                F.array(F.lit("slack"))).otherwise(F.col(channels))
    e = alerts.withColumn("channel", F.explode(F.array_distinct(ch)))
    keep = (F.col("channel").isin("slack", "webhook") |
            ((F.col("channel") == "pagerduty") & F.col(severity).isin("error", "critical")))
    return e.where(keep)


def _lookup(d: dict, c: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(m[c], F.lit(default))


def pd_severity(sev: Column) -> Column:
    return _lookup(PD_SEVERITY, sev, "error")


def severity_emoji(sev: Column) -> Column:
    return _lookup(SEVERITY_EMOJI, sev, "")


def dedup_key(source: Column, title: Column) -> Column:
    """Stable 'aiops-{source}-{n}' with n in 0..9999 (xxhash64, not per-process hash)."""
    return F.concat(F.lit("aiops-"), source, F.lit("-"),
                    F.pmod(F.xxhash64(title), F.lit(10000)).cast("string"))


def payloads(routes: DataFrame, title: str = "title", message: str = "message",
             severity: str = "severity", source: str = "source") -> DataFrame:
    """Payload row (JSON text) per routed channel; delivery is not built."""
    t, m, s = F.col(title), F.col(message), F.col(severity)
    slack = F.to_json(F.struct(F.concat(severity_emoji(s), F.lit(" *"), t, F.lit("*\n"), m).alias("text")))
    pager = F.to_json(F.struct(F.lit("trigger").alias("event_action"),
                               dedup_key(F.col(source), t).alias("dedup_key"),
                               F.struct(t.alias("summary"), pd_severity(s).alias("severity"),
                                        F.col(source).alias("source")).alias("payload")))
    hook = F.to_json(F.struct(t.alias("event_type"),
                              F.struct(m.alias("message"), s.alias("severity")).alias("data")))
    body = (F.when(F.col("channel") == "slack", slack).when(F.col("channel") == "pagerduty", pager)
            .otherwise(hook))
    return routes.withColumn("payload", body)


def latest_state(events: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Most recent event per key (max_by over a struct, partial aggregation)."""
    agg = events.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_s"), F.count(F.lit(1)).alias("events"))
    return agg.select(key, *[F.col(f"_s.{c}").alias(c) for c in cols], "events")


def expire(requests: DataFrame, decisions: DataFrame, key: str, now: Column,
           timeout_seconds: int = APPROVAL_TIMEOUT_SECONDS) -> DataFrame:
    """requests(key, requested_at), decisions(key, decided_at, status) ->
    status: the first decision made between the request and the deadline;
    otherwise 'expired' once the deadline has passed at ``now`` (final: later
    decisions are ignored), else 'pending'."""
    deadline = F.col("requested_at") + F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    r = requests.withColumn("deadline", deadline)
    d = decisions.join(r.select(key, "requested_at", "deadline"), key).where(
        (F.col("decided_at") >= F.col("requested_at")) & (F.col("decided_at") <= F.col("deadline")))
    # earliest decision; on equal times the status order decides (deterministic)
    first = d.groupBy(key).agg(F.min(F.struct("decided_at", "status")).alias("_d"))
    j = r.join(first, key, "left")
    status = (F.when(F.col("_d").isNotNull(), F.col("_d.status"))
              .when(now > F.col("deadline"), F.lit("expired")).otherwise(F.lit("pending")))
    return j.select(key, "requested_at", "deadline", status.alias("status"),
                    F.col("_d.decided_at").alias("decided_at"))
