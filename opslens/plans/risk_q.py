"""Registered risk, approval, incident-response and notification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import risk as rk
from opslens.operators.ordered import epoch_seconds
from opslens.plans.registry import derived, register
from opslens.tables import table

# orders -> requested actions (includes unknown actions for the keyword and default paths)
ACTIONS = ["read", "query", "create", "update", "deploy", "delete", "restart", "rollback",
           "scale_down", "config_change", "terminate_instance", "drop_table", "purge_cache",
           "kill_job", "Deploy", "status", "list", "production_change", "security_change",
           "remove_user"]
ENV_OF_PRIORITY = {"1-URGENT": "production", "2-HIGH": "staging", "3-MEDIUM": "dev",
                   "4-NOT SPECIFIED": "local", "5-LOW": "Production"}

ACTIONS_SQL = "[" + ", ".join(f"'{a}'" for a in ACTIONS) + "]"
ENV_SQL = "CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ENV_OF_PRIORITY.items()) + " END"
MATRIX_SQL = "(VALUES " + ", ".join(f"('{a}', '{e}', '{l}')" for a, e, l in rk.RISK_MATRIX) + \
    ") m(action, environment, level)"
KW_SQL = "|".join(rk.HIGH_RISK_KEYWORDS)

RISK_CTE = f"""
r0 AS (SELECT o_orderkey, o_orderdate, {ACTIONS_SQL}[o_orderkey % {len(ACTIONS)} + 1] AS action,
              {ENV_SQL} AS environment FROM orders),
r AS (SELECT r0.*, coalesce(m1.level, m2.level,
                            CASE WHEN regexp_matches(lower(r0.action), '{KW_SQL}') THEN 'high' END,
                            'medium') AS risk_level
      FROM r0 LEFT JOIN {MATRIX_SQL.replace(' m(', ' m1(')} ON m1.action = lower(r0.action)
                 AND m1.environment = lower(r0.environment)
              LEFT JOIN (SELECT * FROM {MATRIX_SQL} WHERE environment = 'any') m2
                 ON m2.action = lower(r0.action)),
ra AS (SELECT *, risk_level <> 'none' AS requires_approval,
              risk_level IN ('none', 'info') OR (risk_level = 'low' AND environment IN ('dev', 'local'))
                AS auto_approve FROM r)"""


@derived
def _requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    act = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]),
                       (F.col("o_orderkey") % len(ACTIONS) + 1).cast("int"))
    env = F.create_map(*[F.lit(x) for kv in ENV_OF_PRIORITY.items() for x in kv])[F.col("o_orderpriority")]
    r = o.select("o_orderkey", "o_orderdate", act.alias("action"), env.alias("environment"))
    r = rk.with_risk_level(r, rk.matrix(spark))
    return r.withColumn("requires_approval", rk.requires_approval(F.col("risk_level"))).withColumn(
        "auto_approve", rk.auto_approve(F.col("risk_level"), F.col("environment")))


@register("risk_level", f"WITH {RISK_CTE} SELECT o_orderkey, action, environment, risk_level, "
          "requires_approval, auto_approve FROM ra")
def risk_level(spark, sf_dir):
    """Risk of the action each order requests, approval need and auto-approval."""
    return _requests(spark, sf_dir).drop("o_orderdate")


@register("approval_queue", f"""WITH {RISK_CTE}
SELECT left(md5(action || 'order-' || o_orderkey ||
                CASE WHEN epoch_us(o_orderdate) % 1000000 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
                     ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') END), 8) AS id,
       action, 'order-' || o_orderkey AS target, environment, risk_level,
       CASE WHEN auto_approve THEN 'approved' ELSE 'pending' END AS status
FROM ra WHERE requires_approval""")
def approval_queue(spark, sf_dir):
    """Approval requests (risk above none) with md5-based ids; safe ones auto-approved."""
    r = _requests(spark, sf_dir).where("requires_approval")
    target = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    return r.select(rk.request_id(F.col("action"), target, rk.iso(F.col("o_orderdate"))).alias("id"),
                    "action", target.alias("target"), "environment", "risk_level",
                    F.when(F.col("auto_approve"), "approved").otherwise("pending").alias("status"))


def _class_sql(text_expr: str) -> list[str]:
    out = []
    for name, words in rk.CLASS_RULES:
        cond = " OR ".join(f"contains(lower({text_expr}), '{w}')" for w in words)
        out.append(f"bool_or({cond})")
    return out


def _class_case(flags: list[str]) -> str:
    s = "CASE " + " ".join(f"WHEN {f} THEN '{rk.CLASS_RULES[i][0]}'" for i, f in enumerate(flags))
    return s + " ELSE 'unknown' END"


@register("incident_class", f"""
SELECT conv_id, {_class_case(_class_sql('text'))} AS incident_type FROM conversations GROUP BY conv_id""")
def incident_class(spark, sf_dir):
    """Conversations as incidents (every turn a symptom or the title)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "text")
    return rk.classify_parts(c, "conv_id", "text")


PLAY_SQL = "(VALUES " + ", ".join(
    f"('{t}', {i}, '{a}', '{d}', {str(auto).lower()}, {('NULL' if r is None else repr(r))})"
    for t, (_, acts) in rk.PLAYBOOKS.items() for i, (a, d, auto, r) in enumerate(acts)
) + ") pb(incident_type, seq, action, description, automated, risk)"


@register("response_plan", f"""
WITH inc AS (SELECT user_id || '-' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS incident_id,
                    {_class_case(_class_sql('event_type'))} AS incident_type
             FROM events GROUP BY 1),
p AS (SELECT inc.incident_id, inc.incident_type, pb.seq, pb.action, pb.description,
             coalesce(pb.risk, 'medium') AS risk_level,
             contains(pb.action, 'delete') OR contains(pb.action, 'terminate') OR contains(pb.action, 'drop')
               AS destructive, pb.automated
      FROM inc JOIN {PLAY_SQL} ON pb.incident_type = inc.incident_type),
q AS (SELECT incident_id, incident_type, seq::INTEGER AS seq, action, description,
             automated AND NOT (destructive OR risk_level IN ('high', 'critical')) AS automated,
             risk_level, destructive OR risk_level IN ('high', 'critical') AS needs_approval,
             CASE WHEN destructive THEN 'Requires explicit approval (destructive action)'
                  WHEN risk_level IN ('high', 'critical') THEN 'Risk level: ' || risk_level END AS reason,
             '5-10 min' AS estimated_duration FROM p)
SELECT *, row_number() OVER (PARTITION BY incident_id, automated ORDER BY seq) AS list_rank FROM q""")
def response_plan(spark, sf_dir):
    """Incidents = (user, day); symptoms = its event types; plan from the playbooks."""
    ev = table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.to_date("ts"), "yyyy-MM-dd"))
        .alias("incident_id"), "event_type")
    inc = rk.classify_parts(ev, "incident_id", "event_type")
    return rk.response_plan(inc, rk.playbook_actions(spark), "incident_id")


ROUTE_CTE = """
al AS (SELECT event_id, user_id,
              CASE WHEN value > 100 THEN 'critical' WHEN value > 50 THEN 'error'
                   WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity,
              CASE user_id % 4 WHEN 0 THEN ['slack'] WHEN 1 THEN ['slack', 'pagerduty']
                   WHEN 2 THEN ['pagerduty', 'webhook'] ELSE [] END AS channels,
              'Error event ' || event_id AS title, 'value ' || value AS message, 'aiops-agent' AS source
       FROM events WHERE event_type = 'error'),
ex AS (SELECT *, unnest(CASE WHEN len(channels) = 0 THEN ['slack'] ELSE list_distinct(channels) END) AS channel
       FROM al),
rt AS (SELECT * FROM ex WHERE channel IN ('slack', 'webhook')
                           OR (channel = 'pagerduty' AND severity IN ('error', 'critical')))"""


@derived
def _alerts(spark, sf_dir):
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    v = F.col("value")
    sev = (F.when(v > 100, "critical").when(v > 50, "error").when(v > 20, "warning").otherwise("info"))
    k = F.col("user_id") % 4
    ch = (F.when(k == 0, F.array(F.lit("slack"))).when(k == 1, F.array(F.lit("slack"), F.lit("pagerduty")))
          .when(k == 2, F.array(F.lit("pagerduty"), F.lit("webhook"))).otherwise(F.array().cast("array<string>")))
    return ev.select("event_id", "user_id", sev.alias("severity"), ch.alias("channels"),
                     F.concat(F.lit("Error event "), F.col("event_id").cast("string")).alias("title"),
                     F.concat(F.lit("value "), v.cast("string")).alias("message"),
                     F.lit("aiops-agent").alias("source"))


@register("notification_routes", f"""WITH {ROUTE_CTE}
SELECT event_id, channel, severity,
       CASE severity WHEN 'debug' THEN 'info' WHEN 'info' THEN 'info' WHEN 'warning' THEN 'warning'
            WHEN 'error' THEN 'error' WHEN 'critical' THEN 'critical' ELSE 'error' END AS pd_severity
FROM rt""")
def notification_routes(spark, sf_dir):
    """Error events as alerts: severity from value, channels from user; pager only for error/critical."""
    r = rk.route(_alerts(spark, sf_dir))
    return r.select("event_id", "channel", "severity", rk.pd_severity(F.col("severity")).alias("pd_severity"))


@register("approval_latest_state", """
WITH ev AS (SELECT l_orderkey AS request_id, l_shipdate + to_seconds(l_linenumber) AS ts, l_linenumber,
                   l_suppkey, l_partkey,
                   CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'F' THEN 'approved'
                        ELSE 'pending' END AS status,
                   'approver' || (l_suppkey % 10) AS approver FROM lineitem)
SELECT request_id, arg_max(status, (ts, l_linenumber, l_suppkey, l_partkey, status)) AS status,
       arg_max(approver, (ts, l_linenumber, l_suppkey, l_partkey, status)) AS approver, max(ts) AS ts, count(*) AS events
FROM ev GROUP BY request_id""")
def approval_latest_state(spark, sf_dir):
    """Approval events from lineitem (one per line); current state = latest event per request."""
    li = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_linenumber").cast("decimal(18,6)"))
    st = (F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "F", "approved")
          .otherwise("pending"))
    ev = li.select(F.col("l_orderkey").alias("request_id"), ts.alias("ts"), "l_linenumber",
                   "l_suppkey", "l_partkey",
                   st.alias("status"), F.concat(F.lit("approver"), (F.col("l_suppkey") % 10).cast("string")).alias("approver"))
    return rk.latest_state(ev, "request_id", ["ts", "l_linenumber", "l_suppkey", "l_partkey", "status"],
                           ["status", "approver", "ts"])


@register("approval_expiry", """
WITH rq AS (SELECT o_orderkey AS request_id, o_orderdate AS requested_at,
                   o_orderdate + INTERVAL 5184000 SECOND AS deadline FROM orders),
d AS (SELECT l_orderkey AS request_id, l_shipdate AS decided_at,
             CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END AS status
      FROM lineitem WHERE l_linestatus = 'F'),
now AS (SELECT max(l_shipdate) AS now FROM lineitem),
f AS (SELECT d.request_id, arg_min(d.status, (d.decided_at, d.status)) AS status, min(d.decided_at) AS decided_at
      FROM d JOIN rq USING (request_id) WHERE d.decided_at <= rq.deadline AND d.decided_at >= rq.requested_at GROUP BY 1)
SELECT rq.request_id, rq.requested_at, rq.deadline,
       CASE WHEN f.status IS NOT NULL THEN f.status WHEN now.now > rq.deadline THEN 'expired'
            ELSE 'pending' END AS status, f.decided_at
FROM rq LEFT JOIN f USING (request_id), now""")
def approval_expiry(spark, sf_dir):
    """Orders as requests, finished lines as decisions; 60-day timeout; now = last ship date."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"),
                                              F.col("o_orderdate").alias("requested_at"))
    li = table(spark, sf_dir, "lineitem")
    d = li.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").alias("decided_at"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("status"))
    now = li.agg(F.max("l_shipdate")).scalar()  # scalar subquery, evaluated once
    return rk.expire(o, d, "request_id", now, timeout_seconds=60 * 86400)
