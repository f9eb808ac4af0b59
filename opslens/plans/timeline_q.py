"""Registered timeline / correlation queries (events as incidents per user)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import timeline as tlo
from opslens.operators.ordered import ORD, with_ordinal
from opslens.plans.derive import incident_parts, metric_points
from opslens.plans.registry import derived, register

TL_CTE = """
tl AS (
  SELECT user_id AS incident_id, ts, 'alert' AS event_type,
         'Alert: alert_k' || json_extract_string(props, '$.k') AS description,
         CASE WHEN events.event_type = 'click' THEN 'rum' ELSE 'monitoring' END AS source, 0 AS tr, event_id AS in_ord
  FROM events WHERE events.event_type IN ('error', 'click')
  UNION ALL
  SELECT user_id, ts, 'config_change', 'Change: deploy ' || event_id,
         CASE WHEN value > 50 THEN 'ci' ELSE 'unknown' END, 1, event_id
  FROM events WHERE event_type = 'signup'
  UNION ALL
  SELECT user_id, ts, 'related_incident', 'Related: ' || event_type || ' ' || event_id, 'incident_db', 2, event_id
  FROM events WHERE event_type IN ('purchase', 'view')),
tlo AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, tr, in_ord) - 1 AS ord FROM tl)"""


@derived
def _timeline(spark, sf_dir):
    return tlo.timeline(*incident_parts(spark, sf_dir))


@register("incident_timeline", f"WITH {TL_CTE} "
          "SELECT incident_id, ord, ts, event_type, description, source FROM tlo")
def incident_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir).drop("in_ord")


def _gap_sql(gap_s: int) -> str:
    return f"""WITH {TL_CTE},
s AS (SELECT *, sum(CASE WHEN pts IS NULL OR epoch_us(ts) - epoch_us(pts) >= {gap_s * 1_000_000}
                       THEN 1 ELSE 0 END) OVER (PARTITION BY incident_id ORDER BY ord
                                               ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS cluster
      FROM (SELECT *, lag(ts) OVER (PARTITION BY incident_id ORDER BY ord) AS pts FROM tlo))
SELECT incident_id, cluster, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts,
       arg_min(description, ord) AS first_event, arg_max(description, ord) AS last_event
FROM s GROUP BY incident_id, cluster HAVING count(*) >= 2"""


@register("gap_clusters", _gap_sql(3600))
def gap_clusters(spark, sf_dir):
    """Per incident timeline, clusters split at gaps >= 1 hour."""
    cl = tlo.gap_clusters(_timeline(spark, sf_dir), ["incident_id"], gap_seconds=3600)
    return tlo.cluster_summary(cl, ["incident_id"])


GLOBAL_GAP_SQL = """
WITH o AS (SELECT event_id, ts, event_type || ' ' || event_id AS description,
                  row_number() OVER (ORDER BY ts, event_id) - 1 AS ord,
                  lag(ts) OVER (ORDER BY ts, event_id) AS pts FROM events),
s AS (SELECT *, sum(CASE WHEN pts IS NULL OR epoch_us(ts) - epoch_us(pts) >= 300000000
                       THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS cluster
      FROM o)
SELECT 'all' AS stream, cluster, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts,
       arg_min(description, ord) AS first_event, arg_max(description, ord) AS last_event
FROM s GROUP BY cluster HAVING count(*) >= 2"""


@register("gap_clusters_global", GLOBAL_GAP_SQL)
def gap_clusters_global(spark, sf_dir):
    """All events as one stream (a single hot key by construction), 5-minute gaps."""
    ev = metric_points(spark, sf_dir).select(
        F.lit("all").alias("stream"), "ts", "id",
        F.concat_ws(" ", "metric", F.col("id").cast("string")).alias("description"))
    o = with_ordinal(ev, ["stream"], ["ts", "id"], out="ord")
    cl = tlo.gap_clusters(o, ["stream"], gap_seconds=300)
    return tlo.cluster_summary(cl, ["stream"])


@register("source_frequency", f"WITH {TL_CTE} SELECT incident_id, source, count(*) AS count "
          "FROM tl GROUP BY ALL")
def source_frequency(spark, sf_dir):
    return tlo.source_counts(_timeline(spark, sf_dir))


@register("incident_duration", f"""WITH {TL_CTE},
d AS (SELECT incident_id, count(*) AS events, min(ts) AS start, max(ts) AS "end",
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM tl GROUP BY incident_id)
SELECT incident_id, events, start, "end", round(seconds, 6) AS seconds,
       CASE WHEN events < 2 THEN 'Unknown'
            WHEN seconds < 60 THEN printf('%.0f seconds', seconds)
            WHEN seconds < 3600 THEN printf('%.0f minutes', seconds / 60)
            ELSE printf('%.1f hours', seconds / 3600) END AS duration
FROM d""")
def incident_duration(spark, sf_dir):
    return tlo.incident_duration(_timeline(spark, sf_dir)).withColumn(
        "seconds", F.round("seconds", 6))


@register("change_before_alert", """
WITH a AS (SELECT user_id AS incident_id, min(ts) AS first_alert FROM events
           WHERE event_type IN ('error', 'click') GROUP BY user_id),
c AS (SELECT e.user_id AS incident_id, a.first_alert, e.ts, e.event_id
      FROM events e JOIN a ON a.incident_id = e.user_id
      WHERE e.event_type = 'signup' AND e.ts < a.first_alert)
SELECT incident_id, first_alert, arg_max(ts, (ts, event_id)) AS change_ts,
       arg_max(event_id, (ts, event_id)) AS change_id,
       'Change in svc' || (arg_max(event_id, (ts, event_id)) % 7) || ': deploy '
         || arg_max(event_id, (ts, event_id)) AS root_cause
FROM c GROUP BY incident_id, first_alert""")
def change_before_alert(spark, sf_dir):
    alerts, changes, _ = incident_parts(spark, sf_dir)
    return tlo.change_before_alert(alerts, changes)


@register("change_before_each_alert", """
WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS incident_id FROM events),
a AS (SELECT incident_id, ts, event_id FROM e WHERE event_type IN ('error', 'click')),
c AS (SELECT incident_id, ts, event_id FROM e WHERE event_type = 'signup')
SELECT a.incident_id, a.event_id AS alert_id, a.ts AS fired_at, c.ts AS change_ts, c.event_id AS change_id,
       'Change in svc' || (c.event_id % 7) || ': deploy ' || c.event_id AS root_cause
FROM a ASOF LEFT JOIN c ON a.incident_id = c.incident_id AND a.ts > c.ts""")
def change_before_each_alert(spark, sf_dir):
    """Each alert's latest earlier change; a third of all users are one incident."""
    alerts, changes, _ = incident_parts(spark, sf_dir)
    hot = F.when(F.col("incident_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("incident_id"))
    return tlo.change_before_each_alert(alerts.withColumn("incident_id", hot), changes.withColumn("incident_id", hot))
