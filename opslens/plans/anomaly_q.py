"""Registered anomaly queries (events as metric points)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import anomaly
from opslens.operators.ordered import ORD
from opslens.plans.derive import ROUGH_SQL, metric_points, rough_points
from opslens.plans.registry import register

R = 6


def _rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, R))
    return df


PLAIN_SQL = "(SELECT event_type AS metric, ts, event_id AS id, value FROM events)"


def _sigma_rows(thr: float, points: str = PLAIN_SQL) -> str:
    """A window with a NaN has no mean; rows without a value are no points."""
    return f"""
  SELECT metric, ts, id, value, n, mean, std, abs(value - mean) / std AS dev FROM (
    SELECT metric, ts, id, value, row_number() OVER w0 AS n, count(*) FILTER (WHERE isnan(value)) OVER w AS nans,
           avg(value) FILTER (WHERE NOT isnan(value)) OVER w AS mean, stddev_samp(value) FILTER (WHERE NOT isnan(value)) OVER w AS std
    FROM {points} WHERE value IS NOT NULL
    WINDOW w0 AS (PARTITION BY metric ORDER BY ts, id NULLS FIRST, value),
           w AS (PARTITION BY metric ORDER BY ts, id NULLS FIRST, value ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
  WHERE n >= 10 AND nans = 0 AND std > 0 AND abs(value - mean) / std > {thr}"""


def _sigma_sql(points: str) -> str:
    return f"""
SELECT metric, ts, id, value, round(mean, 6) AS expected_value, round(dev, 6) AS deviation,
       CASE WHEN dev > 6 THEN 'critical' ELSE 'warning' END AS severity,
       printf('Value %.2f is %.1f std from mean %.2f', value, dev, mean) AS description
FROM ({_sigma_rows(3.0, points)})
"""


SIGMA_SQL = _sigma_sql(ROUGH_SQL)
SIGMA_PLAIN_SQL = _sigma_sql(PLAIN_SQL)


@register("rolling_sigma_anomalies", SIGMA_SQL)
def rolling_sigma_anomalies(spark, sf_dir):
    """Sigma detector over points with repeats, missing ids and values, ties and NaN."""
    return _rounded(anomaly.rolling_sigma(rough_points(spark, sf_dir)),
                    "expected_value", "deviation")


def _ewma_cte(alpha: float, seed_k: int = 8, points: str = PLAIN_SQL) -> str:
    a = 1.0 - alpha
    return f"""
WITH RECURSIVE p AS (
  SELECT metric, ts, id, value, row_number() OVER w - 1 AS k, first_value(value) OVER w AS x0
  FROM {points} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY metric ORDER BY ts, id NULLS FIRST, value)),
r AS (
  SELECT metric, k, ts, id, value, {alpha}::DOUBLE * value + {a}::DOUBLE * x0 AS e,
         {a}::DOUBLE * ({alpha}::DOUBLE * pow(value - ({alpha}::DOUBLE * value + {a}::DOUBLE * x0), 2)) AS v
  FROM p WHERE k = {seed_k + 1}
  UNION ALL
  SELECT p.metric, p.k, p.ts, p.id, p.value,
         {alpha}::DOUBLE * p.value + {a}::DOUBLE * r.e AS e,
         {a}::DOUBLE * (r.v + {alpha}::DOUBLE * pow(p.value - ({alpha}::DOUBLE * p.value + {a}::DOUBLE * r.e), 2)) AS v
  FROM r JOIN p ON p.metric IS NOT DISTINCT FROM r.metric AND p.k = r.k + 1)"""


EWMA_SQL = _ewma_cte(0.3, points=ROUGH_SQL) + """
SELECT metric, ts, id, value, round(e, 6) AS expected_value,
       round(abs(value - e) / sqrt(v), 6) AS deviation,
       CASE WHEN abs(value - e) / sqrt(v) > 4.0 THEN 'critical' ELSE 'warning' END AS severity,
       printf('EWMA deviation: %.1f std', abs(value - e) / sqrt(v)) AS description
FROM r WHERE v > 0 AND NOT isnan(v) AND abs(value - e) / sqrt(v) > 2.0
"""


@register("ewma_anomalies", EWMA_SQL)
def ewma_anomalies(spark, sf_dir):
    """EWMA detector, alpha 0.3, threshold 2.0 (the default 3.0 cannot fire)."""
    return _rounded(anomaly.ewma(rough_points(spark, sf_dir), alpha=0.3, threshold=2.0),
                    "expected_value", "deviation")


STATS_SQL = _ewma_cte(0.3) + """,
last AS (
  SELECT metric, value FROM (
    SELECT event_type AS metric, value,
           row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn <= 1000),
fin AS (SELECT metric, arg_max(e, k) AS e FROM r GROUP BY metric)
SELECT l.metric, count(*) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
       round(any_value(fin.e), 6) AS ewma
FROM last l JOIN fin ON fin.metric = l.metric
GROUP BY l.metric HAVING count(*) >= 2
"""


@register("metric_stats", STATS_SQL)
def metric_stats(spark, sf_dir):
    return _rounded(anomaly.metric_stats(metric_points(spark, sf_dir)), "mean", "std", "ewma")


HISTORY_SQL = """
SELECT metric, rank, ts, id, value FROM (
  SELECT event_type AS metric, ts, event_id AS id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank
  FROM events) WHERE rank <= 100
"""


@register("metric_history_last_n", HISTORY_SQL)
def metric_history_last_n(spark, sf_dir):
    return anomaly.history(metric_points(spark, sf_dir), limit=100)


COOLDOWN_SQL = f"""
WITH RECURSIVE a AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n) AS k,
         epoch_us(ts) / 1e6 AS t
  FROM ({_sigma_rows(1.5, ROUGH_SQL)})),
r AS (
  SELECT metric, k, t AS last_t, true AS emitted FROM a WHERE k = 1
  UNION ALL
  SELECT a.metric, a.k,
         CASE WHEN a.t > r.last_t + 21600 THEN a.t ELSE r.last_t END,
         a.t > r.last_t + 21600
  FROM r JOIN a ON a.metric IS NOT DISTINCT FROM r.metric AND a.k = r.k + 1)
SELECT a.metric, a.ts, a.id, a.value, round(a.mean, 6) AS expected_value,
       round(a.dev, 6) AS deviation,
       CASE WHEN a.dev > 3.0 THEN 'critical' ELSE 'warning' END AS severity
FROM a JOIN r ON r.metric IS NOT DISTINCT FROM a.metric AND r.k = a.k WHERE r.emitted
"""


@register("cooldown_alerts", COOLDOWN_SQL)
def cooldown_alerts(spark, sf_dir):
    """Sigma anomalies at threshold 1.5 through a 6 h per-metric cooldown."""
    an = anomaly.rolling_sigma(rough_points(spark, sf_dir), threshold=1.5, extra=(ORD,))
    kept = anomaly.cooldown(an, seconds=21600)
    return _rounded(kept.drop("description", ORD), "expected_value", "deviation")


CHECK_SQL = f"""
WITH an AS ({_sigma_rows(3.0)}),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
SELECT strftime(days.d, '%Y-%m-%d') AS day, count(an.id) AS anomalies,
       count(an.id) FILTER (WHERE an.dev > 6) AS critical,
       CASE WHEN count(an.id) FILTER (WHERE an.dev > 6) > 0 THEN 'critical'
            WHEN count(an.id) > 0 THEN 'warning' ELSE 'success' END AS status
FROM days LEFT JOIN an ON CAST(an.ts AS DATE) = days.d
GROUP BY days.d
"""


@register("check_status", CHECK_SQL)
def check_status(spark, sf_dir):
    """Daily check status over the sigma detector's output."""
    pts = metric_points(spark, sf_dir)
    an = anomaly.rolling_sigma(pts).select(F.to_date("ts").alias("d"), "severity")
    days = pts.select(F.to_date("ts").alias("d")).distinct()
    res = anomaly.check_status(days.join(an, "d", "left"), ["d"])
    return res.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "anomalies", "critical", "status")
