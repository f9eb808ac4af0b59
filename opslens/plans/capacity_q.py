"""Registered capacity queries: daily mean value per event type as the series."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import capacity as cap
from opslens.plans.derive import daily_metric
from opslens.plans.registry import derived, register
from opslens.tables import table

SERIES_CTE = """
d AS (SELECT event_type AS metric, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS x,
             count(*) OVER (PARTITION BY metric) AS n FROM d),
t AS (SELECT metric, any_value(n) AS n, coalesce(regr_slope(y, x), 0) AS slope,
             avg(y) - coalesce(regr_slope(y, x), 0) * avg(x) AS intercept,
             avg(y) FILTER (WHERE x < n // 2) AS h1, avg(y) FILTER (WHERE x >= n // 2) AS h2,
             max(day) AS base_day
      FROM s GROUP BY metric HAVING count(*) >= 7),
f AS (SELECT metric, i AS step, base_day + CAST(i AS INTEGER) AS day,
             greatest(0.0, slope * (n + i) + intercept) AS value
      FROM t, range(1, 31) r(i))"""


@derived
def _trend(spark, sf_dir):
    s = cap.daily_series(daily_metric(spark, sf_dir), "metric", "day", "y")
    return cap.trend(s, "metric")


@register("linear_forecast", f"""WITH {SERIES_CTE}
SELECT metric, CAST(step AS INTEGER) AS step, strftime(day, '%Y-%m-%d') AS day, round(value, 6) AS value FROM f""")
def linear_forecast(spark, sf_dir):
    f = cap.linear_forecast(_trend(spark, sf_dir), "metric", horizon=30)
    return f.select("metric", "step", F.date_format("day", "yyyy-MM-dd").alias("day"),
                    F.round("value", 6).alias("value"))


@register("forecast_first_week", f"""WITH {SERIES_CTE}
SELECT metric, CAST(step AS INTEGER) AS step, round(value, 6) AS value FROM f WHERE step <= 7""")
def forecast_first_week(spark, sf_dir):
    f = cap.linear_forecast(_trend(spark, sf_dir), "metric", horizon=30)
    return f.where(F.col("step") <= 7).select("metric", "step", F.round("value", 6).alias("value"))


@register("growth_rate", f"""WITH {SERIES_CTE}
SELECT metric, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(CASE WHEN h1 > 0 THEN (h2 - h1) / h1 * 100 ELSE 0 END, 6) AS growth_rate FROM t""")
def growth_rate(spark, sf_dir):
    t = _trend(spark, sf_dir)
    return t.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "growth_rate")])


@register("breach_date", f"""WITH {SERIES_CTE},
b AS (SELECT metric, min(step) AS days_until_breach, min(day) AS breach_day FROM f
      WHERE value > 50.0 GROUP BY metric)
SELECT t.metric, CAST(b.days_until_breach AS DOUBLE) AS days_until_breach,
       strftime(b.breach_day, '%Y-%m-%d') AS breach_day,
       CASE WHEN b.breach_day IS NULL THEN NULL WHEN b.days_until_breach < 7 THEN 'high'
            ELSE 'medium' END AS urgency
FROM t LEFT JOIN b ON b.metric = t.metric""")
def breach_date(spark, sf_dir):
    """First forecast day above capacity 50 (daily mean value)."""
    r = cap.forecast_report(_trend(spark, sf_dir), "metric", horizon=30, threshold=50.0)
    return r.select("metric", F.col("days_until_breach").cast("double").alias("days_until_breach"),
                    F.date_format("breach_day", "yyyy-MM-dd").alias("breach_day"), "urgency")


RIGHTSIZE_SQL = """
WITH u AS (SELECT p_partkey AS instance_id, p_type AS instance_type, p_size * 2.0 AS avg_cpu,
                  p_retailprice % 100 AS avg_memory FROM part),
r AS (SELECT *, CASE WHEN avg_cpu < 20 AND avg_memory < 40 THEN 'downgrade'
                     WHEN avg_cpu > 80 OR avg_memory > 85 THEN 'upgrade' ELSE 'keep' END AS rec FROM u)
SELECT instance_id, instance_type, avg_cpu, round(avg_memory, 6) AS avg_memory, rec AS recommended,
       CASE rec WHEN 'downgrade' THEN 'Low utilization ' WHEN 'upgrade' THEN 'High utilization '
            ELSE 'Utilization is appropriate ' END
       || printf('(CPU: %.0f%%, Memory: %.0f%%)', avg_cpu, avg_memory) AS reason,
       CASE WHEN rec = 'downgrade' THEN '30-50%' END AS estimated_savings
FROM r"""


@register("rightsize", RIGHTSIZE_SQL)
def rightsize(spark, sf_dir):
    """part as a fleet: cpu = 2 x size, memory = retail price mod 100."""
    util = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("instance_id"), F.col("p_type").alias("instance_type"),
        (F.col("p_size") * 2.0).alias("avg_cpu"), (F.col("p_retailprice") % 100).alias("avg_memory"))
    return cap.rightsize(util).withColumn("avg_memory", F.round("avg_memory", 6))


COST_SQL = """
WITH fleet AS (SELECT CASE p_size % 5 WHEN 0 THEN 't3.micro' WHEN 1 THEN 't3.small'
                       WHEN 2 THEN 't3.medium' WHEN 3 THEN 't3.large' ELSE 'm5.xlarge' END AS instance_type,
                      count(*) AS count FROM part GROUP BY ALL),
pr AS (SELECT * FROM (VALUES ('t3.micro', 0.0104::DOUBLE), ('t3.small', 0.0208::DOUBLE),
                             ('t3.medium', 0.0416::DOUBLE), ('t3.large', 0.0832::DOUBLE)) v(instance_type, hourly))
SELECT f.instance_type, f.count, coalesce(hourly, 0.0416::DOUBLE) AS hourly_rate,
       round(coalesce(hourly, 0.0416::DOUBLE) * 24 * 30 * f.count, 2) AS monthly_usd,
       round(coalesce(hourly, 0.0416::DOUBLE) * 24 * 30 * f.count * 12, 2) AS yearly_usd
FROM fleet f LEFT JOIN pr USING (instance_type)"""


@register("cost_estimate", COST_SQL)
def cost_estimate(spark, sf_dir):
    """Fleet = parts bucketed by size into instance types (one unknown type)."""
    types = F.element_at(F.array(*[F.lit(t) for t in
                                   ("t3.micro", "t3.small", "t3.medium", "t3.large", "m5.xlarge")]),
                         (F.col("p_size") % 5 + 1).cast("int"))
    fleet = table(spark, sf_dir, "part").groupBy(types.alias("instance_type")).agg(
        F.count(F.lit(1)).alias("count"))
    return cap.estimate_cost(fleet, cap.price_table(spark))
