"""Registered alerting / metric-series queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import alerts as al
from opslens.operators import timeline as tlo
from opslens.operators.ordered import epoch_seconds, with_ordinal
from opslens.plans.registry import derived, register
from opslens.session import materialize
from opslens.tables import table

R = 6

# event type -> template key ('signup' has no template and is dropped)
KEY_OF_TYPE = {"error": "error_rate", "view": "latency", "click": "cpu", "purchase": "queue"}

KEY_SQL = ("CASE event_type WHEN 'error' THEN 'error_rate' WHEN 'view' THEN 'latency' "
           "WHEN 'click' THEN 'cpu' WHEN 'purchase' THEN 'queue' ELSE event_type END")

TPL_SQL = ("(VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}', '{}', '{}')".format(*[v.replace("'", "''") for v in t])
    for t in al.ALERT_TEMPLATES) + ") tpl(key, metric, threshold, duration, severity, description)")


def _key(col="event_type"):
    m = F.create_map(*[F.lit(x) for kv in KEY_OF_TYPE.items() for x in kv])
    return F.coalesce(m[F.col(col)], F.col(col))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register("alert_rules", f"""
SELECT tpl.key, upper(tpl.key) || '_ALERT' AS name, tpl.metric || ' > ' || tpl.threshold AS expr,
       duration AS "for", severity, 'platform' AS team, description,
       'runbooks/' || tpl.key || '.md' AS runbook
FROM (SELECT DISTINCT {KEY_SQL} AS key FROM events) k JOIN {TPL_SQL} ON tpl.key = k.key""")
def alert_rules(spark, sf_dir):
    keys = _events(spark, sf_dir).select(_key().alias("key")).distinct()
    return al.alert_rules(keys, al.templates(spark)).select(
        "key", "name", "expr", "for", "severity", "team", "description", "runbook")


@register("alert_rules_text", f"""
SELECT upper(tpl.key) || '_ALERT' AS name,
       printf('\n      - alert: %s\n        expr: %s\n        for: %s\n        labels:\n          severity: %s\n          team: %s\n        annotations:\n          description: "%s"\n          runbook: "%s"\n',
              upper(tpl.key) || '_ALERT', tpl.metric || ' > ' || tpl.threshold, duration, severity,
              'platform', description, 'runbooks/' || tpl.key || '.md') AS yaml
FROM (SELECT DISTINCT {KEY_SQL} AS key FROM events) k JOIN {TPL_SQL} ON tpl.key = k.key""")
def alert_rules_text(spark, sf_dir):
    keys = _events(spark, sf_dir).select(_key().alias("key")).distinct()
    return al.rules_text(al.alert_rules(keys, al.templates(spark)))


@register("rule_breaches", f"""
SELECT upper(tpl.key) || '_ALERT' AS name, count(*) AS breaches, min(e.ts) AS first_ts,
       max(e.ts) AS last_ts, max(e.value) AS max_value
FROM events e JOIN {TPL_SQL} ON tpl.key = {KEY_SQL.replace('event_type', 'e.event_type')}
 AND e.value > CAST(tpl.threshold AS DOUBLE)
GROUP BY 1""")
def rule_breaches(spark, sf_dir):
    pts = _events(spark, sf_dir).select(_key().alias("key"), "ts", "value")
    rules = al.alert_rules(pts.select("key").distinct(), al.templates(spark))
    return al.breach_summary(pts, rules).select("name", "breaches", "first_ts", "last_ts", "max_value")


@register("breaching_points", f"""
SELECT e.event_id, upper(tpl.key) || '_ALERT' AS name, severity
FROM events e JOIN {TPL_SQL} ON tpl.key = {KEY_SQL.replace('event_type', 'e.event_type')}
 AND e.value > CAST(tpl.threshold AS DOUBLE)""")
def breaching_points(spark, sf_dir):
    """Each breaching point with the rules it breaches."""
    pts = _events(spark, sf_dir).select(_key().alias("key"), "event_id", "value")
    rules = al.alert_rules(pts.select("key").distinct(), al.templates(spark))
    return al.evaluate_rules(pts, rules).select("event_id", "name", "severity")


@register("threshold_ladder", """
WITH r AS (SELECT 'rule_' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'all' ELSE (['error', 'view', 'click'])[p_size % 3 + 1] END AS key,
                  p_retailprice / 4 AS threshold FROM part),
p AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'all' ELSE event_type END AS key, round(value, 0) AS v, ts, count(*) AS n FROM events GROUP BY ALL)
SELECT key, name, sum(n)::BIGINT AS breaches, min(ts) AS first_ts, max(ts) AS last_ts, max(v) AS max_value
FROM p JOIN r USING (key) WHERE v > threshold GROUP BY ALL""")
def threshold_ladder(spark, sf_dir):
    """A rule for every part, half of them on one metric that has a third of all points: breaches by rule."""
    price = table(spark, sf_dir, "part").select(
        F.concat(F.lit("rule_"), F.col("p_partkey").cast("string")).alias("name"), F.lit("warning").alias("severity"),
        F.when(F.col("p_partkey") % 2 == 0, "all").otherwise(
            F.element_at(F.array(F.lit("error"), F.lit("view"), F.lit("click")), (F.col("p_size") % 3 + 1).cast("int"))).alias("key"),
        (F.col("p_retailprice") / 4).alias("threshold"))
    pts = _events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, "all").otherwise(F.col("event_type")).alias("key"),
                                        "ts", F.round("value", 0).alias("value"))
    return al.breach_summary(pts, price)


@register("sketch_percentiles", """
SELECT event_type AS metric, count(*) AS n, unnest([0.5, 0.9, 0.99]) AS p, true AS within FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26' GROUP BY 1""")
def sketch_percentiles(spark, sf_dir):
    """Percentiles over three weeks merged from sketches kept per metric and day (written and read back): whether
    the exact rank of each answer is within 1 % of the rank asked for."""
    ev = _events(spark, sf_dir).select(F.col("event_type").alias("metric"), F.to_date("ts").alias("day"), "value")
    kept = materialize(al.quantile_sketches(ev, ["metric", "day"], "value"), "day-sketches")
    weeks = F.col("day").between("2024-01-05", "2024-01-25")
    found = al.sketch_quantiles(kept.where(weeks), ["metric"], [0.5, 0.9, 0.99])
    asked = found.select("metric", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{round(p * 100)}").alias("v"))
                                                            for p in (0.5, 0.9, 0.99)])).alias("a"))
    # the rank of an answer is a range if values repeat
    ranks = ev.where(weeks).join(asked, "metric").groupBy("metric", "n", F.col("a.p").alias("p")).agg(
        F.count_if(F.col("value") < F.col("a.v")).alias("below"), F.count_if(F.col("value") <= F.col("a.v")).alias("upto"))
    slack = F.greatest(F.lit(0.01) * F.col("n"), F.lit(1.0))
    return ranks.select("metric", "n", "p", ((F.col("below") <= F.col("p") * F.col("n") + slack) &
                                             (F.col("upto") >= F.col("p") * F.col("n") - slack)).alias("within"))


@register("counter_rate", """
WITH e0 AS (SELECT event_type AS metric, CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts, event_id AS id FROM events),
e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY metric, CAST(ts AS DATE) ORDER BY ts, id) AS counter,
             row_number() OVER (PARTITION BY metric ORDER BY ts, id) AS k FROM e0),
l AS (SELECT *, lag(counter) OVER w AS pc, lag(us) OVER w AS pus FROM e
      WINDOW w AS (PARTITION BY metric ORDER BY ts, id)),
d AS (SELECT *, CASE WHEN pc IS NULL THEN 0.0 WHEN counter < pc THEN counter::DOUBLE
                     ELSE (counter - pc)::DOUBLE END AS delta FROM l)
SELECT metric, ts, id, counter,
       round((sum(delta) OVER r - arg_min(delta, k) OVER r) / 300, 6) AS rate,
       round(CASE WHEN pc IS NULL THEN NULL ELSE delta / nullif((us - pus) / 1e6, 0) END, 6) AS irate
FROM d WINDOW r AS (PARTITION BY metric ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)""")
def counter_rate(spark, sf_dir):
    """Counter = running event count per metric and day (daily reset); every fifth event is put at
    its full hour, so samples share timestamps."""
    ts = F.when(F.col("event_id") % 5 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    ev = _events(spark, sf_dir).select(F.col("event_type").alias("metric"), ts.alias("ts"),
                                       F.col("event_id").alias("id"), F.to_date("ts").alias("day"))
    c = with_ordinal(ev, ["metric", "day"], ["ts", "id"], out="_o").withColumn("counter", F.col("_o") + 1).drop("_o", "day")
    r = al.counter_rates(c, ["metric"], window_seconds=300, like=ev)
    return r.select("metric", "ts", "id", "counter", F.round("rate", R).alias("rate"),
                    F.round("irate", R).alias("irate"))


@register("error_ratio", """
SELECT strftime(make_timestamp((epoch_us(ts) // 300000000) * 300000000), '%Y-%m-%d %H:%M:%S') AS period,
       count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS total,
       round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio
FROM events GROUP BY 1""")
def error_ratio(spark, sf_dir):
    """Error events over all events per 5-minute period (one pass)."""
    ev = _events(spark, sf_dir)
    g = ev.groupBy(al.bucket_start("ts", 300).alias("period")).agg(
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("ratio", F.round(al.ratio(F.col("errors"), F.col("total")), R))


@register("canary_compare", """
SELECT strftime(make_timestamp((epoch_us(ts) // 3600000000) * 3600000000), '%Y-%m-%d %H:%M:%S') AS period,
       count(*) FILTER (WHERE user_id % 2 = 0) AS stable_total,
       count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'error') AS stable_errors,
       count(*) FILTER (WHERE user_id % 2 = 1) AS canary_total,
       count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'error') AS canary_errors,
       round(count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'error')::DOUBLE
             / nullif(count(*) FILTER (WHERE user_id % 2 = 0), 0), 6) AS stable_ratio,
       round(count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'error')::DOUBLE
             / nullif(count(*) FILTER (WHERE user_id % 2 = 1), 0), 6) AS canary_ratio
FROM events GROUP BY 1""")
def canary_compare(spark, sf_dir):
    """Version = user_id parity (0 stable, 1 canary); hourly error ratios side by side."""
    ev = _events(spark, sf_dir)
    st, ca, err = F.col("user_id") % 2 == 0, F.col("user_id") % 2 == 1, F.col("event_type") == "error"
    g = ev.groupBy(al.bucket_start("ts", 3600).alias("period")).agg(
        F.count_if(st).alias("stable_total"), F.count_if(st & err).alias("stable_errors"),
        F.count_if(ca).alias("canary_total"), F.count_if(ca & err).alias("canary_errors"))
    return g.select("*", F.round(al.ratio(F.col("stable_errors"), F.col("stable_total")), R).alias("stable_ratio"),
                    F.round(al.ratio(F.col("canary_errors"), F.col("canary_total")), R).alias("canary_ratio"))


GRID_CTE = """
h AS (SELECT event_type AS metric, epoch_us(ts) // 3600000000 * 3600 AS hs, avg(value) AS avg_value
      FROM events GROUP BY ALL),
b AS (SELECT metric, min(hs) AS lo, max(hs) AS hi FROM h GROUP BY metric),
g AS (SELECT b.metric, unnest(range(lo, hi + 3600, 3600)) AS hs FROM b),
gr AS (SELECT g.metric, g.hs, h.avg_value, coalesce(h.avg_value > 60, false) AS breaching
       FROM g LEFT JOIN h ON h.metric = g.metric AND h.hs = g.hs),
al AS (SELECT *, sum(breaching::INTEGER) OVER (PARTITION BY metric ORDER BY hs
                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS alarm FROM gr)"""

HOUR_FMT = "strftime(make_timestamp(hs * 1000000), '%Y-%m-%d %H:%M:%S')"


@derived
def _hour_grid(spark, sf_dir):
    ev = _events(spark, sf_dir)
    h = ev.groupBy(F.col("event_type").alias("metric"),
                   (F.floor(epoch_seconds("ts") / 3600) * 3600).cast("long").alias("hs")).agg(
        F.avg("value").alias("avg_value"))
    g = al.period_grid(h, "metric", "hs", 3600)
    return al.n_of_m(g, "metric", "hs", F.col("avg_value") > 60, n=2, m=3)


def _hour_text(c="hs"):
    return F.date_format(F.timestamp_seconds(F.col(c)), "yyyy-MM-dd HH:mm:ss")


@register("n_of_m_alarm", f"""WITH {GRID_CTE}
SELECT metric, {HOUR_FMT} AS hour, round(avg_value, 6) AS avg_value, breaching, alarm FROM al""")
def n_of_m_alarm(spark, sf_dir):
    """Hourly mean value > 60 breaches; alarm at 2 of the last 3 hours; empty hours do not breach."""
    g = _hour_grid(spark, sf_dir)
    return g.select("metric", _hour_text().alias("hour"), F.round("avg_value", R).alias("avg_value"),
                    "breaching", "alarm")


@register("sustained_breach", f"""WITH {GRID_CTE},
r AS (SELECT *, sum((NOT breaching)::INTEGER) OVER (PARTITION BY metric ORDER BY hs
                ROWS UNBOUNDED PRECEDING) AS run FROM gr)
SELECT metric, strftime(make_timestamp(min(hs) * 1000000), '%Y-%m-%d %H:%M:%S') AS run_start,
       strftime(make_timestamp(max(hs) * 1000000), '%Y-%m-%d %H:%M:%S') AS run_end, count(*) AS periods
FROM r WHERE breaching GROUP BY metric, run HAVING count(*) >= 2""")
def sustained_breach(spark, sf_dir):
    """Breach held for at least 2 consecutive hours (rule 'for')."""
    runs = al.sustained(_hour_grid(spark, sf_dir), "metric", "hs", "breaching", 2)
    return runs.select("metric", _hour_text("run_start").alias("run_start"),
                       _hour_text("run_end").alias("run_end"), "periods")


@register("alarm_transitions", f"""WITH {GRID_CTE},
s AS (SELECT *, CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS state FROM al),
t AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY metric ORDER BY hs), 'OK') AS previous FROM s)
SELECT metric, {HOUR_FMT} AS hour, previous, state FROM t WHERE state <> previous""")
def alarm_transitions(spark, sf_dir):
    """Alarm and recovery notifications: state changes of the 2-of-3 alarm."""
    st = F.when(F.col("alarm"), "ALARM").otherwise("OK")
    t = al.transitions(_hour_grid(spark, sf_dir), "metric", "hs", st)
    return t.select("metric", _hour_text().alias("hour"), "previous", "state")


@register("latency_percentiles", """
SELECT event_type AS metric, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    """Exact p50/p95/p99 per event type (value as latency)."""
    pts = _events(spark, sf_dir).select(F.col("event_type").alias("metric"), "value")
    q = al.exact_quantiles(pts, ["metric"], "value", [0.5, 0.95, 0.99])
    return q.select("metric", *[F.round(c, R).alias(c) for c in ("p50", "p95", "p99")])


LE = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@register("histogram_quantile", """
WITH b AS (SELECT event_type AS metric,
                  CASE """ + " ".join(f"WHEN value <= {x} THEN {x}::DOUBLE" for x in LE) + """
                       ELSE 'inf'::DOUBLE END AS le, count(*) AS cnt
           FROM events GROUP BY ALL
           UNION ALL SELECT DISTINCT 'idle_' || event_type, unnest([1.0, 5.0, 'inf'::DOUBLE]), 0 FROM events),
c0 AS (SELECT *, sum(cnt) OVER (PARTITION BY metric ORDER BY le ROWS UNBOUNDED PRECEDING) AS cum FROM b),
c AS (SELECT *, lag(le) OVER (PARTITION BY metric ORDER BY le) AS prev_le,
             coalesce(lag(cum) OVER (PARTITION BY metric ORDER BY le), 0) AS prev_cum,
             max(le) FILTER (WHERE le <> 'inf'::DOUBLE) OVER (PARTITION BY metric) AS prev_finite,
             sum(cnt) OVER (PARTITION BY metric) AS total FROM c0),
h AS (SELECT metric, arg_min(c, le) AS h FROM c WHERE cum >= 0.95 * total GROUP BY metric)
SELECT metric, round(CASE WHEN h.total = 0 THEN NULL WHEN h.le = 'inf'::DOUBLE THEN h.prev_finite
                          WHEN h.prev_le IS NULL AND h.le <= 0 THEN h.le
                          ELSE coalesce(h.prev_le, 0) + (h.le - coalesce(h.prev_le, 0))
                               * ((0.95 * h.total - h.prev_cum) / nullif(h.cum - h.prev_cum, 0)) END, 6) AS quantile
FROM h""")
def histogram_quantile(spark, sf_dir):
    """0.95 quantile from le-buckets of event value (1 .. 250, +Inf), and of series without any observation."""
    v = F.col("value")
    le = F.lit(float("inf"))
    for x in reversed(LE):
        le = F.when(v <= x, F.lit(x)).otherwise(le)
    b = _events(spark, sf_dir).groupBy(F.col("event_type").alias("metric"), le.alias("le")).agg(
        F.count(F.lit(1)).alias("cnt"))
    idle = _events(spark, sf_dir).select(F.concat(F.lit("idle_"), "event_type").alias("metric")).distinct()
    les = F.explode(F.array(F.lit(1.0), F.lit(5.0), F.lit(float("inf"))))
    b = b.unionByName(idle.select("metric", les.alias("le"), F.lit(0).cast("long").alias("cnt")))
    q = al.histogram_quantile(b, ["metric"], 0.95)
    return q.select("metric", F.round("quantile", R).alias("quantile"))


@register("render_cube", """
SELECT c.c_mktsegment AS project, n.n_name AS artist,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS success,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS error,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS queued, count(*) AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY CUBE (c.c_mktsegment, n.n_name)""")
def render_cube(spark, sf_dir):
    """Render totals by project (market segment) and artist (nation), all subtotals."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey))  # nation: fixed 25 rows
    s = F.col("o_orderstatus")
    return j.cube(F.col("c_mktsegment").alias("project"), F.col("n_name").alias("artist")).agg(
        F.count_if(s == "F").alias("success"), F.count_if(s == "P").alias("error"),
        F.count_if(s == "O").alias("queued"), F.count(F.lit(1)).alias("total"))


@register("period_stat", """
SELECT event_type AS metric,
       strftime(make_timestamp((epoch_us(ts) // 300000000) * 300000000), '%Y-%m-%d %H:%M:%S') AS period,
       round(avg(value), 6) AS average, max(value) AS maximum, min(value) AS minimum,
       round(sum(value), 6) AS total, count(*) AS samples
FROM events GROUP BY ALL""")
def period_stat(spark, sf_dir):
    """Average / Maximum / Minimum / Sum per metric and 300 s period."""
    ev = _events(spark, sf_dir)
    g = ev.groupBy(F.col("event_type").alias("metric"), al.bucket_start("ts", 300).alias("period")).agg(
        F.avg("value").alias("average"), F.max("value").alias("maximum"),
        F.min("value").alias("minimum"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("samples"))
    return g.withColumn("average", F.round("average", R)).withColumn("total", F.round("total", R))


@register("daily_cost", """
WITH h AS (SELECT CAST(ts AS DATE) AS d, epoch_us(ts) // 3600000000 AS hr, count(*) AS cap
           FROM events GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS day, max(cap) AS peak_capacity, round(max(cap) * 0.12, 6) AS cost
FROM h GROUP BY d""")
def daily_cost(spark, sf_dir):
    """Peak hourly event count per day as capacity units, 0.12 per unit."""
    ev = _events(spark, sf_dir)
    h = ev.groupBy(F.to_date("ts").alias("d"), F.floor(epoch_seconds("ts") / 3600).alias("hr")).agg(
        F.count(F.lit(1)).alias("cap"))
    g = h.groupBy("d").agg(F.max("cap").alias("peak_capacity"))
    return g.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "peak_capacity",
                    F.round(F.col("peak_capacity") * 0.12, R).alias("cost"))


@register("error_budget", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS total,
       count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(1 - count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS availability,
       round(count(*) FILTER (WHERE event_type = 'error') / ((1 - 0.999) * count(*)), 6) AS budget_used
FROM events GROUP BY 1""")
def error_budget(spark, sf_dir):
    """Daily availability against a 99.9 % target and share of the error budget used."""
    ev = _events(spark, sf_dir)
    g = ev.groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select("*", F.round(1 - F.col("errors") / F.col("total"), R).alias("availability"),
                    F.round(F.col("errors") / ((1 - 0.999) * F.col("total")), R).alias("budget_used"))


@register("mttd_mttr", """
WITH o AS (SELECT user_id, ts, event_type, event_id,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts FROM events),
c AS (SELECT *, sum(CASE WHEN pts IS NULL OR epoch_us(ts) - epoch_us(pts) >= 3600000000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cl FROM o),
i AS (SELECT user_id, cl, min(ts) AS s, max(ts) AS e, min(ts) FILTER (WHERE event_type = 'error') AS det,
             count(*) AS n FROM c GROUP BY ALL)
SELECT strftime(CAST(s AS DATE), '%Y-%m-%d') AS day, count(*) AS incidents,
       round(avg((epoch_us(det) - epoch_us(s)) / 60e6), 6) AS mttd_min,
       round(avg((epoch_us(e) - epoch_us(det)) / 60e6), 6) AS mttr_min
FROM i WHERE n >= 2 AND det IS NOT NULL GROUP BY 1""")
def mttd_mttr(spark, sf_dir):
    """Incidents = per-user event clusters (1 h gaps) holding an error;
    detect = first error - start, remediate = end - first error, in minutes."""
    ev = _events(spark, sf_dir).select(F.col("user_id").alias("incident_id"), "ts",
                                       F.col("event_id").alias("id"), "event_type")
    o = with_ordinal(ev, ["incident_id"], ["ts", "id"], out="ord")
    cl = tlo.gap_clusters(o, ["incident_id"], gap_seconds=3600)
    i = cl.groupBy("incident_id", "cluster").agg(
        F.min("ts").alias("s"), F.max("ts").alias("e"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("det"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    i = i.where((F.col("n") >= 2) & F.col("det").isNotNull())
    return i.groupBy(F.date_format(F.to_date("s"), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("incidents"),
        F.round(F.avg((us("det") - us("s")) / 60e6), R).alias("mttd_min"),
        F.round(F.avg((us("e") - us("det")) / 60e6), R).alias("mttr_min"))


@register("remediation_ratio", """
SELECT strftime(make_timestamp((epoch_us(ts) // 3600000000) * 3600000000), '%Y-%m-%d %H:%M:%S') AS period,
       count(*) FILTER (WHERE event_type = 'purchase') AS succeeded,
       count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS attempts,
       round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE
             / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 6) AS ratio,
       coalesce(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE
             / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0) < 0.8, false) AS alert
FROM events GROUP BY 1""")
def remediation_ratio(spark, sf_dir):
    """Hourly success share of remediations (purchase = success, error = failure); alert under 0.8."""
    ev = _events(spark, sf_dir)
    t = F.col("event_type")
    g = ev.groupBy(al.bucket_start("ts", 3600).alias("period")).agg(
        F.count_if(t == "purchase").alias("succeeded"), F.count_if(t.isin("purchase", "error")).alias("attempts"))
    r = al.ratio(F.col("succeeded"), F.col("attempts"))
    return g.select("*", F.round(r, R).alias("ratio"), F.coalesce(r < 0.8, F.lit(False)).alias("alert"))


@register("upload_rate", """
SELECT user_id AS artist,
       strftime(make_timestamp((epoch_us(ts) // 3600000000) * 3600000000), '%Y-%m-%d %H:%M:%S') AS period,
       count(*) AS uploads, count(*) > 2 AS over_limit
FROM events GROUP BY ALL""")
def upload_rate(spark, sf_dir):
    """Uploads (events) per artist (user) and hour, flagged above a limit of 2."""
    ev = _events(spark, sf_dir)
    g = ev.groupBy(F.col("user_id").alias("artist"), al.bucket_start("ts", 3600).alias("period")).agg(
        F.count(F.lit(1)).alias("uploads"))
    return g.withColumn("over_limit", F.col("uploads") > 2)


@register("absent_series", """
WITH h AS (SELECT DISTINCT event_type AS metric, epoch_us(ts) // 3600000000 * 3600 AS hs FROM events),
m AS (SELECT DISTINCT metric FROM h),
b AS (SELECT min(hs) AS lo, max(hs) AS hi FROM h),
g AS (SELECT m.metric, unnest(range(b.lo, b.hi + 3600, 3600)) AS hs FROM m, b)
SELECT metric, strftime(make_timestamp(hs * 1000000), '%Y-%m-%d %H:%M:%S') AS hour
FROM g ANTI JOIN h USING (metric, hs)""")
def absent_series(spark, sf_dir):
    """Expected (metric, hour) series with no sample: expected-key anti join."""
    ev = _events(spark, sf_dir)
    h = ev.select(F.col("event_type").alias("metric"),
                  (F.floor(epoch_seconds("ts") / 3600) * 3600).cast("long").alias("hs")).distinct()
    lo, hi = h.agg(F.min("hs")).scalar(), h.agg(F.max("hs")).scalar()  # scalar subqueries
    metrics = h.select("metric").distinct()
    grid = metrics.select("metric", F.explode(F.sequence(lo, hi, F.lit(3600).cast("long"))).alias("hs"))
    return grid.join(h, ["metric", "hs"], "left_anti").select("metric", _hour_text().alias("hour"))
