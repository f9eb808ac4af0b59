"""Registered metric-source queries: saved instant/range API responses built
from events, cloud-style period averages, label matchers, relabeling,
storage keys, busy share from an idle counter, render-list pairing,
preventive measures and search hits joined to report titles, sliding counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions import text as tx
from opslens.operators import alerts as al
from opslens.operators import render as rd
from opslens.operators import textsearch as ts
from opslens.plans.derive import postmortems
from opslens.plans.registry import derived, register
from opslens.plans.text_q import PM_CTE, kw_sql
from opslens.session import materialize
from opslens.sources import metrics as ms
from opslens.streaming import monitor as sm
from opslens.tables import table

R = 6


def _ev(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _labels():
    v = F.col("value")
    code = F.when(v > 100, "503").when(v > 50, "500").when(v > 20, "404").otherwise("200")
    job = F.element_at(F.array(F.lit("node"), F.lit("api"), F.lit("batch")), (F.col("user_id") % 3 + 1).cast("int"))
    return F.create_map(F.lit("__name__"), F.col("event_type"), F.lit("status"), code,
                        F.lit("instance"), F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string"), F.lit(":9100")),
                        F.lit("job"), job)


@derived
def instant_responses(spark, sf_dir):
    e = _ev(spark, sf_dir)
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("string")
    one = F.struct(_labels().alias("metric"), F.array(secs, F.col("value").cast("string")).alias("value"))
    resp = F.when(F.col("event_id") % 10 == 0, F.lit('{"status":"success","data":{"result":[]}}')).otherwise(
        F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(one).alias("result")).alias("data"))))
    return e.select("event_id", resp.alias("response"))


@register("instant_values", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events")
def instant_values(spark, sf_dir):
    """Instant-query responses per event; empty results give no value."""
    return ms.parse_instant(instant_responses(spark, sf_dir)).select("event_id", "value")


@register("range_samples", """
SELECT event_id, 'host-' || (user_id % 5) || ':9100' AS instance,
       make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS ts, value FROM events
UNION ALL
SELECT event_id, 'host-' || (user_id % 5) || ':9100',
       make_timestamp((epoch_us(ts) // 1000000 + 60) * 1000000), value + 1 FROM events""")
def range_samples(spark, sf_dir):
    """Range-query responses (two samples a minute apart) to a long table."""
    e = _ev(spark, sf_dir)
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    vals = F.array(F.array(secs.cast("string"), F.col("value").cast("string")),
                   F.array((secs + 60).cast("string"), (F.col("value") + 1).cast("string")))
    series = F.struct(_labels().alias("metric"), vals.alias("values"))
    resp = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.array(series).alias("result")).alias("data")))
    r = ms.parse_range(e.select("event_id", resp.alias("response")))
    return r.select("event_id", F.col("labels")["instance"].alias("instance"), "ts", "value")


@register("latest_period_avg", """
WITH e AS (SELECT event_type AS metric, epoch_us(ts) AS us, value FROM events),
l AS (SELECT metric, max(us) AS lend FROM e GROUP BY 1),
p AS (SELECT e.metric, e.us // 300000000 AS p, avg(value) AS a FROM e JOIN l USING (metric)
      WHERE e.us > l.lend - 600000000 GROUP BY ALL)
SELECT metric, round(arg_max(a, p), 6) AS average, make_timestamp(max(p) * 300000000) AS period_start
FROM p GROUP BY metric""")
def latest_period_avg(spark, sf_dir):
    """Cloud-style datapoint: average of the latest 300 s period (2-period look-back)."""
    pts = _ev(spark, sf_dir).select(F.col("event_type").alias("metric"), "ts", "value")
    return ms.latest_period_avg(pts).withColumn("average", F.round("average", R))


LABELS_SQL = """
SELECT event_type AS metric, event_id, value, user_id,
       CASE WHEN value > 100 THEN '503' WHEN value > 50 THEN '500' WHEN value > 20 THEN '404' ELSE '200' END AS status,
       'host-' || (user_id % 5) || ':9100' AS instance,
       ['node', 'api', 'batch'][user_id % 3 + 1] AS job
FROM events"""


@register("label_matches", f"""WITH l AS ({LABELS_SQL})
SELECT metric, status, count(*) AS samples FROM l
WHERE metric IN ('error', 'view') AND regexp_full_match(status, '5..') AND NOT regexp_full_match(instance, 'host-0:.*')
GROUP BY ALL""")
def label_matches(spark, sf_dir):
    """Selected metrics, status =~ "5..", instance !~ "host-0:.*"."""
    pts = _ev(spark, sf_dir).select(F.col("event_type").alias("metric"), _labels().alias("labels"))
    sel = ms.match_labels(ms.select_metrics(pts, ["error", "view"]), re={"status": "5.."},
                          nre={"instance": "host-0:.*"})
    return sel.groupBy("metric", F.col("labels")["status"].alias("status")).agg(F.count(F.lit(1)).alias("samples"))


RELABEL_RULES = [
    {"action": "keep", "source_labels": ["job"], "regex": "node|api"},
    {"action": "replace", "source_labels": ["instance"], "regex": r"([^:]+):\d+", "target_label": "host",
     "replacement": "$1"},
    {"action": "labelmap", "regex": "__(name)__", "replacement": "metric_$1"},
]


@register("relabelled_series", f"""WITH l AS ({LABELS_SQL})
SELECT event_id, regexp_extract(instance, '^([^:]+):\\d+$', 1) AS host, job, metric AS metric_name
FROM l WHERE regexp_full_match(job, 'node|api')""")
def relabelled_series(spark, sf_dir):
    """Scrape relabeling: keep node/api jobs, host from instance, __name__ copied to metric_name."""
    pts = _ev(spark, sf_dir).select("event_id", _labels().alias("labels"))
    r = ms.relabel(pts, RELABEL_RULES)
    return r.select("event_id", F.col("labels")["host"].alias("host"), F.col("labels")["job"].alias("job"),
                    F.col("labels")["metric_name"].alias("metric_name"))


@register("key_parts", """
WITH k AS (SELECT o_orderkey, 'proj' || (o_custkey % 20) || '/v' || (o_orderkey % 3 + 1) || '/'
                  || strftime(o_orderdate, '%Y%m%d%H%M%S') || '/scene_' || o_orderkey || '/frame_0001.png' AS key
           FROM orders)
SELECT o_orderkey, string_split(key, '/')[1] AS project, string_split(key, '/')[2] AS variation,
       string_split(key, '/')[3] AS stamp, array_to_string(string_split(key, '/')[4:], '/') AS file FROM k""")
def key_parts(spark, sf_dir):
    """Output storage keys project/variation/timestamp/file split into columns."""
    o = table(spark, sf_dir, "orders")
    key = F.concat_ws("/", F.concat(F.lit("proj"), (F.col("o_custkey") % 20).cast("string")),
                      F.concat(F.lit("v"), (F.col("o_orderkey") % 3 + 1).cast("string")),
                      F.date_format("o_orderdate", "yyyyMMddHHmmss"),
                      F.concat(F.lit("scene_"), F.col("o_orderkey").cast("string")), F.lit("frame_0001.png"))
    k = ms.split_key(key)
    return o.select("o_orderkey", k["project"].alias("project"), k["variation"].alias("variation"),
                    k["stamp"].alias("stamp"), k["file"].alias("file"))


@register("cpu_busy_by_instance", """
WITH s AS (SELECT 'host-' || (user_id % 5) AS instance, ts, event_id, epoch_us(ts) AS us,
                  sum(value / 100) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c
           FROM events),
l AS (SELECT *, lag(c) OVER w AS pc, lag(us) OVER w AS pus FROM s WINDOW w AS (PARTITION BY instance ORDER BY ts, event_id)),
r AS (SELECT instance, CASE WHEN c < pc THEN c ELSE c - pc END / ((us - pus) / 1e6) AS irate FROM l WHERE pc IS NOT NULL)
SELECT instance, round(100 - avg(irate) * 100, 6) AS busy_pct FROM r GROUP BY instance""")
def cpu_busy_by_instance(spark, sf_dir):
    """100 - avg by instance of irate(idle counter) x 100; the idle counter is a
    running sum of value/100 per instance (user_id mod 5)."""
    from opslens.operators.ordered import ORD, linear_scan, with_ordinal
    e = _ev(spark, sf_dir).select(F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string")).alias("instance"),
                                  "ts", F.col("event_id").alias("id"), (F.col("value") / 100).alias("inc"))
    o = with_ordinal(e, ["instance"], ["ts", "id"])
    c = linear_scan(o, ["instance"], ORD, "inc", 1.0, "counter")
    r = al.counter_rates(c.select("instance", "ts", "id", "counter", ORD), ["instance"], like=e)
    return r.groupBy("instance").agg(F.round(100 - F.avg("irate") * 100, R).alias("busy_pct"))


# Per root (o_orderkey mod 7): roots 0-1 hold an xlsx right in the render-list folder, 2-3 an xls, 4-6 neither,
# and orders mod 5 have a list of their own in one of four places or none, so each rank wins somewhere.
RL_SQL = """
WITH o AS (SELECT 'r' || (o_orderkey % 7) AS root, 'scene_' || o_orderkey AS base, o_orderkey % 5 AS place, o_orderkey % 7 AS k,
                  '/proj' || (o_custkey % 20) || '/scene_' || o_orderkey AS tail, o_orderkey % 97 AS few FROM orders),
rl AS (SELECT root, base, CASE place WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 4 END AS rk,
              '/' || root || CASE WHEN place IN (0, 3) THEN '/input' ELSE '/renderlists' END || tail
                || CASE WHEN place IN (0, 2) THEN '.xlsx' ELSE '.xls' END AS path FROM o WHERE place <> 4
       UNION ALL
       SELECT root, NULL, CASE WHEN k < 2 THEN 2 ELSE 5 END,
              '/' || root || '/renderlists/' || base || CASE WHEN k < 2 THEN '.xlsx' ELSE '.xls' END FROM o WHERE few = 0 AND k < 4)
SELECT '/' || o.root || '/queue/' || o.base || '.ms' AS script, arg_min(rl.path, (rl.rk, rl.path)) AS render_list
FROM o LEFT JOIN rl ON rl.root = o.root AND (rl.base = o.base OR rl.base IS NULL) GROUP BY 1
"""


@register("pair_render_list", RL_SQL)
def pair_render_list(spark, sf_dir):
    """Queued scripts paired with a render list by base name, all six places in order."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), (k % 7).cast("string")).alias("root"), F.concat(F.lit("scene_"), k.cast("string")).alias("base"),
        (k % 5).alias("place"), (k % 7).alias("k"), (k % 97).alias("few"),
        F.concat(F.lit("/proj"), (F.col("o_custkey") % 20).cast("string"), F.lit("/scene_"), k.cast("string")).alias("tail"))
    folder = F.when(F.col("place").isin(0, 3), "input").otherwise("renderlists")
    ext = F.when(F.col("place").isin(0, 2), "xlsx").otherwise("xls")
    own = o.where(F.col("place") != 4).select("root", folder.alias("folder"), "base", ext.alias("ext"), F.concat(
        F.lit("/"), "root", F.lit("/"), folder, "tail", F.lit("."), ext).alias("path"))
    kind = F.when(F.col("k") < 2, "xlsx").otherwise("xls")
    loose = o.where((F.col("few") == 0) & (F.col("k") < 4)).select(
        "root", F.lit("renderlists").alias("folder"), F.lit(None).cast("string").alias("base"), kind.alias("ext"),
        F.concat(F.lit("/"), "root", F.lit("/renderlists/"), "base", F.lit("."), kind).alias("path"))
    scripts = o.select("root", "base", F.concat(F.lit("/"), "root", F.lit("/queue/"), "base", F.lit(".ms")).alias("script"))
    return rd.pair_render_list(scripts, own.unionByName(loose))


SEARCH_SQL = """
q AS (SELECT 1 AS item_id, lower({q}) AS q, {kws} AS kws),
d AS (SELECT doc_id, lower(text) AS d FROM pm),
s AS (SELECT item_id, doc_id,
             CAST(coalesce(list_sum(list_transform(kws, lambda k: (length(d) - length(replace(d, k, ''))) // length(k))), 0)
                  + CASE WHEN contains(d, q) THEN 10 ELSE 0 END AS BIGINT) AS score FROM q, d),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
                       FROM s WHERE score > 0) WHERE rank <= {k})"""


def _search_sql(query: str, k: int) -> str:
    lit = "'" + query.replace("'", "''") + "'"
    return SEARCH_SQL.format(q=lit, kws=kw_sql(f"lower({lit})"), k=k)


PREVENT_Q = "error bursts canary"


@register("preventive_measures", f"""WITH {PM_CTE}, {_search_sql(PREVENT_Q, 10)},
sel AS (SELECT pm.* FROM pm JOIN top USING (doc_id)),
l2 AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos,
              unnest(string_split(text, chr(10))) AS line FROM sel),
lm AS (SELECT *, contains(line, '## Preventive Measures') OR contains(line, '## Preventive') AS m FROM l2),
st AS (SELECT doc_id, min(pos) AS s FROM lm WHERE m GROUP BY 1),
jj AS (SELECT lm.* FROM lm JOIN st USING (doc_id) WHERE pos >= s),
en AS (SELECT doc_id, min(pos) AS e FROM jj WHERE starts_with(line, '## ') AND NOT m GROUP BY 1),
sec AS (SELECT jj.doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
        FROM jj LEFT JOIN en USING (doc_id) WHERE (e IS NULL OR pos < e) AND NOT m),
b AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(t, '^\\d+\\. ', ''), '^[-* ]+', ''),
                           ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS measure
      FROM sec WHERE starts_with(t, '- ') OR starts_with(t, '* ') OR regexp_matches(t, '^\\d+\\. '))
SELECT measure FROM b WHERE measure <> '' ORDER BY measure LIMIT 10""")
def preventive_measures(spark, sf_dir):
    """Preventive measures from the 10 reports most similar to an incident type."""
    pm = materialize(postmortems(spark, sf_dir), "postmortems")   # reused several times: write once
    qs = spark.range(1).select(F.lit(1).cast("long").alias("item_id"), F.lit(PREVENT_Q).alias("text"))
    hits = ts.search(pm.select("doc_id", "text"), qs, limit=10)
    return ts.preventive(pm.join(hits.select("doc_id"), "doc_id").select("doc_id", "text"))


SIMILAR_Q = "deploy svc3 alert"


@register("similar_reports", f"""WITH {PM_CTE}, {_search_sql(SIMILAR_Q, 5)}
SELECT top.rank, top.doc_id, top.score, pm.name,
       CASE WHEN regexp_extract(pm.text, '(?m)^[ \\t\\x0B\\f\\r]*# [ \\t\\x0B\\f\\r]*(\\S[^\\n]*?)[ \\t\\x0B\\f\\r]*$', 1) = ''
            THEN 'Untitled'
            ELSE regexp_extract(pm.text, '(?m)^[ \\t\\x0B\\f\\r]*# [ \\t\\x0B\\f\\r]*(\\S[^\\n]*?)[ \\t\\x0B\\f\\r]*$', 1) END AS title
FROM top JOIN pm USING (doc_id)""")
def similar_reports(spark, sf_dir):
    """Search hits joined back to their report for title and name."""
    pm = materialize(postmortems(spark, sf_dir), "postmortems")   # reused several times: write once
    qs = spark.range(1).select(F.lit(1).cast("long").alias("item_id"), F.lit(SIMILAR_Q).alias("text"))
    hits = ts.search(pm.select("doc_id", "text"), qs, limit=5)
    return hits.join(pm, "doc_id").select("rank", "doc_id", "score", "name", tx.title("text").alias("title"))


@register("stream_sliding_counts", """
WITH e AS (SELECT event_type AS metric, epoch_us(ts) AS us FROM events),
w AS (SELECT metric, unnest(range((us // 30000000) * 30000000 - 270000000, (us // 30000000) * 30000000 + 1, 30000000)) AS ws
      FROM e)
SELECT metric, strftime(make_timestamp(ws), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events FROM w GROUP BY ALL""")
def stream_sliding_counts(spark, sf_dir):
    """5-minute windows sliding every 30 s, merged from the 30 s panes that the event stream keeps."""
    ev = sm.table_stream(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "ts")
    panes = sm.run_until_caught_up(sm.pane_counts_stream(ev), "panes", "update", keys=["metric", "w"])
    return sm.merge_panes(panes).select("metric", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "events")
