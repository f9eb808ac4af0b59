"""Registered text-search queries: documents x benchmark, and post-mortem
reports derived from the event incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.functions import text as tx
from opslens.operators import textsearch as ts
from opslens.plans.derive import postmortems
from opslens.plans.registry import register
from opslens.tables import table

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
WORD_SQL = r"'[\pL\pN_]+'"


def kw_sql(expr: str) -> str:
    """Order-preserving distinct keywords (first 20) of a lower-cased text."""
    toks = (f"list_filter(regexp_extract_all({expr}, {WORD_SQL}), "
            f"lambda x: length(x) > 3 AND NOT list_contains({STOP_SQL}, x))")
    return (f"list_slice(list_filter({toks}, lambda x, i: list_position({toks}, x) = i), 1, 20)")


@register("keywords", f"""
SELECT doc_id, len(k) AS n_keywords, array_to_string(k, ',') AS keywords
FROM (SELECT doc_id, {kw_sql('lower(text)')} AS k FROM documents)""")
def keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.keywords("text").alias("k"))
    return d.select("doc_id", F.size("k").alias("n_keywords"), F.array_join("k", ",").alias("keywords"))


@register("similar_documents", f"""
WITH q AS (SELECT item_id, lower(text) AS q, {kw_sql('lower(text)')} AS kws FROM benchmark),
d AS (SELECT doc_id, lower(text) AS d FROM documents),
s AS (SELECT item_id, doc_id,
             CAST(coalesce(list_sum(list_transform(kws, lambda k: (length(d) - length(replace(d, k, ''))) // length(k))), 0)
                  + CASE WHEN contains(d, q) THEN 10 ELSE 0 END AS BIGINT) AS score
      FROM q, d)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM s WHERE score > 0) WHERE rank <= 5""")
def similar_documents(spark, sf_dir):
    """Top 5 documents for each benchmark text (keyword counts + phrase bonus)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    qs = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ts.search(docs, qs, limit=5)


TITLE_RE = r"'(?m)^[ \t\x0B\f\r]*# [ \t\x0B\f\r]*(\S[^\n]*?)[ \t\x0B\f\r]*$'"


@register("document_title", f"""
SELECT doc_id, CASE WHEN regexp_extract(text, {TITLE_RE}, 1) = '' THEN 'Untitled'
                    ELSE regexp_extract(text, {TITLE_RE}, 1) END AS title
FROM documents""")
def document_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.title("text").alias("title"))


PM_CTE = """
tl AS (
  SELECT user_id AS incident_id, ts, 'alert' AS event_type FROM events WHERE events.event_type IN ('error', 'click')
  UNION ALL SELECT user_id, ts, 'config_change' FROM events WHERE event_type = 'signup'
  UNION ALL SELECT user_id, ts, 'related_incident' FROM events WHERE event_type IN ('purchase', 'view')),
agg AS (SELECT incident_id AS doc_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'alert') AS n_alerts,
               min(ts) AS start FROM tl GROUP BY 1),
fa AS (SELECT user_id, min(ts) AS first_alert FROM events WHERE event_type IN ('error', 'click') GROUP BY 1),
ch AS (SELECT e.user_id AS doc_id, arg_max(e.event_id, (e.ts, e.event_id)) AS cid
       FROM events e JOIN fa ON fa.user_id = e.user_id
       WHERE e.event_type = 'signup' AND e.ts < fa.first_alert GROUP BY 1),
j AS (SELECT agg.*, 'Change in svc' || (cid % 7) || ': deploy ' || cid AS root_cause,
             CASE WHEN cid IS NULL THEN NULL ELSE 'svc' || (cid % 7) END AS comp
      FROM agg LEFT JOIN ch USING (doc_id)),
pm AS (SELECT doc_id, start,
  'incident_' || doc_id || '_' || coalesce(comp, 'none') || '_' || strftime(start, '%Y%m%d') || '.md' AS name,
  concat_ws(chr(10),
    '# Post-Mortem: Incident ' || doc_id, '', '**Date:** ' || strftime(start, '%Y-%m-%d'),
    '## Summary', n || ' timeline events, ' || n_alerts || ' alerts.',
    '## Root Cause', '**Root Cause:** ' || coalesce(root_cause, 'Unknown'),
    'Trigger component: ' || coalesce(comp, 'none'),
    '## Action Items', '- [ ] Review alert thresholds for incident ' || doc_id,
    '- Fix ' || coalesce(comp, 'monitoring') || ' rollout checks',
    '| ' || n_alerts || ' alerts | triage | open |',
    '## Preventive Measures', '1. Add canary analysis for ' || coalesce(comp, 'all services'),
    '- Alert on error bursts', '* Keep runbooks current',
    '## Timeline', '- ' || n || ' events') AS text
  FROM j),
ln AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos,
              unnest(string_split(text, chr(10))) AS line FROM pm)"""


def _section_sql(markers: list[str], keep_marker_lines: bool) -> str:
    m = " OR ".join(f"contains(line, '{x}')" for x in markers)
    keep = ("NOT (m AND starts_with(line, '## '))" if keep_marker_lines else "NOT m")
    return f"""
lm AS (SELECT *, ({m}) AS m FROM ln),
st AS (SELECT doc_id, min(pos) AS s FROM lm WHERE m GROUP BY 1),
jj AS (SELECT lm.* FROM lm JOIN st USING (doc_id) WHERE pos >= s),
en AS (SELECT doc_id, min(pos) AS e FROM jj WHERE starts_with(line, '## ') AND NOT m GROUP BY 1),
sec AS (SELECT jj.doc_id, pos, line FROM jj LEFT JOIN en USING (doc_id)
        WHERE (e IS NULL OR pos < e) AND {keep})"""


@register("report_title", f"WITH {PM_CTE} SELECT doc_id, name, "
          f"CASE WHEN regexp_extract(text, {TITLE_RE}, 1) = '' THEN 'Untitled' "
          f"ELSE regexp_extract(text, {TITLE_RE}, 1) END AS title FROM pm")
def report_title(spark, sf_dir):
    pm = postmortems(spark, sf_dir)
    return pm.select("doc_id", "name", tx.title("text").alias("title"))


@register("report_date", f"""WITH {PM_CTE}
SELECT doc_id, CASE WHEN regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) <> ''
                    THEN regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)
                    WHEN regexp_extract(name, '(\\d{{4}})(\\d{{2}})(\\d{{2}})', 0) <> ''
                    THEN regexp_replace(regexp_extract(name, '(\\d{{4}})(\\d{{2}})(\\d{{2}})', 0),
                                        '(\\d{{4}})(\\d{{2}})(\\d{{2}})', '\\1-\\2-\\3')
                    ELSE CAST(start AS VARCHAR) END AS date FROM pm""")
def report_date(spark, sf_dir):
    pm = postmortems(spark, sf_dir)
    return pm.select("doc_id", tx.doc_date("name", "start").alias("date"))


@register("section_lines", f"""WITH {PM_CTE}, {_section_sql(['## Action Items'], False)},
it AS (SELECT DISTINCT trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS item
       FROM sec WHERE contains(lower(line), 'svc'))
SELECT item FROM it WHERE starts_with(item, '- ') OR starts_with(item, '|') ORDER BY item LIMIT 10""")
def section_lines(spark, sf_dir):
    """Action items mentioning 'svc' across all reports (distinct, first 10)."""
    return ts.section_lines(postmortems(spark, sf_dir), "svc")


@register("root_causes", f"""WITH {PM_CTE}, {_section_sql(['## Root Cause', '**Root Cause:**'], True)},
c AS (SELECT DISTINCT trim(replace(replace(line, '**Root Cause:**', ''), '*', ''),
                          ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cause
      FROM sec WHERE contains(lower(line), 'deploy'))
SELECT cause FROM c WHERE cause <> '' AND cause <> 'Root Cause' ORDER BY cause LIMIT 10""")
def root_causes(spark, sf_dir):
    """Known root causes mentioning 'deploy' (distinct, first 10)."""
    return ts.root_causes(postmortems(spark, sf_dir), "deploy")


@register("runbook_lookup", f"""WITH {PM_CTE},
t AS (SELECT DISTINCT 'svc' || (event_id % 7) AS topic FROM events WHERE event_type = 'signup')
SELECT topic, arg_min(doc_id, name) AS doc_id, min(name) AS name
FROM t JOIN pm ON contains(lower(pm.name), lower(t.topic)) GROUP BY topic""")
def runbook_lookup(spark, sf_dir):
    """For each component, the first report (by name) whose name mentions it."""
    ev = table(spark, sf_dir, "events")
    topics = ev.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("svc"), (F.col("event_id") % 7).cast("string")).alias("topic")).distinct()
    return ts.runbook(postmortems(spark, sf_dir).select("doc_id", "name"), topics)
