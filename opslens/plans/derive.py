"""Derivations of the native inputs from the driver tables.

The operators take operational data (metric points, incidents, findings,
job messages, ...). The driver tables are generic, so each native input is
derived from them deterministically; every oracle repeats the same
derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.plans.registry import derived
from opslens.tables import table


@derived
def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (metric, ts, id, value): one metric per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("id"), "value")


def rough(points: DataFrame) -> DataFrame:
    """(metric, ts, id, value) of events, batch or stream, with what real sources have: every 5th point at
    its full hour, every 23rd without an id, every 29th without a value, every 31st three times, a third of
    the views without a metric, and a metric 'probe' beside the errors in which every 100th value is NaN."""
    e = F.col("event_id")
    kind, every, none = F.col("event_type"), F.lit(1), F.lit(None)
    metrics = (F.when(kind == "error", F.array(kind, F.lit("probe")))
               .when((kind == "view") & (e % 3 == 0), F.array(none.cast("string"))).otherwise(F.array(kind)))
    copies = F.sequence(every, F.when(e % 31 == 0, F.lit(3)).otherwise(every))
    rows = points.select("event_id", F.explode(metrics).alias("metric"), copies.alias("_copies"),
                         F.when(e % 5 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"),
                         F.when(e % 23 != 0, e).alias("id"), F.when(e % 29 != 0, F.col("value")).alias("value"))
    odd = (F.col("metric") == "probe") & (e % 100 == 3)
    return rows.select("metric", "ts", "id", F.when(odd, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
                       F.explode("_copies").alias("_copy")).drop("_copy")


ROUGH_SQL = """(
  SELECT metric, ts, id, CASE WHEN metric = 'probe' AND event_id % 100 = 3 THEN 'NaN'::DOUBLE ELSE value END AS value
  FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts,
               CASE WHEN event_id % 23 <> 0 THEN event_id END AS id, CASE WHEN event_id % 29 <> 0 THEN value END AS value,
               unnest(CASE WHEN event_type = 'error' THEN ['error', 'probe'] WHEN event_type = 'view' AND event_id % 3 = 0 THEN [NULL]
                           ELSE [event_type] END) AS metric FROM events),
       LATERAL (SELECT unnest(range(CASE WHEN event_id % 31 = 0 THEN 3 ELSE 1 END))))"""


def rough_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rough(table(spark, sf_dir, "events"))


@derived
def incident_parts(spark: SparkSession, sf_dir: str):
    """events -> incident parts keyed by user_id.

    error and click -> alert (name from props.k; clicks from source 'rum', errors
    without one: default monitoring), signup -> change (source 'ci' when value > 50
    else missing, component svc<event_id mod 7>), purchase and view -> related incident.
    """
    ev = table(spark, sf_dir, "events")
    alerts = ev.where(F.col("event_type").isin("error", "click")).select(
        F.col("user_id").alias("incident_id"), F.col("ts").alias("fired_at"),
        F.concat(F.lit("alert_k"), F.get_json_object("props", "$.k")).alias("name"),
        F.when(F.col("event_type") == "click", "rum").alias("source"), F.col("event_id").alias("in_ord"))
    changes = ev.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("incident_id"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("deploy "), F.col("event_id").cast("string")).alias("description"),
        F.when(F.col("value") > 50, F.lit("ci")).alias("source"),
        F.concat(F.lit("svc"), (F.col("event_id") % 7).cast("string")).alias("component"),
        F.col("event_id").alias("in_ord"))
    related = ev.where(F.col("event_type").isin("purchase", "view")).select(
        F.col("user_id").alias("incident_id"), F.col("ts").alias("start_time"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.col("event_id").alias("in_ord"))
    return alerts, changes, related


@derived
def daily_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> (metric, day, y = daily mean value)."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("y"))


@derived
def postmortems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown post-mortem per incident (user) built from its timeline
    and its change-before-first-alert: (doc_id, name, start, text)."""
    from opslens.operators import timeline as tlo

    alerts, changes, related = incident_parts(spark, sf_dir)
    tl = tlo.timeline(alerts, changes, related)
    agg = tl.groupBy(F.col("incident_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "alert").alias("n_alerts"),
        F.min("ts").alias("start"))
    rc = tlo.change_before_alert(alerts, changes).select(
        F.col("incident_id").alias("doc_id"), "root_cause",
        F.regexp_extract("root_cause", r"^Change in (\S+):", 1).alias("comp"))
    j = agg.join(rc, "doc_id", "left")
    comp = F.col("comp")
    idt = F.col("doc_id").cast("string")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Post-Mortem: Incident "), idt), F.lit(""),
        F.concat(F.lit("**Date:** "), F.date_format("start", "yyyy-MM-dd")),
        F.lit("## Summary"),
        F.format_string("%d timeline events, %d alerts.", "n", "n_alerts"),
        F.lit("## Root Cause"),
        F.concat(F.lit("**Root Cause:** "), F.coalesce("root_cause", F.lit("Unknown"))),
        F.concat(F.lit("Trigger component: "), F.coalesce(comp, F.lit("none"))),
        F.lit("## Action Items"),
        F.concat(F.lit("- [ ] Review alert thresholds for incident "), idt),
        F.concat(F.lit("- Fix "), F.coalesce(comp, F.lit("monitoring")), F.lit(" rollout checks")),
        F.format_string("| %d alerts | triage | open |", "n_alerts"),
        F.lit("## Preventive Measures"),
        F.concat(F.lit("1. Add canary analysis for "), F.coalesce(comp, F.lit("all services"))),
        F.lit("- Alert on error bursts"), F.lit("* Keep runbooks current"),
        F.lit("## Timeline"), F.format_string("- %d events", "n"))
    name = F.concat(F.lit("incident_"), idt, F.lit("_"), F.coalesce(comp, F.lit("none")), F.lit("_"),
                    F.date_format("start", "yyyyMMdd"), F.lit(".md"))
    return j.select("doc_id", name.alias("name"), "start", text.alias("text"))


# ---- scanner reports derived from the tables (one JSON report per row) ----

# The secret-scan rules applied to document lines:
# rule id, description, pattern, literal every match contains (cheap guard).
# Lookarounds bound each attempt to a token start, so a line is scanned in
# linear time; ``SECRET_RULES_RE2`` states the same matches without them.
SECRET_RULES = [
    ("generic-api-key", "Generic API Key", r'token = "[0-9a-f]{16,}"', 'token = "'),
    ("email-address", "Email address",
     r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    ("ipv4-address", "IPv4 address", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])", "."),
    ("card-number", "Possible card number", r"(?<![0-9])[0-9]{16}(?![0-9])", None),
]
SECRET_RULES_RE2 = {
    "generic-api-key": r'token = "[0-9a-f]{16,}"',
    "email-address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4-address": r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)",
    "card-number": r"(^|[^0-9])[0-9]{16}([^0-9]|$)",
}


def _rule_test(c, pat, guard):
    return c.rlike(pat) if guard is None else (c.contains(guard) & c.rlike(pat))


def gitleaks_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> one secret-scan report per document with hits (JSON array).

    A document is split into lines only when one of the rules matches it at
    all; each line is tested against every rule in one pass, and the hits of
    a document are gathered into its report (bounded by that one document)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    any_rule = None
    for _, _, pat, guard in SECRET_RULES:
        t = _rule_test(F.col("text"), pat, guard)
        any_rule = t if any_rule is None else (any_rule | t)
    lines = (d.where(any_rule)
             .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")))
    rule_hits = F.filter(F.array(*[
        F.when(_rule_test(F.col("line"), pat, guard),
               F.struct(F.lit(rid).alias("RuleID"), F.lit(desc).alias("Description")))
        for rid, desc, pat, guard in SECRET_RULES]), lambda x: x.isNotNull())
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    hits = lines.select("doc_id", "pos", F.explode(rule_hits).alias("h")).select(
        "doc_id", F.struct(F.col("h.RuleID").alias("RuleID"), F.col("h.Description").alias("Description"),
                           path.alias("File"), (F.col("pos") + 1).cast("int").alias("StartLine")).alias("f"))
    return hits.groupBy("doc_id").agg(F.to_json(F.collect_list("f")).alias("report")).select("report")


def _json_str(c):
    """JSON string literal of a column (escaped, with quotes)."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def npm_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> npm audit report: advisory via object (size%3=0), via string (1), none (2)."""
    p = table(spark, sf_dir, "part")
    sev = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "moderate", "low", "info")]),
                       (F.col("p_size") % 5 + 1).cast("int"))
    k = F.col("p_size") % 3
    url_obj = F.concat(F.lit("https://github.com/advisories/GHSA-"), F.col("p_partkey").cast("string"),
                       F.lit("-"), F.col("p_brand"))
    url_str = F.concat(F.lit("https://npmjs.com/advisories/"), F.col("p_partkey").cast("string"))
    via = (F.when(k == 0, F.concat(F.lit('[{"url":'), _json_str(url_obj), F.lit("}]")))
           .when(k == 1, F.concat(F.lit("["), _json_str(url_str), F.lit("]"))).otherwise(F.lit("[]")))
    rep = F.concat(F.lit('{"vulnerabilities":{'), _json_str(F.col("p_name")), F.lit(':{"severity":'),
                   _json_str(sev), F.lit(',"via":'), via, F.lit("}}}"))
    return p.select(rep.alias("report"))


def pip_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 4
    sev = F.when(k == 1, "low").when(k == 2, "high").when(k == 3, "critical")
    v = F.struct(F.concat(F.lit("PYSEC-"), F.col("s_suppkey").cast("string")).alias("id"),
                 F.col("s_name").alias("name"),
                 F.concat(F.lit("Supplier nation "), F.col("s_nationkey").cast("string")).alias("description"),
                 sev.alias("severity"))
    return s.select(F.to_json(F.array(v)).alias("report"))


def govuln_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    osv = F.when(F.col("n_nationkey") % 5 != 0, F.struct(
        F.concat(F.col("n_name"), F.lit(" advisory")).alias("summary"),
        F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("details")))
    f = F.struct(F.concat(F.lit("GO-2024-"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
                 .alias("vulnerability_id"), osv.alias("osv"))
    return n.select(F.to_json(F.struct(F.array(f).alias("findings"))).alias("report"))


def checkov_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k3, k2 = F.col("c_custkey") % 3, F.col("c_custkey") % 2
    chk = F.struct(
        F.concat(F.lit("CKV_AWS_"), (F.col("c_custkey") % 300).cast("string")).alias("check_id"),
        F.concat(F.initcap("c_mktsegment"), F.lit(" bucket policy")).alias("check_name"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("check_message"),
        F.when(k3 == 1, "medium").when(k3 == 2, "low").alias("severity"),
        F.concat(F.lit("/infra/"), F.lower("c_mktsegment"), F.lit("/main.tf")).alias("file_path"),
        F.when(k2 == 1, "Enable encryption").alias("fix_definition"))
    rep = F.struct(F.struct(F.array(chk).alias("failed_checks")).alias("results"))
    return c.select(F.to_json(rep).alias("report"))


def semgrep_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    cid = F.when(F.col("html").contains("<script"), "html.security.inline-script").otherwise(
        "html.best-practice.missing-alt")
    r = F.struct(cid.alias("check_id"),
                 F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("message"),
                 F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1).alias("path"),
                 F.struct((F.col("page_id") % 100 + 1).cast("int").alias("line")).alias("start"))
    return p.select(F.to_json(F.struct(F.array(r).alias("results"))).alias("report"))


def trivy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> image report with two targets."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    yr = F.year("o_orderdate").cast("string")
    pr = F.col("o_orderpriority")
    sev = (F.when(pr == "1-URGENT", "CRITICAL").when(pr == "2-HIGH", "high")
           .when(pr == "3-MEDIUM", "Medium").when(pr == "5-LOW", "low").otherwise("UNKNOWN"))
    v1 = F.struct(
        F.concat(F.lit("CVE-"), yr, F.lit("-"), key.cast("string")).alias("VulnerabilityID"),
        F.when(key % 4 != 0, F.concat(F.lit("Order "), key.cast("string"), F.lit(" issue"))).alias("Title"),
        F.concat(F.lit("Priority "), pr, F.lit(" order of customer "), F.col("o_custkey").cast("string"),
                 F.lit(" needs attention")).alias("Description"),
        sev.alias("Severity"),
        F.when(key % 3 != 0, F.struct(F.concat(F.lit("1."), (key % 10).cast("string")).alias("FixedVersion")))
        .alias("FixPublished"))
    v2 = F.struct(
        F.concat(F.lit("CVE-"), yr, F.lit("-"), (key + 1000000).cast("string")).alias("VulnerabilityID"),
        F.lit(None).cast("string").alias("Title"),
        F.concat(F.lit("Base image of order "), key.cast("string")).alias("Description"),
        F.lit("low").alias("Severity"),
        F.struct(F.lit(None).cast("string").alias("FixedVersion")).alias("FixPublished"))
    rep = F.struct(F.array(F.struct(F.array(v1).alias("Vulnerabilities")),
                           F.struct(F.array(v2).alias("Vulnerabilities"))).alias("Results"))
    return o.select(F.to_json(rep).alias("report"))


@derived
def plan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> one plan per supplier with one security-group-like resource."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    frm = (k % 40).cast("int")
    ing = F.struct(F.array(F.when(F.col("s_acctbal") > 0, "0.0.0.0/0").otherwise("10.0.0.0/8"),
                           F.lit("192.168.0.0/16")).alias("cidr_blocks"),
                   frm.alias("from_port"), (frm + F.col("s_nationkey")).cast("int").alias("to_port"))
    after = F.when(k % 11 != 0, F.struct(F.array(ing).alias("ingress")))
    rc = F.struct(F.concat(F.lit("aws_security_group.sg_"), k.cast("string")).alias("address"),
                  F.when(k % 5 == 0, "aws_instance").otherwise("aws_security_group").alias("type"),
                  F.struct(after.alias("after")).alias("change"))
    return s.select(F.concat(F.lit("infra/sg_"), k.cast("string"), F.lit(".tf")).alias("path"),
                    F.to_json(F.struct(F.array(rc).alias("resource_changes"))).alias("report"))


@derived
def all_reports(spark: SparkSession, sf_dir: str) -> dict:
    return {"gitleaks": gitleaks_reports(spark, sf_dir), "npm": npm_reports(spark, sf_dir),
            "pip": pip_reports(spark, sf_dir), "govuln": govuln_reports(spark, sf_dir),
            "checkov": checkov_reports(spark, sf_dir), "semgrep": semgrep_reports(spark, sf_dir),
            "trivy": trivy_reports(spark, sf_dir)}
