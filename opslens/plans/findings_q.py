"""Registered security-finding queries over scanner reports derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import findings as fo
from opslens.plans import derive as dv
from opslens.plans.registry import derived, register
from opslens.sources import reports as rp

RULES_SQL = "(VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(r, d, dv.SECRET_RULES_RE2[r].replace("'", "''"))
    for r, d, _p, _g in dv.SECRET_RULES) + ") r(rid, descr, pat)"

FINDINGS_CTE = f"""
ln AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos,
              unnest(string_split(text, chr(10))) AS line FROM documents),
gl AS (SELECT r.rid AS id, 'Secret detected: ' || r.rid AS title, r.descr AS description,
              'CRITICAL' AS severity, 'documents/' || doc_id || '.txt' AS file, (pos + 1)::INTEGER AS line,
              NULL::VARCHAR AS fix, 'gitleaks' AS tool
       FROM ln JOIN {RULES_SQL} ON regexp_matches(ln.line, r.pat)),
np AS (SELECT CASE p_size % 3
                WHEN 0 THEN left(string_split('https://github.com/advisories/GHSA-' || p_partkey || '-' || p_brand, '/')[-1], 20)
                WHEN 1 THEN left(p_partkey::VARCHAR, 20) ELSE 'npm' END AS id,
              'NPM vulnerability in ' || p_name AS title,
              'Via: ' || CASE p_size % 3
                WHEN 0 THEN '{{"url":"https://github.com/advisories/GHSA-' || p_partkey || '-' || p_brand || '"}}'
                WHEN 1 THEN 'https://npmjs.com/advisories/' || p_partkey ELSE '[]' END AS description,
              CASE p_size % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 3 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
              NULL::VARCHAR AS file, NULL::INTEGER AS line, 'npm audit fix --force' AS fix, 'npm-audit' AS tool
       FROM part),
pp AS (SELECT 'PYSEC-' || s_suppkey AS id, s_name AS title, 'Supplier nation ' || s_nationkey AS description,
              CASE s_suppkey % 4 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END,
              NULL::VARCHAR, NULL::INTEGER, 'pip install ' || s_name || '@latest', 'pip-audit'
       FROM supplier),
gv AS (SELECT 'GO-2024-' || lpad(n_nationkey::VARCHAR, 4, '0') AS id,
              CASE WHEN n_nationkey % 5 = 0 THEN 'Go vulnerability' ELSE n_name || ' advisory' END,
              CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'Region ' || n_regionkey END,
              'MEDIUM', NULL::VARCHAR, NULL::INTEGER, NULL::VARCHAR, 'govulncheck'
       FROM nation),
ck AS (SELECT 'CKV_AWS_' || (c_custkey % 300) AS id,
              upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' bucket policy',
              'Nation ' || c_nationkey,
              CASE c_custkey % 3 WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'HIGH' END,
              '/infra/' || lower(c_mktsegment) || '/main.tf', NULL::INTEGER,
              CASE WHEN c_custkey % 2 = 1 THEN 'Enable encryption' END, 'checkov'
       FROM customer),
sg AS (SELECT CASE WHEN contains(html, '<script') THEN 'html.security.inline-script'
                   ELSE 'html.best-practice.missing-alt' END AS id,
              CASE WHEN contains(html, '<script') THEN 'html.security.inline-script'
                   ELSE 'html.best-practice.missing-alt' END,
              'Page ' || page_id, 'MEDIUM', regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1),
              (page_id % 100 + 1)::INTEGER, NULL::VARCHAR, 'semgrep'
       FROM pages),
tv AS (SELECT 'CVE-' || year(o_orderdate) || '-' || o_orderkey AS id,
              CASE WHEN o_orderkey % 4 <> 0 THEN 'Order ' || o_orderkey || ' issue'
                   ELSE left('Priority ' || o_orderpriority || ' order of customer ' || o_custkey || ' needs attention', 100) END,
              'Priority ' || o_orderpriority || ' order of customer ' || o_custkey || ' needs attention',
              CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
                   WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'UNKNOWN' END,
              NULL::VARCHAR, NULL::INTEGER,
              CASE WHEN o_orderkey % 3 <> 0 THEN '1.' || (o_orderkey % 10) END, 'trivy'
       FROM orders
       UNION ALL
       SELECT 'CVE-' || year(o_orderdate) || '-' || (o_orderkey + 1000000),
              left('Base image of order ' || o_orderkey, 100), 'Base image of order ' || o_orderkey,
              'LOW', NULL::VARCHAR, NULL::INTEGER, NULL::VARCHAR, 'trivy'
       FROM orders),
oi AS (SELECT 'AWS_SG_001' AS id, 'Security group allows 0.0.0.0/0',
              'Security group rule allows traffic from anywhere', 'HIGH', 'infra/sg_' || s_suppkey || '.tf',
              NULL::INTEGER, NULL::VARCHAR, 'pattern-match'
       FROM supplier WHERE s_suppkey % 11 <> 0 AND s_acctbal > 0),
f AS (SELECT * FROM gl UNION ALL SELECT * FROM np UNION ALL SELECT * FROM pp UNION ALL SELECT * FROM gv
      UNION ALL SELECT * FROM ck UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM tv
      UNION ALL SELECT * FROM oi)"""


@derived
def _findings(spark, sf_dir):
    reports = dv.all_reports(spark, sf_dir)
    f = fo.union_findings(reports, ["all"])
    plans = dv.plan_reports(spark, sf_dir)
    return f.unionByName(fo.open_ingress(plans.select("path", F.col("report").alias("text"))))


@register("findings_normalised", f"WITH {FINDINGS_CTE} SELECT * REPLACE (line::DOUBLE AS line) FROM f")
def findings_normalised(spark, sf_dir):
    """Seven scanner report kinds plus the open-ingress pattern, one schema
    (line as DOUBLE here so missing lines compare equal across engines)."""
    return _findings(spark, sf_dir).withColumn("line", F.col("line").cast("double"))


@register("severity_rollup", f"WITH {FINDINGS_CTE} SELECT tool, severity, count(*) AS count "
          "FROM f GROUP BY ROLLUP (tool, severity)")
def severity_rollup(spark, sf_dir):
    return fo.severity_rollup(_findings(spark, sf_dir))


GATE_SQL = """count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
       count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
       count(*) FILTER (WHERE severity = 'LOW') AS low,
       CASE WHEN count(*) FILTER (WHERE severity = 'CRITICAL') > 0 THEN 'failed'
            WHEN count(*) FILTER (WHERE severity = 'HIGH') > 5 THEN 'warning' ELSE 'success' END AS status"""


@register("security_gate", f"WITH {FINDINGS_CTE} SELECT {GATE_SQL} FROM f")
def security_gate(spark, sf_dir):
    """critical > 0 fails, high > 5 warns, over all findings."""
    return fo.gate(fo.severity_counts(_findings(spark, sf_dir)))


@register("security_gate_by_tool", f"WITH {FINDINGS_CTE} SELECT tool, {GATE_SQL} FROM f GROUP BY tool")
def security_gate_by_tool(spark, sf_dir):
    return fo.gate(fo.severity_counts(_findings(spark, sf_dir), "tool"))


@register("reportable_findings", f"WITH {FINDINGS_CTE} SELECT * FROM f "
          "WHERE fix IS NOT NULL AND severity IN ('HIGH', 'CRITICAL')")
def reportable_findings(spark, sf_dir):
    return fo.reportable(_findings(spark, sf_dir))


@register("top_findings", f"""WITH {FINDINGS_CTE}
SELECT id, title, description, severity, file, line, fix, tool FROM f
ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END,
         tool NULLS FIRST, id NULLS FIRST, file NULLS FIRST, line NULLS FIRST, title NULLS FIRST,
         description NULLS FIRST, fix NULLS FIRST
LIMIT 10""")
def top_findings(spark, sf_dir):
    return fo.top_findings(_findings(spark, sf_dir), 10)


@register("ssh_exposed", """
SELECT DISTINCT 'aws_security_group.sg_' || s_suppkey AS address,
       printf('Security group %s expõe SSH (porta 22) para a internet', 'aws_security_group.sg_' || s_suppkey) AS msg
FROM supplier
WHERE s_suppkey % 11 <> 0 AND s_suppkey % 5 <> 0 AND s_acctbal > 0
  AND s_suppkey % 40 <= 22 AND s_suppkey % 40 + s_nationkey >= 22""")
def ssh_exposed(spark, sf_dir):
    """Plan rule: security group ingress from 0.0.0.0/0 over a range covering port 22."""
    return fo.ssh_exposed(rp.plan_ingress(dv.plan_reports(spark, sf_dir)))


@register("security_report", f"""WITH {FINDINGS_CTE},
c AS (SELECT tool, severity, count(*) AS n FROM f GROUP BY ALL)
SELECT tool, sum(n)::BIGINT AS findings,
       '{{' || string_agg('"' || severity || '":' || n, ',' ORDER BY severity) || '}}' AS by_severity
FROM c GROUP BY tool""")
def security_report(spark, sf_dir):
    return fo.security_report(_findings(spark, sf_dir))
