"""Scanner report parsers: JSON report text -> normalised findings.

Every parser takes a DataFrame with a JSON string column (one report per
row, as read by ``spark.read.text(path, wholetext=True)`` or from a table)
and returns rows of the common finding schema. Schemas are declared, so no
inference pass runs over the reports; malformed reports parse to null and
yield no findings (a failed report is skipped, not counted as zero).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING_COLS = ["id", "title", "description", "severity", "file", "line", "fix", "tool"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

GITLEAKS_SCHEMA = "array<struct<RuleID:string,Description:string,File:string,StartLine:int>>"
NPM_SCHEMA = "struct<vulnerabilities:map<string,string>>"
PIP_SCHEMA = "array<struct<id:string,name:string,description:string,severity:string>>"
GO_SCHEMA = ("struct<findings:array<struct<vulnerability_id:string,"
             "osv:struct<summary:string,details:string>>>>")
CHECKOV_SCHEMA = ("struct<results:struct<failed_checks:array<struct<check_id:string,"
                  "check_name:string,check_message:string,severity:string,file_path:string,"
                  "fix_definition:string>>>>")
SEMGREP_SCHEMA = ("struct<results:array<struct<check_id:string,message:string,path:string,"
                  "start:struct<line:int>>>>")
TRIVY_SCHEMA = ("struct<Results:array<struct<Vulnerabilities:array<struct<VulnerabilityID:string,"
                "Title:string,Description:string,Severity:string,"
                "FixPublished:struct<FixedVersion:string>>>>>>")
PLAN_SCHEMA = ("struct<resource_changes:array<struct<address:string,type:string,"
               "change:struct<after:struct<ingress:array<struct<cidr_blocks:array<string>,"
               "from_port:int,to_port:int>>>>>>>")


def norm_severity(c: Column) -> Column:
    """Upper-case; anything outside the four levels becomes MEDIUM."""
    u = F.upper(c)
    return F.when(u.isin(SEVERITIES), u).otherwise(F.lit("MEDIUM"))


def _out(df: DataFrame, **cols: Column) -> DataFrame:
    typed = {"line": "int"}
    return df.select(*[cols.get(k, F.lit(None)).cast(typed.get(k, "string")).alias(k)
                       for k in FINDING_COLS])


def parse_gitleaks(reports: DataFrame, col: str = "report") -> DataFrame:
    f = reports.select(F.explode(F.from_json(col, GITLEAKS_SCHEMA)).alias("f"))
    rule = F.col("f.RuleID")
    return _out(f, id=F.coalesce(rule, F.lit("secret")),
                title=F.concat(F.lit("Secret detected: "), F.coalesce(rule, F.lit("unknown"))),
                description=F.coalesce("f.Description", F.lit("")), severity=F.lit("CRITICAL"),
                file=F.coalesce("f.File", F.lit("")), line=F.col("f.StartLine"), tool=F.lit("gitleaks"))


def parse_npm(reports: DataFrame, col: str = "report") -> DataFrame:
    """``vulnerabilities`` is a map name -> {severity, via}; ``via[0]`` is an
    advisory object (its url) or a plain string; the id is the last URL
    segment, at most 20 characters."""
    m = reports.select(F.explode(F.from_json(col, NPM_SCHEMA)["vulnerabilities"]).alias("name", "v"))
    # read each entry once: severity and the via array, then its first element
    m = m.select("name", F.json_tuple("v", "severity", "via").alias("_sev", "_via"))
    m = m.select("name", "_sev", "_via", F.get_json_object("_via", "$[0]").alias("_via0"))
    via0 = F.col("_via0")
    is_obj = F.ltrim(via0).startswith("{")
    url = F.when(is_obj, F.coalesce(F.get_json_object(via0, "$.url"), F.lit("npm"))).otherwise(via0)
    vid = F.when(via0.isNull(), F.lit("npm")).otherwise(
        F.substring(F.element_at(F.split(url, "/"), -1), 1, 20))
    desc = F.concat(F.lit("Via: "), F.coalesce(via0, F.col("_via"), F.lit("[]")))
    return _out(m, id=vid, title=F.concat(F.lit("NPM vulnerability in "), F.col("name")),
                description=desc,
                severity=norm_severity(F.coalesce(F.col("_sev"), F.lit("unknown"))),
                fix=F.lit("npm audit fix --force"), tool=F.lit("npm-audit"))


def parse_pip(reports: DataFrame, col: str = "report") -> DataFrame:
    f = reports.select(F.explode(F.from_json(col, PIP_SCHEMA)).alias("f"))
    return _out(f, id=F.coalesce("f.id", F.lit("pip")), title=F.coalesce("f.name", F.lit("unknown")),
                description=F.coalesce("f.description", F.lit("")),
                severity=F.upper(F.coalesce("f.severity", F.lit("MEDIUM"))),
                fix=F.concat(F.lit("pip install "), F.coalesce("f.name", F.lit("None")), F.lit("@latest")),
                tool=F.lit("pip-audit"))


def parse_govuln(reports: DataFrame, col: str = "report") -> DataFrame:
    f = reports.select(F.explode(F.from_json(col, GO_SCHEMA)["findings"]).alias("f"))
    return _out(f, id=F.coalesce("f.vulnerability_id", F.lit("go")),
                title=F.coalesce("f.osv.summary", F.lit("Go vulnerability")),
                description=F.coalesce("f.osv.details", F.lit("")), severity=F.lit("MEDIUM"),
                tool=F.lit("govulncheck"))


def parse_checkov(reports: DataFrame, col: str = "report") -> DataFrame:
    f = reports.select(F.explode(F.from_json(col, CHECKOV_SCHEMA)["results"]["failed_checks"]).alias("f"))
    return _out(f, id=F.coalesce("f.check_id", F.lit("CKV")),
                title=F.coalesce("f.check_name", F.lit("IaC misconfiguration")),
                description=F.coalesce("f.check_message", F.lit("")),
                severity=F.upper(F.coalesce("f.severity", F.lit("HIGH"))),
                file=F.coalesce("f.file_path", F.lit("")), fix=F.col("f.fix_definition"),
                tool=F.lit("checkov"))


def parse_semgrep(reports: DataFrame, col: str = "report") -> DataFrame:
    f = reports.select(F.explode(F.from_json(col, SEMGREP_SCHEMA)["results"]).alias("f"))
    return _out(f, id=F.coalesce("f.check_id", F.lit("SEMGREP")),
                title=F.coalesce("f.check_id", F.lit("SAST finding")),
                description=F.coalesce("f.message", F.lit("")), severity=F.lit("MEDIUM"),
                file=F.coalesce("f.path", F.lit("")), line=F.col("f.start.line"), tool=F.lit("semgrep"))


def parse_trivy(reports: DataFrame, col: str = "report") -> DataFrame:
    """All result targets (the reference reads only the first one)."""
    t = reports.select(F.explode(F.from_json(col, TRIVY_SCHEMA)["Results"]).alias("t"))
    f = t.select(F.explode("t.Vulnerabilities").alias("f"))
    desc = F.coalesce("f.Description", F.lit(""))
    return _out(f, id=F.coalesce("f.VulnerabilityID", F.lit("CVE")),
                title=F.coalesce("f.Title", F.substring(desc, 1, 100)), description=desc,
                severity=F.upper(F.coalesce("f.Severity", F.lit("MEDIUM"))),
                fix=F.col("f.FixPublished.FixedVersion"), tool=F.lit("trivy"))


PARSERS = {
    "gitleaks": parse_gitleaks, "npm": parse_npm, "pip": parse_pip, "govuln": parse_govuln,
    "checkov": parse_checkov, "semgrep": parse_semgrep, "trivy": parse_trivy,
}


def plan_ingress(plans: DataFrame, col: str = "report") -> DataFrame:
    """Plan JSON -> one row per (resource, ingress rule, cidr)."""
    r = plans.select(F.explode(F.from_json(col, PLAN_SCHEMA)["resource_changes"]).alias("r"))
    i = r.where(F.col("r.change.after").isNotNull()).select(
        F.col("r.address").alias("address"), F.col("r.type").alias("type"),
        F.explode("r.change.after.ingress").alias("ing"))
    return i.select("address", "type", F.col("ing.from_port").alias("from_port"),
                    F.col("ing.to_port").alias("to_port"),
                    F.explode("ing.cidr_blocks").alias("cidr"))
