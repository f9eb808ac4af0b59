"""Security findings: union, roll-ups, gate, reportable filter, top-k,
open-ingress and SSH-exposure rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.sources import reports as rp

# Fixed values (gate thresholds and policy text as the reference states them).
CRITICAL_THRESHOLD = 0
HIGH_THRESHOLD = 5
SSH_PORT = 22
OPEN_CIDR = "0.0.0.0/0"
SSH_MESSAGE = "Security group %s expõe SSH (porta 22) para a internet"
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def union_findings(reports: Mapping[str, DataFrame], types: list[str] | None = None) -> DataFrame:
    """Parse each enabled report kind and concatenate ('all' or None = every kind)."""
    kinds = list(reports) if not types or "all" in types else [t for t in types if t in reports]
    out = None
    for k in kinds:
        f = rp.PARSERS[k](reports[k])
        out = f if out is None else out.unionByName(f)
    return out


def severity_counts(findings: DataFrame, *group: str) -> DataFrame:
    s = F.col("severity")
    return findings.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "CRITICAL").alias("critical"),
        F.count_if(s == "HIGH").alias("high"), F.count_if(s == "MEDIUM").alias("medium"),
        F.count_if(s == "LOW").alias("low"))


def gate(counts: DataFrame, critical: int = CRITICAL_THRESHOLD, high: int = HIGH_THRESHOLD) -> DataFrame:
    """critical > threshold -> failed; else high > threshold -> warning; else success."""
    return counts.withColumn("status", F.when(F.col("critical") > critical, "failed")
                             .when(F.col("high") > high, "warning").otherwise("success"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by tool and severity with per-tool subtotals and a grand total."""
    return findings.rollup("tool", "severity").agg(F.count(F.lit(1)).alias("count"))


def severity_rank():
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(m[F.col("severity")], F.lit(len(SEVERITY_RANK)))


def top_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    """Most severe first (the cap is the feature); full column order breaks ties."""
    return (findings.withColumn("rank_key", severity_rank())
            .orderBy("rank_key", "tool", "id", "file", "line", "title", "description", "fix")
            .limit(k).drop("rank_key"))


def reportable(findings: DataFrame, fixed_only: bool = True,
               severities: tuple[str, ...] = ("HIGH", "CRITICAL")) -> DataFrame:
    f = findings.where(F.col("severity").isin(list(severities)))
    return f.where(F.col("fix").isNotNull()) if fixed_only else f


def ssh_exposed(ingress: DataFrame) -> DataFrame:
    """Security groups open to the internet on a port range covering 22."""
    hit = ingress.where((F.col("type") == "aws_security_group") & (F.col("cidr") == OPEN_CIDR) &
                        (F.col("from_port") <= SSH_PORT) & (F.col("to_port") >= SSH_PORT))
    return hit.select("address", F.format_string(SSH_MESSAGE, "address").alias("msg")).distinct()


def open_ingress(files: DataFrame) -> DataFrame:
    """files(path, text): IaC text mentioning a security group and 0.0.0.0/0."""
    hit = files.where(F.col("text").contains("aws_security_group") &
                      F.col("text").rlike(r"0\.0\.0\.0/0"))
    return rp._out(hit, id=F.lit("AWS_SG_001"), title=F.lit("Security group allows 0.0.0.0/0"),
                   description=F.lit("Security group rule allows traffic from anywhere"),
                   severity=F.lit("HIGH"), file=F.col("path"), tool=F.lit("pattern-match"))


def iac_files(paths: DataFrame, col: str = "path") -> DataFrame:
    """Terraform files not named like tests, and Dockerfiles, outside
    .git / node_modules / .venv."""
    p = F.col(col)
    name = F.element_at(F.split(p, "/"), -1)
    skip = p.rlike(r"(^|/)(\.git|node_modules|\.venv)(/|$)")
    tf = name.endswith(".tf") & ~name.contains("test")
    docker = (name == "Dockerfile") | name.startswith("Dockerfile.")
    return paths.where(~skip & (tf | docker))


def security_report(findings: DataFrame) -> DataFrame:
    """Per tool: count and a JSON severity summary (bounded by 5 levels)."""
    c = findings.groupBy("tool", "severity").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("tool").agg(
        F.sum("n").alias("findings"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n"))))).alias("by_severity"))


SCHEMAS = {"gitleaks": rp.GITLEAKS_SCHEMA, "npm": rp.NPM_SCHEMA, "pip": rp.PIP_SCHEMA, "govuln": rp.GO_SCHEMA,
           "checkov": rp.CHECKOV_SCHEMA, "semgrep": rp.SEMGREP_SCHEMA, "trivy": rp.TRIVY_SCHEMA}


def tool_status(reports: Mapping[str, DataFrame], col: str = "report") -> DataFrame:
    """Per report kind: reports read, unreadable ones, and success when all
    parse; plus the sets of successful and failed tools (one row)."""
    rows = None
    for k, df in reports.items():
        # malformed text: from_json would give an all-null struct, so test the JSON itself
        r = df.select(F.lit(k).alias("tool"), F.try_parse_json(col).isNull().alias("_bad"))
        rows = r if rows is None else rows.unionByName(r)
    per = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("reports"),
                                   F.count_if("_bad").alias("unreadable")).withColumn(
        "success", F.col("unreadable") == 0)
    return per


def tool_sets(status: DataFrame) -> DataFrame:
    """successful / failed tool sets (bounded by the number of tools)."""
    return status.agg(
        F.array_sort(F.collect_set(F.when(F.col("success"), F.col("tool")))).alias("successful"),
        F.array_sort(F.collect_set(F.when(~F.col("success"), F.col("tool")))).alias("failed"))
