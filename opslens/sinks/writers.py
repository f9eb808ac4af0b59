"""Writers for the operators' results. Every writer is a plain DataFrame
write into a folder (partitioned where a natural date key exists); nothing
is delivered to outside services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_incidents(incidents: DataFrame, path: str, ts_col: str = "start_time") -> None:
    """One JSON record per incident, partitioned by date; a later write of the
    same id supersedes it on read (see ``latest_incidents``)."""
    (incidents.withColumn("written_at", F.current_timestamp())
     .withColumn("date", F.to_date(F.coalesce(F.try_to_timestamp(F.col(ts_col)), F.current_timestamp())))
     .write.mode("append").partitionBy("date").json(path))


def latest_incidents(spark, path: str) -> DataFrame:
    """Incidents as last written per id."""
    d = spark.read.json(path)
    return d.groupBy("incident_id").agg(F.max_by(F.struct(*[c for c in d.columns]), "written_at").alias("r")).select("r.*")


def write_reports(reports: DataFrame, path: str, day_col: str = "day") -> None:
    reports.write.mode("append").partitionBy(day_col).parquet(path)


def write_artifact(df: DataFrame, name: str, path: str) -> str:
    """JSON artifact folder named <name>_<yyyymmdd_HHMMSS>."""
    from datetime import datetime, timezone
    out = f"{path.rstrip('/')}/{name}_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}"
    df.write.mode("error").json(out)
    return out


def write_security_report(findings: DataFrame, path: str) -> None:
    """Summary row per tool plus the findings, partitioned by tool."""
    from opslens.operators.findings import security_report
    security_report(findings).write.mode("overwrite").json(f"{path.rstrip('/')}/summary")
    findings.write.mode("overwrite").partitionBy("tool").json(f"{path.rstrip('/')}/findings")


def write_text(lines: DataFrame, col: str, path: str) -> None:
    """Text sink (rule YAML blocks, exposition text) - one line per row."""
    lines.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
