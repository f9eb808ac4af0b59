"""Job runner: a registered query runs as a job and leaves a run-log row
(status, summary, errors, duration, timestamp); the duration is stored,
not only logged."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from opslens.plans.registry import QUERIES

RUN_LOG_SCHEMA = ("job string, status string, summary string, errors string, rows long, "
                  "duration_s double, ts timestamp")


def run_job(name: str, spark: SparkSession, sf_dir: str, sink: str | None = None,
            run_log: str | None = None) -> DataFrame:
    """Run a registered query (written to ``sink`` when given, else counted)
    and return its run-log row; any failure gives status 'failed'."""
    t0 = time.perf_counter()
    status, errors, rows = "success", "", None
    try:
        df = QUERIES[name](spark, sf_dir)
        if sink:
            df.write.mode("overwrite").parquet(sink)
            rows = spark.read.parquet(sink).count()
        else:
            rows = df.count()
    except Exception as ex:  # noqa: BLE001 - recorded in the run log
        status, errors = "failed", str(ex).splitlines()[0][:500]
    dur = time.perf_counter() - t0
    log = spark.createDataFrame(
        [(name, status, f"{name}: {rows if rows is not None else 0} rows", errors, rows, dur,
          datetime.now(timezone.utc))], RUN_LOG_SCHEMA)
    if run_log:
        log.write.mode("append").parquet(run_log)
    return log
