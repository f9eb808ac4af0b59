"""Batch = stream: the streaming detector over the events table gives the
batch anomalies; several micro-batches keep state across batches; a clear
control row forgets a metric."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from opslens.operators import anomaly
from opslens.plans.derive import metric_points
from opslens.streaming import monitor as sm

from .conftest import SF_SMALL


def _key(rows):
    return {(r.metric, r.id, round(r.expected_value, 6), round(r.deviation, 6)) for r in rows}


def test_stream_equals_batch(spark):
    pts = sm.table_stream(spark, SF_SMALL, "events").select(
        F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("id"), "value")
    got = sm.run_until_caught_up(sm.detect_stream(pts), "t-sigma").collect()
    want = anomaly.rolling_sigma(metric_points(spark, SF_SMALL)).collect()
    assert _key(got) == _key(want) and len(want) > 0


def _write_parts(spark, rows, n_parts):
    d = tempfile.mkdtemp(prefix="opslens-stream-in-")
    schema = "metric string, ts timestamp_ntz, id long, value double, control string"
    per = (len(rows) + n_parts - 1) // n_parts
    for i in range(n_parts):
        part = rows[i * per:(i + 1) * per]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(d, f"p{i:03d}"))
    return d, schema


def test_state_carries_across_micro_batches(spark):
    t0 = dt.datetime(2024, 1, 1)
    vals = [float(i % 5) for i in range(60)] + [100.0]
    rows = [("m", t0 + dt.timedelta(seconds=i), i, v, None) for i, v in enumerate(vals)]
    d, schema = _write_parts(spark, rows, 4)
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
         .option("recursiveFileLookup", "true").parquet(d))
    got = sm.run_until_caught_up(sm.detect_stream(s), "t-multi").collect()
    assert [r.id for r in got] == [60]


def test_clear_control_row(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("m", t0 + dt.timedelta(seconds=i), i, float(i % 3), None) for i in range(30)]
    rows.append(("m", t0 + dt.timedelta(seconds=30), 30, 0.0, "clear"))
    rows += [("m", t0 + dt.timedelta(seconds=31 + i), 31 + i, 1.0, None) for i in range(5)]
    rows.append(("m", t0 + dt.timedelta(seconds=40), 40, 500.0, None))
    df = spark.createDataFrame(rows, "metric string, ts timestamp_ntz, id long, value double, control string")
    d = tempfile.mkdtemp(prefix="opslens-stream-in-")
    df.coalesce(1).write.parquet(d + "/p")
    s = spark.readStream.schema(df.schema).parquet(d + "/p")
    got = sm.run_until_caught_up(sm.detect_stream(s.where(F.col("control").isNull() | (F.col("control") == "clear"))),
                                 "t-clear").collect()
    # after the clear only 6 points exist (< 10), so the spike gives no verdict
    assert [r.id for r in got] == []


def test_approval_expiry_deadline(spark):
    t0 = dt.datetime(2024, 1, 1)
    d = tempfile.mkdtemp(prefix="opslens-stream-in-")
    rq = [("a", t0), ("b", t0), ("c", t0), ("z", t0 + dt.timedelta(hours=5))]
    dc = [("a", t0 + dt.timedelta(minutes=30), "approved"), ("a", t0 + dt.timedelta(minutes=40), "rejected"),
          ("c", t0 + dt.timedelta(hours=3), "approved")]
    spark.createDataFrame(rq, "request_id string, requested_at timestamp_ntz").coalesce(1).write.parquet(d + "/rq")
    spark.createDataFrame(dc, "request_id string, decided_at timestamp_ntz, status string").coalesce(1).write.parquet(
        d + "/dc")
    r = spark.readStream.schema("request_id string, requested_at timestamp_ntz").parquet(d + "/rq")
    c = spark.readStream.schema("request_id string, decided_at timestamp_ntz, status string").parquet(d + "/dc")
    out = sm.run_until_caught_up(sm.approval_expiry_stream(r, c, timeout_seconds=3600, watermark="1 minute"), "t-exp")
    got = {x.request_id: x.status for x in sm.settle_expiry(out).collect()}
    # a: first decision wins; b: silent past its deadline; c: decided too late (final); z: still open
    assert got == {"a": "approved", "b": "expired", "c": "expired"}
