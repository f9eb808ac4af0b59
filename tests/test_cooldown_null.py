"""Cooldown keeps the anomalies of a null metric, over one chunk or many, as the plain fold does."""

import datetime as dt
import random

import pytest

from opslens.operators import anomaly


@pytest.mark.parametrize("chunk_rows", [8192, 4])
def test_null_metric(spark, chunk_rows):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted((t0 + dt.timedelta(seconds=rng.randrange(1500)), i) for i in range(60))
    rows = [(None if i % 2 else "m", ts, i) for ts, i in rows]
    want, last = set(), {}
    for metric, ts, i in rows:
        if metric not in last or (ts - last[metric]).total_seconds() > 100:
            want.add(i)
            last[metric] = ts
    a = spark.createDataFrame(rows, "metric string, ts timestamp_ntz, id long")
    assert {r.id for r in anomaly.cooldown(a, 100, chunk_rows=chunk_rows, group_chunks=2).collect()} == want
    assert any(i % 2 for i in want)
