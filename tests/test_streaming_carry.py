"""The streaming detector over several micro-batches against a plain loop over the rows."""

import datetime as dt
import inspect
import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from opslens.streaming import monitor as sm

SCHEMA = "metric string, ts timestamp_ntz, id long, value double, control string"


def plain(batches, method, threshold, alpha, history, min_points, cooldown):
    state, out = {}, []
    for rows in batches:
        for m, ts, i, x, control in sorted(rows, key=lambda r: (r[1], r[2])):
            if control == "clear":
                state.pop(m, None)
                continue
            s = state.setdefault(m, {"xs": [], "n": 0, "e": x, "v": 0.0, "last": None})
            s["n"] += 1
            s["xs"] = [*s["xs"], x][-history:]
            if s["n"] < min_points:
                continue
            if method == "ewma":
                s["e"] = alpha * x + (1 - alpha) * s["e"]
                s["v"] = (1 - alpha) * (s["v"] + alpha * (x - s["e"]) ** 2)
                mean, sd = s["e"], math.sqrt(s["v"])
            else:
                mean, sd = statistics.fmean(s["xs"]), statistics.stdev(s["xs"])
            if sd == 0 or abs(x - mean) / sd <= threshold:
                continue
            t = ts.timestamp()
            if cooldown is not None and s["last"] is not None and t <= s["last"] + cooldown:
                continue
            s["last"] = t
            out.append((m, i, round(mean, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("method,cooldown", [("sigma", 40.0), ("ewma", None)])
def test_carried_state(spark, tmp_path, method, cooldown):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    batches = []
    for k in range(3):
        rows = []
        for i in range(k * 150, k * 150 + 150):
            ts = t0 + dt.timedelta(seconds=10 * i - (700 if i % 11 == 0 else 0))   # some arrive late
            metric = rng.choice(["hot", "hot", None, "other"]) if k != 1 else rng.choice(["hot", None])
            rows.append((metric, ts, i, rng.gauss(0, 1), "clear" if i in (80, 210) else None))
        batches.append(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        for at, _, names in os.walk(f"{tmp_path}/p{k}"):
            for name in names:
                os.utime(f"{at}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    points = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(tmp_path)))
    args = {"method": method, "threshold": 1.3, "alpha": 0.3, "history": 20, "min_points": 10, "cooldown": cooldown}
    found = sm.run_until_caught_up(sm.detect_stream(points, **args), "t-carry")
    got = sorted(((r.metric, r.id, round(r.expected_value, 6)) for r in found.collect()), key=str)
    want = plain(batches, **args)
    assert [g[:2] for g in got] == [w[:2] for w in want] and {g[0] for g in got} >= {"hot", None}
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_no_python_group_takes_a_metric():
    assert "applyInPandas" not in inspect.getsource(sm)
