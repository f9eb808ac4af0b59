"""Expiring job state over several micro-batches against a plain loop."""

import datetime as dt
import os
import random

from opslens.streaming import monitor as sm

SCHEMA = "job string, ts timestamp_ntz, delivery string, status string"


def plain(batches, ttl):
    """As the stream: rows of a batch in time order behind the state of the job."""
    state, out, now = {}, {}, None
    for rows in batches:
        touched = set()
        for job, ts, delivery, status in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[3])):
            s = state.get(job)
            if s is None or (ts - s["ts"]).total_seconds() > ttl:
                s = state[job] = {"ts": ts, "seen": set(), "none": 0, "status": status}
            s["ts"], s["status"] = ts, status
            if delivery is None:
                s["none"] += 1
            else:
                s["seen"].add(delivery)
            touched.add(job)
            now = ts if now is None else max(now, ts)
        for job in touched:
            s = state[job]
            out[job] = (s["ts"], s["status"], len(s["seen"]) + s["none"], len(s["seen"]) + s["none"] > 3)
        state = {j: s for j, s in state.items() if (now - s["ts"]).total_seconds() <= ttl}
    return out


def test_jobs_expire(spark, tmp_path):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    batches = []
    for k in range(5):
        rows = []
        for i in range(80):
            job = rng.choice(["a", "b", "c", None, f"j{rng.randrange(20)}"])
            if k in (2, 3) and job == "a":
                continue  # long enough away to be forgotten
            ts = t0 + dt.timedelta(seconds=k * 100 + i + (30 if job == "b" and i > 40 else 0))
            rows.append((job, ts, rng.choice([None, f"d{rng.randrange(30)}"]), f"s{k}-{i:03d}"))
        rows.append(("x", None, "d", "s"))
        batches.append(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        for at, _, names in os.walk(f"{tmp_path}/p{k}"):
            for name in names:
                os.utime(f"{at}/{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    events = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(tmp_path)))
    jobs = sm.ExpiringState(events, "job", "ts", ["status"], ["status"], "delivery", 60)
    got = {r.job: (r.ts, r.status, r.attempts, r.dead_letter) for r in sm.run_expiring(jobs, "t-expiring").collect()}
    assert got == plain(batches, 60)
    assert got["a"][2] < 60 and len(got) > 15


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, i), f"d{i}", f"s{i}") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    jobs = sm.ExpiringState(df, "job", "ts", ["status"], ["status"], "delivery", 60)
    first = jobs.step(df.where("status < 's3'"), 0, str(tmp_path / "s")).collect()
    for _ in range(2):
        again = jobs.step(df.where("status >= 's2'"), 1, str(tmp_path / "s")).collect()
    assert [r.attempts for r in first] == [3] and [r.attempts for r in again] == [6]
