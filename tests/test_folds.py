"""Plain-Python folds written from the detector semantics, compared with the
distributed Spark versions; tiny chunk sizes force the multi-chunk paths."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from opslens.operators import anomaly
from opslens.operators.ordered import halo_chunks, linear_scan, with_ordinal
from opslens.plans.derive import metric_points

from .conftest import SF_SMALL


def ewma_fold(values, alpha, thr, min_points=10):
    out, e, v = [], None, 0.0
    for i, x in enumerate(values):
        if e is None:
            e = x
        if i + 1 < min_points:
            continue
        e = alpha * x + (1 - alpha) * e
        d = x - e
        v = (1 - alpha) * (v + alpha * d * d)
        sd = v ** 0.5
        if sd > 0 and abs(x - e) / sd > thr:
            out.append((i, e, abs(x - e) / sd))
    return out


def test_ewma_matches_fold(spark):
    pts = metric_points(spark, SF_SMALL)
    rows = pts.orderBy("metric", "ts", "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.metric, []).append(r)
    want = set()
    for m, rs in by.items():
        for i, e, dev in ewma_fold([r.value for r in rs], 0.3, 2.0):
            want.add((m, rs[i].id, round(e, 6), round(dev, 6)))
    got = {(r.metric, r.id, round(r.expected_value, 6), round(r.deviation, 6))
           for r in anomaly.ewma(pts, alpha=0.3, threshold=2.0).collect()}
    assert got == want and len(got) > 0


def test_ewma_default_never_fires(spark):
    assert anomaly.ewma(metric_points(spark, SF_SMALL)).count() == 0


def test_linear_scan_multilevel(spark):
    rnd = random.Random(7)
    rows = [(k, i, rnd.uniform(-5, 5)) for k in ("a", "b") for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, b double")
    for a in (0.9, 0.5, 1.0):
        got = {(r.k, r.o): r.s for r in linear_scan(df, ["k"], "o", "b", a, "s", chunk_rows=6).collect()}
        for k in ("a", "b"):
            s = 0.0
            for i in range(700):
                s = a * s + next(x[2] for x in rows if x[0] == k and x[1] == i) if False else a * s + rows[
                    (0 if k == "a" else 700) + i][2]
                assert math.isclose(got[(k, i)], s, rel_tol=1e-9, abs_tol=1e-9)


def test_ordinal_across_buckets(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("m" if i % 3 else "n", t0 + dt.timedelta(seconds=rnd.randint(0, 10_000)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "metric string, ts timestamp_ntz, id long")
    o = with_ordinal(df, ["metric"], ["ts", "id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 7e8))
    got = {(r.metric, r.id): r._ord for r in o.collect()}
    for m in ("m", "n"):
        seq = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2]))
        assert [got[(m, r[2])] for r in seq] == list(range(len(seq)))


def test_rolling_moments_small_chunks(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    vals = [rnd.choice([1.0, 1.0, 2.0, 50.0]) for _ in range(300)]
    df = spark.createDataFrame([("m", t0 + dt.timedelta(seconds=i), i, v) for i, v in enumerate(vals)],
                               "metric string, ts timestamp_ntz, id long, value double")
    got = {r.id: r for r in anomaly.rolling_moments(df, history=5, chunk_rows=7).collect()}
    for i in range(300):
        w = vals[max(0, i - 4): i + 1]
        mean = sum(w) / len(w)
        assert math.isclose(got[i].mean, mean, rel_tol=1e-9)
        assert got[i].flat == (len(set(w)) == 1)
        if len(w) > 1:
            sd = (sum((x - mean) ** 2 for x in w) / (len(w) - 1)) ** 0.5
            assert math.isclose(got[i].std, sd, rel_tol=1e-7, abs_tol=1e-7)


def cooldown_fold(times, seconds):
    keep, last = [], None
    for i, t in enumerate(times):
        if last is None or t > last + seconds:
            keep.append(i)
            last = t
    return keep


@pytest.mark.parametrize("cool,chunk_rows", [(300, 8192), (3600, 8192), (21600, 8192),
                                             (300, 2), (21600, 2), (3600, 5)])
def test_cooldown_matches_fold(spark, cool, chunk_rows):
    pts = metric_points(spark, SF_SMALL)
    an = anomaly.rolling_sigma(pts, threshold=1.5)
    rows = an.orderBy("metric", "ts", "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.metric, []).append(r)
    want = set()
    for m, rs in by.items():
        ts = [(r.ts - dt.datetime(1970, 1, 1)).total_seconds() for r in rs]
        want |= {(m, rs[i].id) for i in cooldown_fold(ts, cool)}
    got = {(r.metric, r.id) for r in anomaly.cooldown(an, cool, chunk_rows=chunk_rows, group_chunks=3).collect()}
    assert got == want


def test_halo_chunks_complete(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "_ord").withColumn("k", F.lit("a"))
    h = halo_chunks(df, halo=3, chunk_rows=8)
    per = {}
    for r in h.collect():
        per.setdefault(r._chunk, []).append((r._ord, r._halo))
    for c, rs in per.items():
        own = sorted(o for o, halo in rs if not halo)
        copies = sorted(o for o, halo in rs if halo)
        assert own == list(range(c * 8, min(c * 8 + 8, 50)))
        if c > 0:
            assert copies == list(range(c * 8 - 3, c * 8))
