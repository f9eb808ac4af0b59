"""Detectors on rough rows: repeats, null ids, null and NaN values, ties, storms, one hot hour."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.operators import anomaly
from opslens.operators.ordered import quantile_buckets, with_ordinal

T0 = dt.datetime(2024, 1, 1)
POINT = "metric string, ts timestamp_ntz, id long, value double"


def order(row):
    return tuple((x is not None, x or 0) if i else x or T0 for i, x in enumerate(row[1:]))


def rough(n, seed):
    """Points in which the value, the id and the metric can be missing, times tie and rows repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = (rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(n) // 3 * 3),
               rng.choice([None, i, i // 5]), rng.choice([None, 5.0, 5.0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 30)]))
        rows += [row] * rng.choice([1, 1, 1, 3])
    return rows


def sigma_fold(rows, history, threshold, min_points):
    out, held = [], {}
    for row in sorted((r for r in rows if r[3] is not None), key=order):
        xs = held.setdefault(row[0], [])
        xs.append(row[3])
        xs[:] = xs[-history:]
        if len(xs) < min_points or any(map(math.isnan, xs)) or len(set(xs)) == 1:
            continue
        mean, sd = statistics.fmean(xs), statistics.stdev(xs)
        if abs(row[3] - mean) / sd > threshold:
            out.append((*row, round(mean, 6), round(abs(row[3] - mean) / sd, 6)))
    return out


@pytest.mark.parametrize("nans", [0, 4])
def test_rolling_sigma_on_rough_points(spark, nans):
    rows = rough(900, 5)
    for k in range(nans):
        rows[150 + 140 * k] = ("a", rows[150 + 140 * k][1], 7, float("nan"))
    want = sigma_fold(rows, 40, 1.5, 10)
    got = anomaly.rolling_sigma(spark.createDataFrame(rows, POINT), threshold=1.5, history=40, chunk_rows=64).collect()
    got = [(r.metric, r.ts, r.id, r.value, round(r.expected_value, 6), round(r.deviation, 6)) for r in got]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 40


def test_one_nan_raises_no_alarm(spark):
    rows = [("m", T0 + dt.timedelta(seconds=i), i, float("nan") if i == 20 else 1.0 + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, POINT)
    assert anomaly.rolling_sigma(df, threshold=1.05).count() == 0
    assert anomaly.ewma(df, threshold=1.05).where("id >= 20").count() == 0


def test_large_offset(spark):
    rng = random.Random(2)
    rows = [("m", T0 + dt.timedelta(seconds=i), i, 1e9 + rng.gauss(0, 1)) for i in range(500)]
    got = {r.id: r for r in anomaly.rolling_moments(spark.createDataFrame(rows, POINT), history=50).collect()}
    for i in range(60, 500):
        assert got[i].std == pytest.approx(statistics.stdev(x[3] for x in rows[i - 49:i + 1]), rel=1e-6)


def cooldown_fold(rows, seconds):
    out, last = [], {}
    for row in sorted((r for r in rows if r[1] is not None), key=order):
        if row[0] not in last or (row[1] - last[row[0]]).total_seconds() > seconds:
            out.append(row)
            last[row[0]] = row[1]
    return out


@pytest.mark.parametrize("seconds,chunk,group", [(20, 8192, 512), (20, 16, 4), (300, 7, 3), (7200, 5, 2), (0.5, 11, 3)])
def test_cooldown_on_rough_points(spark, seconds, chunk, group):
    rows = rough(700, 9) + [("storm", T0 + dt.timedelta(microseconds=i // 2 * 40_000), i, 1.0) for i in range(1200)]
    rows += [("a", None, 3, 1.0)]
    got = anomaly.cooldown(spark.createDataFrame(rows, POINT), seconds, chunk_rows=chunk, group_chunks=group).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cooldown_fold(rows, seconds), key=str)


def test_jump_functions_compose():
    rng = random.Random(3)
    for _ in range(300):
        times = np.array(sorted(rng.randrange(200) for _ in range(rng.randint(2, 40))))
        cut = rng.randint(1, len(times) - 1)
        cool = rng.choice([1, 7, 40, 300])
        one, two = anomaly.Jump.of(times[:cut], cool), anomaly.Jump.of(times[cut:], cool)
        for before in range(int(times[0]) - cool - 2, int(times[0]) + 1):
            last = before
            for t in times.tolist():
                last = t if t > last + cool else last
            assert one.then(two)(np.array([before]))[0] == last


def test_buckets_cut_a_third_of_all_rows_at_one_instant(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), (F.col("id") % 50).cast("string"))).alias("metric"),
        F.when(F.col("id") % 3 == 0, F.lit(T0)).otherwise(F.lit(T0) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
        (F.col("id") * 64).alias("id"))  # ids of one instant are cut by their value
    cut, names = quantile_buckets(df, ["ts", "id"], parts=32)
    assert cut.groupBy("metric", *names).count().agg(F.max("count")).first()[0] < 60_000 / 16
    got = with_ordinal(df, ["metric"], ["ts", "id"]).where("metric = 'hot'").select((F.col("_ord") * 192 == F.col("id")).alias("ok"))
    assert got.agg(F.min("ok"), F.count("*")).first() == (True, 20_000)
