"""Boundary cases named in the survey: n = 9/10/11 points, zero variance,
gaps of 299/300/301 s, cooldown of exactly 300 s, cpu 20/80 and memory 40/85,
6/7 forecast points, 0/1 critical and 5/6 high findings, a job without
job_id, layer modifiers, and empty / unknown / wrong-extension files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslens.operators import anomaly, capacity, findings, render, timeline
from opslens.operators import filesig as fs

T0 = dt.datetime(2024, 1, 1)


def points(spark, values, metric="m", step=60):
    rows = [(metric, T0 + dt.timedelta(seconds=i * step), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, ts timestamp_ntz, id long, value double")


@pytest.mark.parametrize("n,fires", [(9, False), (10, False), (11, True)])
def test_sigma_needs_points(spark, n, fires):
    # n-1 equal values then a spike: with the point included, z max = (n-1)/sqrt(n)
    vals = [1.0] * (n - 1) + [1000.0]
    got = anomaly.rolling_sigma(points(spark, vals)).count()
    assert (got > 0) == fires


def test_sigma_zero_variance(spark):
    assert anomaly.rolling_sigma(points(spark, [5.0] * 40)).count() == 0


def test_sigma_window_is_last_1000(spark):
    # a level shift is anomalous only relative to the trailing window
    vals = [float(i % 7) for i in range(1200)] + [50.0]
    r = anomaly.rolling_sigma(points(spark, vals)).collect()
    assert [x.id for x in r] == [1200]
    py = vals[-1000:]
    mean = sum(py) / 1000
    assert abs(r[0].expected_value - mean) < 1e-9


@pytest.mark.parametrize("gap,same", [(299, True), (300, False), (301, False)])
def test_gap_clusters_strict(spark, gap, same):
    rows = [("i", T0, 0, "a"), ("i", T0 + dt.timedelta(seconds=gap), 1, "b")]
    df = spark.createDataFrame(rows, "incident_id string, ts timestamp_ntz, ord long, description string")
    cl = timeline.gap_clusters(df, ["incident_id"], 300).select("cluster").distinct().count()
    assert (cl == 1) == same


@pytest.mark.parametrize("gap,kept", [(300, 1), (301, 2)])
def test_cooldown_exactly_300(spark, gap, kept):
    rows = [("m", T0, 1, 9.0, 1.0, 4.0, "warning", "x"),
            ("m", T0 + dt.timedelta(seconds=gap), 2, 9.0, 1.0, 4.0, "warning", "x")]
    an = spark.createDataFrame(rows, "metric string, ts timestamp_ntz, id long, value double, "
                                     "expected_value double, deviation double, severity string, description string")
    assert anomaly.cooldown(an, 300).count() == kept


def test_cooldown_suppressed_do_not_extend(spark):
    # 0, 200 (suppressed), 350 (> 0+300, emitted) -> 2 kept
    rows = [("m", T0 + dt.timedelta(seconds=s), i, 1.0, 0.0, 4.0, "warning", "")
            for i, s in enumerate([0, 200, 350])]
    an = spark.createDataFrame(rows, "metric string, ts timestamp_ntz, id long, value double, "
                                     "expected_value double, deviation double, severity string, description string")
    assert sorted(r.id for r in anomaly.cooldown(an, 300).collect()) == [0, 2]


@pytest.mark.parametrize("cpu,mem,rec", [(19.9, 39.9, "downgrade"), (20.0, 30.0, "keep"), (10.0, 40.0, "keep"),
                                         (80.0, 85.0, "keep"), (80.1, 10.0, "upgrade"), (50.0, 85.1, "upgrade")])
def test_rightsize_boundaries(spark, cpu, mem, rec):
    df = spark.createDataFrame([("t3.small", cpu, mem)], "instance_type string, avg_cpu double, avg_memory double")
    assert capacity.rightsize(df).first().recommended == rec


@pytest.mark.parametrize("n,rows", [(6, 0), (7, 1)])
def test_forecast_needs_7_points(spark, n, rows):
    s = spark.createDataFrame([("m", T0.date() + dt.timedelta(days=i), float(i)) for i in range(n)],
                              "metric string, day date, y double")
    t = capacity.trend(capacity.daily_series(s, "metric", "day", "y"), "metric")
    assert t.count() == rows


def test_forecast_values(spark):
    s = spark.createDataFrame([("m", T0.date() + dt.timedelta(days=i), 2.0 * i + 1) for i in range(10)],
                              "metric string, day date, y double")
    t = capacity.trend(capacity.daily_series(s, "metric", "day", "y"), "metric")
    f = capacity.linear_forecast(t, "metric", 3).orderBy("step").collect()
    # x = n + i (the first step skips one index)
    assert [r.value for r in f] == [2.0 * 11 + 1, 2.0 * 12 + 1, 2.0 * 13 + 1]


@pytest.mark.parametrize("crit,high,status", [(0, 5, "success"), (0, 6, "warning"), (1, 0, "failed")])
def test_security_gate(spark, crit, high, status):
    rows = [("x", "t", "", "CRITICAL", None, None, None, "a")] * crit + \
           [("x", "t", "", "HIGH", None, None, None, "a")] * high + [("x", "t", "", "LOW", None, None, None, "a")]
    f = spark.createDataFrame(rows, "id string, title string, description string, severity string, file string, "
                                    "line int, fix string, tool string")
    assert findings.gate(findings.severity_counts(f)).first().status == status


def test_job_without_job_id_is_quarantined(spark):
    body = ('{"project":"p","variation":"v","artist":"a","filename":"f.blend",'
            '"input_uri":"s3://b/k","output_uri":"s3://o/k"}')
    ok = body.replace('{"project"', '{"job_id":"j1","project"')
    df = spark.createDataFrame([(1, body), (2, ok), (3, "not json")], "mid int, body string")
    valid, quarantine = render.parse_jobs(df, "body")
    assert [r.mid for r in valid.collect()] == [2]
    assert valid.first().priority == 0
    q = {r.mid: r.missing_keys for r in quarantine.collect()}
    assert q[1] == "job_id" and q[3].startswith("job_id,project")


@pytest.mark.parametrize("layers,want", [
    ("(Sup), X", ["SPOTLAR_SUPORTE_X"]),
    ("X_i", ["SPOTLAR_OFERTA_X"]),
    ("SemX", []),
    ("(Sup), SemX, Y", ["SPOTLAR_OFERTA_Y"]),
    ("(Sup), (Sup), X", ["SPOTLAR_SUPORTE_(Sup)", "SPOTLAR_OFERTA_X"]),
    ("(Sup) T1, B", ["SPOTLAR_OFERTA_(Sup) T1", "SPOTLAR_OFERTA_B"]),
    ("A, (Sup)", ["SPOTLAR_OFERTA_A"]),
])
def test_layer_list(spark, layers, want):
    df = spark.createDataFrame([(layers,)], "l string")
    assert df.select(render.normalise_layers("l").alias("x")).first().x == want


@pytest.mark.parametrize("res,w,h", [("1920x1080", 1920, 1080), ("800X600", 800, 600), ("640,480", 640, 480),
                                     ("hd", 1920, 1080), (" 10x10", 1920, 1080)])
def test_resolution(spark, res, w, h):
    r = spark.createDataFrame([(res,)], "r string").select(render.parse_resolution("r").alias("x")).first().x
    assert (r.w, r.h) == (w, h)


def test_files_empty_unknown_wrong_extension(spark):
    rows = [("a/empty.obj", b""), ("a/unknown.obj", b"zzzz plain text"),
            ("a/scene.fbx", b"BLENDER-v300 rest"), ("a/scene.blend", b"BLENDER-v300 rest")]
    df = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in rows],
                               "path string, content binary, length long")
    got = {r.path: r.status for r in fs.validate(df).collect()}
    assert got == {"a/empty.obj": "invalid", "a/unknown.obj": "unknown",
                   "a/scene.fbx": "wrong_extension", "a/scene.blend": "valid"}
