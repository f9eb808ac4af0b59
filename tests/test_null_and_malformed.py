"""Null keys and times in ordered work, one malformed row for each reader, ties in exact
quantiles, streams over folders of shuffled part files."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opslens.operators import alerts as al
from opslens.operators import render as rd
from opslens.operators import textsearch as ts
from opslens.operators.ordered import ORD, linear_scan, with_ordinal
from opslens.plans import QUERIES, more_q
from opslens.sources import metrics as ms
from opslens.streaming import monitor as sm
from opslens.tables import TABLES, table

from .conftest import SF_SMALL


def test_ordinal_keeps_null_keys_and_times(spark):
    rows = [(None if i % 3 == 0 else f"k{i % 3}", None if i % 5 == 0 else i * 700, i) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    got = {r.id: r[ORD] for r in with_ordinal(df, ["k"], ["t", "id"], F.floor(F.col("t") / 3600)).collect()}
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r.id: r.n - 1 for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert got == want and len(got) == 80


def test_scan_carries_state_of_a_null_key(spark):
    df = spark.createDataFrame([(None, i, 1.0) for i in range(50)], "k string, o long, b double")
    got = {r.o: r.s for r in linear_scan(df, ["k"], "o", "b", 1.0, "s", chunk_rows=4).collect()}
    assert got == {i: pytest.approx(i + 1.0) for i in range(50)}


def test_quantiles_with_ties_and_null_group(spark):
    rows = [("same", 5.0)] * 300 + [(None, float(i)) for i in range(11)] + [("one", 2.0), ("gap", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in al.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 0.95]).collect()}
    assert (got["same"].p0, got["same"].p50, got["same"].p95) == (5.0, 5.0, 5.0)
    assert got[None].p50 == 5.0 and got[None].p95 == pytest.approx(np.quantile(range(11), 0.95))
    assert got["one"].p95 == 2.0 and "gap" not in got


def test_malformed_rows_do_not_fail_the_job(spark):
    one = spark.range(1)

    def val(c):
        return one.select(c.alias("x")).first().x

    assert val(rd.error_digest(F.lit("Traceback (most recent call last)"), F.lit("x"))).startswith("Traceback")
    assert tuple(val(rd.split_uri(F.lit("s3://bucket"))))[:3] == ("s3", "bucket", "")
    assert tuple(val(rd.parse_resolution(F.lit("9" * 30 + "x1")))) == rd.DEFAULT_RESOLUTION
    assert tuple(val(ms.split_key(F.lit("a/b")))) == ("a", "b", None, None)
    job = {k: "v" for k in rd.REQUIRED_JOB_KEYS} | {"priority": "high"}
    valid, bad = rd.parse_jobs(spark.createDataFrame([(json.dumps(job),), ("{",)], "body string"))
    assert valid.first().priority == 0 and bad.count() == 1
    short = spark.createDataFrame([('{"status":"ok","data":{"result":[{"metric":{},"value":["1"]}]}}',)], "response string")
    assert ms.parse_instant(short).first().value is None
    odd = spark.createDataFrame([('{"status":"ok","data":{"result":[{"metric":{},"values":[["1"],["x","y"]]}]}}',)],
                                "response string")
    assert [r.value for r in ms.parse_range(odd).collect()] == [None, None]


def test_short_and_empty_patterns(spark):
    t = spark.createDataFrame([("abc",), ("",), ("xb",)], "t string")
    p = spark.createDataFrame([("b",), ("",), ("abcd",), ("bc",)], "p string")
    got = sorted((r.t, r.p) for r in ts.contains_join(t, "t", p, "p").collect())
    assert got == sorted((a, b) for a in ("abc", "", "xb") for b in ("b", "", "abcd", "bc") if b in a)


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The small tables, events and lineitem as folders of four part files in shuffled order."""
    at = tmp_path_factory.mktemp("scattered")
    for name in TABLES:
        df = table(spark, SF_SMALL, name)
        if name in ("events", "lineitem"):
            df.orderBy(F.rand(7)).repartition(4).write.parquet(f"{at}/{name}.parquet")
        else:
            (at / f"{name}.parquet").symlink_to(f"{SF_SMALL}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stream_")))
def test_streams_over_part_files(spark, scattered, name, tmp_path, monkeypatch):
    want = QUERIES[name](spark, SF_SMALL).toPandas()
    for module in (sm, more_q):
        monkeypatch.setattr(module, "ensure_checkpoint_dir", lambda _: f"file://{tmp_path}/shared")
    got = QUERIES[name](spark, scattered).toPandas()
    cols = sorted(want.columns)
    order = [got[cols].round(6).astype(str).sort_values(cols, ignore_index=True),
             want[cols].round(6).astype(str).sort_values(cols, ignore_index=True)]
    pd.testing.assert_frame_equal(*order)
    assert len(want)


def test_state_across_limited_batches(spark, scattered):
    """One file a trigger: the windows still count every row when the watermark is long enough."""
    ev = sm.table_stream(spark, scattered, "events", files_per_trigger=1).select(
        F.col("event_type").alias("metric"), "ts")
    g = sm.sliding_counts_stream(ev, "1 day", "1 day").withColumn("day", F.col("w.start").cast("string")).drop("w")
    got = sm.run_until_caught_up(g, "limited", "update", keys=["metric", "day"])
    assert got.agg(F.sum("events")).first()[0] <= table(spark, SF_SMALL, "events").count()
