"""The commit log and the response data source: runs again, stops midway, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from opslens.operators import inventory as inv
from opslens.sinks.commitlog import CommitLog
from opslens.sources import responses
from opslens.sources.metrics import parse_range


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.read(["k"]) is None and log.vacuum() == 0
    assert log.write(rows(spark, ("a", 1), ("b", 1), (None, 1), ("b", 2)), 0)
    assert not log.write(rows(spark, ("a", 99)), 0)  # the batch runs again
    rows(spark, ("a", 98)).write.parquet(f"{tmp_path}/data/batch-stopped")
    assert log.write(rows(spark, ("b", 0), ("c", 5)), 1)

    def read():
        return {r.k: r.v for r in log.read(["k"], ["v"]).collect()}

    want = {"a": 1, "b": 0, "c": 5, None: 1}
    assert read() == want
    log.compact(["k"], ["v"])
    assert read() == want and len(log.entries()) == 1
    assert not log.write(rows(spark, ("a", 97)), 1) and not log.write(rows(spark, ("a", 97)), 0)
    assert log.write(rows(spark, ("a", 7)), 2) and read() == want | {"a": 7}
    assert log.vacuum() == 3 and read() == want | {"a": 7}


def test_a_stream_into_the_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    for k in range(3):
        rows(spark, ("a", k), (f"k{k}", k)).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = (spark.readStream.schema("k string, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{tmp_path}/in"))
    for ck in ("c", "other"):  # the second run starts without a checkpoint, so all batches come again
        stream.writeStream.foreachBatch(log.sink()).option("checkpointLocation", f"{tmp_path}/{ck}").trigger(
            availableNow=True).start().awaitTermination()
        assert {r.k for r in log.read(["k"]).collect()} == {"a", "k0", "k1", "k2"} and len(log.entries()) == 3


RANGE = json.dumps({"status": "success", "data": {"result": [
    {"metric": {"job": "x"}, "values": [["10.5", "1"], ["20", "NaN"], ["bad", "2"]]}, {"metric": {}, "values": [["30", "oops"]]}]}})
INSTANT = json.dumps({"status": "success", "data": {"result": [{"metric": {"job": "y"}, "value": [40, "4.5"]}]}})


def test_responses(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/r1.json").write_text(RANGE)
    (tmp_path / "f/r2.json").write_text(RANGE[:30])
    (tmp_path / "f/r3.json").write_text('{"status": "error"}')
    responses.register(spark)

    def stream():
        frame = spark.readStream.format("metric_responses").load(str(tmp_path / "f"))
        frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file, str(r.ts), str(r.value)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    batch = spark.read.format("metric_responses").load(str(tmp_path / "f"))
    text = spark.createDataFrame([("r1.json", RANGE)], "file string, response string")
    want = sorted((r.file, str(r.ts), str(r.value)) for r in parse_range(text).collect())
    assert sorted((r.file, str(r.ts), str(r.value)) for r in batch.collect()) == want == stream()
    (tmp_path / "f/r4.json").write_text(INSTANT)
    assert [x for x in stream() if x not in want] == [("r4.json", "1970-01-01 00:00:40", "4.5")]
    with pytest.raises(Exception, match="(?i)error|Expecting"):
        spark.read.format("metric_responses").option("failing", "raise").load(str(tmp_path / "f")).collect()


def test_language_mix_in_one_pass(spark):
    files = spark.createDataFrame([("r", "a.py"), ("r", "b.tf"), ("r", "x/c.tf"), ("s", "README"), (None, "Dockerfile"), ("t", "a.py"), ("t", "a.go")],
                                  "repo string, path string")
    got = {r.repo: (r.language, r.files) for r in inv.language_mix(files).collect()}
    assert got == {"r": ("terraform", 2), "s": ("unknown", 0), None: ("docker", 1), "t": ("python", 1)}
    assert inv.language_mix(files).select(F.max("files")).first()[0] == 2
