"""Readers, writers, metric registry, runner and small operators on real
files in a temporary folder."""

import json
import os

from pyspark.sql import functions as F

from opslens.operators import findings as fo
from opslens.operators import timeline as tlo
from opslens.plans import runner
from opslens.sinks import writers
from opslens.sources import files, metrics

from .conftest import SF_SMALL


def test_incidents_roundtrip(spark, tmp_path):
    inc = {"incident_id": "i1", "title": "API slow", "severity": "high",
           "alerts": [{"name": "HighLatency", "fired_at": "2024-01-01T10:05:00"},
                      {"name": "Errors", "fired_at": "2024-01-01T10:01:00", "source": "pager"}],
           "recent_changes": [{"timestamp": "2024-01-01T09:59:00", "description": "deploy 7", "component": "api"},
                              {"timestamp": "2024-01-01T10:02:00", "description": "late change"}],
           "related_incidents": [{"start_time": "2023-12-30T00:00:00", "title": "old"}]}
    (tmp_path / "a.json").write_text(json.dumps(inc))
    (tmp_path / "bad.json").write_text("{not json")
    d = files.read_incidents(spark, str(tmp_path))
    assert d.count() == 1
    alerts, changes, related = files.incident_parts(d)
    tl = tlo.timeline(alerts, changes, related).orderBy("ord").collect()
    assert [r.event_type for r in tl] == ["related_incident", "config_change", "alert", "config_change", "alert"]
    assert tl[0].source == "incident_db" and tl[2].source == "pager" and tl[4].source == "monitoring"
    rc = tlo.change_before_alert(alerts, changes).first()
    assert rc.root_cause == "Change in api: deploy 7"
    assert files.incident_history(spark, str(tmp_path), limit=20).count() == 1


def test_write_and_latest_incidents(spark, tmp_path):
    p = str(tmp_path / "inc")
    df = spark.createDataFrame([("i1", "v1", "2024-01-01T00:00:00")], "incident_id string, title string, start_time string")
    writers.write_incidents(df, p)
    writers.write_incidents(df.withColumn("title", F.lit("v2")), p)
    assert writers.latest_incidents(spark, p).first().title == "v2"


def test_read_documents_and_scripts(spark, tmp_path):
    (tmp_path / "postmortems").mkdir()
    (tmp_path / "postmortems" / "2024-01-02-outage.md").write_text("# Outage\n## Root Cause\nx\n")
    (tmp_path / "s.ms").write_bytes(b'batchRenderMgr\r\n"SPOTLAR_A"\r\n')
    d = files.read_documents(spark, str(tmp_path), "postmortems").collect()
    assert d[0].name == "2024-01-02-outage.md" and d[0].text.startswith("# Outage")
    s = files.read_scripts(spark, str(tmp_path)).first()
    assert "\r" not in s.text


def test_whole_files_need_no_record_reader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.md", "é\r\nx\n".encode()), ("sub/b.md", b"\xff\x00z"), ("sub/c.md", b""), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(body)
    found = files.read_documents(spark, str(tmp_path))
    plain = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(str(tmp_path), wholetext=True)
    columns = ["_metadata.file_path", "_metadata.file_name", "_metadata.file_modification_time", F.col("value").cast("binary")]
    rows = sorted(map(tuple, found.withColumn("text", F.col("text").cast("binary")).collect()))
    assert rows == sorted(map(tuple, plain.select(*columns).collect()))
    for df in (found, files.read_scripts(spark, str(tmp_path), "*.md")):
        assert "Text" not in df._jdf.queryExecution().executedPlan().toString()


def test_render_and_conversion_lists(spark, tmp_path):
    (tmp_path / "rl.csv").write_text("A,B,C,D,E,F,G\nC1,CATEGORY:Sofa;SUBCATEGORY:Two,,,,,1\n,,,,,,\n"
                                     "C2,plain,,,,,0\n,CATEGORY:X,,,,,1\n")
    from opslens.operators import render as rd
    cfg = rd.render_config(files.read_render_list(spark, str(tmp_path / "rl.csv"))).collect()
    assert [(r.code, r.category, r.name, r.is_renderable) for r in cfg] == [("C1", "Sofa", "Two", True)]
    (tmp_path / "conv.txt").write_text("in/a.fbx | out/a.blend\nbroken line\n b.obj|c.blend|x \n")
    conv = files.read_conversion_list(spark, str(tmp_path / "conv.txt")).collect()
    assert [(r.input, r.output) for r in conv] == [("in/a.fbx", "out/a.blend"), ("b.obj", "c.blend")]


def test_scan_local_jobs(spark, tmp_path):
    (tmp_path / "scene_1.blend").write_bytes(b"BLENDER-v300")
    (tmp_path / "notes.txt").write_bytes(b"x")
    j = files.scan_local_jobs(spark, str(tmp_path)).collect()
    assert len(j) == 1 and j[0].job_id.startswith("local_scene_1_") and j[0].input_uri.startswith("file:///")


def test_metric_registry_skips_failures(spark):
    reg = metrics.MetricRegistry()
    reg.register_metric("ok", lambda s: s.createDataFrame([("2024-01-01 00:00:00", 1, 2.0)], "ts string, id long, value double"))
    reg.register_metric("broken", lambda s: 1 / 0)
    df, failed = reg.collect(spark)
    assert failed == ["broken"] and df.count() == 1
    df2, _ = reg.collect(spark, ["ok", "unknown"])
    assert df2.first().metric == "ok"


def test_run_job_logs(spark, tmp_path):
    log = runner.run_job("check_status", spark, SF_SMALL, run_log=str(tmp_path / "log")).first()
    assert log.status == "success" and log.rows == 30 and log.duration_s > 0
    bad = runner.run_job("check_status", spark, "/nonexistent").first()
    assert bad.status == "failed" and bad.errors


def test_tool_status(spark):
    ok = spark.createDataFrame([('[{"RuleID":"x"}]',)], "report string")
    bad = spark.createDataFrame([("{oops",), ('{"findings":[]}',)], "report string")
    st = fo.tool_status({"gitleaks": ok, "govuln": bad})
    sets = fo.tool_sets(st).first()
    assert sets.successful == ["gitleaks"] and sets.failed == ["govuln"]


def test_iac_files(spark):
    paths = ["infra/main.tf", "infra/test_main.tf", "Dockerfile", "svc/Dockerfile.dev", ".git/x.tf",
             "node_modules/a/main.tf", "app.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in fo.iac_files(df).collect()) == ["Dockerfile", "infra/main.tf", "svc/Dockerfile.dev"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "HIGH"), ("b", "LOW")], "tool string, severity string")
    writers.write_security_report(df, str(tmp_path / "sec"))
    writers.write_text(df.select(F.concat_ws(" ", "tool", "severity").alias("l")), "l", str(tmp_path / "txt"))
    out = writers.write_artifact(df, "scan", str(tmp_path))
    assert os.path.isdir(out) and spark.read.text(str(tmp_path / "txt")).count() == 2
