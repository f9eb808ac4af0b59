"""One test per deliberate departure from the reference's observed behaviour."""

import datetime as dt

from pyspark.sql import functions as F

from opslens.functions import text as tx
from opslens.operators import filesig as fs
from opslens.operators import findings as fo
from opslens.operators import inventory as inv
from opslens.operators import render as rd
from opslens.operators import risk as rk
from opslens.operators import textsearch as ts
from opslens.operators import timeline as tlo
from opslens.sources import reports as rp

T0 = dt.datetime(2024, 1, 1)


def test_trivy_reads_all_targets(spark):
    rep = ('{"Results":[{"Vulnerabilities":[{"VulnerabilityID":"A","Description":"d","Severity":"low"}]},'
           '{"Vulnerabilities":[{"VulnerabilityID":"B","Title":"t","Severity":"HIGH","FixPublished":{"FixedVersion":"2"}}]}]}')
    got = rp.parse_trivy(spark.createDataFrame([(rep,)], "report string")).orderBy("id").collect()
    assert [(r.id, r.title, r.severity, r.fix) for r in got] == [("A", "d", "LOW", None), ("B", "t", "HIGH", "2")]


def test_top_findings_by_severity_not_arrival(spark):
    rows = [("l", "t", "", "LOW", None, None, None, "x"), ("c", "t", "", "CRITICAL", None, None, None, "x")]
    f = spark.createDataFrame(rows, "id string, title string, description string, severity string, file string, "
                                    "line int, fix string, tool string")
    assert [r.id for r in fo.top_findings(f, 1).collect()] == ["c"]


def test_change_before_alert_latest_by_time(spark):
    alerts = spark.createDataFrame([("i", T0 + dt.timedelta(hours=5), "a", None, 0)],
                                   "incident_id string, fired_at timestamp_ntz, name string, source string, in_ord long")
    # input order: the later change comes first
    changes = spark.createDataFrame([("i", T0 + dt.timedelta(hours=3), "late", None, "b", 0),
                                     ("i", T0 + dt.timedelta(hours=1), "early", None, "a", 1)],
                                    "incident_id string, timestamp timestamp_ntz, description string, source string, "
                                    "component string, in_ord long")
    assert tlo.change_before_alert(alerts, changes).first().root_cause == "Change in b: late"


def _docs(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_section_lines_accept_table_rows(spark):
    d = _docs(spark, "## Action Items\n| fix svc1 | me | open |\n- [ ] check svc1\n## Next\n- svc1 later")
    assert [r.item for r in ts.section_lines(d, "svc1").collect()] == ["- [ ] check svc1", "| fix svc1 | me | open |"]


def test_root_cause_line_is_content(spark):
    d = _docs(spark, "## Root Cause\n**Root Cause:** deploy of svc2\nother\n## Impact\ndeploy")
    assert [r.cause for r in ts.root_causes(d, "deploy").collect()] == ["deploy of svc2"]


def test_preventive_numbered_bullets(spark):
    d = _docs(spark, "## Preventive Measures\n1. Add canary\n- Alert early\n* Keep docs\nplain\n## End")
    assert [r.measure for r in ts.preventive(d).collect()] == ["Add canary", "Alert early", "Keep docs"]


def test_doc_date_both_forms(spark):
    df = spark.createDataFrame([("pm_20240105.md",), ("pm-2024-01-06.md",), ("x.md",)], "n string")
    got = [r.d for r in df.select(tx.doc_date("n", F.lit("mtime")).alias("d")).collect()]
    assert got == ["2024-01-05", "2024-01-06", "mtime"]


def test_pager_routing_honours_severity(spark):
    a = spark.createDataFrame([(1, "warning", ["slack", "pagerduty"]), (2, "critical", ["pagerduty"]), (3, "info", None)],
                              "id int, severity string, channels array<string>")
    got = sorted((r.id, r.channel) for r in rk.route(a).collect())
    assert got == [(1, "slack"), (2, "pagerduty"), (3, "slack")]


def test_dedup_key_is_stable(spark):
    df = spark.createDataFrame([("agent", "disk full")], "s string, t string")
    k1 = df.select(rk.dedup_key(F.col("s"), F.col("t")).alias("k")).first().k
    k2 = df.select(rk.dedup_key(F.col("s"), F.col("t")).alias("k")).first().k
    assert k1 == k2 and k1.startswith("aiops-agent-") and 0 <= int(k1.rsplit("-", 1)[1]) < 10000


def test_expiry_is_final(spark):
    req = spark.createDataFrame([("r", T0)], "request_id string, requested_at timestamp_ntz")
    late = spark.createDataFrame([("r", T0 + dt.timedelta(hours=2), "approved")],
                                 "request_id string, decided_at timestamp_ntz, status string")
    got = rk.expire(req, late, "request_id", F.lit(T0 + dt.timedelta(hours=3)).cast("timestamp_ntz")).first()
    assert got.status == "expired"


def test_category_split_intent(spark):
    rows = spark.createDataFrame([("C1", "CATEGORY:Sofa;SUBCATEGORY:Two", None, None, None, None, "1")],
                                 "A string, B string, C string, D string, E string, F string, G string")
    r = rd.render_config(rows).first()
    assert (r.category, r.name) == ("Sofa", "Two")


def test_endpoints_report_verb_and_path(spark):
    f = spark.createDataFrame([("r", "api/app.py", 'from fastapi import x\n@app.post("/items")\n@router.get("/a")')],
                              "repo string, path string, text string")
    got = [(r.method, r.route) for r in inv.endpoints(f).orderBy("n").collect()]
    assert got == [("POST", "/items"), ("GET", "/a")]


def test_real_blend_and_fbx_headers_are_valid(spark):
    rows = [("a.blend", b"BLENDER-v300xxxx"), ("b.fbx", b"Kaydara FBX Binary  \x00\x1a\x00"),
            ("c.ma", b"//Maya ASCII 2020 scene\nrequires maya")]
    df = spark.createDataFrame([(p, bytearray(c), len(c)) for p, c in rows], "path string, content binary, length long")
    assert {r.path: r.status for r in fs.validate(df).collect()} == {"a.blend": "valid", "b.fbx": "valid",
                                                                     "c.ma": "valid"}


def test_keywords_first_occurrence_order(spark):
    df = spark.createDataFrame([("Zeta alpha ZETA beta alpha gamma the",)], "t string")
    assert df.select(tx.keywords("t").alias("k")).first().k == ["zeta", "alpha", "beta", "gamma"]


def test_npm_via_forms(spark):
    rep = ('{"vulnerabilities":{"a":{"severity":"moderate","via":[{"url":"https://x/GHSA-1234567890123456789012"}]},'
           '"b":{"severity":"high","via":["https://y/CVE-1"]},"c":{"via":[]}}}')
    got = {r.title: (r.id, r.severity) for r in rp.parse_npm(spark.createDataFrame([(rep,)], "report string")).collect()}
    assert got == {"NPM vulnerability in a": ("GHSA-123456789012345", "MEDIUM"),
                   "NPM vulnerability in b": ("CVE-1", "HIGH"), "NPM vulnerability in c": ("npm", "MEDIUM")}
