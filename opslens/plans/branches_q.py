"""Registered queries for the branches that the other queries' inputs don't reach: asset files that are whole,
broken or known only by their bytes, a destructive action in a response plan, findings of chosen report kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import filesig as fs
from opslens.operators import findings as fo
from opslens.operators import risk as rk
from opslens.plans import derive
from opslens.plans.registry import register
from opslens.tables import table

STL_HEAD = b"part by the supplier".ljust(80)
# (extension, bytes, zero bytes behind them, format found, status)
BRANCHES = [
    (".stl", b"\x00" * 80 + b"\x02\x00\x00\x00", 100, "stl_binary", "valid"),       # by its first bytes
    (".stl", STL_HEAD + b"\x03\x00\x00\x00", 150, "stl_binary", "valid"),            # by its size alone
    (".stl", STL_HEAD + b"\xff\x00\x00\x00", 7, None, "unknown"),                    # the size fits no count
    (".stl", b"\x00" * 80 + b"\xff\xff\x00\x00", 3, "stl_binary", "corrupted"),
    (".stl", b"solid part\nfacet normal 0 0 1\nendsolid part\n", 0, "stl_ascii", "valid"),
    (".stl", b"solid part\nnothing else\n", 0, "stl_ascii", "corrupted"),
    (".gltf", b'{"asset": {"version": "2.0"}}', 0, "gltf", "valid"),
    (".gltf", b'{"asset": ', 0, "gltf", "corrupted"),
    (".glb", b"glTF\x02\x00\x00\x00\x0c\x00\x00\x00", 4, "gltf", "valid"),
    (".glb", b"glTF\x07\x00\x00\x00\x0c\x00\x00\x00", 4, "gltf", "corrupted"),
    (".blend", b"BLENDERxyz no version", 0, "blender", "corrupted"),
    (".blend", b"BLENDER-v293", 9, "blender", "valid"),
    (".obj", b"g group\nusemtl x\n", 0, "obj", "corrupted"),
    (".obj", b"g group\nv 1 2 3\n", 0, "obj", "valid"),
    (".3ds", b"MM\x01\x03", 5, "3ds", "valid"),
    (".fbx", b"; FBX 7.4 without a bracket", 0, "fbx_ascii", "corrupted"),
    (".fbx", b"a FBX further on", 0, "fbx", "corrupted"),                            # known only within its first bytes
    (".max", b"\xc0\x2d\x3d\x00", 60, "3dsmax", "corrupted"),
    (".max", b"scene = twelve bytes", 0, "3dsmax", "valid"),                         # by a byte anywhere in its head
    (".ma", b"// a Mel script", 0, "maya_ascii", "valid"),                           # by its text
    (".mb", b"Maya Binary", 3, "maya_binary", "valid"),
    (".ply", b"plain text", 0, None, "unknown"),
    (".obj", b"BLENDER-v300", 0, "blender", "wrong_extension"),
    (".ply", b"", 0, None, "invalid"),
]
_ROWS = ", ".join(f"({k}, '{ext}', {repr(fmt) if fmt else 'NULL'}, '{status}')" for k, (ext, _, _, fmt, status) in enumerate(BRANCHES))


@register("asset_branches", f"""
SELECT 'a' || p_partkey || ext AS path, status, fmt AS detected_format
FROM part JOIN (VALUES {_ROWS}) b(k, ext, fmt, status) ON b.k = p_partkey % {len(BRANCHES)}""")
def asset_branches(spark, sf_dir):
    """A file for each part, dealt over every way that a file is detected and checked."""
    kind = (F.col("p_partkey") % len(BRANCHES)).cast("int") + 1

    def of(values):
        return F.element_at(F.array(*values), kind)

    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("a"), F.col("p_partkey").cast("string"), of([F.lit(b[0]) for b in BRANCHES])).alias("path"),
        of([F.lit(bytearray(b[1] + b"\x00" * b[2])) for b in BRANCHES]).alias("content"))
    return fs.validate(rows.withColumn("length", F.length("content").cast("long"))).select("path", "status", "detected_format")


@register("destructive_actions", """
SELECT 'i' || c_custkey AS incident_id, a.action, a.automated AND NOT a.needs AS automated, a.needs AS needs_approval, a.reason
FROM customer, (VALUES ('restart_service', true, false, NULL), ('delete_old_logs', true, true, 'Requires explicit approval (destructive action)'),
  ('terminate_instance', true, true, 'Requires explicit approval (destructive action)'), ('failover', true, true, 'Risk level: high')) a(action, automated, needs, reason)
WHERE c_custkey % 2 = 0""")
def destructive_actions(spark, sf_dir):
    """A playbook with destructive actions: they need approval and are never automated."""
    actions = spark.createDataFrame(
        [("disk", 0, "restart_service", "", True, "low"), ("disk", 1, "delete_old_logs", "", True, "low"),
         ("disk", 2, "terminate_instance", "", True, None), ("disk", 3, "failover", "", True, "high")],
        "incident_type string, seq int, action string, description string, automated boolean, risk string")
    inc = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("incident_id"),
        F.when(F.col("c_custkey") % 2 == 0, "disk").otherwise("unknown").alias("incident_type"))
    return rk.response_plan(inc, actions).select("incident_id", "action", "automated", "needs_approval", "reason")


@register("findings_of_kinds", """
SELECT tool, count(*) AS findings FROM (
  SELECT 'checkov' AS tool FROM customer UNION ALL SELECT 'govulncheck' FROM nation) GROUP BY 1""")
def findings_of_kinds(spark, sf_dir):
    """Findings of two chosen report kinds; a kind without reports is left out."""
    found = fo.union_findings(derive.all_reports(spark, sf_dir), ["checkov", "govuln", "no_such_kind"])
    return found.groupBy("tool").agg(F.count(F.lit(1)).alias("findings"))
