"""Registered render-job queries. Native inputs are derived from the tables:
part -> render manifests, scripts and render lists; orders -> job messages;
lineitem -> progress events and render outcomes; pages -> conversion lists;
documents -> converter logs and asset bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import filesig as fs
from opslens.operators import render as rd
from opslens.operators import textsearch as ts
from opslens.plans.registry import derived, register
from opslens.tables import table

# ---------------- manifests (part) ----------------


def _part_items(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    sn = F.concat(F.lit("P"), k.cast("string"))
    cam = F.concat(F.lit("Camera_"), F.lpad((size % 10).cast("string"), 2, "0"))
    toks = F.transform(F.split("p_name", " "), lambda w: F.when(w.startswith("s"), F.concat(w, F.lit("_i")))
                       .when(w.startswith("c"), F.concat(F.lit("Sem"), w)).otherwise(w))
    toks = F.when(size % 4 == 0, F.concat(F.array(F.lit("(Sup)")), toks)).otherwise(toks)
    res = (F.when(size % 3 == 0, F.lit("1920x1080"))
           .when(size % 3 == 1, F.concat((size * 40).cast("string"), F.lit(","), (size * 20).cast("string")))
           .otherwise(F.lit("hd")))
    rtype = (F.when(F.col("p_type").contains("BRASS"), "refraction").when(F.col("p_type").contains("STEEL"), "shadow")
             .when(F.col("p_type").contains("TIN"), "static").otherwise("color"))
    brand = F.regexp_replace("p_brand", "#", "")
    folder = F.when(size % 5 == 0, F.lit("")).otherwise(brand)
    dest = (F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, F.lit(""))
            .otherwise(F.concat(F.lit("/renders/"), F.lower(brand))))
    render = F.col("p_retailprice") < 1900
    preview = size % 2 == 1
    return p.select(k.alias("p_partkey"), sn.alias("short_name"), cam.alias("camera_name"), toks.alias("toks"),
                    res.alias("resolution"), F.concat(sn, F.lit("_"), cam).alias("filename"),
                    rtype.alias("rtype"), render.alias("render"), preview.alias("preview"),
                    folder.alias("folder"), dest.alias("dest"))


@derived
def manifests(spark, sf_dir):
    """One manifest per part in three shapes ({items:[...]}, bare array with a
    non-object entry, single object), with key aliases and missing keys."""
    it = _part_items(spark, sf_dir)
    k = F.col("p_partkey")
    layer_s = F.array_join("toks", ", ")

    def item(layer, even):
        f = [F.col("short_name"), F.col("camera_name"), layer.alias("layer_name"), F.col("resolution"),
             F.col("filename")]
        if even:
            f += [F.col("rtype").alias("type"), F.col("render").alias("render")]
        else:
            f += [F.col("rtype").alias("render_type"), F.col("render").alias("render_bool")]
        f += [F.col("preview").alias("preview_bool"), F.col("folder").alias("folder_to_use"), F.col("dest")]
        return F.to_json(F.struct(*f))

    body = (F.when((k % 2 == 0) & (k % 5 == 1), item(F.col("toks"), True))
            .when(k % 2 == 0, item(layer_s, True))
            .when(k % 5 == 1, item(F.col("toks"), False)).otherwise(item(layer_s, False)))
    shaped = (F.when(k % 3 == 0, F.concat(F.lit('{"items":['), body, F.lit("]}")))
              .when(k % 3 == 1, F.concat(F.lit("["), body, F.lit(",42]"))).otherwise(body))
    return it.select("p_partkey", shaped.alias("manifest"))


ITEMS_CTE = """
it AS (SELECT p_partkey, 'P' || p_partkey AS short_name,
              'Camera_' || lpad((p_size % 10)::VARCHAR, 2, '0') AS camera_name,
              CASE WHEN p_size % 4 = 0 THEN '(Sup), ' ELSE '' END ||
                array_to_string(list_transform(string_split(p_name, ' '),
                  lambda w: CASE WHEN starts_with(w, 's') THEN w || '_i'
                                 WHEN starts_with(w, 'c') THEN 'Sem' || w ELSE w END), ', ') AS layer_name,
              CASE p_size % 3 WHEN 0 THEN '1920x1080' WHEN 1 THEN (p_size * 40) || ',' || (p_size * 20)
                   ELSE 'hd' END AS resolution,
              p_size, p_retailprice, p_type, p_brand
       FROM part),
items AS (SELECT p_partkey, short_name, camera_name, layer_name, resolution,
              short_name || '_' || camera_name AS filename,
              CASE WHEN contains(p_type, 'BRASS') THEN 'refraction' WHEN contains(p_type, 'STEEL') THEN 'shadow'
                   WHEN contains(p_type, 'TIN') THEN 'static' ELSE 'color' END AS render_type,
              p_retailprice < 1900 AS render_bool, p_size % 2 = 1 AS preview_bool,
              CASE WHEN p_size % 5 = 0 THEN short_name ELSE replace(p_brand, '#', '') END AS folder_to_use,
              CASE WHEN p_partkey % 7 IN (0, 1) THEN '/storage/output'
                   ELSE '/renders/' || lower(replace(p_brand, '#', '')) END AS dest
       FROM it)"""


@derived
def _items(spark, sf_dir):
    return rd.read_manifest(manifests(spark, sf_dir), "manifest")


@register("render_manifest", f"""WITH {ITEMS_CTE},
r AS (SELECT *, CASE WHEN regexp_matches(resolution, '^\\d+[xX]\\d+') THEN regexp_extract(resolution, '^(\\d+)[xX](\\d+)', 1)
                     WHEN regexp_matches(resolution, '^\\d+,\\d+') THEN regexp_extract(resolution, '^(\\d+),(\\d+)', 1)
                     ELSE '1920' END::BIGINT AS width,
                CASE WHEN regexp_matches(resolution, '^\\d+[xX]\\d+') THEN regexp_extract(resolution, '^(\\d+)[xX](\\d+)', 2)
                     WHEN regexp_matches(resolution, '^\\d+,\\d+') THEN regexp_extract(resolution, '^(\\d+),(\\d+)', 2)
                     ELSE '1080' END::BIGINT AS height FROM items)
SELECT short_name, camera_name, layer_name, resolution, filename, render_type, render_bool, preview_bool,
       folder_to_use, dest, width, height,
       CASE WHEN render_type IN ('refraction', 'shadow', 'static') THEN 'CYCLES' ELSE 'BLENDER_EE' END AS engine,
       CASE WHEN render_type = 'refraction' THEN 256 WHEN render_type IN ('shadow', 'static') THEN 128
            END::DOUBLE AS samples,
       CASE WHEN preview_bool THEN width // 2 ELSE width END AS res_x,
       CASE WHEN preview_bool THEN height // 2 ELSE height END AS res_y,
       dest || '/' || folder_to_use || '/' || filename || '.png' AS output_path
FROM r""")
def render_manifest(spark, sf_dir):
    """Manifest items with parsed resolution, render settings and output path."""
    s = rd.render_settings(_items(spark, sf_dir))
    return s.select("short_name", "camera_name", "layer_name", "resolution", "filename", "render_type",
                    "render_bool", "preview_bool", "folder_to_use", "dest", "width", "height", "engine",
                    F.col("samples").cast("double").alias("samples"), "res_x", "res_y", "output_path")


LAYERS_CTE = ITEMS_CTE + """,
tk AS (SELECT short_name, unnest(range(0, len(string_split(layer_name, ',')))) AS i,
              unnest(list_transform(string_split(layer_name, ','), lambda t: trim(t))) AS tok FROM items),
tr AS (SELECT *, coalesce(max(CASE WHEN tok <> '(Sup)' THEN i END) OVER (PARTITION BY short_name ORDER BY i
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_non FROM tk),
tf AS (SELECT *, CASE WHEN ends_with(tok, '_i') THEN tok[1:length(tok) - 2] ELSE tok END AS base,
              (i - 1 - last_non) % 2 = 1 AND NOT starts_with(upper(tok), 'SEM') AS taken FROM tr),
lo AS (SELECT short_name, i, CASE WHEN taken THEN 'SPOTLAR_SUPORTE_' || tok WHEN tok = '(Sup)' THEN NULL
                               WHEN starts_with(upper(base), 'SEM') THEN NULL
                               ELSE 'SPOTLAR_OFERTA_' || base END AS layer FROM tf)"""


@register("layer_list", f"""WITH {LAYERS_CTE}
SELECT short_name, count(layer) AS n_layers, coalesce(string_agg(layer, ',' ORDER BY i), '') AS layers
FROM lo GROUP BY short_name""")
def layer_list(spark, sf_dir):
    """Normalised layer list of every manifest item."""
    it = _items(spark, sf_dir).select("short_name", rd.normalise_layers("layer_name").alias("l"))
    return it.select("short_name", F.size("l").cast("long").alias("n_layers"), F.array_join("l", ",").alias("layers"))


@register("layer_check", f"""WITH {LAYERS_CTE},
req AS (SELECT DISTINCT short_name, layer FROM lo WHERE layer IS NOT NULL),
pw AS (SELECT 'P' || p_partkey AS short_name, unnest(string_split(p_name, ' ')) AS w,
              string_split(p_name, ' ')[1] AS w1 FROM part),
pres AS (SELECT DISTINCT short_name, 'SPOTLAR_OFERTA_' || upper(w) AS name FROM pw WHERE NOT starts_with(w, 'l')
         UNION SELECT DISTINCT short_name, 'SPOTLAR_SUPORTE_' || upper(w1) FROM pw)
SELECT req.short_name, req.layer,
       EXISTS (SELECT 1 FROM pres WHERE pres.short_name = req.short_name
                                    AND contains(lower(pres.name), lower(req.layer))) AS found
FROM req""")
def layer_check(spark, sf_dir):
    """Required layers vs the scene's collections (case-insensitive substring)."""
    req = _items(spark, sf_dir).select("short_name", F.explode(rd.normalise_layers("layer_name")).alias("layer")
                                       ).distinct()
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("short_name"),
                                            F.split("p_name", " ").alias("ws"))
    offer = p.select("short_name", F.explode("ws").alias("w")).where(~F.col("w").startswith("l")).select(
        "short_name", F.concat(F.lit("SPOTLAR_OFERTA_"), F.upper("w")).alias("name"))
    sup = p.select("short_name", F.concat(F.lit("SPOTLAR_SUPORTE_"), F.upper(F.col("ws")[0])).alias("name"))
    present = offer.unionByName(sup).distinct().withColumn("lname", F.lower("name"))
    hits = ts.contains_join(present.select("short_name", "lname"), "lname",
                            req.withColumn("lreq", F.lower("layer")), "lreq", keys=["short_name"])
    found = hits.select("short_name", "layer").distinct().withColumn("found", F.lit(True))
    return req.join(found, ["short_name", "layer"], "left").select(
        "short_name", "layer", F.coalesce("found", F.lit(False)).alias("found"))


RC_SQL = """
WITH rl AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'C' || p_partkey END AS A,
                   string_split(p_type, ' ')[1] AS w1, split_part(p_name, ' ', 2) AS w2, p_size FROM part),
r AS (SELECT A, CASE p_size % 4 WHEN 0 THEN 'CATEGORY:' || w1 || ';SUBCATEGORY:' || w2
                     WHEN 1 THEN 'CATEGORY:' || w1 WHEN 2 THEN 'CATEGORY:' || w1 || ';' || w2
                     ELSE 'Notes ' || w1 END AS B,
             CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS G FROM rl),
p AS (SELECT A, G, string_split(regexp_replace(B, '^CATEGORY:', ''), ';') AS parts FROM r
      WHERE A <> '' AND starts_with(B, 'CATEGORY:'))
SELECT A AS code, CASE WHEN len(parts) >= 2 THEN regexp_replace(parts[2], '^SUBCATEGORY:', '') ELSE parts[1] END AS name,
       parts[1] AS category,
       CASE WHEN len(parts) >= 2 THEN regexp_replace(parts[2], '^SUBCATEGORY:', '') ELSE parts[1] END AS short_name,
       G = '1' AS is_renderable, 'SPOTLAR_' || A AS layer_name
FROM p"""


@register("render_config", RC_SQL)
def render_config(spark, sf_dir):
    """Render list rows (A code, B category text, G render flag) from part."""
    p = table(spark, sf_dir, "part")
    w = [F.get(F.split("p_type", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))]
    size = F.col("p_size")
    rows = p.select(
        F.when(F.col("p_partkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), F.col("p_partkey").cast("string"))).alias("A"),
        F.when(size % 4 == 0, F.concat(F.lit("CATEGORY:"), w[0], F.lit(";SUBCATEGORY:"), w[1]))
        .when(size % 4 == 1, F.concat(F.lit("CATEGORY:"), w[0]))
        .when(size % 4 == 2, F.concat(F.lit("CATEGORY:"), w[0], F.lit(";"), w[1]))
        .otherwise(F.concat(F.lit("Notes "), w[0])).alias("B"),
        F.when(size % 2 == 0, "1").otherwise("0").alias("G"))
    return rd.render_config(rows)


# ---------------- job messages (orders) ----------------

@derived
def job_bodies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    project = F.concat(F.lit("proj"), (F.col("o_custkey") % 20).cast("string"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".blend", ".ms", ".fbx", ".MAX")]), (k % 4 + 1).cast("int"))
    fn = F.concat(F.lit("scene_"), k.cast("string"), ext)
    variation = F.concat(F.lit("v"), (k % 3 + 1).cast("string"))
    uri = (F.when(k % 3 == 0, F.concat(F.lit("s3://renders-in/"), project, F.lit("/"), fn))
           .when(k % 3 == 1, F.concat(F.lit("file:///queue/"), fn)).otherwise(F.concat(F.lit("ftp://host/"), fn)))
    pr = F.col("o_orderpriority")
    prio = (F.when(pr == "1-URGENT", 5).when(pr == "2-HIGH", 4).when(pr == "3-MEDIUM", 3).when(pr == "5-LOW", 1))
    msg = F.struct(
        F.when(k % 97 != 0, F.concat(F.lit("job-"), F.lpad(k.cast("string"), 10, "0"))).alias("job_id"),
        F.when(k % 89 != 0, project).alias("project"), variation.alias("variation"),
        F.concat(F.lit("artist"), (F.col("o_custkey") % 50).cast("string")).alias("artist"),
        fn.alias("filename"), uri.alias("input_uri"),
        F.concat(F.lit("s3://renders-out/"), project, F.lit("/"), variation).alias("output_uri"),
        prio.alias("priority"))
    return o.select("o_orderkey", "o_orderstatus", "o_orderdate", F.to_json(msg).alias("body"))


JOBS_CTE = """
jb AS (SELECT o_orderkey, o_orderstatus, o_orderdate,
              CASE WHEN o_orderkey % 97 <> 0 THEN 'job-' || lpad(o_orderkey::VARCHAR, 10, '0') END AS job_id,
              CASE WHEN o_orderkey % 89 <> 0 THEN 'proj' || (o_custkey % 20) END AS project,
              'proj' || (o_custkey % 20) AS project0,
              'v' || (o_orderkey % 3 + 1) AS variation, 'artist' || (o_custkey % 50) AS artist,
              'scene_' || o_orderkey || ['.blend', '.ms', '.fbx', '.MAX'][o_orderkey % 4 + 1] AS filename,
              CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3
                   WHEN '5-LOW' THEN 1 END AS prio
       FROM orders),
jm AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 's3://renders-in/' || project0 || '/' || filename
                      WHEN 1 THEN 'file:///queue/' || filename ELSE 'ftp://host/' || filename END AS input_uri,
              's3://renders-out/' || project0 || '/' || variation AS output_uri FROM jb)"""


@derived
def _jobs(spark, sf_dir):
    return rd.parse_jobs(job_bodies(spark, sf_dir), "body")


@register("job_messages", f"""WITH {JOBS_CTE}
SELECT o_orderkey, job_id, project, variation, artist, filename, input_uri, output_uri,
       coalesce(prio, 0)::DOUBLE AS priority, true AS valid, '' AS missing_keys
FROM jm WHERE job_id IS NOT NULL AND project IS NOT NULL
UNION ALL
SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL::DOUBLE, false,
       concat_ws(',', CASE WHEN job_id IS NULL THEN 'job_id' END, CASE WHEN project IS NULL THEN 'project' END)
FROM jm WHERE job_id IS NULL OR project IS NULL""")
def job_messages(spark, sf_dir):
    """Job message bodies parsed; rows missing a required key are quarantined."""
    valid, quarantine = _jobs(spark, sf_dir)
    cols = rd.REQUIRED_JOB_KEYS
    v = valid.select("o_orderkey", *cols, F.col("priority").cast("double").alias("priority"),
                     F.lit(True).alias("valid"), F.lit("").alias("missing_keys"))
    q = quarantine.select("o_orderkey", *[F.lit(None).cast("string").alias(c) for c in cols],
                          F.lit(None).cast("double").alias("priority"), F.lit(False).alias("valid"), "missing_keys")
    return v.unionByName(q)


@register("job_routing", f"""WITH {JOBS_CTE},
v AS (SELECT * FROM jm WHERE job_id IS NOT NULL AND project IS NOT NULL),
s AS (SELECT *, regexp_replace(filename, '\\.[^.]*$', '') AS stem,
             regexp_extract(filename, '(\\.[^.]*)$', 1) AS sfx FROM v)
SELECT o_orderkey, job_id,
       CASE lower(regexp_extract(filename, '\\.([^./]*)$', 1)) WHEN 'ms' THEN 'script' WHEN 'blend' THEN 'direct'
            ELSE 'convert-first' END AS route,
       CASE WHEN starts_with(input_uri, 's3://') THEN 's3' WHEN starts_with(input_uri, 'file://') THEN 'file'
            ELSE 'unsupported' END AS scheme,
       CASE WHEN starts_with(input_uri, 's3://') THEN split_part(replace(input_uri, 's3://', ''), '/', 1) END AS bucket,
       CASE WHEN starts_with(input_uri, 's3://')
            THEN substr(replace(input_uri, 's3://', ''), length(split_part(replace(input_uri, 's3://', ''), '/', 1)) + 2) END AS key,
       CASE WHEN starts_with(input_uri, 'file://') THEN replace(input_uri, 'file://', '') END AS local_path,
       project || '_' || variation || '_' || stem || '_' || left(job_id, 8) AS job_folder,
       CASE WHEN starts_with(input_uri, 'file://') AND o_orderstatus IN ('F', 'P')
            THEN stem || '_' || CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END || '_'
                 || epoch(o_orderdate)::BIGINT || sfx END AS disposition
FROM s""")
def job_routing(spark, sf_dir):
    """Route by extension, split the input URI, job folder name and the
    finished input's destination name (status F completed, P failed)."""
    valid, _ = _jobs(spark, sf_dir)
    u = rd.split_uri("input_uri")
    done = F.col("o_orderstatus").isin("F", "P")
    disp = F.when(done, rd.disposition("filename", "input_uri", F.col("o_orderstatus") == "F",
                                       F.unix_seconds(F.col("o_orderdate").cast("timestamp"))))
    return valid.select("o_orderkey", "job_id", rd.route_job("filename").alias("route"),
                        u["scheme"].alias("scheme"), u["bucket"].alias("bucket"), u["key"].alias("key"),
                        u["path"].alias("local_path"),
                        rd.job_folder("project", "variation", "filename", "job_id").alias("job_folder"),
                        disp.alias("disposition"))


# ---------------- progress, counters, exposition (lineitem) ----------------

PROGRESS_CTE = """
pg AS (SELECT l_orderkey AS job_id, l_shipdate + to_seconds(l_linenumber) AS ts, l_linenumber, l_suppkey, l_partkey,
              l_linenumber * 10 AS frames_rendered, 70 AS frames_total,
              CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'failed'
                   WHEN l_linestatus = 'F' THEN 'completed' ELSE 'running' END AS status,
              CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R'
                   THEN left('Blender falhou: exit ' || l_suppkey || ' on part ' || l_partkey, 200) END AS error_message
       FROM lineitem),
ls AS (SELECT job_id, arg_max_null(status, (ts, l_linenumber, l_suppkey, l_partkey, status)) AS status,
              arg_max_null(frames_rendered, (ts, l_linenumber, l_suppkey, l_partkey, status)) AS frames_rendered,
              arg_max_null(frames_total, (ts, l_linenumber, l_suppkey, l_partkey, status)) AS frames_total,
              arg_max_null(error_message, (ts, l_linenumber, l_suppkey, l_partkey, status)) AS error_message,
              max(ts) AS ts, count(*) AS events
       FROM pg GROUP BY job_id)"""


@derived
def _progress(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    failed = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    st = F.when(failed, "failed").when(F.col("l_linestatus") == "F", "completed").otherwise("running")
    err = F.when(failed, F.substring(F.concat(F.lit("Blender falhou: exit "), F.col("l_suppkey").cast("string"),
                                              F.lit(" on part "), F.col("l_partkey").cast("string")), 1,
                                     rd.PROGRESS_ERROR_CAP))
    ts_ = F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_linenumber").cast("decimal(18,6)"))
    return li.select(F.col("l_orderkey").alias("job_id"), ts_.alias("ts"), "l_linenumber", "l_suppkey", "l_partkey",
                     (F.col("l_linenumber") * 10).alias("frames_rendered"), F.lit(70).alias("frames_total"),
                     st.alias("status"), err.alias("error_message"))


@derived
def _latest(spark, sf_dir):
    from opslens.operators import risk as rk
    return rk.latest_state(_progress(spark, sf_dir), "job_id",
                           ["ts", "l_linenumber", "l_suppkey", "l_partkey", "status"],
                           ["status", "frames_rendered", "frames_total", "error_message", "ts"])


@register("job_latest_state", f"WITH {PROGRESS_CTE} SELECT * FROM ls")
def job_latest_state(spark, sf_dir):
    """Progress events (one per line item) -> current state per job."""
    return _latest(spark, sf_dir)


COUNTERS_CTE = PROGRESS_CTE + """,
wc AS (SELECT 'worker-' || (job_id % 8) AS worker, count(*) AS jobs,
              count(*) FILTER (WHERE status = 'failed') AS failed,
              sum(CASE WHEN status = 'completed' THEN frames_rendered ELSE 0 END) AS frames,
              coalesce(max(CASE WHEN status = 'completed' THEN epoch(ts)::BIGINT END), 0) AS last_success,
              count(*) FILTER (WHERE status = 'running') AS queue_depth
       FROM ls GROUP BY 1)"""


@derived
def _counters(spark, sf_dir):
    st = _latest(spark, sf_dir).withColumn("worker", F.concat(F.lit("worker-"), (F.col("job_id") % 8).cast("string")))
    c = rd.worker_counters(st.withColumnRenamed("frames_rendered", "frames"))
    q = st.groupBy("worker").agg(F.count_if(F.col("status") == "running").alias("queue_depth"))
    return c.join(q, "worker")


@register("worker_counters", f"WITH {COUNTERS_CTE} SELECT worker, jobs, failed, frames::BIGINT AS frames, "
          "last_success, queue_depth FROM wc")
def worker_counters(spark, sf_dir):
    """Per worker (job id mod 8): jobs, failures, frames of completed jobs, last success, pending."""
    return _counters(spark, sf_dir).select("worker", "jobs", "failed", F.col("frames").cast("long").alias("frames"),
                                           "last_success", "queue_depth")


EXPO_SQL = "(VALUES " + ", ".join(
    f"({i}, '{n}', '{h}', '{t}', '{c}')" for i, (n, h, t, c) in enumerate(rd.EXPOSITION)) + ") m(i, name, help, typ, col)"


@register("metric_exposition", f"""WITH {COUNTERS_CTE}
SELECT worker, m.i AS metric_no,
       printf('# HELP %s %s\n# TYPE %s %s\n%s{{worker="%s"}} %s', m.name, m.help, m.name, m.typ, m.name, worker,
              CASE m.col WHEN 'frames' THEN frames::BIGINT::VARCHAR WHEN 'jobs' THEN jobs::VARCHAR
                         WHEN 'failed' THEN failed::VARCHAR WHEN 'queue_depth' THEN queue_depth::VARCHAR
                         ELSE last_success::VARCHAR END) AS text
FROM wc, {EXPO_SQL}""")
def metric_exposition(spark, sf_dir):
    """Exposition text (HELP/TYPE/sample) of the worker counters."""
    c = _counters(spark, sf_dir).withColumn("frames", F.col("frames").cast("long"))
    return rd.exposition(c)


@register("queue_depth", """
WITH a AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS arrived FROM orders GROUP BY 1),
c0 AS (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE o_orderstatus = 'F' GROUP BY 1),
c AS (SELECT strftime(done, '%Y-%m-%d') AS day, count(*) AS completed FROM c0 GROUP BY 1),
j AS (SELECT coalesce(a.day, c.day) AS day, coalesce(arrived, 0) AS arrived, coalesce(completed, 0) AS completed
      FROM a FULL OUTER JOIN c ON a.day = c.day)
SELECT day, arrived, completed,
       sum(arrived - completed) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM j""")
def queue_depth(spark, sf_dir):
    """Jobs pending after each day: orders arriving minus finished orders completing."""
    o = table(spark, sf_dir, "orders")
    arr = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    fin = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    done = li.join(fin, "l_orderkey").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    comp = done.select(F.date_format("done", "yyyy-MM-dd").alias("day"))
    return rd.queue_depth(arr, comp).select("day", "arrived", "completed", F.col("depth").cast("long"))


# ---------------- outcomes (lineitem) ----------------

OUT_CTE = """
li AS (SELECT l_orderkey AS batch, 'line_' || l_linenumber AS item, l_linestatus = 'F' AS render_bool,
              l_returnflag <> 'R' AS success, l_shipdate, l_suppkey, l_partkey, l_quantity FROM lineitem),
lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, item
                              ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_quantity DESC) AS rn FROM li)
       WHERE rn = 1)"""


@derived
def _outcomes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("item"),
        (F.col("l_linestatus") == "F").alias("render_bool"), (F.col("l_returnflag") != "R").alias("success"),
        "l_shipdate", "l_suppkey", "l_partkey", "l_quantity")
    return rd.last_wins(li, ["batch", "item"], ["l_shipdate", "l_suppkey", "l_partkey", "l_quantity"])


@register("batch_outcome", f"""WITH {OUT_CTE}
SELECT batch, count(*) AS total, count(*) FILTER (WHERE NOT render_bool OR success) AS succeeded,
       CASE WHEN count(*) FILTER (WHERE NOT render_bool OR success) = count(*) THEN 0
            WHEN count(*) FILTER (WHERE NOT render_bool OR success) > 0 THEN 2 ELSE 1 END AS exit_code
FROM lw GROUP BY batch""")
def batch_outcome(spark, sf_dir):
    """Orders as render batches; skipped items succeed; later results overwrite."""
    return rd.batch_outcome(_outcomes(spark, sf_dir), "batch")


@register("outcome_map", f"""WITH {OUT_CTE}
SELECT batch, count(*) AS total, count(*) FILTER (WHERE success) AS succeeded,
       '{{' || string_agg('"' || item || '":' || success::VARCHAR, ',' ORDER BY item) || '}}' AS outcomes
FROM lw GROUP BY batch""")
def outcome_map(spark, sf_dir):
    """Per batch the input -> success map as JSON (a batch lists its own items)."""
    return rd.outcome_map(_outcomes(spark, sf_dir), "batch", "item", "success")


# ---------------- conversion lists and logs ----------------

@register("conversion_list", """
WITH l AS (SELECT CASE WHEN page_id % 10 = 0 THEN url
                       WHEN page_id % 10 = 1 THEN url || '|a.blend|extra'
                       ELSE url || ' | out/' || page_id || '.blend ' END AS value FROM pages),
p AS (SELECT string_split(trim(value), '|') AS parts FROM l)
SELECT trim(parts[1]) AS input, trim(parts[2]) AS output FROM p WHERE len(parts) >= 2""")
def conversion_list(spark, sf_dir):
    """'input|output' lines built from page URLs (some malformed)."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 10
    v = (F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit("|a.blend|extra")))
         .otherwise(F.concat("url", F.lit(" | out/"), F.col("page_id").cast("string"), F.lit(".blend "))))
    return rd.conversion_list(p.select(v.alias("value")))


@register("error_digest", r"""
WITH d AS (SELECT doc_id,
                  CASE doc_id % 3 WHEN 0 THEN 'Traceback (most recent call last):' || chr(10) || text || chr(10)
                                              || 'ValueError: bad mesh ' || doc_id
                                  WHEN 2 THEN text ELSE '' END AS stderr,
                  CASE doc_id % 3 WHEN 1 THEN text || chr(10) || 'CONVERSION_SUCCESS' ELSE '' END AS stdout
           FROM documents),
c AS (SELECT doc_id, stderr || stdout AS comb FROM d)
SELECT doc_id,
       CASE WHEN contains(comb, 'CONVERSION_SUCCESS') THEN ''
            WHEN contains(comb, 'Traceback') AND len(list_filter(string_split(comb, chr(10)),
                    lambda l: contains(l, 'Error') OR contains(l, 'ERRO'))) > 0
            THEN regexp_replace(list_filter(string_split(comb, chr(10)),
                    lambda l: contains(l, 'Error') OR contains(l, 'ERRO'))[1], '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')
            WHEN length(comb) > 500 THEN right(comb, 500)
            ELSE regexp_replace(comb, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') END AS digest
FROM c""")
def error_digest(spark, sf_dir):
    """Converter logs built around whole documents: traceback, success, or plain output."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    err = (F.when(k == 0, F.concat(F.lit("Traceback (most recent call last):\n"), F.col("text"),
                                   F.lit("\nValueError: bad mesh "), F.col("doc_id").cast("string")))
           .when(k == 2, F.col("text")).otherwise(F.lit("")))
    out = F.when(k == 1, F.concat(F.col("text"), F.lit("\nCONVERSION_SUCCESS"))).otherwise(F.lit(""))
    return d.select("doc_id", rd.error_digest(err, out).alias("digest"))


# ---------------- scripts (part) ----------------

SCRIPT_CTE = """
sc AS (SELECT 'P' || p_partkey AS short_name,
              concat_ws(chr(10),
                CASE WHEN p_size % 2 = 0 THEN 'batchRenderMgr.CreateView "P' || p_partkey || '"' END,
                CASE WHEN p_size % 3 = 0 THEN 'sceneStateMgr.Capture "' || p_brand || '"' END,
                'LayerManager.getLayerFromName "SPOTLAR_OFERTA_' || string_split(p_name, ' ')[1] || '"',
                CASE WHEN p_size % 4 <> 3 THEN 'renderPresetMRUList "' || lower(string_split(p_type, ' ')[1])
                     || '_preview.rps" "' || lower(split_part(p_name, ' ', 2)) || '.rps"' END,
                CASE WHEN p_size % 5 <> 0 THEN 'renderWidth = ' || (p_size * 40) || ' x ' || (p_size * 20) END,
                'layer "SPOTLAR_SUPORTE_' || string_split(p_name, ' ')[2] || '"' || chr(13)) AS text
       FROM part)"""


@derived
def scripts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nm = [F.get(F.split("p_name", " "), F.lit(i)) for i in (0, 1)]
    ty, size = [F.get(F.split("p_type", " "), F.lit(0)), nm[1]], F.col("p_size")
    k = F.col("p_partkey").cast("string")
    text = F.concat_ws(
        "\n",
        F.when(size % 2 == 0, F.concat(F.lit('batchRenderMgr.CreateView "P'), k, F.lit('"'))),
        F.when(size % 3 == 0, F.concat(F.lit('sceneStateMgr.Capture "'), F.col("p_brand"), F.lit('"'))),
        F.concat(F.lit('LayerManager.getLayerFromName "SPOTLAR_OFERTA_'), nm[0], F.lit('"')),
        F.when(size % 4 != 3, F.concat(F.lit('renderPresetMRUList "'), F.lower(ty[0]), F.lit('_preview.rps" "'),
                                       F.lower(ty[1]), F.lit('.rps"'))),
        F.when(size % 5 != 0, F.concat(F.lit("renderWidth = "), (size * 40).cast("string"), F.lit(" x "),
                                       (size * 20).cast("string"))),
        F.concat(F.lit('layer "SPOTLAR_SUPORTE_'), nm[1], F.lit('"\r')))
    return p.select(F.concat(F.lit("P"), k).alias("short_name"), text.alias("text"))


@register("script_features", rf"""WITH {SCRIPT_CTE},
t AS (SELECT short_name, replace(text, chr(13), '') AS t FROM sc)
SELECT short_name, contains(t, 'batchRenderMgr') AS has_batch_render, contains(t, 'sceneStateMgr') AS has_scene_states,
       contains(t, 'LayerManager') AS has_layers, contains(t, '.rps') AS has_presets,
       array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '([\pL\pN_]+)\.rps', 1),
          lambda m: CASE WHEN contains(lower(m), 'preview') THEN lower(replace(m, '_preview', '')) ELSE lower(m) END))), ',')
         AS preset_types,
       CASE WHEN regexp_matches(t, '(\d+)\s*x\s*(\d+)') THEN regexp_extract(t, '(\d+)\s*x\s*(\d+)', 1)::DOUBLE END AS res_w,
       CASE WHEN regexp_matches(t, '(\d+)\s*x\s*(\d+)') THEN regexp_extract(t, '(\d+)\s*x\s*(\d+)', 2)::DOUBLE END AS res_h,
       array_to_string(list_sort(list_distinct(regexp_extract_all(t, '"(SPOTLAR_[^"]+)"', 1))), ',') AS layer_refs
FROM t""")
def script_features(spark, sf_dir):
    """Scene scripts generated per part: feature flags, preset types, first 'W x H', layer names."""
    s = scripts(spark, sf_dir)
    f = rd.script_features("text")
    return s.select("short_name", f["has_batch_render"].alias("has_batch_render"),
                    f["has_scene_states"].alias("has_scene_states"), f["has_layers"].alias("has_layers"),
                    f["has_presets"].alias("has_presets"), F.array_join(f["preset_types"], ",").alias("preset_types"),
                    f["res_w"].cast("double").alias("res_w"), f["res_h"].cast("double").alias("res_h"),
                    F.array_join(rd.layer_refs(F.regexp_replace("text", "\r", "")), ",").alias("layer_refs"))


# ---------------- queue discovery (orders) ----------------

@register("queue_discovery", """
WITH q AS (SELECT '/queue/scene_' || o_orderkey || '.ms' AS path, 'queue' AS source FROM orders
           WHERE o_orderstatus = 'O'),
i0 AS (SELECT CASE WHEN o_orderkey % 10 = 9 THEN '/input/deep/a/b/scene_' || o_orderkey || '.ms'
                   ELSE '/input/proj' || (o_custkey % 20) || '/v' || (o_orderkey % 3 + 1) || '/scene_' || o_orderkey
                        || ['.blend', '.ms', '.fbx', '.MAX'][o_orderkey % 4 + 1] END AS path FROM orders),
i AS (SELECT path, 'input' AS source FROM i0
      WHERE (ends_with(path, '.ms') OR ends_with(path, '.blend')) AND len(string_split(path, '/')) - 2 <= 3),
u AS (SELECT path, min(source) AS source FROM (SELECT * FROM q UNION ALL SELECT * FROM i) GROUP BY path)
SELECT path, source, path = (SELECT min(path) FROM u) AS is_next FROM u""")
def queue_discovery(spark, sf_dir):
    """Queue folder (.ms, depth 1) plus input folder (.ms/.blend, depth <= 3),
    without duplicates; the next job is the first path in order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    q = o.where(F.col("o_orderstatus") == "O").select(
        F.concat(F.lit("/queue/scene_"), k.cast("string"), F.lit(".ms")).alias("path"), F.lit("queue").alias("source"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".blend", ".ms", ".fbx", ".MAX")]), (k % 4 + 1).cast("int"))
    ip = (F.when(k % 10 == 9, F.concat(F.lit("/input/deep/a/b/scene_"), k.cast("string"), F.lit(".ms")))
          .otherwise(F.concat(F.lit("/input/proj"), (F.col("o_custkey") % 20).cast("string"), F.lit("/v"),
                              (k % 3 + 1).cast("string"), F.lit("/scene_"), k.cast("string"), ext)))
    inp = o.select(ip.alias("path"), F.lit("input").alias("source")).where(
        (F.col("path").endswith(".ms") | F.col("path").endswith(".blend")) &
        (F.size(F.split("path", "/")) - 2 <= 3))
    u = q.unionByName(inp).groupBy("path").agg(F.min("source").alias("source"))
    first = u.agg(F.min("path")).scalar()
    return u.select("path", "source", (F.col("path") == first).alias("is_next"))


# ---------------- asset files (documents) ----------------

# Header kinds used to build asset bytes (prefix, extension)
ASSET_KINDS = [
    (b"BLENDER-v300", ".blend"), (b"BLENDER279", ".blend"), (b"# Maya 2020", ".ma"), (b"Maya Binary", ".mb"),
    (b"\xc0-=\x00", ".max"), (b"Kaydara FBX Binary\x00\x00", ".fbx"), (b"; FBX 7.4", ".fbx"),
    (b"v 1.0 2.0 3.0\n", ".obj"), (b"MM\x01\x03", ".3ds"), (b"0\nSECTION\n", ".dxf"), (b"solid part", ".stl"),
    (b"ply\n", ".ply"), (b'<?xml version="1.0"?>', ".dae"), (b"ISO-10303-21;", ".ifc"), (b"", ".txt"),
    (b"glTF\x02\x00\x00\x00\x0c\x00\x00\x00", ".glb"),
]


@derived
def asset_files(spark, sf_dir):
    """documents -> (path, length, content): a format header per kind followed by
    the whole text; every 7th file carries a wrong extension, every 50th is empty."""
    d = table(spark, sf_dir, "documents")
    n = len(ASSET_KINDS)
    kind = (F.col("doc_id") % n).cast("int")
    prefix = F.element_at(F.array(*[F.lit(bytearray(h)) for h, _ in ASSET_KINDS]), kind + 1)
    ext = F.element_at(F.array(*[F.lit(e) for _, e in ASSET_KINDS]), kind + 1)
    ext = F.when(F.col("doc_id") % 7 == 0, F.lit(".obj")).otherwise(ext)
    body = F.encode("text", "UTF-8")
    content = F.concat(prefix, body)
    content = F.when(F.col("doc_id") % 50 == 0, F.lit(bytearray())).otherwise(content)
    return d.select(F.concat(F.lit("assets/doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
                    content.alias("content")).withColumn("length", F.length("content").cast("long"))


def _kind_rows() -> str:
    def text(raw: bytes) -> str:  # undecodable bytes dropped; control characters spelt with chr()
        return " || ".join(f"chr({ord(c)})" for c in raw.decode("utf-8", "ignore")) or "''"
    return ", ".join(f"({i}, unhex('{raw.hex().upper()}'), {text(raw)}, '{ext}')"
                     for i, (raw, ext) in enumerate(ASSET_KINDS))


_EXPECTED = {e: ",".join(ids) for e, ids in fs.extension_formats().items()}
VALIDATION_CTE = rf"""
kinds(k, raw, txt, e) AS (VALUES {_kind_rows()}),
a0 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '.obj' ELSE e END AS ext, doc_id % 50 = 0 AS bare,
              raw || encode(text) AS c, txt || text AS t
       FROM documents JOIN kinds ON kinds.k = doc_id % {len(ASSET_KINDS)}),
a1 AS (SELECT 'assets/doc_' || doc_id || ext AS path, ext, CASE WHEN bare THEN '' ELSE t END AS t,
              CASE WHEN bare THEN '' ELSE hex(c) END AS h, CASE WHEN bare THEN 0 ELSE octet_length(c) END AS n FROM a0),
a2 AS (SELECT *, CASE WHEN n = 0 THEN NULL
    WHEN starts_with(h, '424C454E444552') THEN 'blender'
    WHEN regexp_matches(t, '(?i)\A#\s*Maya\s+\d+') THEN 'maya_ascii'
    WHEN starts_with(h, '4D6179612042696E617279') THEN 'maya_binary'
    WHEN starts_with(h, 'C02D3D00') THEN '3dsmax'
    WHEN starts_with(h, '4B617964617261204642582042696E617279') THEN 'fbx'
    WHEN regexp_matches(t, '(?i)\A; FBX') THEN 'fbx_ascii'
    WHEN regexp_matches(t, '(?i)\A(v|vt|vn|f|o|g|mtllib|usemtl)\s') THEN 'obj'
    WHEN regexp_matches(t, '\A\s*\{{') THEN 'gltf'
    WHEN starts_with(h, '4D4D0103') THEN '3ds'
    WHEN regexp_matches(t, '(?i)\A\s*(0|SECTION|EOF)') THEN 'dxf'
    WHEN regexp_matches(t, '(?i)\Asolid\s+\S') THEN 'stl_ascii'
    WHEN starts_with(h, '00000000') THEN 'stl_binary'
    WHEN regexp_matches(t, '(?i)\Aply\s') THEN 'ply'
    WHEN regexp_matches(t, '(?i)\A<\?xml') THEN 'collada'
    WHEN regexp_matches(t, '(?i)\AISO-10303') THEN 'ifc'
    WHEN ext = '.glb' AND starts_with(h, '676C5446') THEN 'gltf'
    WHEN ext = '.stl' AND starts_with(t, 'solid') AND n < 1000000 THEN 'stl_ascii' END AS fmt,
  CASE ext {' '.join(f"WHEN '{e}' THEN '{ids}'" for e, ids in _EXPECTED.items())} ELSE '' END AS expected_formats FROM a1),
a3 AS (SELECT *, CASE
    WHEN fmt = 'blender' THEN regexp_matches(left(t, 12), '^BLENDER(\d{{3}}|[-_][vV]\d{{3}})')
    WHEN fmt IN ('fbx', 'fbx_ascii') THEN starts_with(h, '4B617964617261204642582042696E617279')
                                          OR (starts_with(t, '; FBX') AND contains(t, '('))
    WHEN fmt = 'gltf' THEN substr(h, 1, 8) = '676C5446' AND substr(h, 9, 8) IN ('01000000', '02000000') AND n >= 12
    WHEN fmt = 'obj' THEN len(list_filter(string_split(t, chr(10))[1:100],
                                          lambda l: regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^[vfntp]\s'))) > 0
    WHEN fmt = 'stl_ascii' THEN contains(lower(t), 'solid') AND (contains(lower(t), 'facet') OR contains(lower(t), 'endsolid'))
    WHEN fmt = '3ds' THEN starts_with(h, '4D4D')
    WHEN fmt = 'maya_ascii' THEN contains(lower(left(t, 100)), 'maya') OR contains(left(t, 100), 'Mel')
    WHEN fmt = '3dsmax' THEN n >= 4 AND len(list_filter(regexp_extract_all(substr(h, 1, 512), '..'), lambda p: p <> '00')) > 10
    ELSE true END AS sound FROM a2),
v AS (SELECT path, ext, fmt AS detected_format, expected_formats, CASE WHEN n = 0 THEN 'invalid' WHEN fmt IS NULL THEN 'unknown'
    WHEN NOT list_contains(string_split(expected_formats, ','), fmt) THEN 'wrong_extension'
    WHEN NOT sound THEN 'corrupted' ELSE 'valid' END AS status FROM a3)"""


@register("file_validation", f"""WITH {VALIDATION_CTE}
SELECT path, status, detected_format, expected_formats, CASE status WHEN 'invalid' THEN '{fs.MESSAGES["empty"]}'
  WHEN 'unknown' THEN '{fs.MESSAGES["unknown"]}'
  WHEN 'wrong_extension' THEN printf('{fs.MESSAGES["wrong_extension"]}', ext, detected_format)
  WHEN 'corrupted' THEN '{fs.MESSAGES["corrupted"]}' ELSE '{fs.MESSAGES["valid"]}' END AS message FROM v""")
def file_validation(spark, sf_dir):
    """Format detection, extension match and integrity over derived asset bytes."""
    return fs.validate(asset_files(spark, sf_dir))


@register("validation_summary", f"""WITH {VALIDATION_CTE}
SELECT count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status <> 'valid') AS invalid,
  count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'wrong_extension') AS wrong_extension,
  count(*) FILTER (status = 'corrupted') AS corrupted FROM v""")
def validation_summary(spark, sf_dir):
    return fs.validation_summary(fs.validate(asset_files(spark, sf_dir)))


@register("conversion_route", f"""WITH {VALIDATION_CTE},
r AS (SELECT path, status, CASE ext {' '.join(f"WHEN '{e}' THEN '{f}'" for e, f in rd.CONVERT_FORMATS.items())} END AS format_type FROM v)
SELECT path, status, format_type, CASE WHEN status NOT IN ('valid', 'unknown') THEN 'rejected_invalid'
  WHEN format_type IS NULL THEN 'rejected_unsupported' WHEN format_type = 'blender' THEN 'copy' ELSE 'convert' END AS route FROM r""")
def conversion_route(spark, sf_dir):
    """Validated assets routed to copy / convert / rejection."""
    v = fs.validate(asset_files(spark, sf_dir)).select("path", "status")
    return rd.conversion_route(v).select("path", "status", "format_type", "route")
