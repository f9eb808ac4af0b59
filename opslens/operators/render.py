"""Render-job data: manifests, layer lists, render settings, job messages,
URIs and routing, progress state, worker counters and exposition text,
queue depth, render lists, conversion lists, error digests and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's) ----
DEFAULT_RESOLUTION = (1920, 1080)
DEFAULT_OUTPUT_BASE = "/storage/output"
LAYER_OFFER = "SPOTLAR_OFERTA_"
LAYER_SUPPORT = "SPOTLAR_SUPORTE_"
SUP_TOKEN = "(Sup)"
ENGINE_CYCLES = "CYCLES"
ENGINE_RASTER = "BLENDER_EE"
REQUIRED_JOB_KEYS = ["job_id", "project", "variation", "artist", "filename", "input_uri", "output_uri"]
EXPOSITION = [  # metric, help, type, column
    ("blender_worker_frames_total", "Frames renderizados pelo worker", "counter", "frames"),
    ("blender_worker_jobs_total", "Jobs processados pelo worker", "counter", "jobs"),
    ("blender_worker_jobs_failed", "Jobs com falha", "counter", "failed"),
    ("blender_worker_queue_depth", "Quantidade de jobs na fila", "gauge", "queue_depth"),
    ("blender_worker_last_success_timestamp", "Timestamp do último job bem sucedido", "gauge",
     "last_success"),
]
ERROR_TAIL = 500
PROGRESS_ERROR_CAP = 200
SUCCESS_MARKER = "CONVERSION_SUCCESS"
CONVERT_FORMATS = {  # extension -> format type of the converter
    ".blend": "blender", ".ms": "maya_ascii", ".ma": "maya_ascii", ".mb": "maya_binary",
    ".max": "3dsmax", ".fbx": "fbx", ".obj": "obj", ".gltf": "gltf", ".glb": "glb", ".3ds": "3ds",
    ".stl": "stl", ".ply": "ply", ".dae": "collada", ".dxf": "dxf",
}



def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- manifests ----

def read_manifest(df: DataFrame, col: str = "manifest",
                  output_base: str = DEFAULT_OUTPUT_BASE) -> DataFrame:
    """Manifest JSON -> one row per render item.

    Accepts {"items": [...]}, a bare array or a single object; non-object
    entries are skipped. Aliases: type/render_type, render_bool/render;
    folder defaults to short_name, dest to ``output_base``; layer_name may be
    a string or a list (joined with ', ')."""
    v = F.try_parse_json(_c(col))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    items = F.when(is_obj, F.coalesce(F.try_variant_get(v, "$.items", "variant"), v)).otherwise(v)
    arr = F.coalesce(F.try_variant_get(items, "$", "array<variant>"), F.array(items))
    e = df.select("*", F.posexplode(arr).alias("item_pos", "_it")).where(
        F.schema_of_variant("_it").startswith("OBJECT"))

    def get(path, typ="string"):
        return F.try_variant_get("_it", path, typ)

    layer = F.coalesce(F.array_join(get("$.layer_name", "array<string>"), ", "),
                       get("$.layer_name"), F.lit(""))
    folder = F.coalesce(get("$.folder_to_use"), F.lit(""))
    short = F.coalesce(get("$.short_name"), F.lit(""))
    dest = F.coalesce(get("$.dest"), F.lit(output_base))
    return e.select(
        *[c for c in df.columns if c != col], "item_pos",
        short.alias("short_name"), F.coalesce(get("$.camera_name"), F.lit("")).alias("camera_name"),
        layer.alias("layer_name"),
        F.coalesce(get("$.resolution"), F.lit("1920x1080")).alias("resolution"),
        F.coalesce(get("$.filename"), F.lit("")).alias("filename"),
        F.coalesce(get("$.type"), get("$.render_type"), F.lit("color")).alias("render_type"),
        F.coalesce(get("$.render_bool", "boolean"), get("$.render", "boolean"), F.lit(True)).alias("render_bool"),
        F.coalesce(get("$.preview_bool", "boolean"), F.lit(False)).alias("preview_bool"),
        F.when(folder == "", short).otherwise(folder).alias("folder_to_use"),
        F.when(dest == "", F.lit(output_base)).otherwise(dest).alias("dest"))


def parse_resolution(res: str | Column) -> Column:
    """'WxH' (x or X) or 'W,H' at the start; else 1920x1080. -> struct(w, h)."""
    r = _c(res)
    x = F.regexp_extract(r, r"^(\d+)[xX](\d+)", 0) != ""
    cm = F.regexp_extract(r, r"^(\d+),(\d+)", 0) != ""
    w = (F.when(x, F.regexp_extract(r, r"^(\d+)[xX](\d+)", 1))
         .when(cm, F.regexp_extract(r, r"^(\d+),(\d+)", 1)).otherwise(F.lit(str(DEFAULT_RESOLUTION[0]))))
    h = (F.when(x, F.regexp_extract(r, r"^(\d+)[xX](\d+)", 2))
         .when(cm, F.regexp_extract(r, r"^(\d+),(\d+)", 2)).otherwise(F.lit(str(DEFAULT_RESOLUTION[1]))))
    both = w.try_cast("long").isNotNull() & h.try_cast("long").isNotNull()  # an overlong number is unreadable
    return F.struct(*[F.when(both, c.try_cast("long")).otherwise(F.lit(d).cast("long")).alias(n)
                      for c, d, n in zip((w, h), DEFAULT_RESOLUTION, ("w", "h"), strict=True)])


def _is_sem(c: Column) -> Column:
    return F.upper(c).startswith("SEM")


def normalise_layers(layer_name: str | Column) -> Column:
    """Comma list -> normalised layer names (array).

    '(Sup)' makes the next token a support layer (unless it starts with Sem);
    '_i' suffix is removed; 'Sem…' tokens are dropped; the rest become offer
    layers. A token is taken by a '(Sup)' exactly when the run of '(Sup)'
    tokens right before it has odd length (pairs form left to right), so
    each token's fate is a function of its prefix, computed without a fold."""
    toks = F.transform(F.split(_c(layer_name), ",", -1), lambda t: F.trim(t))
    n = F.size(toks)

    def fate(i):
        tok = F.element_at(toks, i + 1)
        # last index j < i whose token is not '(Sup)' (or -1)
        prev = F.filter(F.sequence(F.lit(-1), i - 1),
                        lambda j: (j < 0) | (F.element_at(toks, j + 1) != SUP_TOKEN))
        run = i - 1 - F.array_max(prev)
        taken = (run % 2 == 1) & ~_is_sem(tok)
        base = F.when(tok.endswith("_i"), F.substring(tok, F.lit(1), F.length(tok) - 2)).otherwise(tok)
        return (F.when(taken, F.concat(F.lit(LAYER_SUPPORT), tok))
                .when(tok == SUP_TOKEN, F.lit(None))
                .when(_is_sem(base), F.lit(None))
                .otherwise(F.concat(F.lit(LAYER_OFFER), base)))

    out = F.transform(F.sequence(F.lit(0), n - 1), fate)
    return F.filter(out, lambda x: x.isNotNull())


def output_path(dest: str | Column, folder: str | Column, filename: str | Column) -> Column:
    return F.concat(_c(dest), F.lit("/"), _c(folder), F.lit("/"), _c(filename), F.lit(".png"))


def render_settings(items: DataFrame) -> DataFrame:
    """Engine and samples by render type; preview halves the resolution."""
    t = F.col("render_type")
    res = parse_resolution("resolution")
    engine = F.when(t.isin("refraction", "shadow", "static"), ENGINE_CYCLES).otherwise(ENGINE_RASTER)
    samples = F.when(t == "refraction", 256).when(t.isin("shadow", "static"), 128)
    half = F.col("preview_bool")
    return items.select(
        "*", res["w"].alias("width"), res["h"].alias("height"), engine.alias("engine"),
        samples.alias("samples"),
        F.when(half, F.floor(res["w"] / 2)).otherwise(res["w"]).cast("long").alias("res_x"),
        F.when(half, F.floor(res["h"] / 2)).otherwise(res["h"]).cast("long").alias("res_y"),
        output_path("dest", "folder_to_use", "filename").alias("output_path"))


def batch_outcome(results: DataFrame, batch: str) -> DataFrame:
    """results(batch, render_bool, success): skipped items count as success.
    exit_code 0 all succeeded, 2 some, 1 none."""
    ok = F.when(~F.col("render_bool"), F.lit(True)).otherwise(F.col("success"))
    g = results.groupBy(batch).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"))
    return g.withColumn("exit_code", F.when(F.col("succeeded") == F.col("total"), 0)
                        .when(F.col("succeeded") > 0, 2).otherwise(1))


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key in ``order`` (later results overwrite)."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def outcome_map(results: DataFrame, batch: str, key: str, ok: str) -> DataFrame:
    """Per batch: JSON object input -> success (key order ascending)."""
    return results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(ok)).alias("succeeded"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, ok))))).alias("outcomes"))


# ---- job messages ----

def parse_jobs(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """JSON job messages -> (valid, quarantine). All seven keys are required;
    priority defaults to 0 (also when it is no integer). Unparseable bodies go to quarantine too.

    ``json_tuple`` reads every top-level key in one pass over the text (field
    access on a ``from_json`` struct would re-parse the body per field)."""
    keys = REQUIRED_JOB_KEYS + ["priority"]
    p = df.select("*", F.json_tuple(body, *keys).alias(*[f"_k_{k}" for k in keys]))
    missing = F.filter(F.array(*[F.when(F.col(f"_k_{k}").isNull(), F.lit(k)) for k in REQUIRED_JOB_KEYS]),
                       lambda x: x.isNotNull())
    p = p.withColumn("missing", missing)
    cols = [F.col(f"_k_{k}").alias(k) for k in REQUIRED_JOB_KEYS]
    valid = p.where(F.size("missing") == 0).select(
        *[c for c in df.columns if c != body], *cols,
        F.coalesce(F.col("_k_priority").try_cast("int"), F.lit(0)).alias("priority"))
    quarantine = p.where(F.size("missing") > 0).select(
        *[c for c in df.columns], F.array_join("missing", ",").alias("missing_keys"))
    return valid, quarantine


def split_uri(uri: str | Column) -> Column:
    """s3://bucket/key -> (s3, bucket, key); file://path -> (file, path);
    anything else -> unsupported."""
    u = _c(uri)
    s3 = u.startswith("s3://")
    rest = F.regexp_replace(u, "^s3://", "")
    bucket = F.when(s3, F.get(F.split(rest, "/", 2), F.lit(0)))
    key = F.when(s3, F.coalesce(F.get(F.split(rest, "/", 2), F.lit(1)), F.lit("")))
    local = F.when(u.startswith("file://"), F.regexp_replace(u, "^file://", ""))
    scheme = F.when(s3, "s3").when(u.startswith("file://"), "file").otherwise("unsupported")
    return F.struct(scheme.alias("scheme"), bucket.alias("bucket"), key.alias("key"), local.alias("path"))


def stem(filename: str | Column) -> Column:
    """Path(filename).stem: last component without its last suffix."""
    name = F.element_at(F.split(_c(filename), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$") & ~name.rlike(r"^\.[^.]*$"),
                  F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def suffix(filename: str | Column) -> Column:
    name = F.element_at(F.split(_c(filename), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$") & ~name.rlike(r"^\.[^.]*$"),
                  F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))


def job_folder(project, variation, filename, job_id) -> Column:
    return F.concat_ws("_", _c(project), _c(variation), stem(filename), F.substring(_c(job_id), 1, 8))


def route_job(filename: str | Column) -> Column:
    """By lower-case extension: ms -> script, blend -> direct, else convert-first."""
    ext = F.lower(F.regexp_extract(_c(filename), r"\.([^./]*)$", 1))
    return F.when(ext == "ms", "script").when(ext == "blend", "direct").otherwise("convert-first")


def disposition(filename, input_uri, success, epoch) -> Column:
    """Destination name of a local input after the job: {stem}_{completed|failed}_{epoch}{suffix}."""
    u = _c(input_uri)
    src_suffix = suffix(F.regexp_replace(u, "^file://", ""))
    name = F.concat(stem(filename), F.lit("_"), F.when(_c(success), "completed").otherwise("failed"),
                    F.lit("_"), _c(epoch).cast("string"), src_suffix)
    return F.when(u.startswith("file://"), name)


def error_digest(stderr: str | Column, stdout: str | Column) -> Column:
    """'' on the success marker; on a traceback the first line mentioning
    Error/ERRO (stripped); else the last 500 characters (or the stripped text)."""
    comb = F.concat(F.coalesce(_c(stderr), F.lit("")), F.coalesce(_c(stdout), F.lit("")))
    lines = F.split(comb, "\n", -1)
    err_line = F.get(F.filter(lines, lambda l: l.contains("Error") | l.contains("ERRO")), F.lit(0))
    tail = F.when(F.length(comb) > ERROR_TAIL,
                  F.substring(comb, F.length(comb) - ERROR_TAIL + 1, ERROR_TAIL)).otherwise(
        F.regexp_replace(comb, r"^\s+|\s+$", ""))
    traced = comb.contains("Traceback") & err_line.isNotNull()
    return (F.when(comb.contains(SUCCESS_MARKER), F.lit(""))
            .when(traced, F.regexp_replace(err_line, r"^\s+|\s+$", "")).otherwise(tail))


# ---- counters, exposition, queue ----

def worker_counters(jobs: DataFrame, worker: str = "worker") -> DataFrame:
    """jobs(worker, status, frames, ts) (one row per job, latest state) ->
    processed, failed, frames and last success time (epoch seconds)."""
    ok = F.col("status") == "completed"
    return jobs.groupBy(worker).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.when(ok, F.col("frames")).otherwise(0)).alias("frames"),
        F.coalesce(F.max(F.when(ok, F.unix_seconds(F.col("ts").cast("timestamp")))), F.lit(0))
        .alias("last_success"))


def exposition(counters: DataFrame, worker: str = "worker") -> DataFrame:
    """Text exposition: HELP / TYPE / sample line per metric and worker."""
    rows = None
    for i, (name, help_, typ, col) in enumerate(EXPOSITION):
        r = counters.select(worker, F.lit(i).alias("metric_no"), F.format_string(
            "# HELP %s %s\n# TYPE %s %s\n%s{worker=\"%s\"} %s", F.lit(name), F.lit(help_), F.lit(name),
            F.lit(typ), F.lit(name), F.col(worker), F.col(col).cast("string")).alias("text"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def queue_depth(arrivals: DataFrame, completions: DataFrame, period: str = "day") -> DataFrame:
    """Pending jobs after each period: running arrivals minus completions.

    Both inputs are already per-period counts, so the running sum is over one
    row per period."""
    a = arrivals.groupBy(period).agg(F.count(F.lit(1)).alias("arrived"))
    c = completions.groupBy(period).agg(F.count(F.lit(1)).alias("completed"))
    j = a.join(c, period, "full_outer").fillna(0, ["arrived", "completed"])
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("depth", F.sum(F.col("arrived") - F.col("completed")).over(w))


# ---- render lists, conversion lists ----

def render_config(rows: DataFrame) -> DataFrame:
    """Render-list rows (columns A..G) -> render config: a code is required and
    column B must start with 'CATEGORY:'; 'CATEGORY:a;SUBCATEGORY:b' gives
    category a and name b (a single part serves as both); G == '1' renders."""
    code = F.coalesce(F.col("A"), F.lit(""))
    b = F.coalesce(F.col("B"), F.lit(""))
    body = F.regexp_replace(b, "^CATEGORY:", "")
    parts = F.split(body, ";", -1)
    cat = parts[0]
    sub = F.when(F.size(parts) >= 2, F.regexp_replace(F.get(parts, F.lit(1)), "^SUBCATEGORY:", "")).otherwise(parts[0])
    r = rows.where((code != "") & b.startswith("CATEGORY:"))
    return r.select(code.alias("code"), sub.alias("name"), cat.alias("category"), sub.alias("short_name"),
                    (F.coalesce(F.col("G"), F.lit("0")) == "1").alias("is_renderable"),
                    F.concat(F.lit("SPOTLAR_"), code).alias("layer_name"))


def pair_render_list(scripts: DataFrame, lists: DataFrame) -> DataFrame:
    """scripts(root, script, base), lists(root, folder, base, ext, path) -> script, render_list.

    Of the lists under the script's root, in this order: xlsx of its base name in
    a sub-folder of ``input``, then of ``renderlists``, then any xlsx right in
    ``renderlists``; then the same three for xls. ``base`` is null for a list right
    in the folder; of several the first path counts."""
    late = F.when(F.lower("ext") == "xls", 3).when(F.lower("ext") == "xlsx", 0)
    named = lists.where(F.col("base").isNotNull()).groupBy("root", "base").agg(F.min(F.struct(
        (late + F.when(F.col("folder") == "input", 0).when(F.col("folder") == "renderlists", 1)).alias("rank"), "path")).alias("own"))
    loose = lists.where(F.col("base").isNull() & (F.col("folder") == "renderlists")).groupBy("root").agg(
        F.min(F.struct((late + 2).alias("rank"), "path")).alias("any"))
    return (scripts.join(named, ["root", "base"], "left").join(loose, "root", "left")
            .select("script", F.least("own", "any")["path"].alias("render_list")))


def conversion_list(lines: DataFrame, col: str = "value") -> DataFrame:
    """'input|output' lines (at least two parts, trimmed)."""
    p = F.split(F.trim(F.col(col)), r"\|", -1)
    return lines.where(F.size(p) >= 2).select(F.trim(p[0]).alias("input"), F.trim(F.get(p, F.lit(1))).alias("output"))


def conversion_route(validated: DataFrame, force: bool = False) -> DataFrame:
    """validated(path, status) -> route: rejected_invalid (not forced, not valid
    and not unknown), unsupported extension, copy (.blend) or convert."""
    ext = F.lower(suffix("path"))
    fmt = F.create_map(*[F.lit(x) for kv in CONVERT_FORMATS.items() for x in kv])[ext]
    bad = (F.col("status") != "valid") & (F.col("status") != "unknown")
    r = (F.when(F.lit(not force) & bad, "rejected_invalid").when(fmt.isNull(), "rejected_unsupported")
         .when(fmt == "blender", "copy").otherwise("convert"))
    return validated.withColumn("format_type", fmt).withColumn("route", r)


# ---- script text ----

def script_features(text: str | Column) -> Column:
    """MAXScript text (CR removed) -> flags, preset types and first 'W x H'."""
    t = F.regexp_replace(_c(text), "\r", "")
    presets = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_]+)\.rps"), 1),
        lambda m: F.when(F.lower(m).contains("preview"), F.lower(F.replace(m, F.lit("_preview"), F.lit(""))))
        .otherwise(F.lower(m)))))
    res = F.regexp_extract(t, r"(\d+)\s*x\s*(\d+)", 0)
    return F.struct(
        t.contains("batchRenderMgr").alias("has_batch_render"),
        t.contains("sceneStateMgr").alias("has_scene_states"),
        t.contains("LayerManager").alias("has_layers"), t.contains(".rps").alias("has_presets"),
        presets.alias("preset_types"),
        F.when(res != "", F.regexp_extract(t, r"(\d+)\s*x\s*(\d+)", 1).try_cast("long")).alias("res_w"),
        F.when(res != "", F.regexp_extract(t, r"(\d+)\s*x\s*(\d+)", 2).try_cast("long")).alias("res_h"))


def layer_refs(text: str | Column) -> Column:
    """Distinct quoted "SPOTLAR_…" names in a script (sorted)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r'"(SPOTLAR_[^"]+)"'), 1)))
