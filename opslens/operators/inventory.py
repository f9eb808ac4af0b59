"""Repository inventory over a file listing: language mix, API endpoints,
components, folder listing, requirements and package.json dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.sinks.rowfiles import list_files

# Language -> file patterns (declaration order breaks ties).
LANGUAGE_PATTERNS = [
    ("python", ["*.py", "requirements*.txt", "setup.py", "pyproject.toml"]),
    ("javascript", ["*.js", "*.ts", "package.json", "*.jsx", "*.tsx"]),
    ("go", ["*.go", "go.mod", "go.sum"]),
    ("terraform", ["*.tf", "*.tfvars"]),
    ("docker", ["Dockerfile*", "docker-compose*.yml"]),
    ("kubernetes", ["*.yaml", "*.yml", "helm/**"]),
]
# Route patterns (framework, regex with groups (object, verb, path)).
ROUTE_PATTERNS = {
    "fastapi": r"""@(app|router)\.(get|post|put|patch|delete)\(['"]([^'"]+)['"]""",
    "flask": r"""@(app|blueprint)\.(route|get|post|put|delete)\(['"]([^'"]+)['"]""",
    "express": r"""(app|router)\.(get|post|put|patch|delete)\(['"]([^'"]+)['"]""",
}
COMPONENT_RULES = [  # component, path words
    ("API Service", ["api"]),
    ("Frontend/Web UI", ["web", "frontend", "portal"]),
    ("Background Worker", ["worker", "job"]),
    ("Job Scheduler", ["scheduler"]),
    ("Infrastructure", ["terraform", "infra"]),
]
PRUNED_DIRS = [".git", "node_modules", "__pycache__", ".venv"]
ENDPOINT_CAP = 20
DEP_CAP = 10
FILES_PER_FOLDER = 5


def _glob_re(pattern: str) -> str:
    if pattern.endswith("/**"):
        return "(^|/)" + pattern[:-3].replace(".", r"\.") + "/"
    body = pattern.replace(".", r"\.").replace("*", "[^/]*")
    return "(^|/)" + body + "$"


def visible(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop files under pruned or hidden folders and hidden files."""
    return files.where(~F.col(path).rlike(r"(^|/)\.[^/]*(/|$)") &
                       ~F.col(path).rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in PRUNED_DIRS) + ")/"))


def language_mix(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """Per repo: files matching each language's patterns; the language with
    most files wins, ties by declaration order; none -> unknown."""
    hits = [reduce(Column.__or__, [F.col(path).rlike(_glob_re(p)) for p in pats]) for _, pats in LANGUAGE_PATTERNS]
    counts = files.groupBy(repo).agg(*[F.count_if(c).alias(f"_n{k}") for k, c in enumerate(hits)])
    best = F.array_max(F.array(*[F.struct(F.col(f"_n{k}").alias("n"), F.lit(-k).alias("rank"), F.lit(lang).alias("language"))
                                 for k, (lang, _) in enumerate(LANGUAGE_PATTERNS)]))
    return counts.withColumn("_best", best).select(
        repo, F.when(F.col("_best.n") > 0, F.col("_best.language")).otherwise("unknown").alias("language"),
        F.col("_best.n").alias("files"))


def endpoints(files: DataFrame, repo: str = "repo", cap: int = ENDPOINT_CAP) -> DataFrame:
    """files(repo, path, text): route declarations, verb and path (the
    reference reports object and verb), first ``cap`` per repo by (path, position)."""
    name = F.element_at(F.split("path", "/"), -1)
    py = name.endswith(".py")
    js = name.rlike(r"\.(js|ts|jsx|tsx)$") & (name.contains("express") | name.contains("next"))
    pat = (F.when(py & F.col("text").contains("fastapi"), F.lit(ROUTE_PATTERNS["fastapi"]))
           .when(py & F.col("text").contains("flask"), F.lit(ROUTE_PATTERNS["flask"]))
           .when(js & F.col("text").contains("express"), F.lit(ROUTE_PATTERNS["express"])))
    f = files.withColumn("_pat", pat).where(F.col("_pat").isNotNull())
    m = f.select(repo, "path", F.posexplode(F.expr("regexp_extract_all(text, _pat, 0)")).alias("pos", "m"), "_pat")
    m = m.select(repo, "path", "pos", F.upper(F.regexp_extract("m", ROUTE_PATTERNS["express"], 2)).alias("method"),
                 F.regexp_extract("m", ROUTE_PATTERNS["express"], 3).alias("route"))
    w = Window.partitionBy(repo).orderBy("path", "pos")
    return (m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
            .select(repo, "method", "route", F.col("path").alias("file"), "n"))


def components(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """Components named by folder words (distinct per repo)."""
    folder = F.lower(F.regexp_replace(F.col(path), "/[^/]*$", ""))
    named = F.array(*[F.when(reduce(Column.__or__, [folder.contains(w) for w in words]), F.lit(comp)) for comp, words in COMPONENT_RULES])
    return files.select(repo, F.explode(F.array_compact(named)).alias("component")).distinct()


def folder_listing(files: DataFrame, repo: str = "repo", path: str = "path",
                   per_folder: int = FILES_PER_FOLDER, max_depth: int = 3) -> DataFrame:
    """First ``per_folder`` files of each folder (by name) and an overflow
    line '... (n more)'; folders deeper than ``max_depth`` are left out."""
    folder = F.regexp_replace(F.col(path), "/[^/]*$", "")
    name = F.element_at(F.split(F.col(path), "/"), -1)
    depth = F.size(F.split(folder, "/")) - 1
    f = files.select(repo, folder.alias("folder"), name.alias("name"), depth.alias("depth")).where(
        F.col("depth") <= max_depth)
    w = Window.partitionBy(repo, "folder").orderBy("name")
    listed = f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_folder).select(
        repo, "folder", "n", F.col("name").alias("entry"))
    over = f.groupBy(repo, "folder").agg(F.count(F.lit(1)).alias("files")).where(
        F.col("files") > per_folder).select(
        repo, "folder", F.lit(per_folder + 1).alias("n"),
        F.format_string("... (%d more)", F.col("files") - per_folder).alias("entry"))
    return listed.unionByName(over)


def requirements(files: DataFrame, cap: int = DEP_CAP) -> DataFrame:
    """requirements.txt rows: skip blank, comment and option lines, cut at the
    first version operator, first ``cap`` per file in line order."""
    ln = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    t = F.regexp_replace("line", r"^\s+|\s+$", "")
    dep = F.regexp_replace(F.split(t, "[=<>!~]")[0], r"^\s+|\s+$", "")
    d = ln.where((t != "") & ~t.startswith("#") & ~t.startswith("-")).withColumn("dep", dep).where(
        F.col("dep") != "")
    w = Window.partitionBy("path").orderBy("pos")
    return d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).select("path", "n", "dep")


def package_deps(files: DataFrame, cap: int = DEP_CAP) -> DataFrame:
    """package.json: first ``cap`` dependency names in file order."""
    keys = F.json_object_keys(F.get_json_object("text", "$.dependencies"))
    return files.select("path", F.posexplode(F.slice(keys, 1, cap)).alias("pos", "dep")).select(
        "path", (F.col("pos") + 1).alias("n"), "dep")


def file_inventory(spark, path: str) -> DataFrame:
    """path (below the folder), length, modificationTime of every file, empty ones included; no content is read."""
    return list_files(spark, path).withColumnRenamed("modified", "modificationTime")
