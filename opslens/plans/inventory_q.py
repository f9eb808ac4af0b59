"""Registered repository-inventory queries over a file tree derived from pages:
repo = the URL's language segment, path from the URL, text from the page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens.operators import inventory as inv
from opslens.plans.registry import derived, register
from opslens.tables import table

# fixed file names by page_id mod 10 (the tree's file kinds)
FILE_KINDS = ["app.py", "express_routes.js", "main.go", "main.tf", "deploy.yaml", "Dockerfile",
              "requirements.txt", "package.json", "flask_app.py", "notes.md"]
DIRS = ["api", "web", "worker", "scheduler", "infra", "lib", ".git", "node_modules", "docs", "jobs"]

FILES_CTE = """
p AS (SELECT page_id, html,
             coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1), ''), 'root') AS repo,
             regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS links FROM pages),
f AS (SELECT repo, page_id,
             'repo/' || repo || '/' || """ + "[" + ", ".join(f"'{d}'" for d in DIRS) + """][page_id % 10 + 1]
               || CASE WHEN page_id % 3 = 0 THEN '/sub' || (page_id % 4) ELSE '' END
               || '/' || page_id || '_' || """ + "[" + ", ".join(f"'{k}'" for k in FILE_KINDS) + """][(page_id // 10) % 10 + 1]
               AS path,
             links FROM p),
ft AS (SELECT repo, path, CASE
          WHEN ends_with(path, '.py') THEN concat_ws(chr(10),
              CASE WHEN ends_with(path, 'flask_app.py') THEN 'from flask import Flask' ELSE 'from fastapi import FastAPI' END,
              array_to_string(list_transform(links, lambda l: '@app.' ||
                 ['get', 'post', 'put', 'delete'][length(l) % 4 + 1] || '("' || l || '")'), chr(10)))
          WHEN ends_with(path, '.js') THEN concat_ws(chr(10), 'const express = require("express");',
              array_to_string(list_transform(links, lambda l: 'router.' ||
                 ['get', 'post', 'put', 'delete'][length(l) % 4 + 1] || '(''' || l || ''', h);'), chr(10)))
          WHEN ends_with(path, 'requirements.txt') THEN concat_ws(chr(10), '# deps', '-r base.txt', '',
              array_to_string(list_transform(links, lambda l: replace(l, '/', '') || '>=1.0'), chr(10)))
          WHEN ends_with(path, 'package.json') THEN '{"dependencies": {' ||
              array_to_string(list_transform(links, lambda l: '"' || replace(l, '/', 'pkg-') || '": "^1.0.0"'), ', ')
              || '}}'
          ELSE '' END AS text FROM f)"""


@derived
def repo_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    repo = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)", 1), F.lit("")), F.lit("root"))
    links = F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), 1)
    k = F.col("page_id")
    d = F.element_at(F.array(*[F.lit(x) for x in DIRS]), (k % 10 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in FILE_KINDS]), (F.floor(k / 10) % 10 + 1).cast("int"))
    sub = F.when(k % 3 == 0, F.concat(F.lit("/sub"), (k % 4).cast("string"))).otherwise(F.lit(""))
    path = F.concat(F.lit("repo/"), repo, F.lit("/"), d, sub, F.lit("/"), k.cast("string"), F.lit("_"), kind)
    verb = lambda l: F.element_at(F.array(*[F.lit(v) for v in ("get", "post", "put", "delete")]),
                                  (F.length(l) % 4 + 1).cast("int"))
    nl = "\n"
    py = F.concat_ws(nl, F.when(path.endswith("flask_app.py"), F.lit("from flask import Flask"))
                     .otherwise(F.lit("from fastapi import FastAPI")),
                     F.array_join(F.transform(links, lambda l: F.concat(F.lit("@app."), verb(l), F.lit('("'), l,
                                                                         F.lit('")'))), nl))
    js = F.concat_ws(nl, F.lit('const express = require("express");'),
                     F.array_join(F.transform(links, lambda l: F.concat(F.lit("router."), verb(l), F.lit("('"), l,
                                                                         F.lit("', h);"))), nl))
    req = F.concat_ws(nl, F.lit("# deps"), F.lit("-r base.txt"), F.lit(""),
                      F.array_join(F.transform(links, lambda l: F.concat(F.replace(l, F.lit("/"), F.lit("")),
                                                                         F.lit(">=1.0"))), nl))
    pkg = F.concat(F.lit('{"dependencies": {'),
                   F.array_join(F.transform(links, lambda l: F.concat(F.lit('"'), F.replace(l, F.lit("/"), F.lit("pkg-")),
                                                                      F.lit('": "^1.0.0"'))), ", "), F.lit("}}"))
    text = (F.when(path.endswith(".py"), py).when(path.endswith(".js"), js)
            .when(path.endswith("requirements.txt"), req).when(path.endswith("package.json"), pkg).otherwise(F.lit("")))
    return p.select(repo.alias("repo"), path.alias("path"), text.alias("text"))


@derived
def _visible(spark, sf_dir):
    return inv.visible(repo_files(spark, sf_dir))


LANG_SQL = []
for _rank, (_lang, _pats) in enumerate(inv.LANGUAGE_PATTERNS):
    _c = " OR ".join(f"regexp_matches(path, '{inv._glob_re(p_)}')" for p_ in _pats)
    LANG_SQL.append(f"SELECT repo, '{_lang}' AS language, {_rank} AS rk, count(*) FILTER (WHERE {_c}) AS files "
                    f"FROM v GROUP BY repo")
VISIBLE_SQL = r"""v AS (SELECT * FROM ft WHERE NOT regexp_matches(path, '(^|/)\.[^/]*(/|$)')
                  AND NOT regexp_matches(path, '(^|/)(\.git|node_modules|__pycache__|\.venv)/'))"""


@register("language_mix", f"""WITH {FILES_CTE}, {VISIBLE_SQL},
c AS ({' UNION ALL '.join(LANG_SQL)}),
b AS (SELECT repo, arg_max(language, (files, -rk)) AS language, max(files) AS files FROM c WHERE files > 0
      GROUP BY repo)
SELECT r.repo, coalesce(b.language, 'unknown') AS language, coalesce(b.files, 0) AS files
FROM (SELECT DISTINCT repo FROM v) r LEFT JOIN b USING (repo)""")
def language_mix(spark, sf_dir):
    """Primary language per repo by file-pattern counts (ties: declaration order)."""
    return inv.language_mix(_visible(spark, sf_dir))


@register("endpoints", f"""WITH {FILES_CTE}, {VISIBLE_SQL},
s AS (SELECT repo, path, CASE
        WHEN ends_with(path, '.py') AND contains(text, 'fastapi') THEN 'fa'
        WHEN ends_with(path, '.py') AND contains(text, 'flask') THEN 'fl'
        WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '\\.(js|ts|jsx|tsx)$')
             AND (contains(regexp_extract(path, '[^/]*$'), 'express') OR contains(regexp_extract(path, '[^/]*$'), 'next'))
             AND contains(text, 'express') THEN 'ex' END AS fw, text FROM v),
m AS (SELECT repo, path, fw, unnest(CASE fw
        WHEN 'fa' THEN regexp_extract_all(text, '@(app|router)\\.(get|post|put|patch|delete)\\([''"]([^''"]+)[''"]', 0)
        WHEN 'fl' THEN regexp_extract_all(text, '@(app|blueprint)\\.(route|get|post|put|delete)\\([''"]([^''"]+)[''"]', 0)
        ELSE regexp_extract_all(text, '(app|router)\\.(get|post|put|patch|delete)\\([''"]([^''"]+)[''"]', 0) END) AS m,
      generate_subscripts(CASE fw
        WHEN 'fa' THEN regexp_extract_all(text, '@(app|router)\\.(get|post|put|patch|delete)\\([''"]([^''"]+)[''"]', 0)
        WHEN 'fl' THEN regexp_extract_all(text, '@(app|blueprint)\\.(route|get|post|put|delete)\\([''"]([^''"]+)[''"]', 0)
        ELSE regexp_extract_all(text, '(app|router)\\.(get|post|put|patch|delete)\\([''"]([^''"]+)[''"]', 0) END, 1) - 1 AS pos
      FROM s WHERE fw IS NOT NULL),
e AS (SELECT repo, upper(regexp_extract(m, '(app|router)\\.(get|post|put|patch|delete)\\([''"]([^''"]+)[''"]', 2)) AS method,
             regexp_extract(m, '(app|router)\\.(get|post|put|patch|delete)\\([''"]([^''"]+)[''"]', 3) AS route,
             path AS file, row_number() OVER (PARTITION BY repo ORDER BY path, pos) AS n FROM m)
SELECT * FROM e WHERE n <= 20""")
def endpoints(spark, sf_dir):
    """Route declarations (verb, path) in Python/Express files, first 20 per repo."""
    return inv.endpoints(_visible(spark, sf_dir))


@register("components", f"""WITH {FILES_CTE}, {VISIBLE_SQL},
d AS (SELECT repo, lower(regexp_replace(path, '/[^/]*$', '')) AS folder FROM v)
SELECT DISTINCT repo, component FROM (
  SELECT repo, 'API Service' AS component FROM d WHERE contains(folder, 'api')
  UNION ALL SELECT repo, 'Frontend/Web UI' FROM d
            WHERE contains(folder, 'web') OR contains(folder, 'frontend') OR contains(folder, 'portal')
  UNION ALL SELECT repo, 'Background Worker' FROM d WHERE contains(folder, 'worker') OR contains(folder, 'job')
  UNION ALL SELECT repo, 'Job Scheduler' FROM d WHERE contains(folder, 'scheduler')
  UNION ALL SELECT repo, 'Infrastructure' FROM d WHERE contains(folder, 'terraform') OR contains(folder, 'infra'))""")
def components(spark, sf_dir):
    return inv.components(_visible(spark, sf_dir))


@register("folder_listing", f"""WITH {FILES_CTE}, {VISIBLE_SQL},
d AS (SELECT repo, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS name FROM v),
dd AS (SELECT *, len(string_split(folder, '/')) - 1 AS depth FROM d),
l AS (SELECT repo, folder, row_number() OVER (PARTITION BY repo, folder ORDER BY name) AS n, name AS entry
      FROM dd WHERE depth <= 3)
SELECT repo, folder, n, entry FROM l WHERE n <= 5
UNION ALL
SELECT repo, folder, 6 AS n, printf('... (%d more)', count(*) - 5) FROM dd WHERE depth <= 3
GROUP BY repo, folder HAVING count(*) > 5""")
def folder_listing(spark, sf_dir):
    """First five files per folder (depth <= 3) and the overflow line."""
    return inv.folder_listing(_visible(spark, sf_dir)).select("repo", "folder", F.col("n").cast("long"), "entry")


@register("requirements_deps", f"""WITH {FILES_CTE}, {VISIBLE_SQL},
l AS (SELECT path, unnest(range(0, len(string_split(text, chr(10))))) AS pos,
             unnest(string_split(text, chr(10))) AS line FROM v WHERE ends_with(path, 'requirements.txt')),
t AS (SELECT path, pos, trim(line) AS t FROM l),
d AS (SELECT path, pos, trim(regexp_split_to_array(t, '[=<>!~]')[1]) AS dep FROM t
      WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '-')),
n AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos) AS n, dep FROM d WHERE dep <> '')
SELECT * FROM n WHERE n <= 10""")
def requirements_deps(spark, sf_dir):
    """requirements.txt dependency names, first 10 per file."""
    f = _visible(spark, sf_dir).where(F.col("path").endswith("requirements.txt"))
    return inv.requirements(f)


@register("package_deps", f"""WITH {FILES_CTE}, {VISIBLE_SQL},
k AS (SELECT path, json_keys(json_extract(text, '$.dependencies')) AS ks FROM v WHERE ends_with(path, 'package.json'))
SELECT path, unnest(range(1, len(ks[1:10]) + 1)) AS n, unnest(ks[1:10]) AS dep FROM k""")
def package_deps(spark, sf_dir):
    """package.json dependency names, first 10 per file."""
    f = _visible(spark, sf_dir).where(F.col("path").endswith("package.json"))
    return inv.package_deps(f).select("path", F.col("n").cast("long"), "dep")
