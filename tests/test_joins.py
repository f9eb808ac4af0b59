"""As-of join, threshold ladders, block-max search, panes, sketches and files as rows against plain loops."""

import datetime as dt
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opslens.functions.text import KEYWORD_CAP, STOPWORDS
from opslens.operators import alerts as al
from opslens.operators import textsearch as ts
from opslens.operators.ordered import asof_join
from opslens.sinks import rowfiles

T0 = dt.datetime(2024, 1, 1)


def test_asof_join(spark):
    rng = random.Random(1)

    def at():
        return rng.choice([None, *[T0 + dt.timedelta(seconds=rng.randrange(300)) for _ in range(20)]])

    left = [(rng.choice(["hot", "hot", "a", None]), at(), i) for i in range(400)]
    right = [(rng.choice(["hot", "hot", "a", None]), at(), i, f"c{i}") for i in range(300)]
    got = asof_join(spark.createDataFrame(left, "k string, t timestamp_ntz, i long"),
                    spark.createDataFrame(right, "k string, t timestamp_ntz, o long, c string"), ["k"], "t", ["o"], ["c"])
    got = {(r.k, r.i): r.asof.c if r.asof else None for r in got.collect()}
    assert len(got) == 400
    for k, t, i in left:
        earlier = [r for r in right if r[0] == k and t is not None and r[1] is not None and r[1] < t]
        assert got[k, i] == (max(earlier, key=lambda r: (r[1], r[2]))[3] if earlier else None)


def test_threshold_ladders(spark):
    rng = random.Random(2)
    points = [(rng.choice(["a", "b", "c", None]), T0 + dt.timedelta(seconds=i), rng.choice([None, float("nan"), *map(float, range(12))])) for i in range(300)]
    rules = [(rng.choice(["a", "b", "d"]), f"r{j}", rng.choice([None, 3.0, *map(float, range(0, 14, 2))]), "warning") for j in range(40)]
    p = spark.createDataFrame(points, "key string, ts timestamp_ntz, value double")
    r = spark.createDataFrame(rules, "key string, name string, threshold double, severity string")

    def above(v, limit):  # NaN is above every number, as Spark has it
        return v is not None and limit is not None and (v > limit or v != v)

    pairs = sorted((t, n) for k, t, v in points for q, n, limit, _ in rules if k == q and above(v, limit))
    assert sorted((x.ts, x.name) for x in al.evaluate_rules(p, r).collect()) == pairs
    got = {x.name: (x.breaches, x.first_ts, x.last_ts) for x in al.breach_summary(p, r).collect()}
    want = {n: (len(own := [t for t, m in pairs if m == n]), min(own), max(own)) for n in {n for _, n in pairs}}
    assert got == want


def scores(docs, query):
    low = query.lower()
    kws = list(dict.fromkeys(w for w in re.findall(r"\w+", low) if len(w) > 3 and w not in STOPWORDS))[:KEYWORD_CAP]
    out = [(i, sum(t.lower().count(k) for k in kws) + (10 if low in t.lower() else 0)) for i, t in docs]
    return sorted(((i, s) for i, s in out if s > 0), key=lambda x: (-x[1], x[0]))


def test_search_scores_few_documents(spark):
    rng = random.Random(3)
    words = ["disk", "error", "network", "diskfull", "the", "of", "is", "latency", "spike", "cpu", "render", "queue"]
    # most documents have one of the words at most, a few have many
    docs = [(i, " ".join([f"filler{rng.randrange(300)}", *rng.choices(words, k=rng.random() < 0.3 if i % 200 else 20)])) for i in range(6000)]
    docs[7] = (7, "network error " * 9 + "the disk is full")
    docs[900] = (900, "disk " * 30)
    queries = [(1, "disk error"), (2, "The disk is full"), (3, "latency spike of the render queue"), (4, "is"), (5, "nothing here"),
               (6, ""), (7, "the of is"), (8, "Network")]
    report = {}
    found = ts.search(spark.createDataFrame(docs, "doc_id long, text string"),
                      spark.createDataFrame(queries, "item_id long, text string"), limit=4, block_docs=16, report=report)
    got = {}
    for r in found.orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
    for q, text in queries:
        if text:  # every document contains the empty text
            assert got.get(q, []) == scores(docs, text)[:4], text
    # of three words and more few documents are scored; a short query's phrase can be wherever its longest
    # word is, and "is" ties all its documents, which go by id
    counts = {r.item_id: r["count"] for r in report["scored"].groupBy("item_id").count().collect()}
    matching = {q: len(scores(docs, t)) for q, t in queries if t}
    assert counts[2] < matching[2] / 2 and counts[3] < matching[3] / 4 and counts[1] < matching[1], (counts, matching)


def test_search_writes_only_what_queries_look_up(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(200)) + (" ononon onon Onon" if i % 50 == 0 else "")) for i in range(2000)]
    docs[50] = (50, docs[50][1] + " onon thon")
    query = "onon thon"
    folder = Path(spark.conf.get("spark.checkpoint.dir"), "tables")
    before = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    found = ts.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, query)], "item_id long, text string"))
    assert [(r.doc_id, r.score) for r in found.orderBy("rank").collect()] == scores(docs, query)[:5]
    written = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) - before
    assert written < sum(len(t) for _, t in docs) / 10


def test_contains_join_in_slices(spark):
    rng = random.Random(9)
    texts = [None, "", *["".join(rng.choice("abcé") for _ in range(rng.randint(0, 12))) for _ in range(100)]]
    pats = [None, "", *["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(50)]]
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, s string")
    p = spark.createDataFrame(list(enumerate(pats)), "pid int, q string")
    want = {(i, j) for i, x in enumerate(texts) for j, q in enumerate(pats) if x is not None and q is not None and q in x}
    for limit in (20, 10_000):
        assert {(r.tid, r.pid) for r in ts.contains_join(t, "s", p, "q", limit=limit).collect()} == want


def test_sections_by_one_expression(spark):
    text = "# T\n## Action Items x\n- a\n## Action Items\n- b\n\n## Other\n- c\n## Action Items\n- d"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "## Action Items")], "doc_id long, text string")
    assert [(r.pos, r.line) for r in ts.section(docs, ["## Action Items"]).orderBy("pos").collect()] == [(2, "- a"), (4, "- b"), (5, "")]


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("m"), (F.col("id") % 40).alias("day"), F.sin("id").alias("v"))
    kept = al.quantile_sketches(df, ["m", "day"], "v")
    exact = {r.m: r for r in al.exact_quantiles(df.where("day < 20"), ["m"], "v", [0.5, 0.99]).collect()}
    for r in al.sketch_quantiles(kept.where("day < 20"), ["m"], [0.5, 0.99]).collect():
        for p in ("p50", "p99"):
            own = df.where((F.col("day") < 20) & (F.col("m") == r.m))
            rank = own.where(F.col("v") <= r[p]).count() / own.count()
            assert abs(rank - int(p[1:]) / 100) < 0.02 and exact[r.m][p] is not None


def test_files_as_rows(spark, tmp_path):
    rows = [("a/b/one.txt", b"1"), ("two.bin", b"\x00\xff"), ("a/empty", b""), ("a/none", None), ("a/b/one.md", b"x" * 100_000)]
    df = spark.createDataFrame(rows, "path string, content binary")
    rowfiles.write_files(df, str(tmp_path / "t"))
    rowfiles.write_files(df, str(tmp_path / "t"))  # again: nothing changes
    got = {r.path: r.length for r in rowfiles.list_files(spark, str(tmp_path / "t")).collect()}
    assert got == {p: len(c or b"") for p, c in rows}
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "t")).where("length > 0")
    assert {bytes(r.content) for r in read.collect()} == {b"1", b"\x00\xff", b"x" * 100_000}
    with pytest.raises(Exception, match="not a path inside"):
        rowfiles.write_files(spark.createDataFrame([("../x", b"")], "path string, content binary"), str(tmp_path / "t"))
