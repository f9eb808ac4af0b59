"""Every training-data operator against a brute-force version, with nulls, empty and long
texts, ties, repeated rows, an empty table and extra columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opslens.llm import (bpe_count, decontaminate, gam, license_scan, packing, simhash, token_store, toxicity, warc,
                         winnow)
from opslens.llm.common import open_fs, order_bucket, shared_path
from opslens.llm.queries import ORACLES, QUERIES, tokenizer
from opslens.llm.tokens import WordEncoder, slices

SF = "/root/testdata/sf0.001"
CLASHING = ("words", "hits", "score", "fp", "key", "label", "bucket", "next", "packed", "own", "edited", "held_out",
            "__score", "__hits", "n", "i")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folder of small tables: real rows and every odd case; documents carry extra columns."""
    at = tmp_path_factory.mktemp("llm")
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    words = real[3][1].split()
    odd = [(900, None), (901, ""), (902, "  \n\t "), (None, "a row without an id"), (None, None), (903, real[0][1]),
           (904, real[0][1]), (904, real[0][1]), (905, " ".join(words * 60)), (906, "Released under the MIT License. " * 3),
           (907, "Apache License, Version 2.0 and CC BY-NC 4.0; GNU General Public License, version 3."),
           (908, f"before {passage} after"), (909, "é日本語 😀 <|endoftext|> ½ x\u0000y   z"), (910, "one"),
           (911, "you stupid idiot, worthless scum " * 4), (912, "Kelvin K under the mİt license under the MIT license"),
           (913, " ".join(real[1][1].split()[:-1])), (914, "x" * 40_000)]
    rows = [(i, t, *([None] * len(CLASHING))) for i, t in real + odd]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    docs.limit(0).write.parquet(f"{at}/none.parquet")
    labels = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i, _ in real] + [(None, 1, 1), (911, None, 1), (900, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(1, passage), (2, passage), (None, passage), (3, None), (4, ""), (5, "Released Under"), (6, real[2][1][:300])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    pages = [(1, "http://a.example/x y", "<title>T &amp; U</title><p>Hi<br>there <a href='/z'>l</a></p>"), (1, None, None),
             (None, "http://b.example/\nq", ""), (2, "http://[bad", "<a href='http://[x'>b</a><script>no</script>é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def docs_of(spark, tables, name="documents"):
    return spark.read.parquet(f"{tables}/{name}.parquet")


def rows_of(spark, tables):
    return [(r.doc_id, r.text or "") for r in docs_of(spark, tables).select("doc_id", "text").collect()]


def same(got, want):
    def key(row):
        return [(x is None, str(x)) for x in row]
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_licence_scan(spark, tables):
    docs = docs_of(spark, tables)
    got = license_scan.summary(license_scan.scan(docs, license_scan.fit(docs))).collect()
    upper = {c: c + 32 for c in range(65, 91)}
    want = []
    for i, t in rows_of(spark, tables):
        ws = re.findall(license_scan.WORD, t.translate(upper))
        places = [(s, tpl) for tpl in license_scan.TEMPLATES for k in [tpl.key.split()]
                  for s in range(len(ws) - len(k) + 1) if ws[s:s + len(k)] == k]
        base = [s for s, tpl in places if tpl.base]
        want.append((i, len(ws), len(base), min(base, default=None), max(base, default=None),
                     ",".join(sorted({tpl.label for _, tpl in places if tpl.base})), ",".join(sorted({tpl.label for _, tpl in places}))))
    same([r[:7] for r in got], want)
    by_id = {r.doc_id: r for r in got}
    assert by_id[906].n_base == 3 and by_id[907].labels == "apache-2,cc-by-nc,gpl-3" and by_id[912].n_base == 1
    assert by_id[900].score == 0 and 0 < by_id[906].score <= 1


def test_token_counts_equal_the_library(spark, tables):
    import sentencepiece
    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = bpe_count.count_tokens(docs_of(spark, tables), path, limit=500).collect()
    want = [(i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 500) for i, t in rows_of(spark, tables)]
    same(got, want)
    counter, rng = bpe_count.MergeCounter(path), random.Random(2)
    texts = ["".join(rng.choice(" \n\t aAbé'’.,!0 1<|>s日▁\r\x1c　µ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    import pyarrow as pa
    assert counter.counts(pa.array(texts)).tolist() == [len(model.encode(t)) for t in texts]


@pytest.mark.parametrize("name,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_equals_the_library(name, blank):
    import pyarrow as pa
    from tokenizers import Tokenizer
    rng = random.Random(1)
    texts = ["", " ", "\n", "x<|endoftext|>, y  <|endoftext|>\nz", "don't  it's 12.5 µ ª ÿ Foo,\nBar. baz\n", "ab" * 2000]
    for alphabet in (" \n\t aAbé'’.,!0 1<|>s日́▁\r\x1c\x85　µÀ", "ab cÉ,é.N\n "):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    whole, own = Tokenizer.from_file(tokenizer(name)), WordEncoder(tokenizer(name), blank)
    got = []
    for _, part in slices(pa.array(texts), 4000):
        ids, at = own.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def winnowed(text, k=winnow.K, w=winnow.WINDOW):
    import xxhash
    ws = [x for x in re.split("[\x20\x09-\x0D]+", text) if x]
    grams = []
    for i in range(max(1, len(ws) - k + 1) if ws else 0):
        h = 42
        for x in ws[i:i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        grams.append(h >> 33)
    out = {}
    for j in range(max(1, len(grams) - w + 1) if grams else 0):
        part = grams[j:j + w]
        out[min(part), max(i for i, x in enumerate(part) if x == min(part)) + j] = None
    return list(out)


def test_winnowing(spark, tables):
    docs = docs_of(spark, tables)
    got = {(r.doc_id, i) for r in winnow.fingerprint(docs).collect() for i in [tuple((p.hash, p.pos) for p in r.fingerprint)]}
    rows = sorted(rows_of(spark, tables), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert got == {(i, tuple(winnowed(t))) for i, t in rows}
    want = []

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 2
        edited = t[:len(t) - cut] + after[:cut]
        own, new, nxt = ([h for h, _ in winnowed(x)] for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:08x}" for h in own),
                     "".join(f"{h:08x}" for h in new), near(set(own), set(new)), near(set(own), set(nxt))))
    same(winnow.edited_pairs(docs).collect(), want)


def test_winnowing_guarantee():
    rng = random.Random(4)
    shared = [f"w{rng.randint(0, 9)}" for _ in range(winnow.K + winnow.WINDOW - 1)]
    for _ in range(50):
        a, b = ([f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30))] for _ in range(2))
        one, two = (winnowed(" ".join(x + shared + x[::-1])) for x in (a, b))
        assert {h for h, _ in one} & {h for h, _ in two}


def test_order_buckets_ascend(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("doc_id"))
    got = df.withColumn("b", order_bucket(df)).orderBy("doc_id").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and len({r.b for r in got}) > 10


def test_token_files(spark, tables):
    from tokenizers import Tokenizer
    path = tokenizer("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, []
    rows = sorted(rows_of(spark, tables), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = shared_path(spark, "test-ids")
    manifest = token_store.write(docs_of(spark, tables), path, 2, folder)
    same(token_store.read(manifest, digest=True).collect(), want)
    some = token_store.read(manifest, doc_ids=[905, 910]).collect()
    assert sorted(r.doc_id for r in some) == [905, 910] and all(len(r.ids) == r.n_tokens for r in some)
    # standard frames: any zstandard reader can read a file's data frames in a row
    import zstandard
    first = manifest.orderBy("bucket").first().path
    fs, at = open_fs(first)
    raw = fs.open_input_file(at).read()
    reader = token_store.FrameReader(first)
    joined = b"".join(x for _, _, x in reader.documents())
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == joined
    broken = bytearray(raw)
    broken[-23] ^= 1  # the last document's checksum in the seek table
    with fs.open_output_stream(at + ".broken", compression=None) as out:
        out.write(bytes(broken))
    with pytest.raises(ValueError):
        list(token_store.FrameReader(first + ".broken").documents())


@pytest.mark.parametrize("limit", [decontaminate.SLICE_WORDS, 60])
def test_decontamination(spark, tables, limit):
    docs, bench = docs_of(spark, tables), docs_of(spark, tables, "benchmark")
    got = decontaminate.with_hits(docs, bench, "found", limit=limit).select(
        "doc_id", "found.n_words", decontaminate.n_hit("found").alias("h"), F.array_join("found.items", ",").alias("i")).collect()
    upper = {c: c + 32 for c in range(65, 91)}

    def cut(t):
        return re.findall(license_scan.WORD, (t or "").translate(upper))

    items = [("" if r.item_id is None else str(r.item_id), cut(r.text)) for r in bench.collect()]
    want = []
    for i, t in rows_of(spark, tables):
        ws, hit, named = cut(t), set(), set()
        for name, w in items:
            n = min(10, len(w))
            grams = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if n else set()
            for s in range(len(ws) - n + 1) if n else ():
                if tuple(ws[s:s + n]) in grams:
                    hit.update(range(s, s + n))
                    named.add(name)
        want.append((i, len(ws), len(hit), ",".join(sorted(named))))
    same(got, want)
    assert any(r.h for r in got)


def test_decontamination_removes(spark, tables):
    docs, bench = docs_of(spark, tables), docs_of(spark, tables, "benchmark")
    hit = {r.doc_id for r in decontaminate.report(docs, bench).collect() if r.contaminated}
    kept = decontaminate.drop_documents(docs, bench)
    assert 908 in hit and not hit & {r.doc_id for r in kept.collect() if r.doc_id is not None} and kept.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.drop_spans(docs, bench).collect()}
    assert cut[908] == "before after" and cut[910] == "one" and cut[900] is None
    none = decontaminate.report(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


def brute_components(prints, radius):
    parent = {f: f for f in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = list(prints)
    for k, a in enumerate(every):
        for b in every[:k]:
            if bin(a ^ b).count("1") <= radius:
                parent[top(a)] = top(b)
    return {f: top(f) for f in prints}


def test_simhash(spark, tables):
    rows = rows_of(spark, tables)
    got = simhash.near_duplicates(docs_of(spark, tables)).select("doc_id", simhash.hex16("fp"), "component_id").collect()
    prints = {simhash.simhash(t) for _, t in rows}
    class_of = brute_components(prints, simhash.RADIUS)
    first = {}
    for i, t in rows:
        c = class_of[simhash.simhash(t)]
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    same(got, [(i, f"{simhash.simhash(t):016x}", first[class_of[simhash.simhash(t)]]) for i, t in rows])


def test_simhash_of_a_text():
    import xxhash
    text = "The the THE quick É é  brown\nfox the quick É é"
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(len(ws) - 3)]
    assert simhash.simhash(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.simhash(" \n") == 0 and simhash.simhash("a b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("split", [simhash.SPLIT, 8])
def test_links_of_near_fingerprints(spark, split):
    rng = random.Random(3)
    prints = {0}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            prints.add(y)
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    labels = {r.node: r.label for r in simhash.components(simhash.links(df, split=split)).collect()}
    want = brute_components(prints, simhash.RADIUS)
    got = {}
    for x in prints:
        got.setdefault(labels.get(simhash._signed(x), simhash._signed(x)), set()).add(x)
    by = {}
    for x, c in want.items():
        by.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_packing(spark, tables):
    from tokenizers import Tokenizer
    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs_of(spark, tables), path, capacity=512).collect()
    want = []
    for i, t in rows_of(spark, tables):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        cuts = sorted({0, *range(len(ids) % 512, len(ids), 512)} - {len(ids)})
        for k, a in enumerate(cuts):
            b = cuts[k + 1] if k + 1 < len(cuts) else len(ids)
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    same([r[:5] for r in got], want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(np.exp(rng.normal(5 + seed / 2, 1, 4000)).astype(int), 1, 2048)
    sizes[: seed * 400] = 760
    lengths, counts = np.unique(sizes, return_counts=True)
    stretches, n = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    rooms = []
    for x in sorted(sizes.tolist(), reverse=True):  # plain best fit, one piece at a time
        k = min((r, j) for j, r in enumerate([*rooms, 2048]) if r >= x)[1]
        rooms = rooms + [2048] if k == len(rooms) else rooms
        rooms[k] -= x
    assert -(-int(sizes.sum()) // 2048) <= n <= len(rooms)


def test_quality_model_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)  # only a pair tells
    model = gam.train(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    assert gam.train(x[:5], np.ones(5)).score(x[:2]).tolist() == [1.0, 1.0]


@pytest.mark.parametrize("op,column", [(gam, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, op, column, tables):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = op.fit(docs, labels)
    rows = op.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[column] for r in rows) / len(rows)
    assert right > (0.97 if column == "quality" else 0.92)
    assert not any(r.predicted == 1 and r[column] == 0 for r in rows) or column == "quality"
    odd = op.classify(docs_of(spark, tables), model).collect()
    assert len(odd) == docs_of(spark, tables).count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id: r.held_out for r in odd}[910] == (zlib.crc32(b"910") % 3 == 1)
    untaught = op.fit(docs, labels.limit(0))
    kept = op.drop_toxic(docs, untaught) if op is toxicity else op.drop_low_quality(docs, untaught)
    assert kept.count() == docs.count()


def test_toxic_words_decide(spark, tables):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.classify(docs_of(spark, tables), toxicity.fit(docs, labels)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[911].predicted == 1 and by_id[910].predicted == 0 and by_id[901].predicted == 0


def test_warc_derivatives(spark, tables):
    pages = docs_of(spark, tables, "pages")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 2 * pages.count() and {r.record_type for r in rows} == {"metadata", "conversion"}
    for r in rows:
        assert r.block_digest == warc.sha1(r.content.encode()) and r.content_length == len(r.content.encode())
    source = {}
    for r in pages.collect():
        fields, block = warc.parse(warc.response("" if r.page_id is None else str(r.page_id), r.url, r.html))
        source[fields["WARC-Record-ID"]] = (fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"])
    assert {r.refers_to: (r.target_uri, r.source_payload_digest) for r in rows} == source
    texts = {r.target_uri: r.content for r in rows if r.record_type == "conversion"}
    assert texts["http://a.example/x%20y"] == "T & U\nHi\nthere l"
    bad = spark.createDataFrame([("k", bytearray(b"nonsense")), ("n", None)], "key string, record binary")
    assert [r.record_type for r in warc.derive(bad).collect()] == ["invalid", "invalid"]


def test_warc_http_codings():
    import gzip
    body = gzip.compress("né".encode())
    chunked = b"".join(f"{len(x):x}\r\n".encode() + x + b"\r\n" for x in (body[:5], body[5:])) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    assert warc.parse_http(head + chunked)[2].decode() == "né"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, tables, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, tables)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    same([tuple(r) for r in got.collect()], want)


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tables):
    docs, trail = docs_of(spark, tables), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, tables)
        assert kept.columns == docs.columns
        path = shared_path(spark, "stage")
        kept.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        trail.append((name, before, docs))
    _, before, after = trail[2]
    prints = [(r.doc_id, simhash.simhash(r.text or "")) for r in before.collect()]
    class_of = brute_components({p for _, p in prints}, simhash.RADIUS)
    first = {}
    for i, p in prints:
        if i is not None:
            first[class_of[p]] = min(i, first.get(class_of[p], i))
    assert sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == sorted(first.values())
    last = corpus_pipeline.run(spark, tables)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
