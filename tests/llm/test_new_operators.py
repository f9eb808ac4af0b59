"""Importance resampling, packing along a curve and spelling variants against brute-force versions, with
nulls, empty and very long texts, ties, repeated rows, an empty table and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslens.llm import curve, importance, spelling
from opslens.llm.queries import tokenizer
from opslens.llm.wordbytes import WordCutter, crcs, joined_crc

SF = "/root/testdata/sf0.001"
CLASHING = ("words", "n", "key", "score", "rank", "row", "down", "late", "bucket", "cell", "part", "salt", "word")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    long_word = "x" * 300 + "é" * 200
    return real + [(900, None), (901, ""), (902, " \n\t 5 "), (None, "a row without an id " * 9), (None, None),
                   (903, real[0][1]), (904, real[0][1]), (904, real[0][1]), (905, f"{long_word} and {long_word} {long_word}x " * 5),
                   (906, "ÀÉ× ÷ÿ Ünïcödé ÜNÏCÖDÉ naïveté 日本語 \x00 x y " * 4), (907, real[3][1] * 40), (908, "word " * 5000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *["z"] * len(CLASHING)) for i, t in rows], schema).repartition(5)


def key(row):
    return [(x is None, str(x)) for x in row]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_words_and_joined_checksums():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcABC019 é日,\n\x00ÿß") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    found = WordCutter(importance.FOLD).cut(pa.array(texts)[7:290])
    for i, text in enumerate(texts[7:290]):
        own = [found.distinct[c].decode() for c in found.codes[found.offsets[i]:found.offsets[i + 1]]]
        assert own == words_of(text)
    heads, tails = [rng.randbytes(rng.randint(0, 50)) for _ in range(500)], [rng.randbytes(rng.randint(0, 255)) for _ in range(500)]
    both = joined_crc(crcs(heads), crcs(tails), np.array(list(map(len, tails))))
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]


def resampled(rows, target, percent, least, buckets=importance.BUCKETS):
    def feats(text):
        ws = words_of(text)
        return [zlib.crc32(g.encode()) % buckets for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(feats(text))
    for text in target:
        t.update(feats(text))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (ns + buckets) / ((s[k] + 1) * (nt + buckets)))) for k in range(buckets)]
    out = []
    for i, text in rows:
        f = feats(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(words_of(text))])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[:percent * len(drawn) // 100], 1):
        r[4] = rank
    return out


@pytest.mark.parametrize("percent,least", [(25, 20), (100, 0), (1, 20), (60, 1)])
def test_importance_resampling(spark, rows, docs, percent, least):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, items, percent, least).collect()
    # rows equal in id and score can change places
    want = resampled(rows, target, percent, least)
    assert sorted((tuple(r) for r in got), key=key) == sorted(map(tuple, want), key=key)


def test_cutoff_by_many_brackets(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, i, 5]), 30, 59, 0, rng.choice([7, 7, 7, rng.randint(-50, 50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    order = sorted(((-r[4], r[0] if r[0] is not None else 1 << 63) for r in rows))
    for percent in (1, 33, 50, 99):
        got = importance.draw(df, percent, sketch=20, limit=3).where("rank is not null").orderBy("rank").collect()
        assert [r.rank for r in got] == list(range(1, 30 * percent + 1))
        assert [(-r.score, r.doc_id if r.doc_id is not None else 1 << 63) for r in got] == order[:30 * percent]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = curve.hilbert(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("capacity", [2048, 100])
def test_curve_packing(rows, docs, capacity):
    from tokenizers import Tokenizer
    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = curve.pack_documents(docs, path, capacity=capacity, with_ids=True).collect()
    want = Counter((i, *library.encode(t or "", add_special_tokens=False).ids, 1) for i, t in rows)
    sequences = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1]
        assert ends[-1] == capacity or ends[-1] & (ends[-1] - 1) == 0  # no padding anywhere
    total = sum(len(d) - 1 for d in want.elements())
    assert len(sequences) <= total // capacity + bin(total % capacity).count("1")
    # pieces of one document in order, put together again: along the whole curve documents stand one behind the other
    pieces = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    found, own = Counter(), []
    for r in pieces:
        assert r.start == len(own)
        own += r.ids
        if len(own) == r.doc_tokens:
            found[(r.doc_id, *own)] += 1
            own = []
    assert found == want and not own


def test_similar_documents_are_neighbours(spark):
    rng = random.Random(3)
    topics = [[f"w{k}x{j}" for j in range(60)] for k in range(4)]
    rows = [(i, " ".join(rng.choices(topics[i % 4], k=300))) for i in range(200)]
    got = curve.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("byte_bpe_50k.json")).collect()
    order = list(dict.fromkeys(r.doc_id % 4 for r in got)), [r.doc_id % 4 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a != b for a, b in zip(order[1], order[1][1:], strict=False)) < 40  # by chance 150


def test_tail_needs_no_padding():
    for total in range(300):
        edges = curve.tail_edges(total, 64)
        assert edges[0] == total // 64 * 64 and edges[-1] == total
        assert all((b - a) & (b - a - 1) == 0 for a, b in zip(edges, edges[1:], strict=False))


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(rows, least_letters, ratio):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += len(run) >= least_letters
    n = {w: c for w, c in n.items() if c >= 2}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    form, out = {}, []
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out.append([w, form[w], None, n[w], len(found), n[best] if form[w] else None])
    for r in out:
        r[2] = r[0]
        while form[r[2]]:
            r[2] = form[r[2]]
    return out


@pytest.mark.parametrize("letters,ratio,sizes", [(7, 10, {}), (3, 2, {"sample": 40, "cell": 8, "group": 30}), (1, 10, {"sample": 9, "cell": 1, "group": 7})])
def test_spelling_variants(rows, docs, letters, ratio, sizes):
    from opslens.llm.common import settle
    words = settle(spelling.vocabulary(docs, least_letters=letters), "t-words")
    got = spelling.grouped(words, ratio, **sizes).collect()
    want = spelled(rows, letters, ratio)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len(want) > 100


def test_roots_follow_long_chains(spark):
    words = [("a" * 8 + "b" * i, 10 ** i) for i in range(9)]
    got = spelling.grouped(spark.createDataFrame(words, "word string, n long"), 10).collect()
    assert {r.root for r in got} == {words[-1][0]} and len(got) == 9


def test_box_pruning_loses_no_word():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(9)) for _ in range(700)})
    longer = sorted({w[:k] + rng.choice("abcdé") + w[k:] for w in words for k in (rng.randrange(10),)})
    for points, more in ((words, 0), (longer, 1)):
        got = {(words[i], points[j]) for a, b in spelling.near_pairs(words, points, more) for i, j in zip(a, b, strict=True)}
        assert got == {(w, p) for w in words for p in points if near(w, p)}


def test_empty_tables(docs):
    none = docs.limit(0)
    assert importance.resample(none, none).count() == 0
    assert importance.resample(docs, none).where("rank is not null").count() > 0
    assert curve.pack_documents(none, tokenizer("byte_bpe_50k.json")).count() == 0
    assert spelling.variants(none).count() == 0


def test_nothing_is_drawn(docs):
    few = docs.where(F.col("doc_id") == 901)
    assert [tuple(r)[:5] for r in importance.resample(few, few).collect()] == [(901, 0, 0, r, None) for r in
                                                                             [importance.resample(few, few).first().score]]
