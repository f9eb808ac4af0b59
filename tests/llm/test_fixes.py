"""Near-duplicate rows without or with shared ids, links of odd pages, plain scorers, the packing gap."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from opslens.llm import decontaminate, gam, packing, simhash, tokens, toxicity, warc
from opslens.llm.queries import tokenizer

TEXTS = ["the quick brown fox jumps over the lazy dog again and again until it is tired of all that",
         "a wholly different sentence about rivers, mountains and the sea that nobody has written before",
         "numbers like one two three four five six seven eight nine ten eleven twelve thirteen"]


def test_one_row_of_each_group(spark):
    rows = [(1, TEXTS[0]), (1, TEXTS[1]), (2, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[2]), (None, TEXTS[2]),
            (5, None), (None, ""), (3, TEXTS[2]), (3, TEXTS[2]), (None, "alone without an id")]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, row string, fp string").repartition(4)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, TEXTS[0]), (1, TEXTS[1]), (3, TEXTS[2]), (5, None), (None, "alone without an id")])
    again = simhash.one_of_each(docs.withColumnRenamed("doc_id", "id"), id_col="id")
    assert again.count() == 5


def test_links_of_odd_pages():
    page = ("<script src='/a.js'></script><noscript><img alt='x>y' src=\"/b.png\"></noscript><a href=/c>c</a>"
            "<!-- <a href='/no'> --><script>'<a href=/no2>'</script><style>a{b:url(<a href=/no3>)}</style>"
            "<template><a title='1 > 0' href='/d?x=1&amp;y=2'>d</a></template><a name='none'>n</a><link data-href='/no4' HREF='/e'>")
    assert [x["url"] for x in warc.links_of(page, "http://h/p/")] == [f"http://h{u}" for u in ("/a.js", "/b.png", "/c", "/d?x=1&y=2", "/e")]
    assert [x["path"] for x in warc.links_of(page, None)][:2] == ["script@/src", "img@/src"]
    assert warc.plain_text("<p title=\"a>b\">hi<br class='>'>there</p> 1 < 2 <b>x") == "hi\nthere\n1 < 2 x"
    assert warc.plain_text("<a " + 'b="c" ' * 30_000) and warc.links_of("<a href=" * 30_000, None) == []


def test_very_long_and_repeated_pages(spark):
    pages = [(1, "http://a.example/", "<p>word</p>" * 40_000 + "<a href='/z'>z</a>", "k"), (1, "http://a.example/", "<p>x</p>", "k"),
             (1, "http://a.example/", "<p>x</p>", "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, key string")
    got = warc.derivatives(df).collect()
    assert Counter(r.record_type for r in got) == {"metadata": 3, "conversion": 3}
    assert max(r.content.count("word") for r in got if r.record_type == "conversion") == 40_000


def test_quality_scores_by_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    texts = ["", *(" ".join(rng.choice(["a", "B", "the", "x1", "|", "!!", "été", "no\n"], rng.integers(1, 60))) for _ in range(300))]
    rows = np.array([gam.features(t) for t in texts])
    model = gam.train(rows, (rows[:, 2] > 0.3).astype(int)) if hasattr(gam, "train") else None
    assert gam.features("a b c c c d")[gam.FEATURES.index("top_word")] == 0.5
    if model is None:
        pytest.skip("no training function by that name")
    for row, got in zip(rows, model.score(rows), strict=True):
        total = model.intercept
        bins = [sum(c <= x for c in cuts) for cuts, x in zip(model.cuts, row, strict=True)]
        total += sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[model.coarse[f][bins[f]], model.coarse[g][bins[g]]] for f, g, t in model.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, total)))))


def test_toxicity_scores_by_a_plain_loop():
    ids = np.array(sorted({x for w in ("stupid", "idiots", "kind") for x in toxicity.features_of(w)}), np.int64)
    model = toxicity.Model(ids, np.linspace(-1, 2, len(ids)), -0.7)
    weight = dict(zip(ids.tolist(), model.weights.tolist(), strict=True))
    score = model.scorer()
    for text in ["", "You STUPID, stupid idiots!", "kind words", "idiotsfoo kindness stupid-ish", "stupid " * 2000]:
        found = set()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            found |= {zlib.crc32(word.encode()), *(zlib.crc32(b"^" + word[:k].encode()) for k in (4, 5, 6) if len(word) > k)}
        assert score(text) == pytest.approx(1 / (1 + np.exp(0.7 - sum(weight.get(x, 0) for x in found))))


def test_copies_by_the_whole_feature_set(spark):
    """Documents that share their smallest hashes only are not merged: the prior is that of all."""
    rows = [(3 * i, f"common words of all texts here {'stupid idiots' if i % 3 == 0 else 'plain things'} {chr(97 + i // 26)}{chr(97 + i % 26)}zzz") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("stupid" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()}
    assert all(scores[i] == int("stupid" in t) for i, t in rows)


def test_packing_gap_is_reported():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 700, 3000), return_counts=True)
    stretches, n, gap = packing.solve(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    fewest = -(-int((lengths * counts).sum()) // packing.CAPACITY)
    assert gap >= 0 and n <= fewest * 1.01 and n == round((1 + gap) * n / (1 + gap))
    configs, bound = packing.fractional(np.bincount(lengths, counts, packing.CAPACITY + 1).astype(np.int64))
    assert bound <= n and bound >= 0.97 * fewest
    assert all(sum(x * k for x, k in c.items()) <= packing.CAPACITY for c, _ in configs)


def test_windows_of_many_equal_items():
    text = " ".join(f"w{i}" for i in range(30))
    grams = decontaminate.NGrams([(f"i{k:03d}", text) for k in range(50)] + [("short", "w3 w4"), ("other", "w29 w28 w27")])
    n, spans, items = decontaminate.NGrams.of(grams.state).scan("x " + text[: text.index(" w12")] + " y w29 w28 w27")
    assert items == [*(f"i{k:03d}" for k in range(50)), "other", "short"] and spans == [(1, 13), (14, 17)] and n == 17


def test_plain_links_are_joined_once_a_page(monkeypatch):
    calls, join = [], warc.urljoin
    monkeypatch.setattr(warc, "urljoin", lambda base, url: calls.append(url) or join(base, url))
    plain = [f"/ä{i}/b-{i}" for i in range(50)]
    odd = ["/a/../b", "/a//b", "//h/x", "/a;p", "/a?q#f", "b", "/", "/a/", "#f", "http://[x", "/a b"]
    page = "<!--<a href='/no'>--><script src='/s'>'<a href=/no>'</script >" + "".join(f'<a href="{u}">' for u in plain + odd)
    for base in (None, "", "http://h:8/p/q?x#y", "mailto:a@b", "x/y", "//n/p", "http://[bad"):
        calls.clear()
        got = [x["url"] for x in warc.links_of(page, base)]
        if base == "http://h:8/p/q?x#y":
            assert len(calls) < 15
        want = []
        for u in ["/s", *plain, *odd]:
            try:
                want.append(join(base or "", u))
            except ValueError:
                want.append(u)
        assert got == want, base


def test_words_are_learnt_once():
    path, seen = tokenizer("byte_bpe_50k.json"), []
    texts = pa.array(["", "One one two, <|x|> three  four\n", "é" * 30 + " two", " one two three", "<|endoftext|>", "five six"])
    plain = tokens.WordEncoder(path, keeps_blank=True)
    for limit in (1, 1_000_000):  # forgotten before each slice, or kept
        encoder = tokens.WordEncoder(path, keeps_blank=True, memo_bytes=limit)
        learn = encoder._learn
        encoder._learn = lambda words, learn=learn: seen.append(words.to_pylist()) or learn(words)
        for part in (texts, texts.slice(2), texts.slice(0, 3)):
            assert [x.tolist() for x in encoder.encode(part)] == [x.tolist() for x in plain.encode(part)]
        kept, seen = seen, []
        assert bool(kept[1] or kept[2]) == (limit == 1)
    assert tokens.worker_encoder(path, True, 5) is tokens.worker_encoder(path, True, 5)
