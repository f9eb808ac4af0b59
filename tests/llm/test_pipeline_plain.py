"""The whole pipeline against a chain of plain loops over the same rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from opslens.llm import gam, simhash, toxicity
from opslens.llm.common import settle
from opslens.llm.queries import tokenizer
from tests.llm.test_operators import brute_components, docs_of, tables  # noqa: F401


def toxic_score(model, text):
    if not len(model.ids):
        return 0.0
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    found = set()
    for token in text.split():
        for word in re.findall(r"[^\W\d_]+", token.lower()):
            found |= {zlib.crc32(word.encode()), *(zlib.crc32(b"^" + word[:k].encode()) for k in (4, 5, 6) if len(word) > k)}
    return 1 / (1 + np.exp(-np.clip(model.intercept + sum(weight.get(x, 0) for x in found), -30, 30)))


def quality_score(model, text):
    if not model.tables:
        return 1.0
    row = gam.features(text)
    bins = [sum(c <= x for c in cuts) for cuts, x in zip(model.cuts, row, strict=True)]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    total += sum(t[model.coarse[f][bins[f]], model.coarse[g][bins[g]]] for f, g, t in model.pairs)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_pipeline_is_the_plain_chain(spark, tables):  # noqa: F811
    docs = docs_of(spark, tables)
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def stage(k, docs, want):
        out = settle(corpus_pipeline.STAGES[k][1](spark, docs, tables), "plain-stage")
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want), corpus_pipeline.STAGES[k][0]
        return out

    model = toxicity.fit(docs, labels)
    rows = [(i, t) for i, t in rows if toxic_score(model, t or "") < toxicity.REJECT]
    docs = stage(0, docs, rows)
    model = gam.fit(docs, labels)
    rows = [(i, t) for i, t in rows if quality_score(model, t or "") >= gam.KEEP]
    docs = stage(1, docs, rows)
    prints = [simhash.simhash(t or "") for _, t in rows]
    class_of = brute_components(set(prints), simhash.RADIUS)
    best = {}
    for (i, t), p in zip(rows, prints, strict=True):
        rank = (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        if class_of[p] not in best or rank < best[class_of[p]][0]:
            best[class_of[p]] = rank, (i, t)
    got = corpus_pipeline.STAGES[2][1](spark, docs, tables).collect()
    rows = [row for _, row in best.values()]
    # a null text is an empty one there: of equal ranks either may stay
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter((i, t or "") for i, t in rows)
    docs = settle(corpus_pipeline.STAGES[2][1](spark, docs, tables), "plain-stage")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    windows = set()
    for item in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        ws = words(item.text)
        n = min(10, len(ws))
        windows |= {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    rows = [(i, t) for i, t in rows for ws in (words(t),)
            if not any(tuple(ws[k:k + n]) in windows for n in sizes for k in range(len(ws) - n + 1))]
    docs = stage(3, docs, rows)
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = sorted({0, *range(len(ids) % 2048, len(ids), 2048)} - {len(ids)})
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
