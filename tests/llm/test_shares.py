"""The toxicity classifier at toxic shares from low to high, and with a large group of clean copies."""

import random

import pytest

from opslens.llm import toxicity


@pytest.mark.parametrize("share,copies", [(0.05, 0), (0.2, 0), (0.4, 0), (0.13, 1 / 3), (0.13, 0.6)])
def test_toxic_share(spark, share, copies):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(rng.choices(letters, k=7)) for _ in range(3000)]
    bad = ["q" + "".join(rng.choices(letters, k=6)) for _ in range(12)]
    group = " ".join(rng.choices(common, k=80))
    rows = []
    for i in range(2400):
        if i < copies * 2400:
            rows.append((i, group, 0))
            continue
        words = rng.choices(common, k=80)
        toxic = i < (copies + share) * 2400
        if toxic:
            words[10:10] = rng.sample(bad, 5)
        elif rng.random() < 0.1:
            words.append(rng.choice(bad))  # one such word alone is not toxic
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert len(model.ids) >= len(bad)
    assert sum(toxic) > 0.9 * len(toxic)
    assert sum(clean) < 0.03 * len(clean)
