"""Paths the driver tables are too small to reach: the percentile bracket
path (groups larger than the sketch accuracy) and the n-gram contains join
against brute force on random strings."""

import random

import numpy as np
import pytest

from opslens.operators import alerts as al
from opslens.operators import textsearch as ts


@pytest.mark.parametrize("accuracy", [50, 100])
def test_exact_quantiles_bracket_path(spark, accuracy):
    rnd = random.Random(5)
    rows = [("g%d" % (i % 3), float(rnd.choice([rnd.gauss(0, 1), rnd.randint(0, 20), 3.0]))) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {r.g: r for r in al.exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    for g in ("g0", "g1", "g2"):
        vals = np.array(sorted(v for k, v in rows if k == g))
        for p in probs:
            want = float(np.quantile(vals, p))       # linear interpolation at p*(n-1)
            assert abs(getattr(got[g], f"p{round(p * 100):d}") - want) < 1e-9


def test_contains_join_matches_brute_force(spark):
    rnd = random.Random(9)
    alphabet = "abcab"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(120)]
    pats = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    t = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "tid int, txt string")
    p = spark.createDataFrame([(j, s) for j, s in enumerate(pats)], "pid int, pat string")
    got = {(r.tid, r.pid) for r in ts.contains_join(t, "txt", p, "pat").collect()}
    want = {(i, j) for i, s in enumerate(texts) for j, q in enumerate(pats) if q in s}
    assert got == want and len(want) > 0


def test_contains_join_with_keys(spark):
    t = spark.createDataFrame([("k1", "spotlar_oferta_gold"), ("k2", "spotlar_oferta_rose")], "k string, n string")
    p = spark.createDataFrame([("k1", "oferta_gold"), ("k2", "oferta_gold"), ("k2", "rose")], "k string, q string")
    got = sorted((r.k, r.q) for r in ts.contains_join(t, "n", p, "q", keys=["k"]).collect())
    assert got == [("k1", "oferta_gold"), ("k2", "rose")]
