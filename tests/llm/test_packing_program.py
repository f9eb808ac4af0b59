"""The configuration program runs where best fit alone reaches the bound, and prices every length."""

import numpy as np

from opslens.llm import packing


def test_program_runs_on_a_tie(monkeypatch):
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 256, 1200), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    assert packing.rounded(histogram, 512, None)[1] == -(-int((lengths * counts).sum()) // 512)
    priced = []
    solve = packing.best_configuration
    monkeypatch.setattr(packing, "best_configuration", lambda own, *a: priced.append(len(own)) or solve(own, *a))
    stretches, n = packing.plan(histogram, 512)
    assert n == packing.rounded(histogram, 512, None)[1]
    assert max(priced) == len(lengths) > 160  # no cut to some lengths
    assert stretches != packing.rounded(histogram, 512, None)[0]


def test_copies_are_bounded():
    found = packing.best_configuration(np.array([9, 7, 3]), np.array([0.9, 0.7, 0.3]), np.array([1, 5, 2]), 43)
    assert sum(x * k for x, k in found.items()) == 43 or sum(found.values()) == 8
    assert all(k <= {9: 1, 7: 5, 3: 2}[x] for x, k in found.items())
