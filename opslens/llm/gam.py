"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature (and each chosen pair) has a lookup table over its bins. Boosting
goes round the features: a shallow tree over one feature's bins is fitted to
the gradient and added to that feature's table, at a low rate; then the pairs
whose tables would take off most of what is left are boosted the same way with
trees that split both features. A score is the sum of table entries, found by
binning all rows of a batch at once.

The features are shares and lengths of a text's words, letters, marks, lines
and repeats. Null and empty texts have all features zero and are scored so.
Without labels of both kinds the score is 1 (nothing is rejected). Repeated
rows score alike.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import fresh_name, held_out, id_text
from opslens.llm.labelled import sample

SAMPLE = 12_000
BINS = 48
PAIR_BINS = 8
PAIRS = 12
ROUNDS = 60
PAIR_ROUNDS = 25
RATE = 0.2
KEEP = 0.5

FEATURES = ("log_words", "word_length", "distinct_words", "distinct_pairs", "same_as_last", "longest_run",
            "upper", "digits", "marks", "bars", "symbols", "exclaims", "marked_words", "lone_marks",
            "distinct_lines", "line_length", "top_word", "distinct_folded", "other_bytes")

_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])
_ODD = np.array([chr(b) in "#$%&*+<=>@[\\]^_{|}~" for b in range(256)])


def features(text: str) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n = len(words) or 1
    again = list(map(eq, words, words[1:]))
    run = best = 0
    if any(again):
        for same in again:
            run = run + 1 if same else 0
            best = max(best, run)
    distinct = set(words)
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 1
    lines = text.split("\n")
    letters = int(count[0x41:0x5B].sum() + count[0x61:0x7B].sum()) or 1
    ends = sum(w[-1] in "#$%&*+<=>@^_|~!" for w in distinct)
    lone = words.count("|")
    top = max(Counter(words).values(), default=0)
    return [float(np.log1p(len(words))), len(text) / n, len(distinct) / n, pairs / max(1, n - 1), sum(again) / n,
            float(best), count[0x41:0x5B].sum() / letters, count[0x30:0x3A].sum() / size, count[_MARK].sum() / size,
            count[0x7C] / n, count[_ODD].sum() / size, count[0x21] / n, ends / (len(distinct) or 1), lone / n,
            len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))), top / n,
            len({w.lower() for w in distinct}) / n, count[0x80:].sum() / size]


class Model(NamedTuple):
    cuts: list[np.ndarray]                   # bin bounds of each feature
    tables: list[np.ndarray]                 # one entry a bin
    coarse: list[np.ndarray]                 # bin -> coarse bin of pairs, for each feature
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.ones(len(rows))
        bins = [np.searchsorted(c, rows[:, f], "right") for f, c in enumerate(self.cuts)]
        total = np.full(len(rows), self.intercept)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 2.0) -> np.ndarray:
    """A shallow tree over ordered bins: the value added to each bin. ``grad`` and ``hess`` are sums by bin."""
    g, h = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    parts = [(0, len(grad))]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    while len(parts) < leaves:
        gains = []
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = worth(a, c) + worth(c, b) - worth(a, b)
                best = int(gain.argmax())
                gains.append((float(gain[best]), k, int(c[best])))
        if not gains or max(gains)[0] <= 1e-9:
            break
        _, k, c = max(gains)
        a, b = parts[k]
        parts[k:k + 1] = [(a, c), (c, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """One split of either feature, then one of the other in each half: values by cell, and the gain."""
    def worth(a, b):
        return a ** 2 / (b + ridge)

    best, gain = np.zeros_like(grad), 0.0
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        top_g, top_h = np.cumsum(g, 0), np.cumsum(h, 0)
        for c in range(1, len(g)):
            out, found = np.zeros_like(g), 0.0
            for rows, half_g, half_h in ((slice(0, c), top_g[c - 1], top_h[c - 1]),
                                         (slice(c, None), top_g[-1] - top_g[c - 1], top_h[-1] - top_h[c - 1])):
                left_g, left_h = np.cumsum(half_g)[:-1], np.cumsum(half_h)[:-1]
                all_g, all_h = half_g.sum(), half_h.sum()
                gains = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h)
                k = int(gains.argmax())
                out[rows, :k + 1] = left_g[k] / (left_h[k] + ridge)
                out[rows, k + 1:] = (all_g - left_g[k]) / (all_h - left_h[k] + ridge)
                found += gains[k]
            found -= worth(g.sum(), h.sum())
            if found > gain:
                best, gain = (out.T if turned else out), float(found)
    return best, gain


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS,
          pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Cyclic boosting of feature tables, then of the tables of the best pairs."""
    if not 0 < labels.sum() < len(labels):
        return Model([], [], [], [], 0.0)
    wide = rows.shape[1]
    cuts = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS)) for f in range(wide)]
    bins = [np.searchsorted(c, rows[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    rate_up = labels.mean()
    intercept = float(np.log(rate_up / (1 - rate_up)))
    total = np.full(len(rows), intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(wide):
            g, h = slope()
            n = len(tables[f])
            step = rate * tree(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n))
            tables[f] += step
            total += step[bins[f]]
    coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in tables]
    cells = [coarse[f][bins[f]] for f in range(wide)]

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = slope()
        at = cells[f] * PAIR_BINS + cells[g]
        return tuple(np.bincount(at, x, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS) for x in (grad, hess))

    gains = sorted(((pair_tree(*sums(f, g))[1], f, g) for f, g in combinations(range(wide), 2)), reverse=True)
    chosen = [(f, g, np.zeros((PAIR_BINS, PAIR_BINS))) for _, f, g in gains[:pairs]]
    for _ in range(pair_rounds):
        for f, g, table in chosen:
            step = rate * pair_tree(*sums(f, g))[0]
            table += step
            total += step[cells[f], cells[g]]
    return Model(cuts, tables, coarse, chosen, intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    got = (sample(docs, labels, label, F.lit(True), limit, id_col, text_col)
           .select("label", measured("text").alias("x")).toPandas())
    if not len(got):
        return Model([], [], [], [], 0.0)
    return train(np.array(got["x"].tolist()), got["label"].to_numpy(float))


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([features(t) for t in texts])))

    return scores(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = id_text(docs, id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score")
                       ).withColumn("predicted", (F.col("score") >= keep).cast("int"))


def drop_low_quality(docs: DataFrame, model: Model, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, columns as given."""
    own = fresh_name(docs, "score")
    return docs.withColumn(own, score(model, F.col(text_col))).filter(F.col(own) >= keep).drop(own)
