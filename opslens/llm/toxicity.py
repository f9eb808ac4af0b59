"""Toxicity by non-negative positive-unlabelled learning.

Two samples are drawn from the training fold: confirmed toxic documents, and
documents whose label is not looked at (unlabelled). A document is the set of
its words and word beginnings (hashed). Features that stand out in the
confirmed documents against the clean part of the unlabelled ones (their rate
there is what the class prior leaves of the unlabelled rate) are kept, and a
logistic classifier is trained in numpy with the risk

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

whose second term, the negative risk corrected by the class prior, is never
allowed below zero (the step then goes back along its gradient). The class prior is the
share of confirmed documents among the unlabelled sample's rows, copies counted once as in
both samples; no single row's label is used. Scores are shifted so that
the rejecting score stands where the same risk with the 0-1 loss is smallest.

Cases: a null or empty text has no features and the score of the intercept. Without
confirmed documents nothing is learned and every score is 0. Repeated rows
score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import fresh_name, held_out, id_text, settle
from opslens.llm.labelled import sample

POSITIVE = 4000      # confirmed documents in the sample, at most
UNLABELLED = 10_000  # unlabelled documents in the sample, at most
FEATURES = 4096      # kept features, at most
BEGINNINGS = (4, 5, 6)
STEPS = 400
STAND = 5.0          # standard errors by which a kept feature stands out
LIFT = 5.0           # times that it is as frequent in confirmed documents as in clean ones, at least
SPEED = 0.2          # of a step
REJECT = 0.7
MEMO_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def features_of(token: str) -> list[int]:
    """Hashed words and word beginnings inside a white-space separated token."""
    out = []
    for word in _WORD.findall(token.lower()):
        out.append(zlib.crc32(word.encode()))
        out.extend(zlib.crc32(b"^" + word[:k].encode()) for k in BEGINNINGS if len(word) > k)
    return out


class Model(NamedTuple):
    ids: np.ndarray      # kept features, sorted
    weights: np.ndarray
    intercept: float

    def scorer(self):
        weight = dict(zip(self.ids.tolist(), self.weights.tolist(), strict=True))
        memo: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            tokens = set(text.split())
            for t in tokens.difference(memo):
                memo[t] = tuple(x for x in features_of(t) if x in weight)
            found = {x for t in tokens for x in memo[t]}
            if len(memo) > MEMO_WORDS:
                memo.clear()
            if not len(self.ids):
                return 0.0
            return 1 / (1 + np.exp(-np.clip(self.intercept + sum(weight[x] for x in found), -30, 30)))
        return score


def train(positive: list, unlabelled: list, ids: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """``positive`` and ``unlabelled``: the kept features (among ``ids``, sorted) of each document."""
    n, m = len(positive), len(unlabelled)
    if not n or not m or not len(ids) or not 0 < prior < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    every = [np.asarray(x, np.int64) for x in [*positive, *unlabelled]]
    row = np.repeat(np.arange(n + m), [len(x) for x in every])
    col = np.searchsorted(ids, np.concatenate(every))
    theta = np.append(np.zeros(len(ids)), np.log(prior / (1 - prior)))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(row, theta[col], n + m) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        rest = loss_neg[n:].mean() - prior * loss_neg[:n].mean()
        g = np.zeros(n + m)  # derivative of the risk by z
        if rest >= 0:
            g[:n] = prior / n * ((s[:n] - 1) - s[:n])
            g[n:] = s[n:] / m
        else:  # the corrected negative risk is below zero: climb back
            g[:n] = prior / n * s[:n]
            g[n:] = -s[n:] / m
        grad = np.append(np.bincount(col, g[row], len(ids)) + 1e-5 * theta[:-1], g.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        theta = theta - SPEED * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    z = np.bincount(row, theta[col], n + m) + theta[-1]
    return Model(ids, theta[:-1], float(theta[-1]) - threshold(z[:n], z[n:], prior) + np.log(REJECT / (1 - REJECT)))


def threshold(confirmed: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Where the same corrected risk, with the 0-1 loss, is smallest: a third up the widest such stretch."""
    at = np.unique(np.concatenate((confirmed, unlabelled)))
    above_p = 1 - np.searchsorted(np.sort(confirmed), at[1:], "left") / len(confirmed)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), at[1:], "left") / len(unlabelled)
    if not len(above_p):
        return float(at[0]) + 1
    risk = prior * (1 - above_p) + np.maximum(0, above_u - prior * above_p)
    width = np.where(risk <= risk.min() + 1e-9, np.diff(at), 0)
    k = int(width.argmax())
    return float(at[k] + (at[k + 1] - at[k]) / 3)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", positive: int = POSITIVE,
        unlabelled: int = UNLABELLED, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    confirmed = sample(docs, labels, label, F.col("label") == 1, positive, id_col, text_col)
    others = sample(docs, labels, label, F.lit(True), unlabelled, id_col, text_col)

    @F.pandas_udf("array<long>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({x for w in set(t.split()) for x in features_of(w)}) for t in texts])

    both = confirmed.withColumn("kind", F.lit(1)).unionByName(others.withColumn("kind", F.lit(0)))
    rows = both.select("kind", "label", hashed("text").alias("ids"))
    # copies count once: documents of a kind with the same features, by a hash of the whole set
    rows = settle(rows.groupBy("kind", F.xxhash64("ids").alias("same"))
                  .agg(F.min("ids").alias("ids"), F.avg("label").alias("toxic")), "features")
    sizes = {r["kind"]: r for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("toxic")).collect()}
    n, m = (sizes[k]["n"] if k in sizes else 0 for k in (1, 0))
    prior = sizes[0]["toxic"] if m else 0.0
    ids = np.array(sorted(r["id"] for r in standing_out(rows, n, m, features, prior).collect()), np.int64)
    wanted = F.array(*map(F.lit, ids.tolist())) if len(ids) else F.array().cast("array<bigint>")
    small = rows.select("kind", F.array_intersect("ids", wanted).alias("ids")).collect() if len(ids) else []
    return train(*[[r["ids"] for r in small if r["kind"] == k] for k in (1, 0)], ids, prior)


def standing_out(rows: DataFrame, n: int, m: int, features: int, prior: float) -> DataFrame:
    """Features that are more frequent in the ``n`` confirmed documents (kind 1) than in the ``m``
    unlabelled ones by enough standard errors, and ``LIFT`` times as frequent as in the clean ones
    among these, of which there are ``1 - prior``; at most ``features``, those that stand out most."""
    counts = rows.select("kind", F.explode("ids").alias("id")).groupBy("id").agg(
        F.sum("kind").alias("in_p"), F.sum(1 - F.col("kind")).alias("in_u"))
    n, m = max(n, 1), max(m, 1)
    p, u = F.col("in_p") / n, F.col("in_u") / m
    pooled = (F.col("in_p") + F.col("in_u")) / (n + m)
    stand = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m) + 1e-12)
    clean = (u - prior * p) / max(1 - prior, 1e-9)
    return (counts.filter((F.col("in_p") >= 3) & (p > LIFT * clean)).withColumn("stand", stand)
            .filter(F.col("stand") > STAND).orderBy(F.desc("stand"), "id").limit(features))


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for texts in parts:
            yield pd.Series([own(t) for t in texts], dtype="float64")

    return scores(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = id_text(docs, id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score")
                       ).withColumn("predicted", (F.col("score") >= reject).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, columns as given."""
    own = fresh_name(docs, "score")
    return docs.withColumn(own, score(model, F.col(text_col))).filter(F.col(own) < reject).drop(own)
