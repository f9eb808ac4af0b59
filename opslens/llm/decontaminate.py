"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

An item's windows are its ``n`` consecutive words (all of them if it has
fewer). What is broadcast are numpy arrays: the items' words as codes, one
behind the other, and for each window its hash (sorted), its place among the
codes and its item; documents are scanned window by window (only windows all
of whose words some item has are looked up), every hash hit is verified word by
word at its place, and its span and items are kept.

The broadcast is bounded: a slice has at most ``SLICE_WORDS`` item words, or
one item. A word takes 20 bytes in the arrays and about 120 in the table of
words if it is a new one, so a slice takes at most 70 MB in a worker. A larger
benchmark is dealt into slices by item, and the documents are scanned once a
slice with the spans carried along, so the result is the same at any size.

Cases: a null or empty text, of a document or an item, has no words and no
windows. A null item id counts as the empty string. Repeated items or
documents count each for itself; a window that several items have names all.
With an empty benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import fresh_name, settle

N = 10
SLICE_WORDS = 500_000

# A-Z to a-z; digits, a-z and all bytes above 0x7F are word characters, the rest separate.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))
_FACTORS = np.random.default_rng(10).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class NGrams:
    """Windows of a set of items, ready for scanning."""

    def __init__(self, items: list[tuple[str, str]], n: int = N):
        self.code: dict[bytes, int] = {}
        self.items = sorted({item_id for item_id, _ in items})
        number = {item_id: k for k, item_id in enumerate(self.items)}
        flat: list[np.ndarray] = []
        held, spans = 0, {}  # length of windows -> (first places, items, counts)
        for item_id, text in items:
            own = np.array([self.code.setdefault(w, len(self.code) + 1) for w in words(text)], np.int32)
            if size := min(n, len(own)):
                spans.setdefault(size, []).append((held, number[item_id], len(own) - size + 1))
            flat.append(own)
            held += len(own)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # length -> hash, place, item
        for size, own in spans.items():
            place = np.concatenate([np.arange(a, a + k) for a, _, k in own])
            item = np.repeat([i for _, i, _ in own], [k for _, _, k in own])
            found = np.concatenate([self._hash(self.flat[place[k:k + 65_536, None] + np.arange(size)])
                                    for k in range(0, len(place), 65_536)])
            order = np.lexsort((item, found))
            self.tables[size] = found[order], place[order].astype(np.int32), item[order].astype(np.int32)

    @classmethod
    def of(cls, state: tuple) -> NGrams:
        """From (code, items, flat, tables): plain values, which any worker can read."""
        out = cls([])
        out.code, out.items, out.flat, out.tables = state
        return out

    @property
    def state(self) -> tuple:
        return self.code, self.items, self.flat, self.tables

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            out += rows[:, j].astype(np.uint64) * _FACTORS[j % 64] + np.uint64(j)
        return out ^ (out >> np.uint64(29))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(number of words, merged spans [from, until) that windows cover, their items)."""
        own = words(text)
        get = self.code.get
        codes = np.array([get(w, 0) for w in own], np.int64)
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        spans, items = [], set()
        for size, (table, place, item) in self.tables.items():
            if len(own) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            for part in range(0, len(at), 1 << 16):
                some = at[part:part + (1 << 16)]
                rows = codes[some[:, None] + np.arange(size)]
                found = self._hash(rows)
                first, last = np.searchsorted(table, found, "left"), np.searchsorted(table, found, "right")
                for k in np.flatnonzero(first < last).tolist():
                    near = slice(first[k], last[k])  # verified word by word
                    same = (self.flat[place[near][:, None] + np.arange(size)] == rows[k]).all(axis=1)
                    if same.any():
                        items.update(item[near][same].tolist())
                        spans.append((int(some[k]), int(some[k]) + size))
        items = {self.items[i] for i in items}
        return len(own), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_KIND = "struct<n_words:long,span_from:array<int>,span_until:array<int>,items:array<string>>"


def _slices(benchmark: DataFrame, n: int, limit: int, item_col: str, text_col: str) -> Iterator[NGrams]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # characters: at least twice the words
    parts = max(1, -(-size // (2 * limit)))
    for k in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield NGrams([(r["item"], r["text"]) for r in some.collect()], n)


def _scanner(shared):
    """UDF (text, hits so far) -> hits, with the broadcast n-grams."""
    @F.arrow_udf(_KIND)
    def scan(texts: pa.Array, prior: pa.Array) -> pa.Array:
        grams = NGrams.of(shared.value)
        found = []
        for text, old in zip(texts.to_pylist(), prior.to_pylist(), strict=True):
            count, spans, items = grams.scan(text)
            if old:
                spans = merged([*spans, *zip(old["span_from"], old["span_until"], strict=True)])
                items = sorted({*items, *old["items"]})
            found.append({"n_words": count, "span_from": [a for a, _ in spans],
                          "span_until": [b for _, b in spans], "items": items})
        return pa.array(found, pa.struct([("n_words", pa.int64()), ("span_from", pa.list_(pa.int32())),
                                          ("span_until", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))
    return scan


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str = "hits", n: int = N, limit: int = SLICE_WORDS,
              text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with a column ``out``: struct of n_words, span_from, span_until (word positions) and items."""
    spark = docs.sparkSession
    none = F.lit(None).cast(_KIND)
    rows, first = docs.withColumn(out, none), True
    for grams in _slices(benchmark, n, limit, item_col, item_text):
        scan = _scanner(spark.sparkContext.broadcast(grams.state))
        if not first:
            rows = settle(rows, "hits")
        rows, first = rows.withColumn(out, scan(F.coalesce(F.col(text_col), F.lit("")), F.col(out))), False
    return rows


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(F.zip_with(f"{hits}.span_until", f"{hits}.span_from", lambda b, a: b - a),
                       F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, n=n)
    items = F.array_join(F.array_sort("hits.items"), ",")
    return rows.select("doc_id", "hits.n_words", n_hit().alias("n_hit"),
                       F.size("hits.items").cast("long").alias("n_items"),
                       F.sha2(items.cast("binary"), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text") -> DataFrame:
    """The documents without any window of the benchmark, columns as given."""
    own = fresh_name(docs, "hits")
    return with_hits(docs, benchmark, own, n, text_col=text_col).filter(n_hit(own) == 0).drop(own)


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text") -> DataFrame:
    """All documents, with the words of hit spans cut out of the text (and what separates them)."""
    own = fresh_name(docs, "hits")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([_without(t, h) for t, h in zip(texts.to_pylist(), hits.to_pylist(), strict=True)], pa.string())

    rows = with_hits(docs, benchmark, own, n, text_col=text_col)
    return rows.withColumn(text_col, cut(F.col(text_col), F.col(own))).drop(own)


def _without(text: str | None, hits: dict) -> str | None:
    if not text or not hits["span_from"]:
        return text
    raw = text.encode()
    folded = raw.translate(_FOLD)
    starts = [i for i, b in enumerate(folded) if b != 0x20 and (not i or folded[i - 1] == 0x20)] + [len(raw)]
    out, at = [], 0
    for a, b in zip(hits["span_from"], hits["span_until"], strict=True):
        out.append(raw[at:starts[a]])
        at = starts[b] if b < len(starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::varchar, '') AS item, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, w[i + 1:i + n] AS gram
      FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
h AS (SELECT r, i, p.n, item FROM p JOIN g ON g.n = p.n AND g.gram = w[i + 1:i + p.n]),
k AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
