"""SimHash near-dedup with a bit-sliced comparison of fingerprints.

1. ``fingerprints``: 64-bit SimHash of every text over its word shingles
   (repeats included), XXH64 with a seed; a bit is set where over half of the
   shingle hashes have it.
2. ``links``: fingerprints within ``radius`` bits. The 64 bits are cut into
   ``radius + 2`` blocks, of which two at least agree if at most ``radius``
   bits differ; so candidates share the bits of some pair of blocks. Within a
   candidate bucket, 64 fingerprints at a time stand vertically as 64 bit
   planes; a query's distances to all 64 grow plane by plane in carry-save
   bit counters, and a block is abandoned once all its distances exceed the
   radius. Each task hands on a spanning forest of the links it found, so
   rows never grow with the square of a bucket and no link between classes is
   lost. A bucket above ``SPLIT`` fingerprints is dealt as pairs of parts.
3. ``components``: smallest label over links with pointer jumping, written to
   the shared folder each round, until nothing changes.

Cases: a null or empty text (or only white space) has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle of all.
Documents with equal fingerprints are one class from the start (copies are
never paired). A null id is in its class but is never the class id; a class
of null ids alone has a null id. Repeated rows give one result row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from opslens.llm.common import fresh_name, id_text, settle, shuffle_width

SHINGLE = 4
RADIUS = 4
SEED = 42
SPLIT = 32_768
CHUNK = 1 << 14  # (query, block) pairs compared at a time


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash
    words = text.encode().lower().split()  # on bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    found = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)),
                        np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):  # bounded memory for very long texts
        part = found[at:at + 65_536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return id_text(docs, id_col, text_col).select("doc_id", bits(F.col("text"), shingle, seed).alias("fp"))


def bits(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of a text that is not null, as a long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


def planes_of(values: np.ndarray) -> np.ndarray:
    """(blocks, 64) bit planes: bit i of plane b of a block is bit b of its i-th value."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    bits = np.vstack([bits, np.zeros((-len(bits) % 64, 64), np.uint8)]).reshape(-1, 64, 64).transpose(0, 2, 1)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view("<u8")[:, :, 0]


def within(query: np.ndarray, planes: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> Iterator:
    """For pairs (query fingerprint, block): yields (pair index, lane) of lanes within the radius."""
    pair, full = np.arange(len(query)), ~np.uint64(0)
    counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(query), np.uint64)
    for b in range(64):
        carry = planes[block, b] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        over |= carry
        if b % 8 == 7:
            above, equal = over.copy(), np.full(len(over), full)
            for k in range(len(counters) - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            lanes = lanes & ~above
            go = lanes != 0  # abandon blocks whose distances all exceed the radius
            if not go.all():
                pair, query, block, lanes, over = pair[go], query[go], block[go], lanes[go], over[go]
                counters = [c[go] for c in counters]
            if not len(pair):
                return
    hits = np.unpackbits(lanes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    row, lane = np.nonzero(hits)
    yield pair[row], block[row] * 64 + lane


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of linked positions; labels are the smallest position of a class."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


def forest(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among values with equal keys (keys come in runs)."""
    n = len(values)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    stops = np.repeat(np.concatenate((starts[1:], [n])), np.diff(np.concatenate((starts, [n]))))
    q = np.flatnonzero(np.arange(n) + 1 < stops)  # each against the later ones of its run
    planes, label = planes_of(values), np.arange(n)
    first, blocks = (q + 1) // 64, (stops[q] - 1) // 64 - (q + 1) // 64 + 1
    total = np.concatenate(([0], np.cumsum(blocks)))
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK, "right")) - 1)
        own = np.repeat(np.arange(at, to), blocks[at:to])
        block = first[own] + np.arange(len(own)) - (total[own] - total[at])
        low = np.maximum(q[own] + 1 - block * 64, 0).astype(np.uint64)
        high = np.minimum(stops[q[own]] - block * 64, 64)
        full = ~np.uint64(0)
        lanes = (full << low) & (full >> (64 - high).astype(np.uint64))
        for pair, lane in within(values[q[own]], planes, block, lanes, radius):
            label = merge(label, q[own[pair]], lane)
        at = to
    tied = np.flatnonzero(label != np.arange(n))
    return values[tied], values[label[tied]]


def _forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, v):
            u, w = forest(k, v, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(w.view(np.int64))], ["u", "v"])

        for part in batches:
            k = np.concatenate((held_k, part.column(0).to_numpy(zero_copy_only=False)))
            v = np.concatenate((held_v, part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])  # keys are sorted; the last run may go on
            if last:
                yield out(k[:last], v[:last])
            held_k, held_v = k[last:].copy(), v[last:].copy()
        if len(held_k):
            yield out(held_k, held_v)
    return run


def _masks(radius: int) -> list[int]:
    n = radius + 2
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """u, v: links of distinct fingerprints (column fp) that connect all within the radius."""
    bands = fps.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(_masks(radius))
    ])).alias("key"))
    large = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split)
    parts = bands.join(large, "key", "left").withColumn("m", F.coalesce(F.ceil(F.col("n") / split), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - 1, F.lit(0))))
    parts = parts.withColumn("i", own).withColumn("j", other).filter((F.col("m") == 1) | (F.col("i") != F.col("j")))
    parts = parts.select(F.when(F.col("m") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).alias("key"), "fp")
    parts = parts.repartition(shuffle_width(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    return parts.mapInArrow(_forests(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for the nodes of the edges (u, v)."""
    both = settle(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
        "node", F.least("node", "v").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                F.least("label", "near").alias("via"))
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("label").alias("far")), "via")
        seen = Observation()
        nxt = jump.select("node", F.least("via", "far").alias("label"), "old").observe(
            seen, F.sum(F.when(F.col("label") != F.col("old"), 1).otherwise(0)).alias("changed"))
        labels = settle(nxt.select("node", "label"), "labels")
        if not seen.get["changed"]:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links, itself included)."""
    prints = settle(fingerprints(docs, id_col, text_col, shingle, seed), "fp")
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-ids")
    labels = components(links(least.select("fp"), radius))
    # both are written, so that the join by label below can split a class with very many members
    linked = settle(labels.withColumnRenamed("node", "fp").join(least, "fp"), "linked")
    heads = settle(linked.groupBy("label").agg(F.min("first").alias("component_id")), "heads")
    linked = linked.join(heads, "label").select("fp", "component_id")
    classes = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    classes = settle(classes, "classes")  # so that the join by fingerprint can split one with very many copies
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of each near-duplicate group, columns as given: the one with the smallest id (null last), of
    such rows the one whose text has the smallest SHA-256, of equal rows any one.

    Rows are told apart by a number that is written with them, not by their id, which they may share or lack."""
    row, fp = fresh_name(docs, "row"), fresh_name(docs, "fp")
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = settle(docs.withColumns({row: F.monotonically_increasing_id(), fp: bits(text, shingle, seed)}), "fingerprinted")
    rank = F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"),
                    F.sha2(text.cast("binary"), 256).alias("digest"), F.col(row).alias("row"))
    best = settle(held.groupBy(F.col(fp).alias("node")).agg(F.min(rank).alias("best")), "best")
    labels = components(links(best.select(F.col("node").alias("fp")), radius))
    kept = (best.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("class"))
            .agg(F.min("best").alias("best")).select(F.col("best.row").alias(row)))
    # the kept numbers are hashed, so that whole texts need no sorting
    return held.join(kept.hint("shuffle_hash"), row, "left_semi").select(docs.columns)


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
