"""Best-fit packing by a configuration linear program over the length histogram.

1. ``pieces``: token ids of every document with an end id; longer documents
   are cut into full pieces, the first of which may be shorter. Written once.
2. ``plan``: only the histogram of lengths (at most ``capacity`` rows) reaches
   the driver. A configuration is a multiset of lengths that fits a sequence.
   The covering program (as few sequences as cover all counts) is solved by
   multiplicative weights: they are the duals, a length's price falls as it is
   covered, and a knapsack dynamic program finds the configuration of the highest
   price. Pricing all lengths at once gives a lower bound on the sequences, and
   the gap to it is what ends the work. The fractional solution is rounded down;
   what rounding leaves goes by best-fit decreasing, bin classes at a time. The
   plan's size depends on the capacity and the number of configurations, not on
   the number of documents.
3. ``pack``: pieces of one length are numbered in two levels (bucket counts,
   then rows within a bucket), and the number is looked up in the plan.

Cases: a null or empty text is a document of its end id alone. Repeated rows
are packed as often as they occur; null ids like any other. An empty table
packs into nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.common import id_text, settle, shuffle_width
from opslens.llm.tokens import SLICE_BYTES, WordEncoder, slices

CAPACITY = 2048
SHARE = 0.5     # of the scarcest count that a use of a configuration covers
ETA = 0.05      # how fast a covered length loses weight
GROUP = 128     # lengths that are priced together in a round, about
ROUNDS = 64     # rounds from one pricing of all lengths to the next
WASTE = 0.01    # what a configuration may lack of a full sequence; then best fit takes over
PASSES = 3      # times that the program is solved, at most
GAP = 0.0002    # to the lower bound, as a share, at which it ends


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document. ``slice_bytes`` of
    text are encoded at a time: fewer take less memory and more time, with equal results."""
    rows = id_text(docs, id_col, text_col)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, keeps_blank=True)
        for batch in batches:
            for at, texts in slices(batch.column(1), slice_bytes):
                ids, offsets = encoder.encode(texts)
                raw, ends = ids.tobytes(), (4 * offsets).tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(texts)):
                    own = raw[ends[i]:ends[i + 1]] + end
                    n = len(own) // 4
                    a, k = 0, 0
                    while a < n:
                        b = a + (capacity if k or n % capacity == 0 else n % capacity)
                        row.append(at + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[4 * a:4 * b]))
                        a, k = b, k + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(lengths: np.ndarray, price: np.ndarray, copies: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming over the capacity: the multiset of ``lengths`` with
    the highest total price, each at most ``copies`` times (taken in groups of 1, 2, 4, ... copies)."""
    items = []  # (place in lengths, copies in the group)
    for k, n in enumerate(copies.tolist()):
        group = 1
        while n:
            items.append((k, min(group, n)))
            n -= items[-1][1]
            group *= 2
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    sizes, prices = lengths.tolist(), price.tolist()
    for row, (k, n) in enumerate(items):
        x = sizes[k] * n
        option = value[:-x] + prices[k] * n
        better = taken[row, x:]
        np.greater(option, value[x:], out=better)
        np.copyto(value[x:], option, where=better)
    found: dict[int, int] = {}
    c = int(value.argmax())
    for row in range(len(items) - 1, -1, -1):
        if taken[row, c]:
            k, n = items[row]
            found[sizes[k]] = found.get(sizes[k], 0) + n
            c -= sizes[k] * n
    return found


def fractional(left: np.ndarray, seed: int = 0) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Multiplicative weights for the covering program over the counts ``left``: configurations with
    how often each is used, and a lower bound on the number of sequences.

    The weights are the duals: a piece's price is its length's weight. It begins at the length's share of
    a sequence, where no configuration is worth more than one sequence, and falls by a factor as the
    count is covered. A round deals the lengths that are not covered yet into groups by chance, prices
    each group by the knapsack, and uses the configuration of the highest price until its scarcest
    length has had a fixed share of its count. Every ``ROUNDS`` rounds all lengths are priced at once:
    by weak duality the counts' total price over the best configuration's is a lower bound. It ends when
    all is covered, or the best configuration of all lengths left does not fill a sequence.
    """
    capacity = len(left) - 1
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return [], 0.0
    rng = np.random.default_rng(seed)
    count = left[lengths].astype(float)
    covered = np.zeros(len(lengths))
    out: list[tuple[dict[int, int], float]] = []
    bound, size, rounds = 0.0, GROUP, 0
    while True:
        price = lengths / capacity * np.exp(-ETA * covered / count)
        if rounds % ROUNDS == 0:
            most = np.minimum(capacity // lengths, np.ceil(count)).astype(int)
            whole = best_configuration(lengths[::-1], price[::-1], most[::-1], capacity)
            worth = sum(price[np.searchsorted(lengths, x)] * k for x, k in whole.items())
            bound = max(bound, float((count * price).sum() / worth))
        rounds += 1
        open_ = rng.permutation(np.flatnonzero(covered < count))
        if not len(open_):
            return out, bound
        groups = max(1, len(open_) // size)
        used = False
        for group in np.array_split(open_, groups):
            group = np.sort(group)[::-1]
            room = np.floor((count - covered)[group] + 1e-9)
            copies = np.minimum(capacity // lengths[group], np.maximum(room, 1)).astype(int)
            config = best_configuration(lengths[group], price[group], copies, capacity)
            if sum(x * k for x, k in config.items()) < (1 - WASTE) * capacity:
                continue
            at = np.searchsorted(lengths, list(config))
            each = np.array(list(config.values()), float)
            use = min(((count[at] - covered[at]) / each).min(), max(1.0, SHARE * (count[at] / each).min()))
            covered[at] += use * each
            out.append((config, use))
            used = True
        if not used:
            if groups == 1:
                return out, bound
            size = 2 * size


class Stretch(NamedTuple):
    """The ``first``-th piece of a length on: ``each`` pieces a sequence, from ``at`` in it."""
    length: int
    first: int
    sequence: int
    each: int
    at: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Stretch], int]:
    """(where the pieces of each length go, number of sequences); see ``solve``."""
    return solve(histogram, capacity)[:2]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Stretch], int, float]:
    """Also the gap: by how much the number of sequences exceeds the lower bound, as a share of it.

    Each pass solves the program, rounds it down, and gives what is left to best fit; it ends with the
    first pass whose gap is at most ``GAP``, after ``PASSES`` of them at the latest, and the best one is
    kept. Best fit alone is the comparison: it is taken only if no pass reaches its count.
    """
    alone = rounded(histogram, capacity, None)
    best, fewest = None, 0
    for seed in range(PASSES):
        found = rounded(histogram, capacity, seed)
        fewest = max(fewest, math.ceil(found[3] - 1e-6))
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= (1 + GAP) * fewest:
            break
    best = best if best[1] <= alone[1] else alone
    return best[0], best[1], best[1] / fewest - 1 if fewest else 0.0


def rounded(histogram: dict[int, int], capacity: int, seed: int | None) -> tuple[list[Stretch], int, np.ndarray, float]:
    """Solve (unless ``seed`` is None), round down, and best fit for the rest; the stretches, the number
    of sequences, the count of each length that was left to best fit, and a lower bound."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    out: list[Stretch] = []
    sequences = 0

    def lay(config: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        at = 0
        for length, k in config:
            out.append(Stretch(length, int(used[length]), sequences, k, at))
            used[length] += k * times
            left[length] -= k * times
            at += k * length
        sequences += times

    if left[capacity]:
        lay([(capacity, 1)], int(left[capacity]))
    bound = float(sequences)
    configs, rest_bound = fractional(left, seed) if seed is not None else ([], 0.0)
    bound += rest_bound
    for config, use in configs:
        times = min(int(use + 1e-9), *(int(left[x]) // k for x, k in config.items()))
        if times:
            lay(sorted(config.items(), reverse=True), times)
    # best fit decreasing for the rest, a class of equal bins at a time
    bins: dict[int, list[list]] = {}  # room -> [configuration, number of bins]
    rest = left.copy()
    for length in np.flatnonzero(rest)[::-1].tolist():
        n = int(rest[length])
        while n:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                config, many, room = [], -(-n // (capacity // length)), capacity
            else:
                config, many = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            k = room // length
            full = min(many, n // k)
            if full:
                bins.setdefault(room - k * length, []).append([[*config, (length, k)], full])
                n -= full * k
            if many > full:
                if n:  # fewer than a bin takes
                    bins.setdefault(room - n * length, []).append([[*config, (length, n)], 1])
                    full, n = full + 1, 0
                if config and many > full:
                    bins.setdefault(room, []).append([config, many - full])
    for classes in bins.values():
        for config, many in classes:
            lay(config, many)
    return out, sequences, rest, bound


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (doc_id, piece, start, length, ids_crc32; a written table) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    stretches, _ = plan(histogram, capacity)
    stretches.sort()
    width = 1 << 42  # pieces of one length
    keys = np.array([s.length * width + s.first for s in stretches], np.int64)
    table = np.array([s[1:] for s in stretches], np.int64).reshape(-1, 4)

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        x, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        first, sequence, each, at = table[np.searchsorted(keys, x * width + r, "right") - 1].T
        return pa.StructArray.from_arrays([pa.array(sequence + (r - first) // each),
                                           pa.array(at + (r - first) % each * x)], ["sequence_id", "offset"])

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = found.withColumn("bucket", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_width(found.sparkSession))))
    ahead = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
            .select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")))
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    return ranked.withColumn("to", place("length", F.col("base") + F.col("rank"))).select(
        *cols, "to.sequence_id", "to.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    found = pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, slice_bytes)
    return pack(settle(found, "pieces"), capacity)
