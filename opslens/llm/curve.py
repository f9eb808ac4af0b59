"""Packing along a space-filling curve: similar documents stand next to each other.

1. ``encoded``: token ids of every whole document, and its place on the curve. The
   document's vector counts its token ids hashed into ``BUCKETS`` signed buckets, rare ids
   weighing more; a fixed random projection takes the vector to ``DIMENSIONS`` numbers,
   which are scaled by its length, cut into ``2**BITS`` levels each, and joined to a
   Hilbert key. Bits of a row's hash below the key keep equal documents apart. Written once.
2. ``ranges``: quantiles of the key cut the curve into ranges of about equally many rows,
   so a third of all rows with equal texts is cut like any other third. Each range's
   tokens, counted from the written table's narrow columns, give where it begins.
3. ``pack``: rows go to their range, sorted by key, and are laid end to end along the
   whole curve; every ``capacity`` tokens a new sequence begins. The last stretch, which
   does not fill a sequence, becomes sequences whose lengths are descending powers of
   two, which need no padding: all sequences together hold not one padding token.

Cases: a null or empty text is a document of its end id alone (key of the zero vector).
Repeated rows and null ids are documents like any other. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import id_text, order_bucket, settle, shuffle_width
from opslens.llm.tokens import slices, worker_encoder

CAPACITY = 2048
SLICE_BYTES = 8_000_000
MEMO_BYTES = 32_000_000  # words and ids that a worker remembers
BUCKETS = 4096
DIMENSIONS = 4
BITS = 9       # levels of a dimension
SALT_BITS = 26  # of the row's hash, below the 36 of the curve


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows of up to ``bits`` bits a dimension) along the Hilbert curve:
    the axes are brought to their transposed Gray-code form, whose bits are interleaved."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for k in range(bits - 1, 0, -1):
        q = 1 << k
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turn, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for k in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> k) & 1, (1 << k) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> k) & 1)
    return key


class Projector:
    """Hilbert keys of documents from their token ids."""

    def __init__(self, vocabulary: int):
        token = np.arange(vocabulary, dtype=np.uint64)
        mixed = (token + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (mixed >> np.uint64(40)) % np.uint64(BUCKETS)
        sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
        # ids are in the order in which the vocabulary was merged, so late ones are rare
        self.weight = np.log2(2.0 + token.astype(float)) / np.log2(2.0 + vocabulary)
        rows = np.random.default_rng(12).standard_normal((BUCKETS, DIMENSIONS))
        self.rows = rows[bucket.astype(np.int64)] * (sign * self.weight)[:, None]

    def keys(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One key for each stretch of ``ids``; an empty stretch has that of the zero vector."""
        n = np.diff(offsets)
        sums = np.zeros((len(n), DIMENSIONS))
        norm = np.zeros(len(n))
        some = np.flatnonzero(n)
        if len(some):
            first = offsets[:-1][some]
            for j in range(DIMENSIONS):
                sums[some, j] = np.add.reduceat(self.rows[ids, j], first)
            norm[some] = np.add.reduceat(self.weight[ids] ** 2, first)
        level = 0.5 * (1 + np.tanh(sums / np.maximum(np.sqrt(norm), 1e-9)[:, None] / 2))
        return hilbert(np.minimum((level * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
            slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, key, doc_tokens and ids (little-endian, two bytes each where the vocabulary allows) of
    every document; equal keys differ in no other way than equal rows."""
    salt = F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - SALT_BITS)
    rows = id_text(docs, id_col, text_col).withColumn("salt", salt)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, True, MEMO_BYTES)
        top = max(len(encoder.edge), end_id + 1)
        projector, narrow = Projector(top), "<u2" if top <= 1 << 16 else "<u4"
        for batch in batches:
            for at, texts in slices(batch.column(1), slice_bytes):
                ids, offsets = encoder.encode(texts)
                salted = (projector.keys(ids, offsets) << SALT_BITS) | batch.column(2).slice(at, len(texts)).to_numpy()
                whole = np.insert(ids, offsets[1:], end_id).astype(narrow)  # the end id behind each document
                ends = (offsets + np.arange(len(offsets))) * whole.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(texts),
                                               [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(salted, pa.int64()),
                     pa.array(np.diff(offsets) + 1, pa.int64()), packed.cast(pa.binary())],
                    ["doc_id", "key", "doc_tokens", "ids"])

    return rows.mapInArrow(encode, f"doc_id {kind}, key long, doc_tokens long, ids binary")


def tail_edges(total: int, capacity: int) -> list[int]:
    """Where the sequences after the last full one end: descending powers of two."""
    at, rest = total - total % capacity, total % capacity
    edges = [at]
    for k in reversed(range(rest.bit_length())):
        if rest >> k & 1:
            edges.append(edges[-1] + (1 << k))
    return edges


def cuts(first: int, size: int, capacity: int, tail: list[int]) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset in it) of a document at ``first`` on the curve."""
    out, at, end = [], first, first + size
    full = tail[0] // capacity
    while at < end:
        if at < tail[0]:
            sequence, begin = divmod(at, capacity)
            until = (sequence + 1) * capacity
        else:
            k = int(np.searchsorted(tail, at, "right"))
            sequence, begin, until = full + k - 1, at - tail[k - 1], tail[k]
        to = min(end, until)
        out.append((at - first, to - at, sequence, begin))
        at = to
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the written table ``found`` (of ``encoded``): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset and, ``with_ids``, the piece's ids."""
    spark = found.sparkSession
    ranged = found.withColumn("bucket", order_bucket(found, "key").cast("int"))
    sums = sorted(ranged.groupBy("bucket").agg(F.sum("doc_tokens").alias("n")).collect())  # one a range
    base, total = {}, 0
    for bucket, n in sums:
        base[bucket] = total
        total += n
    tail = tail_edges(total, capacity)
    rows = (ranged.repartition(shuffle_width(spark), "bucket")
            .sortWithinPartitions("bucket", "key", "doc_id", "doc_tokens", "ids"))
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, 0
        for batch in batches:
            row, cols, own = [], [[] for _ in names[1:]], []
            sizes = batch.column(2).to_pylist()
            buckets, raws = batch.column(4).to_pylist(), batch.column(3)
            for i, (size, bucket) in enumerate(zip(sizes, buckets, strict=True)):
                if bucket != held:
                    held, at = bucket, base[bucket]
                raw = raws[i].as_py()
                ids = np.frombuffer(raw, f"<u{len(raw) // size}").astype("<u4")
                for start, length, sequence, offset in cuts(at, size, capacity, tail):
                    part = ids[start:start + length]
                    row.append(i)
                    for col, x in zip(cols, (start, length, zlib.crc32(part.tobytes()), size, sequence, offset), strict=True):
                        col.append(x)
                    if with_ids:
                        own.append(part.astype(np.int32))
                at += size
            out = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(own, pa.list_(pa.int32()))] if with_ids else out,
                                             [*names, "ids"] if with_ids else names)

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]) + ", ids array<int>" * with_ids
    return rows.mapInArrow(lay, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(settle(encoded(docs, tokenizer_path, end_id, id_col, text_col), "encoded"), capacity, with_ids)
