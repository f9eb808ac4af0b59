"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds documents in id order. Each document is one frame (its ids as
little-endian unsigned 32-bit integers, with zstandard's own checksum). Behind
the frames stand a skippable frame with the document ids and another with the
seek table of the zstandard seekable format: compressed size, size and XXH64
checksum (low 32 bits) of every frame, so a reader decompresses only the
documents asked for. ``write`` makes one file for each quantile bucket of the
id, in the shared folder, and returns the manifest; a retried task writes a
file of a new name and only the manifest's files count.

Cases: a null or empty text is a document of its end id alone. Null ids come
first, repeated ids stand in order of text. An empty table has no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.common import id_text, open_fs, order_bucket, settle, shared_path, shuffle_width
from opslens.llm.tokens import WordEncoder, slices

# Fixed values of the zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

NO_ID = -(1 << 63)  # stands for a null id in the index


def checksum(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    def __init__(self, sink, level: int = 3):
        import zstandard
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.sink, self.ids, self.table = sink, [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.pack(raw)
        self.sink.write(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.table.append((len(frame), len(raw), checksum(raw)))

    def close(self) -> None:
        index = np.array(self.ids, "<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        rows = [*self.table, (8 + len(index), 0, 0)]
        table = np.array(rows, "<u4").tobytes() + struct.pack("<IBI", len(rows), HAS_CHECKSUMS, SEEKABLE_FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.sink.close()


class FrameReader:
    def __init__(self, uri: str):
        import zstandard
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.unpack = zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self._at(self.file.size() - 9, 9))
        if magic != SEEKABLE_FOOTER or flags != HAS_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self._at(self.file.size() - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.table = table[:-1]
        self.first = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.doc_ids = np.frombuffer(self._at(int(self.first[-2]) + 8, 8 * len(self.table)), "<i8")

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset) if size else b""

    def _checked(self, k: int, frame: bytes) -> bytes:
        raw = self.unpack(frame)
        if len(raw) != self.table[k, 1] or checksum(raw) != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its entry in the seek table")
        return raw

    def frame(self, k: int) -> bytes:
        """The ids of the k-th document; only its frame is read."""
        return self._checked(k, self._at(int(self.first[k]), int(self.table[k, 0])))

    def documents(self, doc_ids=None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, ids before it in this file, its ids), all in order or those asked for."""
        starts = np.cumsum(self.table[:, 1]) // 4 - self.table[:, 1] // 4
        if doc_ids is not None:
            for k in np.flatnonzero(np.isin(self.doc_ids, list(doc_ids))).tolist():
                yield int(self.doc_ids[k]), int(starts[k]), self.frame(k)
            return
        n, at = len(self.table), 0
        while at < n:  # stretches of a few MB
            to = max(at + 1, int(np.searchsorted(self.first, self.first[at] + (4 << 20), "right")) - 1)
            to = min(to, n)
            part = memoryview(self._at(int(self.first[at]), int(self.first[to] - self.first[at])))
            for k in range(at, to):
                a = int(self.first[k] - self.first[at])
                own = self._checked(k, bytes(part[a:a + int(self.table[k, 0])]))
                yield None if self.doc_ids[k] == NO_ID else int(self.doc_ids[k]), int(starts[k]), own
            at = to


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, level: int = 3,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; the manifest: bucket, path, n_docs, n_ids, base (ids of all files before)."""
    rows = id_text(docs, id_col, text_col)
    rows = rows.select(order_bucket(rows).cast("int").alias("bucket"), F.col("doc_id").cast("long"), "text")
    rows = (rows.repartition(shuffle_width(docs.sparkSession), "bucket")
            .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text"))
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, keeps_blank=False)
        fs, base = open_fs(folder)
        writer, at = None, None
        done: list[tuple] = []

        def close() -> None:
            writer.close()
            done.append((at, f"{folder}/{name}", len(writer.table), sum(r[1] for r in writer.table) // 4))

        for batch in batches:
            for first, texts in slices(batch.column(2)):
                ids, offsets = encoder.encode(texts)
                raw, ends = ids.tobytes(), (4 * offsets).tolist()
                buckets = batch.column(0).slice(first, len(texts)).to_pylist()
                names = batch.column(1).slice(first, len(texts)).to_pylist()
                for i, bucket in enumerate(buckets):
                    if bucket != at:
                        if writer:
                            close()
                        at, name = bucket, f"part-{bucket + 1:06d}-{uuid.uuid4().hex}.ids.zst"
                        fs.create_dir(base, recursive=True)
                        writer = FrameWriter(fs.open_output_stream(f"{base}/{name}", compression=None), level)
                    writer.add(names[i], raw[ends[i]:ends[i + 1]] + end)
        if writer:
            close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("bucket", "path", "n_docs", "n_ids"), r, strict=True)) for r in done],
            pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = settle(rows.mapInArrow(encode, "bucket int, path string, n_docs long, n_ids long"), "manifest")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, digest: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digest``, ids_crc32) of every document, or of
    those asked for, from the files."""
    files = manifest.select("path", "base").repartition(shuffle_width(manifest.sparkSession), "path")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for doc_id, start, raw in FrameReader(path).documents(doc_ids):
                    rows.append((doc_id, base + start, len(raw) // 4,
                                 zlib.crc32(raw) if digest else np.frombuffer(raw, "<u4").astype(np.int32)))
                    size += 0 if digest else len(raw)
                    if len(rows) == 10_000 or size > 8_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          ["doc_id", "start", "n_tokens", "last"])

    last = "ids_crc32 long" if digest else "ids array<int>"
    kind = "long" if digest else "array<int>"
    return files.mapInArrow(decode, f"doc_id long, start long, n_tokens long, last {kind}").withColumnRenamed(
        "last", last.split()[0])


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Write all documents and read each back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_path(docs.sparkSession, "token-ids")
    return read(write(docs, tokenizer_path, end_id, folder, id_col=id_col, text_col=text_col), digest=True)
