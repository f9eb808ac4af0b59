"""Words of many whole texts by numpy over their bytes, and the crc32 of joined strings.

``WordCutter`` finds the maximal runs of a byte class in a slice of texts without a
Python step for each text or word: the class is a table over the 256 byte values,
words are dictionary-encoded by Arrow, and what follows works on their codes.

crc32 is linear: crc(a + b) is crc(a) moved on by len(b) zero bytes, xor crc(b). So the
checksum of two words joined, or of an id put ahead of a word, comes from the parts'
checksums by four table look-ups, for whole arrays at once.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8_000_000
LONG = 255  # longest second part, in bytes, that the shift tables know
POLYNOMIAL = 0xEDB88320  # crc32, bits reversed

_SHIFT: list[np.ndarray] = []


class Words(NamedTuple):
    """``distinct`` words (UTF-8), the code of each word in order, and each text's offsets among the codes."""
    distinct: list[bytes]
    codes: np.ndarray
    offsets: np.ndarray


class WordCutter:
    """Runs of the bytes that ``fold`` (256 values, 0 separates) maps to another byte. Bytes that
    follow ``lead`` belong to a run too (the second half of a two-byte character)."""

    def __init__(self, fold: bytes, lead: int | None = None):
        self.fold, self.lead = np.frombuffer(fold, np.uint8), lead

    def cut(self, texts: pa.Array) -> Words:
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
            if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(held, np.uint8)[at[0]:at[-1]] if held is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        folded = self.fold[raw]
        keep = folded != 0
        if self.lead is not None and len(raw):
            second = np.flatnonzero(raw[:-1] == self.lead) + 1
            keep[second] = True
            folded[second] = raw[second]
        edges = at[at < len(raw)]
        first = keep.copy()
        first[1:] &= ~keep[:-1]
        first[edges] = keep[edges]
        last = keep.copy()
        last[:-1] &= ~keep[1:]
        ends = at[at > 0] - 1
        last[ends] = keep[ends]
        begin = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - begin
        bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(folded[keep])])
        coded = words.dictionary_encode()
        return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(begin, at))


def _shift_tables() -> np.ndarray:
    """[n, k, b]: the byte b at place k of a checksum, moved on by n zero bytes."""
    if not _SHIFT:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
        out = np.empty((LONG + 1, 4, 256), np.uint32)
        out[0] = np.arange(256, dtype=np.uint32) << np.uint32([[0], [8], [16], [24]])
        for n in range(LONG):
            out[n + 1] = (out[n] >> 8) ^ step[out[n] & 255]
        _SHIFT.append(out.ravel())
    return _SHIFT[0]


def joined_crc(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of strings joined, from the parts' checksums and the byte lengths of the second
    parts (``LONG`` at most: longer ones are up to the caller)."""
    table = _shift_tables()
    at = np.minimum(size, LONG).astype(np.int32) << 10
    out = tail.astype(np.uint32, copy=True)
    for k in range(4):
        out ^= table[at + ((head >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int32) + 256 * k]
    return out


def crcs(strings: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, strings), np.uint32, len(strings))
