"""Token ids of many whole texts, word by word.

Byte-pair merges never cross the places where a text is cut here, so the ids
of the words, joined, are the library's ids of the whole text. Arrow cuts a
slice of texts and dictionary-encodes the words, the tokenizers library encodes
each distinct word once, and numpy joins the ids. Slices have at most
``SLICE_BYTES``, so a worker's memory is bounded by that and its longest text.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16_000_000

MARK = "\x1f"  # where texts are cut; texts that hold it are cut by the exact pattern instead
# White space other than the blank and the line end, as Python's \s has it.
_OTHER_SPACE = ("\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
                "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
_ODD = f"<\\||[ \\n][ \\n]|^[ \\n]|[ \\n]$|[{_OTHER_SPACE}]"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# A letter or digit and a run of these at a word's end are never in one pre-token.
_TAIL = r"([\p{L}\p{N}])([!-&(-/:-@\[-`{-~]+)"


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of stretches of at most ``size`` bytes, or of one text."""
    total = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False),
                                           dtype=np.int64)))
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def words_of(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's code, and the offsets of the texts among the words."""
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), offsets.astype(np.int64)


def patched(lists: pa.ListArray, odd: pa.Array, texts: pa.Array, cut: Callable[[str], list[str]]) -> pa.ListArray:
    """``lists`` with the rows where ``odd`` holds cut anew."""
    if not pc.any(odd).as_py():
        return lists
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    anew = pa.array([cut(texts[int(i)].as_py()) for i in at], lists.type)
    take = np.arange(len(texts))
    take[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([lists, anew]).take(pa.array(take))


def cut_at_spaces(texts: pa.Array) -> pa.ListArray:
    """For vocabularies that drop white space: cut at blanks, line ends and closing marks."""
    plain = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _TAIL + "( |$)", r"\1 \2\3")
    return patched(pc.split_pattern(plain, " "), pc.match_substring(texts, "<|"), texts, lambda t: t.split(" "))


def cut_before_spaces(texts: pa.Array) -> pa.ListArray:
    """For byte-level vocabularies, whose words keep the blank before them: cut before each
    blank or line end that stands alone between two other characters, and at closing marks."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n")
    marked = pc.replace_substring_regex(marked, _TAIL + f"({MARK}|$)", rf"\1{MARK}\2\3")
    return patched(pc.split_pattern(marked, MARK), pc.match_substring_regex(texts, _ODD), texts, _CUT.split)


def _byte_letters() -> str:
    """Byte-level vocabularies spell each UTF-8 byte as a character: printable ones as
    themselves, the others as the characters from U+0100 on, in order; line ends stay."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    spell = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)} | {10: "\n"}
    return "".join(spell[b] for b in range(256))


class WordEncoder:
    """Ids of whole texts for a tokenizers file; ``keeps_blank`` says that its words keep the
    blank before them (byte-level vocabularies). Words and their ids are remembered up to
    ``memo_bytes``, then forgotten."""

    LINE = 4096  # words encoded in one call

    def __init__(self, path: str, keeps_blank: bool, memo_bytes: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core only
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.whole = Tokenizer.from_file(path)
        # the same model for words that are one pre-token and already normalised, one a line
        self.lines = Tokenizer.from_file(path)
        self.lines.normalizer = Sequence([])
        self.lines.pre_tokenizer = CharDelimiterSplit("\n")
        self.cut = cut_before_spaces if keeps_blank else cut_at_spaces
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin or end a word
        self.edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if keeps_blank else t.endswith("</w>"))]] = True
        self.keeps_blank = keeps_blank
        self.plain = f"^{' ' if keeps_blank else ''}[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"
        self.letters = _byte_letters()
        self.memo_bytes = memo_bytes
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.span = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros((2, 0), np.int64)

    def _recalled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_learn``, of words that are not remembered only."""
        if not self.memo_bytes:
            return self._learn(words)
        if self.known.nbytes + self.flat.nbytes + self.span.nbytes > self.memo_bytes:
            self._forget()
        words = words.cast(pa.string())
        at = pc.index_in(words, self.known)
        rows = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        fresh = words.take(pa.array(rows))
        flat, span = self._learn(fresh)
        span[0] += len(self.flat)
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[rows] = len(self.known) + np.arange(len(rows))
        self.known = pa.concat_arrays([self.known, fresh])
        self.flat, self.span = np.concatenate((self.flat, flat)), np.concatenate((self.span, span), axis=1)
        return self.flat, self.span[:, place]

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in some order, (first, size) of each word among them)."""
        plain = pc.match_substring_regex(words, self.plain).to_numpy(zero_copy_only=False)
        parts, held = [], 0
        span = np.zeros((2, len(words)), np.int64)
        one_by_one = [np.flatnonzero(~plain)]
        rows = np.flatnonzero(plain)
        for at in range(0, len(rows), self.LINE):
            some = rows[at:at + self.LINE]
            own = words.take(pa.array(some))
            line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_py()
            line = codecs.charmap_decode((line if self.keeps_blank else line.lower()).encode(), "strict", self.letters)[0]
            ids = np.array(self.lines.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            edge = np.flatnonzero(self.edge[ids])
            cuts = np.append(edge, len(ids)) if self.keeps_blank else np.concatenate(([0], edge + 1))
            if len(cuts) != len(some) + 1 or cuts[0] or cuts[-1] != len(ids):
                one_by_one.append(some)  # a vocabulary that spells words otherwise
                continue
            span[:, some] = held + cuts[:-1], np.diff(cuts)
            parts.append(ids)
            held += len(ids)
        some = np.concatenate(one_by_one)
        found = self.whole.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)
        for row, ids in zip(some.tolist(), (x.ids for x in found), strict=True):
            span[:, row] = held, len(ids)
            parts.append(np.array(ids, "<u4"))
            held += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), span

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of each text among them)."""
        words, codes, offsets = words_of(self.cut(texts))
        flat, (first, size) = self._recalled(words)
        size = size[codes]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(first[codes] - ends[:-1], size)
        at += np.arange(len(at))
        return flat[at], ends[offsets]


@lru_cache(maxsize=1)
def worker_encoder(path: str, keeps_blank: bool, memo_bytes: int) -> WordEncoder:
    """The encoder that a Python worker keeps for all its tasks: its file is read, and words are learnt, once."""
    return WordEncoder(path, keeps_blank, memo_bytes)
