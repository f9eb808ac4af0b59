"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes symbols (characters, blanks as U+2581, one such mark ahead).
The adjacent pair with the lowest rank is popped from a heap and merged in a
linked list until no pair of the vocabulary is left; the count is the initial
symbols minus the merges, where a character outside the vocabulary counts as
its UTF-8 bytes. No token ids are made.

No piece of the vocabulary has a mark after another character, so merges never
cross from one word to the next: a text is counted word by word, and a worker
remembers the counts of words (bounded; emptied when full). Ranks are the
pieces' scores as the model file gives them.

Cases: a null or empty text has no tokens. A word as long as the text is one
heap run of n log n steps. Repeated rows give one result row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import id_text
from opslens.llm.tokens import patched, slices, words_of

MARK = "▁"
MEMO_WORDS = 500_000
CLOSING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


class MergeCounter:
    """Token counts of texts for a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        kept.sort(key=lambda i: (-model.get_score(i), i))
        self.rank = {model.id_to_piece(i): r for r, i in enumerate(kept)}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece crosses words; texts cannot be counted word by word")
        # a word is cut where two adjacent characters stand together in no piece
        self.pairs = {(a, b) for p in self.rank for a, b in zip(p, p[1:], strict=False)}
        self.memo: dict[str, int] = {}
        self.tails: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Symbols left when no adjacent pair of ``word`` can be merged."""
        rank, part, n = self.rank, list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        look = rank.get
        heap = [r * n + i for i in range(n - 1) if (r := look(part[i] + part[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if not part[i] or j >= n or look(both := part[i] + part[j]) != r:
                continue  # one of the two was merged since
            part[i], part[j] = both, ""
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := look(both + part[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := look(part[h] + both)) is not None:
                heappush(heap, r * n + h)
        unknown = [p for p in part if p and p not in rank]  # spelt in bytes
        return n - merges + sum(len(p.encode()) - 1 for p in unknown)

    def _word(self, word: str) -> int:
        stem = word.rstrip(CLOSING)
        if not 1 < len(stem) < len(word) or (stem[-1], word[len(stem)]) in self.pairs:
            return self.merged(word)
        rest = word[len(stem):]
        if (n := self.memo.get(stem[1:])) is None:  # the memo's keys go without their mark
            n = self.memo[stem[1:]] = self.merged(stem)
        if (t := self.tails.get(rest)) is None:
            t = self.tails[rest] = self.merged(rest)
        return n + t

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Token count of each text."""
        marked = pc.replace_substring(texts, " ", MARK)
        odd = pc.match_substring_regex(marked, f"{MARK}{MARK}|^{MARK}")
        units = pc.split_pattern(pc.binary_join_element_wise(MARK, marked, ""), MARK)  # the first part is empty
        units = patched(units, odd, marked, lambda t: ["", *[u[1:] for u in _UNITS.findall(MARK + t)]])
        distinct, codes, offsets = words_of(units)
        words = distinct.to_pylist()
        memo = self.memo
        for word in words:
            if word not in memo:
                memo[word] = self._word(MARK + word)
        found = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        if len(memo) + len(self.tails) > MEMO_WORDS:
            self.memo, self.tails = {}, {}
        total = np.concatenate(([0], np.cumsum(found[codes])))
        spare = found[codes[offsets[:-1]]] if len(texts) else 0  # of the empty first part
        total = np.diff(total[offsets]) - spare
        return np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, total)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = MergeCounter(model_path)
        for batch in batches:
            parts = [counter.counts(texts) for _, texts in slices(batch)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.int64())

    return id_text(docs, id_col, text_col).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
