"""Spelling variants by k-d trees over letter-count vectors.

1. ``vocabulary``: words and their occurrences, counted slice by slice in numpy (a
   deletion is chosen by the checksum of id and word) and summed by Spark. Written once.
2. ``route``: one edit moves the vector of a word's letter counts by at most 2 in L1: by 2
   if a letter is replaced, by 1 if one is inserted or deleted. For each length a k-d tree
   over a bounded sample of words cuts the space into cells; every word lies in one cell
   and is sent as a query to the cells of its own length within distance 2 and to those
   of the next length within 1, all others being pruned by their boxes. The sample only
   says where the cuts are.
3. ``near_in_cell``: a group holds one cell. A k-d tree over its words is searched for all
   queries at once, boxes beyond the distance are pruned, and the leaves' words are
   verified letter by letter. Cells of too many rows are split, words against queries.
4. ``grouped``: a word's near words are counted and its form chosen; forms are followed to
   their roots by pointer doubling (each step's count grows tenfold, so a few rounds do).

Cases: a null or empty text has no words. A null id counts as the empty string in the
checksum. Repeated rows count as often as they occur. Words of any length take part; an
empty table gives no words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import id_text, settle
from opslens.llm.importance import CRC_TABLE, crc_sql
from opslens.llm.tokens import slices
from opslens.llm.wordbytes import LONG, SLICE_BYTES, WordCutter, crcs, joined_crc

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
EVERY = 31          # a run whose checksum this divides loses a letter
SAMPLE = 50_000     # words that the cells are cut by
CELL = 32_768       # words of a cell, about
GROUP = 250_000     # rows of a group's words or queries, at most
LEAF = 24           # words of a leaf of a cell's tree

# A-Z to a-z, a-z and the first byte of U+00C0 to U+00FF (0xC3) are letters; all else separates.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b == 0xC3 else 0 for b in range(256))
ALPHABET = 26 + 64


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = EVERY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words with enough letters and occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = WordCutter(LETTERS, lead=0xC3)
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                words = cutter.cut(texts)
                heads = [(x or "").encode() + b":" for x in batch.column(0).slice(at, len(texts)).to_pylist()]
                own = crcs(words.distinct)
                size = np.fromiter(map(len, words.distinct), np.int64, len(own))
                head = np.repeat(crcs(heads), np.diff(words.offsets))
                mark = joined_crc(head, own[words.codes], size[words.codes])
                for i in np.flatnonzero(size[words.codes] > LONG).tolist():
                    mark[i] = zlib.crc32(words.distinct[words.codes[i]], int(head[i]))
                cut = mark % np.uint32(every) == 0
                n = np.bincount(words.codes[~cut], minlength=len(own))
                changed: dict[str, int] = {}
                for code, m in zip(words.codes[cut].tolist(), mark[cut].tolist(), strict=True):
                    word = words.distinct[code].decode()
                    k = m % len(word)
                    word = word[:k] + word[k + 1:]
                    if len(word) >= least_letters:
                        changed[word] = changed.get(word, 0) + 1
                kept = [(w, c) for w, c in zip(words.distinct, n.tolist(), strict=True)
                        if c and len(w) >= least_letters and len(w.decode()) >= least_letters]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*(w.decode() for w, _ in kept), *changed], pa.string()),
                     pa.array([*(c for _, c in kept), *changed.values()], pa.int64())], ["word", "n"])

    rows = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


def letters_of(words: list[str], width: int) -> np.ndarray:
    """Letter numbers (a-z: 0 to 25, then U+00C0 on), one row of ``width`` a word."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), width)
    return np.where(raw >= 0xC0, raw - (0xC0 - 26), raw - 97).astype(np.uint8)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """The letter-count vector of each row."""
    n = len(letters)
    at = letters.astype(np.int64) + np.arange(n)[:, None] * ALPHABET
    kind = np.int8 if letters.shape[1] < 120 else np.int32
    return np.bincount(at.ravel(), minlength=n * ALPHABET).reshape(n, ALPHABET).astype(kind)


class KdTree:
    """A k-d tree of count vectors, cut at medians of the widest spread. ``leaves`` are row numbers."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis: list[int] = []   # -1: a leaf, whose number stands in ``low``
        self.at: list[int] = []     # rows with at most this count go low
        self.low: list[int] = []
        self.high: list[int] = []
        self.leaves: list[np.ndarray] = []
        todo = [(np.arange(len(points)), -1, False)]
        while todo:
            rows, parent, is_high = todo.pop()
            me = len(self.axis)
            if parent >= 0:
                (self.high if is_high else self.low)[parent] = me
            own = points[rows]
            spread = own.var(axis=0) if len(rows) > leaf else np.zeros(1)
            axis = int(spread.argmax())
            self.high.append(-1)
            if spread[axis] == 0:
                self.axis.append(-1)
                self.at.append(0)
                self.low.append(len(self.leaves))
                self.leaves.append(rows)
                continue
            values = own[:, axis]
            cut = int(np.sort(values)[(len(values) - 1) // 2])
            if cut == values.max():
                cut = int(values[values < cut].max())
            self.axis.append(axis)
            self.at.append(cut)
            self.low.append(-1)
            below = values <= cut
            todo += [(rows[below], me, False), (rows[~below], me, True)]

    def reached(self, queries: np.ndarray, radius: int, apart: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of the queries whose L1 distance to its box is at most ``radius``); ``apart``
        is what each query's distance is beforehand.

        A box is what the cuts on the way leave of each axis. Going to a child changes one axis, so
        the distance changes by that axis's part alone."""
        start = np.zeros(len(queries), np.int32) if apart is None else apart.astype(np.int32)
        near = np.flatnonzero(start <= radius)
        todo = [(0, near, start[near], {})]
        while todo:
            node, rows, distance, box = todo.pop()
            axis = self.axis[node]
            if axis < 0:
                yield self.low[node], rows
                continue
            cut, (low, high) = self.at[node], box.get(axis, (0, 1 << 30))
            q = queries[rows, axis].astype(np.int32)
            old = np.maximum(low - q, 0) + np.maximum(q - high, 0)
            for child, part in ((self.low[node], (low, cut)), (self.high[node], (cut + 1, high))):
                new = distance - old + np.maximum(part[0] - q, 0) + np.maximum(q - part[1], 0)
                keep = new <= radius
                if keep.any():
                    todo.append((child, rows[keep], new[keep], box | {axis: part}))

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point lies in."""
        out = np.zeros(len(points), np.int64)
        for leaf, rows in self.reached(points, 0):
            out[rows] = leaf
        return out


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a row of ``b`` is that of ``a`` with one letter more."""
    n = a.shape[1]
    ahead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def near_pairs(queries: list[str], points: list[str], longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, point numbers) of near words; points have ``longer`` (0 or 1) letters more."""
    if not queries or not points:
        return
    width = len(points[0])
    own, theirs = letters_of(points, width), letters_of(queries, width - longer)
    same = one_inserted if longer else one_replaced
    radius = 1 if longer else 2
    vectors, asked = counts_of(own), counts_of(theirs)
    used = vectors.any(axis=0)  # letters that no point has only add to the distance
    vectors, asked = np.ascontiguousarray(vectors[:, used]), np.ascontiguousarray(asked[:, used])
    apart = (width - longer - asked.sum(axis=1)).astype(asked.dtype)
    tree = KdTree(vectors, LEAF)
    for leaf, rows in tree.reached(asked, radius, apart):
        held = tree.leaves[leaf]
        box = vectors[held]
        low, high = box.min(axis=0), box.max(axis=0)  # tighter than the cuts
        some = asked[rows]
        beyond = np.abs(some - np.clip(some, low, high)).sum(axis=1, dtype=np.int32)
        rows = rows[beyond + apart[rows] <= radius]
        for k in range(0, len(rows), 4096):
            part = rows[k:k + 4096]
            for m in range(0, len(held), 256):  # a leaf of equal vectors can be large
                block = held[m:m + 256]
                i, j = np.repeat(part, len(block)), np.tile(block, len(part))
                hit = same(theirs[i], own[j])
                if hit.any():
                    yield i[hit], j[hit]


def cell_trees(words: DataFrame, sample: int, cell: int) -> dict[int, KdTree]:
    """A tree for each length, over a bounded sample of the words; cells hold about ``cell`` words."""
    count = words.count()
    every = max(1, -(-count // sample))
    some = words.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word")
    by_length: dict[int, list[str]] = {}
    for r in some.limit(2 * sample).collect():
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    return {k: KdTree(counts_of(letters_of(own, k)), max(8, cell // every)) for k, own in by_length.items()}


POINT, SAME, SHORTER = 0, 1, 2


def routed(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """length, cell, kind, word, n: each word as a point of its cell, and as a query (``SAME`` length or
    ``SHORTER`` by one) of every cell that its near words can lie in."""
    trees = cell_trees(words, sample, cell)
    plain = {k: (t.axis, t.at, t.low, t.high) for k, t in trees.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for k, state in plain.items():
            known[k] = KdTree(np.zeros((0, 1), np.int32), 1)
            known[k].axis, known[k].at, known[k].low, known[k].high = state
        whole = KdTree(np.zeros((0, 1), np.int32), 1)  # a length without a sampled word is one cell
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), object)
            size = np.fromiter(map(len, words), np.int64, len(words))
            out: list[list[np.ndarray]] = [[], [], [], []]

            def put(length: int, cell: np.ndarray, kind: int, rows: np.ndarray, out=out) -> None:
                for col, x in zip(out, (np.full(len(rows), length), cell, np.full(len(rows), kind), rows), strict=True):
                    col.append(x)

            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                vectors = counts_of(letters_of(words[rows].tolist(), length))
                put(length, known.get(length, whole).cell(vectors), POINT, rows)
                for kind, to, radius in ((SAME, length, 2), (SHORTER, length + 1, 1)):
                    for leaf, some in known.get(to, whole).reached(vectors, radius):
                        put(to, np.full(len(some), leaf), kind, rows[some])
            length, place, kind, rows = (np.concatenate(c) for c in out)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(length, pa.int32()), pa.array(place, pa.int32()), pa.array(kind, pa.int8()), *taken.columns],
                ["length", "cell", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(route, "length int, cell int, kind byte, word string, n long")


def near_in_cell(table: pa.Table) -> pa.Table:
    """For the words of one group: how many near words each has there, and the best of them."""
    kind = table.column("kind").to_numpy()
    words, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    best: dict[str, list] = {}

    def add(to: np.ndarray, other: np.ndarray) -> None:
        """Near words ``other`` (row numbers) of the rows ``to``: the counts and the best of each run."""
        order = np.lexsort((rank[other], to))
        to, other = to[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        many = np.diff(np.append(first, len(to)))
        for row, k, top in zip(to[first].tolist(), many.tolist(), other[first].tolist(), strict=True):
            had = best.setdefault(words[row], [0, top])
            had[0] += k
            if rank[top] < rank[had[1]]:
                had[1] = top

    rank = np.empty(len(words), np.int64)  # by n downwards, then by code point
    rank[np.lexsort((np.argsort(np.argsort(words)), -n))] = np.arange(len(words))
    points = np.flatnonzero(kind == POINT)
    for query, longer in ((SAME, 0), (SHORTER, 1)):
        asked = np.flatnonzero(kind == query)
        for i, j in near_pairs(words[asked].tolist(), words[points].tolist(), longer):
            add(asked[i], points[j])
            if longer:
                add(points[j], asked[i])
    rows = list(best.items())
    return pa.table({"word": pa.array([w for w, _ in rows], pa.string()),
                     "n_near": pa.array([b[0] for _, b in rows], pa.int64()),
                     "best_n": pa.array([int(n[b[1]]) for _, b in rows], pa.int64()),
                     "best": pa.array([words[b[1]] for _, b in rows], pa.string())})


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """word, n_near, best_n, best (the near word of the largest n, ties the smallest) of words with near words."""
    rows = settle(routed(words, sample, cell), "routed")
    is_point = F.col("kind") == POINT
    sizes = rows.groupBy("length", "cell").agg(F.count_if(is_point).alias("a"), F.count_if(~is_point).alias("b"))
    large = sizes.select("length", "cell", F.ceil(F.col("a") / group).cast("int").alias("parts"),
                         F.ceil(F.col("b") / group).cast("int").alias("blocks"))
    large = large.filter((F.col("parts") > 1) | (F.col("blocks") > 1))

    def dealt(many: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.coalesce(F.col(many), F.lit(1))).cast("int")

    def every(many: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(many), F.lit(1)), F.lit(1)) - 1))

    rows = rows.join(large, ["length", "cell"], "left")
    cols = ["length", "cell", "kind", "word", "n"]
    points = rows.filter(is_point).select(*cols, dealt("parts").alias("part"), every("blocks").alias("block"))
    asked = rows.filter(~is_point).select(*cols, dealt("blocks").alias("block"), every("parts").alias("part"))
    found = points.unionByName(asked).groupBy("length", "cell", "part", "block").applyInArrow(
        near_in_cell, "word string, n_near long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                      F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
            .select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best"))


def grouped(words: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of the written table ``words`` (of ``vocabulary``)."""
    near = words.join(near_words(words, sample, cell, group), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = settle(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                              F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
                  "near")
    # an edge leads to a word of at least ``ratio`` times the count, so chains have few edges
    top = rows.agg(F.max("n")).first()[0] or 1
    longest, n = 0, 1
    while n * ratio <= top:
        longest, n = longest + 1, n * ratio
    edges = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range((longest - 1).bit_length() if longest > 1 else 0):
        onward = edges.select(F.col("word").alias("root"), F.col("root").alias("further"))
        edges = settle(edges.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return rows.join(edges, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
             every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return grouped(settle(vocabulary(docs, least_letters, least_count, every, id_col, text_col), "words"), ratio)


def oracle(least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY) -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, w, count(*) AS m FROM (SELECT coalesce(doc_id::varchar, '') AS doc_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, m, {crc_sql("(doc_id || ':' || w)")} AS h FROM o, t WHERE length(w) >= {least_letters}),
v AS (SELECT word, sum(m)::bigint AS n FROM (SELECT m, CASE WHEN h % {every} = 0
        THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h)
      WHERE length(word) >= {least_letters} GROUP BY word HAVING sum(m) >= {least_count}),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
stars AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS s FROM holes),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM holes),
near AS (SELECT a.word, b.word AS other, b.n AS k FROM stars a JOIN stars b USING (s) WHERE a.word <> b.word
  UNION ALL SELECT v.word, l.word, l.n FROM v JOIN less l ON l.s = v.word
  UNION ALL SELECT l.word, v.word, v.n FROM v JOIN less l ON l.s = v.word),
best AS (SELECT word, count(*) AS n_near, max(k) AS top, min(struct_pack(a := -k, b := other)) AS pick FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {ratio} * v.n THEN pick.b END AS form,
      CASE WHEN top >= {ratio} * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::bigint AS n_near, form_n FROM f JOIN ends USING (word)
"""
