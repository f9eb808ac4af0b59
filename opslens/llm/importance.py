"""Target-distribution importance resampling over hashed word and word-pair features.

1. ``histogram``: how often each bucket of hashed features occurs, counted slice by
   slice in numpy and summed by Spark. It has ``buckets`` rows at any size of input.
2. ``gains``: the integer log-ratio of target and corpus for each bucket, an array.
3. ``scored``: each document's weight is the floored mean of that array over its
   features; a Gumbel number from a hash of its id makes the score.
4. ``cutoff``: the last place to be drawn. A quantile sketch of the scores brackets it,
   exact counts outside the bracket validate it or have it widened, and it is narrowed
   by sketches within it until few rows are left; only these are sorted. Equal scores go
   by id, and rows equal in both by their place in the written table, so that no
   group of ties is ever sorted as a whole.
5. ``draw``: the drawn rows alone are range-sorted for their ranks.

Cases: a null or empty text has no features: n_features and weight 0, never drawn. A
null id counts as the empty string in the hash and comes after all other ids. Repeated
rows have equal scores and are drawn one by one. An empty target makes all rarer
features dearer; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import id_text, settle, shuffle_width
from opslens.llm.tokens import slices
from opslens.llm.wordbytes import LONG, SLICE_BYTES, WordCutter, crcs, joined_crc

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
SKETCH = 10_000        # accuracy of the quantile sketches
BRACKET_ROWS = 50_000  # a bracket of more rows is narrowed before it is sorted

# A-Z to a-z; digits, a-z and all bytes above 0x7F are word characters, the rest separate.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or chr(b).isalnum() else 0 for b in range(256))


class Features(NamedTuple):
    """Buckets of the single words and of the pairs that begin at each word (-1: the last word of
    a text), and each text's offsets among the words."""
    single: np.ndarray
    pair: np.ndarray
    offsets: np.ndarray


def features(cutter: WordCutter, texts: pa.Array, buckets: int) -> Features:
    words = cutter.cut(texts)
    own = crcs(words.distinct)
    ahead = np.fromiter((zlib.crc32(b" ", c) for c in own.tolist()), np.uint32, len(own))
    size = np.fromiter(map(len, words.distinct), np.int64, len(own))
    pair = np.full(len(words.codes), -1, np.int64)
    if len(pair) > 1:
        first, second = words.codes[:-1], words.codes[1:]
        both = joined_crc(ahead[first], own[second], size[second])
        for i in np.flatnonzero(size[second] > LONG).tolist():
            both[i] = zlib.crc32(words.distinct[second[i]], int(ahead[first[i]]))
        pair[:-1] = both % np.uint32(buckets)
    ends = words.offsets[1:][np.diff(words.offsets) > 0] - 1
    pair[ends] = -1
    return Features((own % np.uint32(buckets)).astype(np.int64)[words.codes], pair, words.offsets)


def histogram(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all rows; an array of ``buckets`` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, total = WordCutter(FOLD), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0), SLICE_BYTES):
                found = features(cutter, texts, buckets)
                total += np.bincount(found.single, minlength=buckets)
                total += np.bincount(found.pair[found.pair >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = table.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (target share / corpus share)), both smoothed by one occurrence a bucket."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter, worth = WordCutter(FOLD), np.append(gain, 0)  # the last stands for no pair
        for batch in batches:
            parts = []
            for _, texts in slices(batch, SLICE_BYTES):
                found = features(cutter, texts, len(gain))
                total = np.concatenate(([0], np.cumsum(worth[found.single] + worth[found.pair])))
                n_words = np.diff(found.offsets)
                n = np.maximum(2 * n_words - 1, 0)
                weight = np.diff(total[found.offsets]) // np.maximum(n, 1)
                parts.append(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n_words, n, weight)], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return (id_text(docs, id_col, text_col).select("doc_id", weigh("text").alias("w"))
            .select("doc_id", "w.n_words", "w.n_features", "w.weight", (F.col("w.weight") + gumbel).cast("long").alias("score")))


#: The order of drawing: ascending in each, the next where the one before is equal.
PLACE = ("down", "late", "row")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``scored`` with a total order: the score downwards, the id (null last), the row."""
    far = F.lit((1 << 63) - 1)
    return rows.withColumns({"down": -F.col("score"), "late": F.coalesce(F.col("doc_id").cast("long"), far),
                             "row": F.monotonically_increasing_id()})


def bracket(rows: DataFrame, column: str, rank: int, count: int, sketch: int = SKETCH) -> tuple[int, int, int, int]:
    """(low, high, rows below low, rows within) of a range of ``column`` that holds the row of the
    given rank (from 1, of ``count``): by a quantile sketch, its outside counted exactly, and widened
    until the counts put the rank inside."""
    margin = 2 / sketch
    while True:
        share = (rank - 0.5) / count
        at = [max(0.0, share - margin), min(1.0, share + margin)]
        low, high = rows.agg(F.percentile_approx(column, at, sketch).alias("q")).first()["q"]
        if margin >= 1:
            low, high = rows.agg(F.min(column), F.max(column)).first()
        below, within = rows.agg(F.count_if(F.col(column) < low), F.count_if(F.col(column).between(low, high))).first()
        if below < rank <= below + within:
            return low, high, below, within
        margin *= 4


def cutoff(rows: DataFrame, rank: int, sketch: int = SKETCH, limit: int = BRACKET_ROWS) -> tuple | None:
    """The place (down, late, row) of the rank-th row (from 1) of ``placed`` rows; None if rank is 0."""
    if rank < 1:
        return None
    rest, count, names = rows.select(*PLACE), rows.count(), list(PLACE)
    while names and count > limit:
        low, high, below, within = bracket(rest, names[0], rank, count, sketch)
        rest, rank = rest.filter(F.col(names[0]).between(low, high)), rank - below
        if low == high or within == count:  # one value, or a sketch that can't narrow it further
            if low == high:
                names.pop(0)
            else:
                middle = (low + high) // 2  # halve the range instead
                left = rest.filter(F.col(names[0]) <= middle).count()
                keep = F.col(names[0]) <= middle if rank <= left else F.col(names[0]) > middle
                rest, rank, within = rest.filter(keep), rank if rank <= left else rank - left, left if rank <= left else within - left
        count = within
    return tuple(rest.orderBy(*PLACE).offset(rank - 1).limit(1).first())


def not_after(place: tuple) -> Column:
    """Whether a row stands at ``place`` or before it."""
    a, b, c = (F.col(x) for x in PLACE)
    down, late, row = (F.lit(x).cast("long") for x in place)
    return (a < down) | ((a == down) & ((b < late) | ((b == late) & (c <= row))))


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, sketch: int = SKETCH,
         limit: int = BRACKET_ROWS) -> DataFrame:
    """All rows of ``scored`` with their rank among the drawn, null for those not drawn."""
    held = settle(placed(rows), "scored")
    eligible = held.filter(F.col("n_words") >= least_words)
    last = cutoff(eligible, percent * eligible.count() // 100, sketch, limit)
    if last is None:
        return held.drop(*PLACE).withColumn("rank", F.lit(None).cast("long"))
    drawn = (F.col("n_words") >= least_words) & not_after(last)
    # the id of a row in a sorted partition holds the partition's number and the row's place there
    parts = (held.filter(drawn).repartitionByRange(shuffle_width(held.sparkSession), *PLACE).sortWithinPartitions(*PLACE)
             .withColumn("at", F.monotonically_increasing_id()))
    parts = settle(parts, "drawn").withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)})
    before, offsets = 0, []
    for part, n in sorted(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one a partition
        offsets.append((part, before))
        before += n
    offset = F.broadcast(held.sparkSession.createDataFrame(offsets, "part long, before long"))
    ranked = parts.join(offset, "part").withColumn("rank", F.col("before") + F.col("at") + 1)
    cols = [c for c in held.columns if c not in PLACE]
    return ranked.select(*cols, "rank").unionByName(
        held.filter(~drawn).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) and n_words of every document."""
    gain = gains(histogram(docs, text_col, buckets), histogram(target, target_text, buckets))
    found = draw(scored(docs, gain, seed, id_col, text_col), percent, least_words)
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


# crc32 in SQL: the table of 256 entries is derived, and a list of bytes is folded over it.
CRC_TABLE = """t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    """crc32 of a string's UTF-8 bytes; needs ``tab`` of CRC_TABLE in scope."""
    digits = f"hex(encode({text}))"
    own = f"list_transform(range(1, strlen({text})*2, 2), lambda p: ('0x' || substr({digits}, p, 2))::bigint)"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {own}), "
            "lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295)")


def oracle(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    def words(table: str) -> str:
        return f"""regexp_extract_all(translate(coalesce({table}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

    grams = """SELECT r, unnest(w) AS g FROM {0} UNION ALL
      SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM {0})"""
    return f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {words('documents')} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, {words('benchmark')} AS w FROM benchmark),
dg AS ({grams.format('d')}), bg AS ({grams.format('b')}),
v AS (SELECT g, {crc_sql('g')} % {buckets} AS k FROM (SELECT DISTINCT g FROM (SELECT g FROM dg UNION ALL SELECT g FROM bg)), t),
s AS (SELECT k, count(*) AS s FROM dg JOIN v USING (g) GROUP BY k), u AS (SELECT k, count(*) AS t FROM bg JOIN v USING (g) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT count(*) FROM dg) + {buckets})
    / ((coalesce(s, 0) + 1)::double * ((SELECT count(*) FROM bg) + {buckets}))))::bigint AS gain FROM s FULL JOIN u USING (k)),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain)::double / count(*))::bigint AS weight
      FROM dg JOIN v USING (g) JOIN gain USING (k) GROUP BY r),
x AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT r, doc_id, n_words, n_features, weight,
      weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM y WHERE n_words >= {least_words})
SELECT doc_id::bigint AS doc_id, n_features::bigint AS n_features, weight, score,
  CASE WHEN rank <= {percent} * (SELECT count(*) FROM z) // 100 THEN rank END AS rank, n_words::bigint AS n_words
FROM y LEFT JOIN z USING (r)
"""
