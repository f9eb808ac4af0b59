"""Ordered computations over keys that may be very hot.

A plain ``Window.partitionBy(metric).orderBy(ts)`` sends every row of one
metric to one task. When a single metric holds a third of all rows that task
is the whole job. The helpers here keep ordered semantics exact while the
work stays spread over many tasks:

* ``with_ordinal`` numbers rows 0..n-1 inside each key. Rows are first cut
  into order buckets of about equally many rows (quantiles of the order
  columns, so a burst in one hour or at one instant is cut like anything
  else); a small per-(key, bucket) count table gives each bucket its starting
  offset, and ``row_number`` only runs inside (key, bucket) partitions.
* ``halo_chunks`` cuts each key into fixed-size ordinal chunks and copies the
  last ``halo`` rows of every chunk into the next one, so a frame of
  ``halo`` preceding rows is complete inside every chunk partition.
* ``linear_scan`` evaluates the first-order recurrence s_k = a*s_{k-1} + b_k
  exactly: a closed form inside each chunk (one cumulative window sum), and
  the same scan applied recursively to the much smaller table of chunk
  totals to carry state across chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORD = "_ord"
CHUNK = "_chunk"
HALO = "_halo"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since epoch as DOUBLE for TIMESTAMP or TIMESTAMP_NTZ input."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys come from the left side."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _bisect(bounds: str, x: str, n: int) -> str:
    """SQL: how many of the ``n`` (or fewer) ascending ``bounds`` lie below ``x``, in log n steps."""
    steps = ", ".join(str(1 << k) for k in reversed(range(n.bit_length())))
    return f"aggregate(array({steps}), 0, (at, s) -> CASE WHEN get({bounds}, at + s - 1) < {x} THEN at + s ELSE at END)"


def _place(df: DataFrame, column: str) -> str | None:
    """SQL: ``column`` as a number that orders alike; None if it is neither a number nor a time."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return f"unix_micros(cast(`{column}` AS timestamp))"
    if kind == "date":
        return f"unix_date(`{column}`)"
    return f"`{column}`" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else None


GRID = 65536


def quantile_buckets(df: DataFrame, order: Sequence[str], parts: int | None = None,
                     like: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with bucket columns that ascend with ``order`` and hold at most about 1/``parts`` of all
    rows each, whatever their keys; and the columns' names.

    Bounds are approximate quantiles of the first order column, a scalar subquery: no job runs while
    the plan is built. They are taken over ``like``, if given: a table with a column of that name and
    spread, so that a frame derived at length isn't planned once more for them. A value that is a bound
    itself (many rows may share it) is a bucket of its own, cut further by the next order columns: small
    integers by value, long ones into stretches of ``GRID`` values. A first column that is neither a
    number nor a time is not cut."""
    parts = parts or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    like = df if like is None else like
    x = _place(df, order[0])
    if x is None:
        return df, []
    at = ", ".join(str(i / parts) + "D" for i in range(1, parts))
    sketch = like.agg(F.expr(f"array_distinct(percentile_approx({_place(like, order[0])}, array({at}), {20 * parts}))").alias("b"))
    out = df.withColumn("_bounds", sketch.scalar()).withColumn("_below", F.expr(_bisect("_bounds", x, parts)))
    alone = f"({x} IS NULL OR coalesce(get(_bounds, _below) = {x}, false))"
    places = {"_bkt0": F.expr(f"CASE WHEN {x} IS NULL THEN -1 ELSE 2 * _below + int({alone}) END")}
    for i, c in enumerate(order[1:], 1):
        kind = dict(df.dtypes)[c]
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            break
        step = f"floor(`{c}` / {GRID})" if kind == "bigint" else f"`{c}`"
        places[f"_bkt{i}"] = F.expr(f"CASE WHEN {alone} THEN cast({step} AS bigint) ELSE 0 END")
        if kind == "bigint":
            break
    return out.withColumns(places).drop("_bounds", "_below"), list(places)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 bucket: Column | Sequence[Column] | None = None, out: str = ORD, like: DataFrame | None = None) -> DataFrame:
    """Add a 0-based per-key ordinal following ``order``.

    The work is split by ``quantile_buckets`` (over ``like``, if given); a caller may give a ``bucket``
    of its own, one column or more, which must be monotone non-decreasing in ``order`` within a key. It
    only controls how the numbering work is split, never the result. A null key is a key of its own;
    rows without an order value come first.
    """
    if bucket is None:
        b, names = quantile_buckets(df, order, like=like)
    else:
        buckets = [bucket] if isinstance(bucket, Column) else list(bucket)
        names = [f"_bkt{i}" for i in range(len(buckets))]
        b = df.withColumns(dict(zip(names, buckets, strict=True)))
    counts = b.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_bn"))
    prior = Window.partitionBy(*keys).orderBy(*names).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *names,
                            F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_boff"))
    inner = Window.partitionBy(*keys, *names).orderBy(*_cols(order))
    numbered = b.withColumn("_brn", F.row_number().over(inner))
    return (join_null_safe(numbered, offsets, [*keys, *names])
            .withColumn(out, (F.col("_boff") + F.col("_brn") - 1).cast("long"))
            .drop(*names, "_boff", "_brn"))


def halo_chunks(df: DataFrame, halo: int, chunk_rows: int, ordinal: str = ORD) -> DataFrame:
    """Assign rows to ordinal chunks and duplicate each chunk's tail into the next.

    Result has ``_chunk`` and ``_halo`` (True on the copies). A window
    partitioned by (key, _chunk) with a frame of up to ``halo`` preceding rows
    sees exactly what a per-key window would see, for every non-halo row.
    """
    if halo > chunk_rows:
        raise ValueError("halo must not exceed chunk_rows")
    own = F.floor(F.col(ordinal) / chunk_rows)
    if halo == 0:
        return df.withColumn(CHUNK, own).withColumn(HALO, F.lit(False))
    copies = F.array(F.struct(own.alias("c"), F.lit(False).alias("h")))
    tail = F.pmod(F.col(ordinal), F.lit(chunk_rows)) >= chunk_rows - halo
    copies = F.when(tail, F.concat(copies, F.array(F.struct((own + 1).alias("c"), F.lit(True).alias("h"))))).otherwise(copies)
    return df.select("*", F.explode(copies).alias("_copy")).select(
        *df.columns, F.col("_copy.c").alias(CHUNK), F.col("_copy.h").alias(HALO))


def _scan_chunk_rows(a: float) -> int:
    """Largest chunk with a**-(C-1) well inside double range (<= 1e150)."""
    if a >= 1.0:
        return 100_000
    c = int(150.0 / -math.log10(a)) + 1
    return max(2, min(c, 100_000))


MAX_ROWS_PER_KEY = 10 ** 15


def linear_scan(df: DataFrame, keys: Sequence[str], ordinal: str, b: str, a: float,
                out: str, max_rows_per_key: int = MAX_ROWS_PER_KEY,
                chunk_rows: int | None = None) -> DataFrame:
    """s_k = a * s_{k-1} + b_k per key in ordinal order, with s_{-1} = 0.

    Exact up to floating point rounding and without any look-back cap.
    Ordinals must be dense within a key (0..n-1, or a suffix of that).
    Inside a chunk of C rows: s_k = a^p_k * cumsum_j(a^-p_j * b_j), with C
    chosen so a^-C stays far from overflow. Chunk end states follow the same
    recurrence with factor a^C over a table C times smaller, solved by the
    same function until one chunk holds a whole key.
    """
    if a < 1e-290:                       # no state survives a single step
        return df.withColumn(out, F.col(b))
    c_rows = min(chunk_rows, _scan_chunk_rows(a)) if chunk_rows else _scan_chunk_rows(a)
    la = math.log(a)
    if max_rows_per_key <= c_rows:       # whole key fits in one chunk
        w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.exp(F.col(ordinal) * la) *
                             F.sum(F.col(b) * F.exp(-F.col(ordinal) * la)).over(w))
    t = (df.withColumn("_sc", F.floor(F.col(ordinal) / c_rows))
         .withColumn("_sp", F.col(ordinal) - F.col("_sc") * c_rows))
    w = Window.partitionBy(*keys, "_sc").orderBy(ordinal).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_sl", F.exp(F.col("_sp") * la) *
                     F.sum(F.col(b) * F.exp(-F.col("_sp") * la)).over(w))
    # chunk totals = local state at each chunk's last row
    tot = t.groupBy(*keys, "_sc").agg(F.max_by("_sl", ordinal).alias("_tb"))
    # end state of chunk c: E_c = a^C * E_{c-1} + T_c (first chunk: no predecessor)
    lvl = f"_sc_{len(keys)}_{c_rows}"
    carried = linear_scan(tot.withColumnRenamed("_sc", lvl), keys, lvl, "_tb",
                          a ** c_rows, "_send",
                          max_rows_per_key=-(-max_rows_per_key // c_rows), chunk_rows=chunk_rows)
    prev = carried.select(*keys, (F.col(lvl) + 1).alias("_sc"), F.col("_send").alias("_sprev"))
    return (join_null_safe(t, prev, [*keys, "_sc"], "left")
            .withColumn(out, F.col("_sl") + F.coalesce(F.col("_sprev"), F.lit(0.0)) *
                        F.exp((F.col("_sp") + 1) * la))
            .drop("_sc", "_sp", "_sl", "_sprev"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, order: Sequence[str],
              take: Sequence[str], out: str = "asof") -> DataFrame:
    """``left`` with the struct ``out`` (``time``, ``order``, ``take``) of the latest row of ``right`` with equal keys
    and a strictly earlier ``time``; of several at that time the last by ``order``. Null if there is none.

    Both sides are united and cut into ranges of time of about equally many rows (``quantile_buckets``). In
    a range the latest row of ``right`` so far is carried along; each range's last one, a small table, is
    carried over the ends of ranges. So a hot key is spread over many tasks. A null key is a key of its
    own; rows without a time have no earlier row and are none. The columns of ``left`` stay as they are."""
    held = F.struct(*[F.col(c) for c in [time, *order, *take]])
    cols = left.columns
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"), F.lit(0).alias("_side"),
                    F.struct(*cols).alias("_row"))
    b = right.where(F.col(time).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).alias("_t"),
                                                    F.lit(1).alias("_side"), held.alias("_held"))
    both, names = quantile_buckets(a.unionByName(b, allowMissingColumns=True), ["_t", "_side"],
                                   like=a.select("_t").unionByName(b.select("_t")))
    own = [f"_k{i}" for i in range(len(keys))]
    # at one time the left rows come first, so that only earlier rows are seen; then the right ones by their order
    seen = Window.partitionBy(*own, *names).orderBy("_t", "_side", "_held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("_seen", F.last("_held", ignorenulls=True).over(seen)).where(F.col("_side") == 0)
    before = Window.partitionBy(*own).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*own, *names).agg(F.max("_held").alias("_end"))  # the struct begins with the time and order
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = join_null_safe(within, ends, [*own, *names])
    return found.select("_row.*", F.when(F.col("_t").isNotNull(), F.coalesce("_seen", "_carried")).alias(out))
