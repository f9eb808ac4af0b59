"""Metric anomaly detection: rolling sigma, EWMA, statistics, history, cooldown.

Input is a long metric table with columns (metric, ts, id, value). Points are
taken in the order (ts, id, value), nulls first; rows equal in all of them
are the same point twice, so every ordering is total. All per-metric ordered
work goes through ``operators.ordered`` so one hot metric is still spread
over many tasks.

Cases: a row without a value is no point and left out. A NaN value makes the
mean of every window that holds it NaN, and the EWMA from there on, and a NaN
deviation is no anomaly. Repeated rows, null ids and a null metric are points
like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.ordered import CHUNK, HALO, ORD, halo_chunks, join_null_safe, linear_scan, with_ordinal
from opslens.session import materialize

# Fixed values of the detector (must match the reference behaviour).
DEFAULT_THRESHOLD = 3.0
DEFAULT_ALPHA = 0.3
HISTORY = 1000          # points kept per metric
MIN_POINTS = 10         # no verdict before this many points
COOLDOWN_SECONDS = 300  # per metric, strictly greater than last emitted + cooldown

ANOMALY_COLS = ["metric", "ts", "id", "value", "expected_value", "deviation",
                "severity", "description"]


def ordered_points(points: DataFrame) -> DataFrame:
    """Attach the per-metric ordinal without a per-metric shuffle; rows without a value are left
    out. Points that carry an ordinal keep it."""
    points = points.where(F.col("value").isNotNull())
    if ORD in points.columns:
        return points
    return with_ordinal(points, ["metric"], ["ts", "id", "value"])


def numbered(points: DataFrame) -> DataFrame:
    """``ordered_points`` that several branches of a plan read: written once to the shared folder."""
    return points if ORD in points.columns else materialize(ordered_points(points), "numbered-points")


def _severity(dev, threshold: float):
    return F.when(dev > 2 * threshold, F.lit("critical")).otherwise(F.lit("warning"))


def _moments(frame, name: str):
    """Mergeable summary of ``value`` over a frame: n, mean, M2 (squared deviations), min, max."""
    n = F.count(F.lit(1)).over(frame).cast("double")
    mean, var = F.avg("value").over(frame), F.var_pop("value").over(frame)
    return F.struct(n.alias("n"), mean.alias("mean"), (var * n).alias("m2"),
                    F.min("value").over(frame).alias("low"), F.max("value").over(frame).alias("high")).alias(name)


def rolling_moments(points: DataFrame, history: int = HISTORY, chunk_rows: int = 16384,
                    extra: tuple[str, ...] = ()) -> DataFrame:
    """Per point: n, mean and sample std of the last ``history`` values
    (current included), plus ``flat`` when all of them are equal, and the
    columns ``extra`` as given.

    O(1) work per row by two stacks: ordinals are cut into blocks of ``history`` rows, so a window
    is the end of one block and the beginning of the next. Running summaries (count, mean, M2) from
    each block's first row on and from each row to its block's last row are merged in pairs; no
    difference of large sums is taken, and a NaN is in the windows that hold it and no others."""
    o = ordered_points(points)
    per_chunk = -(-max(chunk_rows, history) // history) * history
    chunks = halo_chunks(o, halo=history, chunk_rows=per_chunk).repartition("metric", CHUNK)
    block = Window.partitionBy("metric", CHUNK, F.floor(F.col(ORD) / history))
    ahead = block.orderBy(ORD).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = block.orderBy(F.col(ORD).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = Window.partitionBy("metric", CHUNK).orderBy(ORD)
    whole = F.pmod(F.col(ORD) + 1, F.lit(history)) == 0  # the window is the row's own block
    c = chunks.select("*", _moments(ahead, "_a")).select("*", _moments(behind, "_z"))
    # the window's part in the block before begins history - 1 rows earlier
    c = c.withColumn("_b", F.when(~whole, F.lag("_z", history - 1).over(rows))).where(~F.col(HALO))
    a, b = F.col("_a"), F.col("_b")
    n = a["n"] + F.coalesce(b["n"], F.lit(0.0))
    delta = b["mean"] - a["mean"]
    mean = F.when(b.isNull(), a["mean"]).otherwise(a["mean"] + delta * (b["n"] / n))
    m2 = F.when(b.isNull(), a["m2"]).otherwise(a["m2"] + b["m2"] + delta * delta * (a["n"] * b["n"] / n))
    flat = (F.least(a["low"], b["low"]) == F.greatest(a["high"], b["high"]))
    return c.select("metric", "ts", "id", "value", *extra, ORD, n.alias("n"), mean.alias("mean"),
                    F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"), flat.alias("flat"))


def rolling_sigma(points: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  history: int = HISTORY, min_points: int = MIN_POINTS,
                  chunk_rows: int = 16384, extra: tuple[str, ...] = ()) -> DataFrame:
    """Flag points more than ``threshold`` sample std from the mean of the last
    ``history`` points (current point included). No verdict before
    ``min_points`` points or when the std is 0 (all values equal). ``extra`` may name the point's
    ordinal (``ORD``), by which ``cooldown`` then cuts."""
    return sigma_verdicts(rolling_moments(points, history, chunk_rows), threshold, min_points, extra)


def sigma_verdicts(m: DataFrame, threshold: float, min_points: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The anomalies among rows of ``rolling_moments``."""
    dev = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    s = (m.where((F.col(ORD) + 1 >= min_points) & ~F.col("flat") & (F.col("std") > 0))
         .withColumn("deviation", dev).where((F.col("deviation") > threshold) & ~F.isnan("deviation")))
    return s.select(
        "metric", "ts", "id", "value", *extra, F.col("mean").alias("expected_value"), "deviation",
        _severity(F.col("deviation"), threshold).alias("severity"),
        F.format_string("Value %.2f is %.1f std from mean %.2f", F.col("value"),
                        F.col("deviation"), F.col("mean")).alias("description"))


def ewma_states(points: DataFrame, alpha: float = DEFAULT_ALPHA,
                min_points: int = MIN_POINTS) -> DataFrame:
    """Per point EWMA ``e`` and variance ``v`` as the detector maintains them.

    The average is seeded with the metric's first value and only advances
    from point ``min_points`` on (earlier points return before updating):
    e = a*x + (1-a)*e ; d = x - e ; v = (1-a)*(v + a*d^2).
    Rows before the first update are not returned.
    """
    if min_points < 2:
        raise ValueError("min_points must be >= 2")
    a = 1.0 - alpha
    o = numbered(points)
    first = o.groupBy("metric").agg(F.min_by("value", ORD).alias("_x0"))
    seed_ord = min_points - 2
    o = (join_null_safe(o.where(F.col(ORD) >= seed_ord), first, ["metric"])
         .withColumn("_b", F.when(F.col(ORD) == seed_ord, F.col("_x0"))
                     .otherwise(F.lit(alpha) * F.col("value"))))
    if a == 0.0:
        e = o.withColumn("e", F.col("_b"))
    else:
        e = linear_scan(o, ["metric"], ORD, "_b", a, "e")
    e = e.withColumn("d", F.col("value") - F.col("e")).withColumn(
        "_b2", F.when(F.col(ORD) == seed_ord, F.lit(0.0))
        .otherwise(F.lit(a * alpha) * F.col("d") * F.col("d")))
    v = e.withColumn("v", F.col("_b2")) if a == 0.0 else linear_scan(e, ["metric"], ORD, "_b2", a, "v")
    return v.where(F.col(ORD) > seed_ord).drop("_b", "_b2", "_x0")


def ewma(points: DataFrame, alpha: float = DEFAULT_ALPHA, threshold: float = DEFAULT_THRESHOLD,
         min_points: int = MIN_POINTS) -> DataFrame:
    """EWMA detector: flag |x - e| / sqrt(v) > threshold when v > 0.

    With the default alpha 0.3 the ratio is bounded by 1/sqrt(a(1-a)) = 2.18,
    so threshold 3 never fires; that is the reference behaviour, kept."""
    return ewma_verdicts(ewma_states(points, alpha, min_points), threshold)


def ewma_verdicts(s: DataFrame, threshold: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """The anomalies among rows of ``ewma_states``."""
    dev = F.abs(F.col("d")) / F.sqrt(F.col("v"))
    s = s.where(F.col("v") > 0).withColumn("deviation", dev).where(
        (F.col("deviation") > threshold) & ~F.isnan("deviation"))
    return s.select(
        "metric", "ts", "id", "value", *extra, F.col("e").alias("expected_value"), "deviation",
        _severity(F.col("deviation"), threshold).alias("severity"),
        F.format_string("EWMA deviation: %.1f std", F.col("deviation")).alias("description"))


def detect(points: DataFrame, method: str = "sigma", threshold: float = DEFAULT_THRESHOLD,
           alpha: float = DEFAULT_ALPHA, **kw) -> DataFrame:
    """Detector choice: 'ewma' or 'sigma'; any other name falls back to sigma."""
    if method == "ewma":
        return ewma(points, alpha=alpha, threshold=threshold, **kw)
    return rolling_sigma(points, threshold=threshold, **kw)


def metric_stats(points: DataFrame, last: int = HISTORY, alpha: float = DEFAULT_ALPHA,
                 min_points: int = MIN_POINTS) -> DataFrame:
    """count, mean, sample std, min, max over the last ``last`` points and the
    latest EWMA; metrics with fewer than 2 points are omitted."""
    o = numbered(points)
    n = o.groupBy("metric").agg(F.max(ORD).alias("_last"))
    tail = join_null_safe(o, n, ["metric"]).where(F.col(ORD) > F.col("_last") - last)
    stats = tail.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max")).where(F.col("count") >= 2)
    # ewma before the first update is the first value (seed)
    seed = o.groupBy("metric").agg(F.min_by("value", ORD).alias("_seed"))
    latest = ewma_states(o, alpha, min_points).groupBy("metric").agg(
        F.max_by("e", ORD).alias("_e"))
    found = join_null_safe(join_null_safe(stats, seed, ["metric"]), latest, ["metric"], "left")
    return (found.select("metric", "count", "mean", "std", "min", "max",
                    F.coalesce("_e", "_seed").alias("ewma")))


def history(points: DataFrame, limit: int = 100) -> DataFrame:
    """Newest ``limit`` points per metric, newest first (rank 1).

    ``row_number() <= k`` lets Spark apply the limit per map task before the
    shuffle (WindowGroupLimit), so a hot metric ships at most k rows per task.
    """
    w = Window.partitionBy("metric").orderBy(F.col("ts").desc(), F.col("id").desc())
    return (points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("metric", "rank", "ts", "id", "value"))


COOLDOWN_ROWS = 8192     # anomalies of a chunk
COOLDOWN_CHUNKS = 512    # chunks of a group
NEVER = -(1 << 62)       # before the first alert


class Jump:
    """What a stretch of anomalies does to the time of the last alert, in microseconds.

    A last alert before ``until[k]`` (and not before an earlier one) becomes ``after[k]``; one that
    holds the whole stretch back stays as it is. Only last alerts up to the stretch's first time
    come in, so it has as many steps as there are times within one cooldown of that, at most."""

    def __init__(self, first: int, until: np.ndarray, after: np.ndarray):
        self.first = first
        enough = int(np.searchsorted(until, first, "right")) + 1
        until, after = until[:enough], after[:enough]
        last = np.append(after[1:] != after[:-1], True)  # equal neighbours are one step
        self.until, self.after = until[last], after[last]

    @classmethod
    def of(cls, times: np.ndarray, cooldown: int) -> Jump:
        """Of ascending times: from each the alerts are followed to the last one."""
        _, last = followed(times, cooldown)
        return cls(int(times[0]), times - cooldown, times[last])

    def __call__(self, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.until, before, "right")
        return np.where(at < len(self.until), self.after[np.minimum(at, len(self.until) - 1)], before)

    def then(self, later: Jump) -> Jump:
        """This stretch and the ``later`` one behind it as one."""
        more = later.until > self.until[-1] if self.until[-1] <= self.first else np.zeros(len(later.until), bool)
        return Jump(self.first, np.concatenate((self.until, later.until[more])),
                    np.concatenate((later(self.after), later.after[more])))


def followed(times: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """For an alert at each time: the place of the next alert (the length if none), and of the last."""
    after = np.searchsorted(times, times + cooldown, "right")
    last = np.where(after < len(times), after, np.arange(len(times)))
    while not np.array_equal(further := last[last], last):
        last = further
    return after, last


def _sorted(table: pa.Table, column: str) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(column, "ascending")]))


def _jumps(table: pa.Table) -> list[Jump]:
    columns = (table.column(c).to_pylist() for c in ("first", "until", "after"))
    return [Jump(f, np.array(u, np.int64), np.array(a, np.int64)) for f, u, a in zip(*columns, strict=True)]


def cooldown(anomalies: DataFrame, seconds: float = COOLDOWN_SECONDS, chunk_rows: int = COOLDOWN_ROWS,
             group_chunks: int = COOLDOWN_CHUNKS) -> DataFrame:
    """Keep an anomaly if none was emitted yet for its metric or it is strictly
    later than the last *emitted* one plus ``seconds``.

    Composable jump functions: the anomalies of a metric, numbered in order, are cut into chunks of
    ``chunk_rows``. Each chunk is summarised as a function from the last alert before it to the
    last alert after it; the functions of ``group_chunks`` chunks are composed into one, and only the
    groups are walked through in order. What comes out is applied back, first to the chunks of a group,
    then to the rows of a chunk. A storm takes the same way as anything else.

    Anomalies that carry their points' ordinal are cut by it; else they are numbered in the order
    (ts, id, value, expected_value), as far as they have these. An anomaly without a time is never an alert."""
    cool = round(seconds * 1e6)
    cols = anomalies.columns
    timed = anomalies.where(F.col("ts").isNotNull()).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    if ORD in cols:
        rows = timed.withColumn("_at", F.col(ORD))
    else:
        rows = with_ordinal(timed, ["metric"], [c for c in ("ts", "id", "value", "expected_value") if c in cols], out="_at")
    rows = rows.withColumn("_chunk", F.floor(F.col("_at") / chunk_rows))
    key = rows.schema["metric"].dataType.simpleString()

    def summary(at: str) -> str:
        return f"metric {key}, {at} long, first long, until array<long>, after array<long>"

    def as_table(table: pa.Table, at: str, found: list[tuple[int, Jump]]) -> pa.Table:
        metric = table.column("metric").slice(0, 1).combine_chunks()
        return pa.table([metric.take(pa.array([0] * len(found), pa.int64())), pa.array([k for k, _ in found], pa.int64()),
                         pa.array([j.first for _, j in found], pa.int64()),
                         pa.array([j.until for _, j in found], pa.list_(pa.int64())),
                         pa.array([j.after for _, j in found], pa.list_(pa.int64()))], ["metric", at, "first", "until", "after"])

    def summarise(table: pa.Table) -> pa.Table:
        times = np.sort(table.column("_t").to_numpy())
        return as_table(table, "_chunk", [(table.column("_chunk")[0].as_py(), Jump.of(times, cool))])

    def compose(table: pa.Table) -> pa.Table:
        table = _sorted(table, "_chunk")
        whole, *rest = _jumps(table)
        for later in rest:
            whole = whole.then(later)
        return as_table(table, "_group", [(table.column("_group")[0].as_py(), whole)])

    def walk(at: str):
        def through(table: pa.Table) -> pa.Table:
            """The last alert before each stretch, from the one before the first."""
            table = _sorted(table, at)
            last = np.array([table.column("_before")[0].as_py()])
            before = []
            for jump in _jumps(table):
                before.append(int(last[0]))
                last = jump(last)
            return pa.table([table.column("metric"), table.column(at), pa.array(before, pa.int64())], ["metric", at, "_before"])
        return through

    def emit(table: pa.Table) -> pa.Table:
        table = _sorted(table, "_at")
        times = table.column("_t").to_numpy()
        after, _ = followed(times, cool)
        keep = np.zeros(len(times), bool)
        at = int(np.searchsorted(times, table.column("_before")[0].as_py() + cool, "right"))
        while at < len(times):
            keep[at] = True
            at = int(after[at])
        return table.select(cols).filter(pa.array(keep))

    chunks = rows.select("metric", "_chunk", "_t").groupBy("metric", "_chunk").applyInArrow(summarise, summary("_chunk"))
    chunks = chunks.withColumn("_group", F.floor(F.col("_chunk") / group_chunks))
    groups = chunks.groupBy("metric", "_group").applyInArrow(compose, summary("_group"))
    ahead = groups.withColumn("_before", F.lit(NEVER)).groupBy("metric").applyInArrow(
        walk("_group"), f"metric {key}, _group long, _before long")
    entered = join_null_safe(chunks, ahead, ["metric", "_group"]).groupBy("metric", "_group").applyInArrow(
        walk("_chunk"), f"metric {key}, _chunk long, _before long")
    kept = join_null_safe(rows, entered, ["metric", "_chunk"]).groupBy("metric", "_chunk")
    return kept.applyInArrow(emit, anomalies.schema)


def check_status(anomalies: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per group: any critical -> critical, any anomaly -> warning, else success.

    ``anomalies`` must already be left-joined to the full group list with a
    nullable ``severity``."""
    return anomalies.groupBy(*group_cols).agg(
        F.count("severity").alias("anomalies"),
        F.count_if(F.col("severity") == "critical").alias("critical")).withColumn(
        "status", F.when(F.col("critical") > 0, "critical")
        .when(F.col("anomalies") > 0, "warning").otherwise("success"))
