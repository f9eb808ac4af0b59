"""Structured Streaming twins of the batch operators.

* ``detect_stream``: per-metric detector (rolling sigma or EWMA) with the
  alert cooldown, by the batch operators over each micro-batch and a small
  table carried from the one before (``foreachBatch``). State per metric
  is bounded: the last ``history`` values, the EWMA pair and the time of the
  last emitted alert. A row whose ``control`` column is 'clear' drops the
  metric's state at that point of the stream (rows after it start afresh).
* windowed aggregations with watermarks: tumbling period statistics,
  sliding counts, session clusters, canary gate;
* latest state per key (update mode), redelivery counting with a
  dead-letter flag;
* sinks: ``run_until_caught_up`` runs a query with ``availableNow`` into a
  parquet folder under the session's checkpoint folder and returns the
  result as a batch DataFrame; update-mode queries are upserted by keeping
  the last version of every key.

The detector has no watermark: it sorts the rows of a micro-batch by time and
takes micro-batches in arrival order. The windowed aggregations have one
(default 10 minutes) and drop rows that arrive later than that behind the
newest event time of the micro-batches before; a replay of a table is one
micro-batch and drops none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.operators import anomaly as an
from opslens.operators.ordered import ORD, epoch_seconds, join_null_safe, linear_scan, with_ordinal
from opslens.session import ensure_checkpoint_dir
from opslens.tables import table

WATERMARK = "10 minutes"
MONITOR_TRIGGER = "60 seconds"
SESSION_GAP = "299 seconds 999999 microseconds"   # strict '< 300 s' as the batch clustering
MAX_ATTEMPTS = 3


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A driver table (a file or a folder of part files) as a file stream with a declared schema.

    Without a limit a replay takes all files that are there as one micro-batch, so their
    order does not matter and no row is late."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, as a stream takes a plain path for a folder; it names the file or the folder alike
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}[.]parquet")


def _scratch(spark: SparkSession, tag: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/streams/{tag}-{uuid.uuid4().hex[:12]}"


def run_until_caught_up(df: "DataFrame | DetectStream", tag: str, output_mode: str = "append",
                        keys: list[str] | None = None, order: str = "_batch") -> DataFrame:
    """Run ``df`` with trigger(availableNow) into parquet under the shared
    checkpoint folder; return the written rows as a batch DataFrame.

    append: rows as written. update: each micro-batch appends its updated
    rows tagged with the batch id and the result keeps, per ``keys``, the row
    of the latest batch (an upsert without a table format)."""
    spark = df.points.sparkSession if isinstance(df, DetectStream) else df.sparkSession
    root = _scratch(spark, tag)
    out, ck = f"{root}/out", f"{root}/checkpoint"
    if isinstance(df, DetectStream):
        def write(found: DataFrame, batch_id: int) -> None:
            found.write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")
        df.start(write, ck, f"{root}/state", availableNow=True).awaitTermination()
        none = df.finish(spark.createDataFrame([], OUT_SCHEMA))
        return spark.read.schema(none.schema).option("recursiveFileLookup", "true").parquet(out) \
            if _exists(spark, out) else none
    if output_mode == "append":
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def upsert(batch: DataFrame, batch_id: int) -> None:
            # one folder a batch: a batch that runs again replaces its own rows
            batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
                f"{out}/batch-{batch_id}")
        q = (df.writeStream.foreachBatch(upsert).option("checkpointLocation", ck)
             .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.schema(_result_schema(df, output_mode)).option(
        "recursiveFileLookup", str(output_mode != "append").lower()).parquet(out) if _exists(spark, out) else \
        spark.createDataFrame([], _result_schema(df, output_mode))
    if output_mode == "complete":       # every batch holds the whole result: keep the last one
        res = res.where(F.col("_batch") == res.agg(F.max("_batch")).scalar()).drop("_batch")
    elif output_mode != "append":
        w = Window.partitionBy(*(keys or [])).orderBy(F.col(order).desc())
        res = res.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_batch")
    return res


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, asked of its own file system (a query without a batch writes none)."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _result_schema(df: DataFrame, mode: str):
    s = df.schema
    if mode != "append":
        from pyspark.sql.types import LongType, StructField, StructType
        s = StructType(list(s.fields) + [StructField("_batch", LongType(), False)])
    return s


# ---------------- stateful detector (STR1-STR4, STR12) ----------------

OUT_SCHEMA = ("metric string, ts timestamp_ntz, id long, value double, expected_value double, "
              "deviation double, severity string, description string")
TAIL_SCHEMA = f"metric string, ts timestamp_ntz, id long, value double, {ORD} long"
PAIR_SCHEMA = "metric string, n long, e double, v double, last_alert double"


def _key(part: Column) -> Column:
    """A metric and its part (clear rows seen so far) as one text that is never null."""
    return F.concat(part.cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), "metric"), F.lit("")))


def _metric_of(key: str) -> Column:
    rest = F.expr(f"substring({key}, instr({key}, ':') + 1)")
    return F.when(rest != "", F.substring(rest, 2, 2 ** 31 - 1))


class DetectStream:
    """A stream of points and the detector that runs over each of its micro-batches.

    A micro-batch is handled by the batch operators, so a metric is spread over many tasks. Its
    rows go on from a small table carried in ``state`` (a shared folder): per metric the last
    ``history`` rows, the EWMA pair, the count of rows and the last alert's time. A micro-batch
    that runs again reads the state of the one before it and writes its own anew; older states are deleted."""

    def __init__(self, points: DataFrame, method: str, threshold: float, alpha: float, history: int,
                 min_points: int, cooldown: float | None, then: tuple[Callable, ...] = ()):
        self.points, self.method, self.threshold, self.alpha = points, method, threshold, alpha
        self.history, self.min_points, self.cooldown, self.then = history, min_points, cooldown, then

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> "DetectStream":
        """``fn`` is applied to the anomalies of every micro-batch."""
        return DetectStream(self.points, self.method, self.threshold, self.alpha, self.history, self.min_points,
                            self.cooldown, (*self.then, fn))

    def finish(self, found: DataFrame) -> DataFrame:
        for fn in self.then:
            found = fn(found)
        return found

    def start(self, sink: Callable[[DataFrame, int], None], checkpoint: str, state: str, **trigger) -> "StreamingQuery":  # noqa: F821
        def each(batch: DataFrame, batch_id: int) -> None:
            sink(self.finish(self.step(batch, batch_id, state)), batch_id)
        return (self.points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
                .trigger(**trigger).start())

    def step(self, batch: DataFrame, batch_id: int, state: str) -> DataFrame:
        spark = self.points.sparkSession
        own, before = f"{state}/batch-{batch_id}", f"{state}/batch-{batch_id - 1}"

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{own}/{name}")
            return spark.read.schema(df.schema).parquet(f"{own}/{name}")

        def carried(name: str, schema: str) -> DataFrame:
            there = _exists(spark, f"{before}/{name}")
            return spark.read.schema(schema).parquet(f"{before}/{name}") if there else spark.createDataFrame([], schema)

        control = "control" in batch.columns
        batch.select("metric", "ts", "id", F.col("value").cast("double").alias("value"),
                     *(["control"] if control else [])).write.mode("overwrite").parquet(f"{own}/given")
        rows = spark.read.parquet(f"{own}/given")
        parts = F.lit(0).cast("long")
        if control:   # clear rows cut a metric into parts
            flag = F.when(F.col("control") == "clear", 1.0).otherwise(0.0)
            cut = with_ordinal(rows.withColumn("_clear", flag), ["metric"], ["ts", "id", "value"], out="_at")
            cut = linear_scan(cut, ["metric"], "_at", "_clear", 1.0, "_parts")
            rows = keep(cut.select("metric", "ts", "id", "value", "_clear", F.round("_parts").cast("long").alias("_part")), "cut")
            last_part = rows.groupBy("metric").agg(F.max("_part").alias("_last"))
            rows, parts = rows.where("_clear = 0"), F.col("_part")
        pair = carried("pair", PAIR_SCHEMA).withColumn("metric", _key(F.lit(0)))
        tail = carried("tail", TAIL_SCHEMA).withColumn("metric", _key(F.lit(0)))
        rows = an.ordered_points(rows.select(_key(parts).alias("metric"), "ts", "id", "value"))
        rows = rows.join(pair, "metric", "left").withColumn(ORD, F.col(ORD) + F.coalesce("n", F.lit(0)))
        rows = keep(rows, "rows")
        every = rows.select("metric", "ts", "id", "value", ORD, F.lit(True).alias("_new")).unionByName(
            tail.withColumn("_new", F.lit(False)))
        if self.method == "ewma":
            states = keep(self._ewma_states(rows), "ewma")
            found = an.ewma_verdicts(states, self.threshold, (ORD,))
        else:
            states = None
            moments = an.rolling_moments(every, self.history, extra=("_new",)).where("_new")
            found = an.sigma_verdicts(moments, self.threshold, self.min_points, (ORD,))
        if self.history < self.min_points:    # never enough points for a verdict
            found = found.limit(0)
        found = keep(found, "anomalies")
        if self.cooldown is not None:
            # what the last alert still holds back, then the cooldown over the rest
            seconds = epoch_seconds("ts")
            due = (found.join(pair.select("metric", "last_alert"), "metric", "left")
                   .where(F.col("last_alert").isNull() | (seconds > F.col("last_alert") + F.lit(float(self.cooldown))))
                   .drop("last_alert"))
            found = keep(an.cooldown(due, self.cooldown), "alerts")
        # the state after this micro-batch: rows of each metric's last part
        live = every.withColumn("_m", _metric_of("metric"))
        if control:
            ends = last_part.select(_key(F.col("_last")).alias("_end"), F.col("metric").alias("_m"))
            live = join_null_safe(live, ends, ["_m"], "left").where(F.col("_end").isNull() | (F.col("_end") == F.col("metric")))
        newest = Window.partitionBy("metric").orderBy(F.col(ORD).desc())
        live = keep(live.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max(self.history, 1))
                    .select("metric", "_m", "ts", "id", "value", ORD), "live")
        after = live.groupBy("metric", "_m").agg((F.max(ORD) + 1).alias("n"))
        alerts = found.groupBy("metric").agg(F.max(epoch_seconds("ts")).alias("_alert"))
        after = after.join(alerts, "metric", "left").join(pair.drop("n"), "metric", "left")
        e, v = F.col("e"), F.col("v")
        if states is not None:
            latest = states.groupBy("metric").agg(F.max_by("e", ORD).alias("_e"), F.max_by("v", ORD).alias("_v"))
            first = rows.groupBy("metric").agg(F.min_by("value", ORD).alias("_x0"))
            after = after.join(latest, "metric", "left").join(first, "metric", "left")
            e, v = F.coalesce("_e", "e", "_x0"), F.coalesce("_v", "v", F.lit(0.0))
        keep(after.select(F.col("_m").alias("metric"), "n", e.alias("e"), v.alias("v"),
                          F.greatest("_alert", "last_alert").alias("last_alert")), "pair")
        keep(live.select(F.col("_m").alias("metric"), "ts", "id", "value", ORD), "tail")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch-{batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return found.withColumn("metric", _metric_of("metric")).drop(ORD)

    def _ewma_states(self, rows: DataFrame) -> DataFrame:
        """Per new row from point ``min_points`` on, e and v as they go on from the carried pair."""
        alpha, a = self.alpha, 1.0 - self.alpha
        first = rows.groupBy("metric").agg(F.min_by("value", ORD).alias("_x0"))
        starts = F.col(ORD) == F.greatest(F.coalesce("n", F.lit(0)), F.lit(self.min_points - 1))
        r = (rows.join(first, "metric").where(F.col(ORD) >= self.min_points - 1)
             .select("metric", "ts", "id", "value", ORD, starts.alias("_starts"),
                     F.coalesce("e", "_x0").alias("_e0"), F.coalesce("v", F.lit(0.0)).alias("_v0")))
        carry = F.when(F.col("_starts"), a * F.col("_e0")).otherwise(0.0)
        r = linear_scan(r.withColumn("_b", alpha * F.col("value") + carry), ["metric"], ORD, "_b", a, "e")
        r = r.withColumn("d", F.col("value") - F.col("e"))
        carry = F.when(F.col("_starts"), a * F.col("_v0")).otherwise(0.0)
        r = r.withColumn("_b2", a * alpha * F.col("d") * F.col("d") + carry)
        return linear_scan(r, ["metric"], ORD, "_b2", a, "v").select("metric", "ts", "id", "value", ORD, "e", "d", "v")


def detect_stream(points: DataFrame, method: str = "sigma", threshold: float = an.DEFAULT_THRESHOLD,
                  alpha: float = an.DEFAULT_ALPHA, history: int = an.HISTORY,
                  min_points: int = an.MIN_POINTS, cooldown: float | None = None) -> DetectStream:
    """Streaming detector over (metric, ts, id, value[, control]); emits
    anomalies (after the cooldown when given) as soon as their micro-batch is
    processed. Rows are ordered by (ts, id) inside a micro-batch; across
    micro-batches arrival order is kept, as the reference does."""
    return DetectStream(points, method, threshold, alpha, history, min_points, cooldown)


def start_monitor(points: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  trigger: str = MONITOR_TRIGGER, **detector) -> "StreamingQuery":  # noqa: F821
    """Continuous check every ``trigger``: detector -> ``sink(batch_df, batch_id)``. The
    detector's state is beside the checkpoint."""
    return detect_stream(points, **detector).start(sink, checkpoint, f"{checkpoint.rstrip('/')}-detector",
                                                   processingTime=trigger)


# ---------------- windowed aggregations (STR6, STR7, STR8, STR11) ----------------

def _evt(df: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    return df.withColumn("_evt", F.col(ts).cast("timestamp")).withWatermark("_evt", watermark)


def period_stats_stream(points: DataFrame, period: str = "300 seconds") -> DataFrame:
    w = _evt(points).groupBy("metric", F.window("_evt", period).alias("w"))
    return w.agg(F.avg("value").alias("average"), F.max("value").alias("maximum"),
                 F.min("value").alias("minimum"), F.sum("value").alias("total"),
                 F.count(F.lit(1)).alias("samples"))


def pane_counts_stream(events: DataFrame, pane: str = "30 seconds") -> DataFrame:
    """Events by metric and pane ``w``: each event is counted once, whatever windows its pane is in."""
    return _evt(events).groupBy("metric", F.window("_evt", pane).alias("w")).agg(F.count(F.lit(1)).alias("events"))


def merge_panes(panes: DataFrame, length: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """(metric, w, events) of sliding windows, merged from panes (metric, w, events) that are as long as
    the slide. Only panes are multiplied, one row a metric and slide at most."""
    return panes.groupBy("metric", F.window("w.start", length, slide).alias("w")).agg(F.sum("events").alias("events"))


def sliding_counts_stream(events: DataFrame, length: str = "5 minutes", slide: str = "30 seconds") -> DataFrame:
    """Sliding windows as one stream, for a sink that wants the windows themselves: every event is
    multiplied by the windows it is in. ``pane_counts_stream`` with ``merge_panes`` is the cheaper way."""
    return _evt(events).groupBy("metric", F.window("_evt", length, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("events"))


def session_clusters_stream(events: DataFrame, key: str, gap: str = SESSION_GAP) -> DataFrame:
    return _evt(events).groupBy(key, F.session_window("_evt", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def canary_gate_stream(events: DataFrame, limit: float = 0.01, period: str = "1 minute") -> DataFrame:
    """Per period and version: 5xx-like error share, gate fails above ``limit``."""
    g = _evt(events).groupBy(F.window("_evt", period).alias("w"), "version").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_error")).alias("errors"))
    return g.withColumn("ratio", F.col("errors") / F.col("total")).withColumn("failed", F.col("ratio") > limit)


# ---------------- keyed state (STR5, STR10) ----------------

def latest_state_stream(events: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Most recent event per key (update mode)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_s"),
                                   F.count(F.lit(1)).alias("events")).select(
        key, *[F.col(f"_s.{c}").alias(c) for c in cols], "events")


def dead_letters_stream(deliveries: DataFrame, key: str = "job_id", delivery: str = "delivery_id",
                        max_attempts: int = MAX_ATTEMPTS, watermark: str = WATERMARK) -> DataFrame:
    """Receives per job (duplicate deliveries dropped within the watermark);
    more than ``max_attempts`` receives -> dead letter."""
    d = _evt(deliveries, watermark=watermark).dropDuplicatesWithinWatermark([key, delivery])
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("attempts")).withColumn(
        "dead_letter", F.col("attempts") > max_attempts)


class ExpiringState:
    """Attempts and latest event of each job, kept only while the job is alive: a job without an event for
    ``ttl_seconds`` of event time is forgotten, and starts afresh with its next event.

    ``step`` handles a micro-batch with what the one before it left in ``state`` (a shared folder): a row for each
    live job and the deliveries of its present life, so state is bounded by the jobs alive.
    Rows of a job are taken in the order (``ts``, ``order``); a gap above the time to live between two of
    them ends a life, also inside one micro-batch. A delivery seen in the same life counts once. A micro-batch
    that runs again reads the state of the one before it and writes its own anew. The work is a sorted
    window per job on the executors, which spills; no job is gathered in a Python worker."""

    def __init__(self, events: DataFrame, key: str, ts: str, order: list[str], cols: list[str], delivery: str,
                 ttl_seconds: int, max_attempts: int = MAX_ATTEMPTS):
        self.events, self.key, self.ts, self.order, self.cols = events, key, ts, order, cols
        self.delivery, self.ttl, self.max_attempts = delivery, int(ttl_seconds * 1_000_000), max_attempts

    def start(self, sink: Callable[[DataFrame, int], None], checkpoint: str, state: str, **trigger) -> "StreamingQuery":  # noqa: F821
        def each(batch: DataFrame, batch_id: int) -> None:
            sink(self.step(batch, batch_id, state), batch_id)
        return (self.events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start())

    def step(self, batch: DataFrame, batch_id: int, state: str) -> DataFrame:
        """key, ts of its last event, the columns of that event, attempts, dead_letter: jobs with an event in this batch."""
        spark = self.events.sparkSession
        own, before = f"{state}/batch-{batch_id}", f"{state}/batch-{batch_id - 1}"
        latest = F.struct(F.col(self.ts).alias("ts"), *[F.col(c) for c in [*self.order, *[c for c in self.cols if c not in self.order]]])
        new = batch.where(F.col(self.ts).isNotNull()).select(
            F.col(self.key).alias("_key"), F.unix_micros(F.col(self.ts).cast("timestamp")).alias("_us"), latest.alias("_latest"),
            F.col(self.delivery).alias("_delivery"), F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_new"))

        def carried(name: str, like: DataFrame) -> DataFrame:
            path = f"{before}/{name}"
            return spark.read.schema(like.schema).parquet(path) if _exists(spark, path) else like.limit(0)

        live = carried("live", new.drop("_new", "_delivery")).withColumns({"_new": F.lit(False), "_delivery": F.lit(None).cast(
            new.schema["_delivery"].dataType)})
        seen = carried("seen", new.select("_key", "_delivery"))
        rows = new.unionByName(live)
        by_time = Window.partitionBy("_key").orderBy("_us", "_new", "_latest")
        rows = rows.withColumn("_life", F.when(F.col("_us") - F.lag("_us").over(by_time) > self.ttl, 1).otherwise(0))
        rows = rows.withColumn("_life", F.sum("_life").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        rows.write.mode("overwrite").parquet(f"{own}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{own}/rows")
        # a delivery counts once in a life: in this batch, and not if the life goes on from the state, which saw it
        goes_on = rows.where(~F.col("_new")).select("_key", F.col("_life").alias("_old"))
        rows = join_null_safe(rows, goes_on, ["_key"], "left")
        known = F.col("_new") & F.col("_delivery").isNotNull()
        rows = rows.join(seen.select(F.col("_key").alias("_sk"), F.col("_delivery").alias("_sd")).distinct(),
                         known & (F.col("_life") == F.col("_old")) & F.col("_key").eqNullSafe(F.col("_sk")) & (F.col("_delivery") == F.col("_sd")),
                         "left").withColumn("_again", F.col("_sd").isNotNull()).drop("_sk", "_sd")
        counted = F.when(known & ~F.col("_again"), F.struct("_delivery"))
        lives = rows.groupBy("_key", "_life").agg(
            (F.count_distinct(counted) + F.sum(F.when(~known, F.col("_n")).otherwise(0))).alias("_n"),
            F.max("_us").alias("_us"), F.max("_latest").alias("_latest"), F.max("_new").alias("_new"))
        last = lives.groupBy("_key").agg(F.max_by(F.struct("_us", "_latest", "_n", "_new", "_life"), "_life").alias("l")).select("_key", "l.*")
        last.write.mode("overwrite").parquet(f"{own}/last")
        last = spark.read.schema(last.schema).parquet(f"{own}/last")
        now = last.agg(F.max("_us")).scalar()
        live = last.where(F.col("_us") >= now - self.ttl)
        live.select("_key", "_us", "_latest", "_n").write.mode("overwrite").parquet(f"{own}/live")
        lives = live.select("_key", "_life")
        came = join_null_safe(rows.where(F.col("_new") & F.col("_delivery").isNotNull()), lives, ["_key", "_life"]).select("_key", "_delivery")
        stays = join_null_safe(seen, join_null_safe(goes_on.withColumnRenamed("_old", "_life"), lives, ["_key", "_life"]), ["_key"])
        came.unionByName(stays.select("_key", "_delivery")).distinct().write.mode("overwrite").parquet(f"{own}/seen")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch-{batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return last.where("_new").select(F.col("_key").alias(self.key), F.col("_latest.ts").alias("ts"),
                                         *[F.col(f"_latest.{c}").alias(c) for c in self.cols], F.col("_n").alias("attempts"),
                                         (F.col("_n") > self.max_attempts).alias("dead_letter"))


def run_expiring(jobs: ExpiringState, tag: str) -> DataFrame:
    """Run with trigger(availableNow); each job as the last micro-batch with an event of it left it."""
    spark = jobs.events.sparkSession
    root = _scratch(spark, tag)

    def write(found: DataFrame, batch_id: int) -> None:
        found.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{root}/out/batch-{batch_id}")

    jobs.start(write, f"{root}/checkpoint", f"{root}/state", availableNow=True).awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    newest = Window.partitionBy(jobs.key).orderBy(F.col("_batch").desc())
    return found.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", "_batch")


# ---------------- approval expiry with an event-time deadline (STR9) ----------------

def approval_expiry_stream(requests: DataFrame, decisions: DataFrame, timeout_seconds: int = 3600,
                           watermark: str = WATERMARK) -> DataFrame:
    """requests(request_id, requested_at) LEFT OUTER JOIN decisions(request_id,
    decided_at, status) on a decision between the request and its deadline.

    Matches are emitted as they happen; a request with no match is emitted
    (status null) once the watermark passes its deadline, which is the
    expiry. Decisions outside the window never match, so expiry is final.
    ``settle_expiry`` turns the emitted rows into one status per request."""
    r = (requests.withColumn("_rt", F.col("requested_at").cast("timestamp")).withWatermark("_rt", watermark)
         .withColumnRenamed("request_id", "_rid"))
    d = (decisions.withColumn("_dt", F.col("decided_at").cast("timestamp")).withWatermark("_dt", watermark)
         .withColumnRenamed("request_id", "_did"))
    cond = F.expr(f"_did = _rid AND _dt >= _rt AND _dt <= _rt + INTERVAL {int(timeout_seconds)} SECONDS")
    j = r.join(d, cond, "leftOuter")
    return j.select(F.col("_rid").alias("request_id"), "requested_at", "decided_at", "status")


def settle_expiry(emitted: DataFrame) -> DataFrame:
    """Emitted join rows -> first decision per request (ties: status order),
    or 'expired' for a request emitted without a match."""
    g = emitted.groupBy("request_id", "requested_at").agg(
        F.min(F.when(F.col("decided_at").isNotNull(), F.struct("decided_at", "status"))).alias("_d"))
    return g.select("request_id", F.coalesce(F.col("_d.status"), F.lit("expired")).alias("status"),
                    "requested_at", F.col("_d.decided_at").alias("decided_at"))
