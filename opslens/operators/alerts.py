"""Alert rules and metric-series operators: rule generation and evaluation,
counter rates, ratios, N-of-M alarms, sustained conditions, transitions,
percentiles and histogram quantiles, period statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.ordered import CHUNK, HALO, ORD, halo_chunks, join_null_safe, linear_scan, with_ordinal
from opslens.session import materialize

# Alert templates (key, metric, threshold text, duration,
# severity, description) as the reference defines them.
ALERT_TEMPLATES = [
    ("cpu", "cpu_usage_percent", "80", "5m", "warning", "High CPU usage"),
    ("memory", "memory_usage_percent", "85", "5m", "warning", "High memory usage"),
    ("latency", "http_request_duration_seconds", "1.0", "2m", "critical", "High request latency"),
    ("error_rate", "http_requests_total{status=~'5..'}", "10", "1m", "critical", "High error rate"),
    ("queue", "job_queue_length", "100", "5m", "warning", "Job queue backup"),
]
RULE_TEAM = "platform"
RULE_INTERVAL = "30s"


def templates(spark) -> DataFrame:
    return spark.createDataFrame(
        ALERT_TEMPLATES, "key string, metric string, threshold string, duration string, "
                         "severity string, description string")


def alert_rules(metric_keys: DataFrame, tpl: DataFrame) -> DataFrame:
    """metric_keys(key) -> one rule per known key; unknown keys are dropped.
    The template table has a fixed handful of rows, so it is broadcast."""
    j = metric_keys.join(F.broadcast(tpl), "key")
    return j.select(
        "key", F.concat(F.upper("key"), F.lit("_ALERT")).alias("name"),
        F.concat_ws(" > ", "metric", "threshold").alias("expr"),
        F.col("duration").alias("for"), "severity", F.lit(RULE_TEAM).alias("team"),
        "description", F.concat(F.lit("runbooks/"), F.col("key"), F.lit(".md")).alias("runbook"),
        F.col("metric").alias("rule_metric"), F.expr("try_cast(threshold AS double)").alias("threshold"))


def rules_text(rules: DataFrame) -> DataFrame:
    """One YAML rule block per rule (for a ``write.text`` sink)."""
    return rules.select("name", F.format_string(
        "\n      - alert: %s\n        expr: %s\n        for: %s\n        labels:\n"
        "          severity: %s\n          team: %s\n        annotations:\n"
        "          description: \"%s\"\n          runbook: \"%s\"\n",
        "name", "expr", "for", "severity", "team", "description", "runbook").alias("yaml"))


def _ladders(rules: DataFrame) -> DataFrame:
    """(key, steps): each key's rules in ascending order of threshold. Rules without a threshold never fire."""
    step = F.struct("threshold", "name", "severity")
    return (rules.where(F.col("threshold").isNotNull()).groupBy(F.col("key").alias("_key"))
            .agg(F.sort_array(F.collect_list(step)).alias("steps")))


def _climbed(points: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """Points with their key's ladder ``steps`` and ``rungs``, how many of its thresholds lie below the
    value, found by one binary search; points below all are left out."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("steps", at + step - 1)["threshold"] < F.col("value"), at + step).otherwise(at))
    ladders = _ladders(rules)
    j = points.join(ladders, points["key"] == ladders["_key"]).drop("_key")
    return j.where(F.col("value") > F.get("steps", F.lit(0))["threshold"]).withColumn("rungs", found)


MAX_RULES = 1 << 20   # rules of one key that a binary search of 20 steps reaches


def evaluate_rules(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Breaching points (value > threshold) with name, threshold and severity of each rule they
    breach. A point meets its key's rules once, sorted by threshold, and those it breaches are the
    first ones: no pair that doesn't breach is made."""
    j = _climbed(points, rules, MAX_RULES)
    hit = F.explode(F.slice("steps", F.lit(1), F.col("rungs"))).alias("_rule")
    return j.select(*points.columns, hit).select(*points.columns, "_rule.name", "_rule.threshold", "_rule.severity")


def breach_summary(points: DataFrame, rules: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, name, breaches, first_ts, last_ts, max_value) of each rule that any point of its key breaches.

    No (point, rule) pair is made: points are counted by the highest threshold they exceed, and a
    rule's breaches are the counts of its own and all higher rungs of its key, a running sum."""
    p = points.select("key", F.col(ts).alias("ts"), F.col(value).alias("value"))
    tops = _climbed(p, rules, MAX_RULES).groupBy("key", F.col("rungs").alias("rung")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.max("value").alias("m"))
    rungs = _ladders(rules).select(F.col("_key").alias("key"), F.posexplode("steps").alias("at", "step"))
    rungs = rungs.select("key", (F.col("at") + 1).alias("rung"), "step.name")
    higher = Window.partitionBy("key").orderBy(F.col("rung").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rungs.join(tops, ["key", "rung"], "left").select(
        "key", "name", F.sum("n").over(higher).alias("breaches"), F.min("a").over(higher).alias("first_ts"),
        F.max("z").over(higher).alias("last_ts"), F.max("m").over(higher).alias("max_value")).where(F.col("breaches") > 0)


def counter_rates(samples: DataFrame, keys: Sequence[str], window_seconds: int = 300,
                  like: DataFrame | None = None) -> DataFrame:
    """samples(keys..., ts, id, counter) -> rate over [t-window, t] and irate.

    delta = v - prev, or v after a reset (v < prev). The window increase sums
    the deltas of in-window samples except the first one (no extrapolation).
    irate uses the last two samples; it is null if they share a timestamp.

    Samples are taken in the order (ts, id, counter); those of one timestamp are in the same windows.
    The window's ends are ordinals: each sample asks for the first one not older than the window, and
    questions and samples are numbered together, so one hot key or hour is cut like any other rows.
    The increase is the difference of two running sums. Samples without a time or counter are left out.
    Samples that carry an ordinal keep it; ``like`` is a plain table whose times are spread alike (see
    ``with_ordinal``)."""
    keys, like = list(keys), samples if like is None else like
    s = (samples.where(F.col("ts").isNotNull() & F.col("counter").isNotNull())
         .withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))))
    o = s if ORD in s.columns else with_ordinal(s, keys, ["ts", "id", "counter"], like=like)
    ch = halo_chunks(o, halo=1, chunk_rows=65536)
    w = Window.partitionBy(*keys, CHUNK).orderBy(ORD)
    d = (ch.withColumn("_pv", F.lag("counter").over(w)).withColumn("_pus", F.lag("_us").over(w))
         .where(~F.col(HALO)).drop(CHUNK, HALO))
    delta = (F.when(F.col("_pv").isNull(), F.lit(0.0))
             .when(F.col("counter") < F.col("_pv"), F.col("counter").cast("double"))
             .otherwise((F.col("counter") - F.col("_pv")).cast("double")))
    d = materialize(linear_scan(d.withColumn("_delta", delta), keys, ORD, "_delta", 1.0, "_sum"), "counter-sums")
    both = (d.select(*keys, F.col("_us").alias("_x"), F.lit(1).alias("_k"), F.col(ORD).alias("_i"))
            .unionByName(d.select(*keys, (F.col("_us") - window_seconds * 1_000_000).alias("_x"),
                                  F.lit(0).alias("_k"), F.col(ORD).alias("_i"))))
    # before a question stand the samples older than the window, and as many questions as samples before its own
    times = like.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("_x"))
    asked = with_ordinal(both, keys, ["_x", "_k", "_i"], out="_c", like=times).where(F.col("_k") == 0).select(
        *keys, F.col("_i").alias(ORD), (F.col("_c") - F.col("_i")).alias("_first"))
    first = d.select(*keys, F.col(ORD).alias("_first"), F.col("_sum").alias("_from"))
    last = d.groupBy(*keys, "_us").agg(F.max_by("_sum", ORD).alias("_to"))
    r = join_null_safe(join_null_safe(join_null_safe(d, asked, [*keys, ORD]), first, [*keys, "_first"]), last, [*keys, "_us"])
    irate = F.when(F.col("_pv").isNotNull(), F.try_divide(F.col("_delta"), (F.col("_us") - F.col("_pus")) / F.lit(1e6)))
    return r.select(*keys, "ts", "id", "counter",
                    ((F.col("_to") - F.col("_from")) / window_seconds).alias("rate"), irate.alias("irate"))


def bucket_start(ts: str | Column, seconds: int) -> Column:
    """Start of the tumbling period containing ts, as 'yyyy-MM-dd HH:mm:ss'."""
    c = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(c.cast("timestamp"))
    start = F.timestamp_micros(F.floor(us / (seconds * 1_000_000)) * (seconds * 1_000_000))
    return F.date_format(start, "yyyy-MM-dd HH:mm:ss")


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def period_grid(agg: DataFrame, key: str, period_col: str, step: int) -> DataFrame:
    """Complete (key, period) grid between each key's first and last period.

    One row per key and period; built from the per-key bounds so its size is
    the time span divided by the period, independent of data volume."""
    b = agg.groupBy(key).agg(F.min(period_col).alias("_lo"), F.max(period_col).alias("_hi"))
    g = b.select(key, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias(period_col))
    return g.join(agg, [key, period_col], "left")


def n_of_m(grid: DataFrame, key: str, order: str, breach: Column, n: int, m: int) -> DataFrame:
    """alarm when at least n of the last m periods breach (missing periods in
    the grid count as not breaching)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(m - 1), 0)
    g = grid.withColumn("breaching", F.coalesce(breach, F.lit(False)))
    return g.withColumn("alarm", F.sum(F.col("breaching").cast("int")).over(w) >= n)


def sustained(grid: DataFrame, key: str, order: str, cond: str, min_periods: int) -> DataFrame:
    """Runs of consecutive periods with ``cond`` true lasting >= min_periods
    (gaps and islands: run id = running count of false rows)."""
    w = Window.partitionBy(key).orderBy(order)
    g = grid.withColumn("_run", F.sum((~F.col(cond)).cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = g.where(F.col(cond)).groupBy(key, "_run").agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"),
        F.count(F.lit(1)).alias("periods"))
    return runs.where(F.col("periods") >= min_periods).drop("_run")


def transitions(grid: DataFrame, key: str, order: str, state: Column,
                initial: str = "OK") -> DataFrame:
    """Rows where the state differs from the previous period's (or from
    ``initial`` for the first period)."""
    w = Window.partitionBy(key).orderBy(order)
    g = grid.withColumn("state", state).withColumn(
        "previous", F.coalesce(F.lag("state").over(w), F.lit(initial)))
    return g.where(F.col("state") != F.col("previous"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = 10_000, parts: int = 256) -> DataFrame:
    """Exact linear-interpolated quantiles (position p*(n-1)) without sending a
    whole group to one task, the same way for any group size.

    1. equal values are counted before anything is ordered, so ties are one row;
    2. percentile_approx cuts each group into ``parts`` value ranges; their exact
       counts place every range among the ranks;
    3. only ranges that hold a wanted rank are ordered, by distinct value.
    A null key is a group of its own; null values are not counted.
    """
    keys = list(keys)
    some = df.select(*keys, F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    counts = some.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    cuts = [i / parts for i in range(1, parts)]
    bounds = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                     F.percentile_approx("_x", cuts, accuracy).alias("_b"))
    placed = join_null_safe(counts, bounds.select(*keys, "_b"), keys).withColumn(
        "_k", F.size(F.filter("_b", lambda b: b < F.col("_x")))).drop("_b")
    prior = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "_k").agg(F.sum("_c").alias("_rc")).withColumn(
        "_off", F.coalesce(F.sum("_rc").over(prior), F.lit(0)))
    pos = F.col("_p") * (F.col("_n") - 1)
    wanted = bounds.select(*keys, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_q", "_p"))
    wanted = wanted.select(*keys, "_q", (pos - F.floor(pos)).alias("_frac"), F.explode(F.array(
        F.struct(F.floor(pos).alias("r"), F.lit(0).alias("up")), F.struct(F.ceil(pos).alias("r"), F.lit(1).alias("up"))
    )).alias("_w"))
    wanted = join_null_safe(wanted, ranges, keys).where(
        (F.col("_w.r") >= F.col("_off")) & (F.col("_w.r") < F.col("_off") + F.col("_rc")))
    held = join_null_safe(placed, wanted.select(*keys, "_k", "_off").distinct(), [*keys, "_k"])
    w = Window.partitionBy(*keys, "_k").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("_end", F.col("_off") + F.sum("_c").over(w)).withColumn("_from", F.col("_end") - F.col("_c"))
    found = join_null_safe(wanted.drop("_off", "_rc"), held.drop("_off"), [*keys, "_k"]).where(
        (F.col("_w.r") >= F.col("_from")) & (F.col("_w.r") < F.col("_end")))
    res = found.groupBy(*keys, "_q", "_frac").agg(
        F.max(F.when(F.col("_w.up") == 0, F.col("_x"))).alias("_lo"),
        F.max(F.when(F.col("_w.up") == 1, F.col("_x"))).alias("_hi"))
    res = res.select(*keys, "_q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("_v"))
    out = res.groupBy(*keys).pivot("_q", list(range(len(probs)))).agg(F.first("_v"))
    for i, p in enumerate(probs):
        out = out.withColumnRenamed(str(i), f"p{round(p * 100):d}")
    return out


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 400) -> DataFrame:
    """keys..., n, sketch: a KLL sketch of the values of each group (say metric and period), a few kB each;
    to be written once and merged for any range of groups. Null and NaN values are not counted."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                              F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float], k: int = 400) -> DataFrame:
    """keys..., n, p<percent>...: quantiles of the merged sketches of each group, no raw value read."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("_s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(f"p{round(p * 100):d}")
                                       for p in probs])


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """buckets(keys..., le DOUBLE (inf for +Inf), cnt non-cumulative) ->
    quantile with linear interpolation inside the bucket that holds rank q*total;
    the +Inf bucket answers with the largest finite bound. Keys without any count have no
    quantile (null)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("le")
    b = (buckets.withColumn("cum", F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("prev_le", F.lag("le").over(w))
         .withColumn("prev_cum", F.coalesce(F.lag("cum").over(w), F.lit(0)))
         .withColumn("prev_finite", F.max(F.when(~F.isnan("le") & (F.col("le") != float("inf")),
                                                 F.col("le"))).over(Window.partitionBy(*keys)))
         .withColumn("total", F.sum("cnt").over(Window.partitionBy(*keys))))
    rank = F.lit(q) * F.col("total")
    hit = b.where(F.col("cum") >= rank).groupBy(*keys).agg(
        F.min_by(F.struct("le", "prev_le", "cum", "prev_cum", "prev_finite", "total"), "le").alias("h"))
    h = F.col("h")
    start = F.coalesce(h["prev_le"], F.lit(0.0))
    val = (F.when(h["le"] == float("inf"), h["prev_finite"])
           .when(h["prev_le"].isNull() & (h["le"] <= 0), h["le"])
           .otherwise(start + (h["le"] - start) *
                      F.try_divide(F.lit(q) * h["total"] - h["prev_cum"], h["cum"] - h["prev_cum"])))
    return hit.select(*keys, F.when(h["total"] > 0, val).alias("quantile"))
