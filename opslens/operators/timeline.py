"""Incident timelines: union of alerts, changes and related incidents, gap
clustering, source counts, durations and change-before-first-alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.operators.ordered import CHUNK, HALO, ORD, asof_join, halo_chunks, linear_scan, with_ordinal

GAP_SECONDS = 300   # events closer than this (strictly) join a cluster

TYPE_RANK = {"alert": 0, "config_change": 1, "related_incident": 2}


def epoch_micros(ts) -> F.Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def _ts_or_now(c: str) -> F.Column:
    """Timestamp with default now (missing ISO strings parse to now)."""
    col = F.col(c)
    return F.coalesce(col, F.current_timestamp().cast("timestamp_ntz"))


def timeline(alerts: DataFrame, changes: DataFrame, related: DataFrame) -> DataFrame:
    """Tagged union of the three incident parts.

    alerts(incident_id, fired_at, name, source, in_ord)
    changes(incident_id, timestamp, description, source, component, in_ord)
    related(incident_id, start_time, title, in_ord)
    -> incident_id, ord, ts, event_type, description, source
    ``ord`` orders by timestamp, ties in input order (alerts, changes, related).
    """
    a = alerts.select("incident_id", _ts_or_now("fired_at").alias("ts"),
                      F.lit("alert").alias("event_type"),
                      F.concat(F.lit("Alert: "), F.coalesce("name", F.lit("Unknown"))).alias("description"),
                      F.coalesce("source", F.lit("monitoring")).alias("source"),
                      F.lit(0).alias("_tr"), "in_ord")
    c = changes.select("incident_id", _ts_or_now("timestamp").alias("ts"),
                       F.lit("config_change").alias("event_type"),
                       F.concat(F.lit("Change: "), F.coalesce("description", F.lit("Unknown"))).alias("description"),
                       F.coalesce("source", F.lit("unknown")).alias("source"),
                       F.lit(1).alias("_tr"), "in_ord")
    r = related.select("incident_id", _ts_or_now("start_time").alias("ts"),
                       F.lit("related_incident").alias("event_type"),
                       F.concat(F.lit("Related: "), F.coalesce("title", F.lit("Unknown"))).alias("description"),
                       F.lit("incident_db").alias("source"),
                       F.lit(2).alias("_tr"), "in_ord")
    u = a.unionByName(c).unionByName(r)
    o = with_ordinal(u, ["incident_id"], ["ts", "_tr", "in_ord"])
    return o.select("incident_id", F.col(ORD).alias("ord"), "ts", "event_type", "description",
                    "source", "in_ord")


def gap_clusters(events: DataFrame, keys: list[str], gap_seconds: float = GAP_SECONDS,
                 ordinal: str = "ord") -> DataFrame:
    """Number clusters per key: a new cluster starts when the gap to the
    previous event (in ``ordinal`` order) is >= ``gap_seconds``.

    ``ordinal`` must be dense per key. Adds ``cluster`` (0-based)."""
    e = events.withColumn("_us", epoch_micros("ts"))
    ch = halo_chunks(e, halo=1, chunk_rows=65536, ordinal=ordinal)
    w = Window.partitionBy(*keys, CHUNK).orderBy(ordinal)
    s = (ch.withColumn("_pus", F.lag("_us").over(w)).where(~F.col(HALO))
         .withColumn("_start", F.when(F.col("_pus").isNull() |
                                      (F.col("_us") - F.col("_pus") >= int(gap_seconds * 1e6)), 1.0)
                     .otherwise(0.0))
         .drop(CHUNK, HALO, "_pus"))
    s = linear_scan(s, keys, ordinal, "_start", 1.0, "_cl")
    return s.withColumn("cluster", (F.round("_cl") - 1).cast("long")).drop("_cl", "_start", "_us")


def cluster_summary(clustered: DataFrame, keys: list[str], ordinal: str = "ord",
                    min_events: int = 2) -> DataFrame:
    """count, first/last time and first/last description of clusters with at
    least ``min_events`` events (member rows stay available in long form)."""
    return (clustered.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("description", ordinal).alias("first_event"),
        F.max_by("description", ordinal).alias("last_event"))
        .where(F.col("count") >= min_events))


def source_counts(tl: DataFrame) -> DataFrame:
    return tl.groupBy("incident_id", "source").agg(F.count(F.lit(1)).alias("count"))


def duration_text(seconds: F.Column, n: F.Column) -> F.Column:
    return (F.when(n < 2, F.lit("Unknown"))
            .when(seconds < 60, F.format_string("%.0f seconds", seconds))
            .when(seconds < 3600, F.format_string("%.0f minutes", seconds / 60))
            .otherwise(F.format_string("%.1f hours", seconds / 3600)))


def incident_duration(tl: DataFrame) -> DataFrame:
    d = tl.groupBy("incident_id").agg(F.count(F.lit(1)).alias("events"),
                                     F.min("ts").alias("start"), F.max("ts").alias("end"))
    secs = (epoch_micros("end") - epoch_micros("start")) / F.lit(1e6)
    return d.withColumn("seconds", secs).withColumn(
        "duration", duration_text(F.col("seconds"), F.col("events")))


def change_before_alert(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change strictly before the first alert of each incident
    (ties on time: the later input row wins)."""
    first = alerts.groupBy("incident_id").agg(F.min("fired_at").alias("first_alert"))
    cand = changes.join(first, "incident_id").where(F.col("timestamp") < F.col("first_alert"))
    best = cand.groupBy("incident_id", "first_alert").agg(
        F.max_by(F.struct("timestamp", "in_ord", "component", "description"),
                 F.struct("timestamp", "in_ord")).alias("c"))
    return best.select(
        "incident_id", "first_alert", F.col("c.timestamp").alias("change_ts"),
        F.col("c.in_ord").alias("change_id"),
        F.concat(F.lit("Change in "), F.coalesce("c.component", F.lit("unknown")), F.lit(": "),
                 F.coalesce("c.description", F.lit(""))).alias("root_cause"))


def change_before_each_alert(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Every alert with its latest change strictly before it (ties on time: the later input row
    wins), by an as-of join; alerts without an earlier change have none."""
    a = alerts.select("incident_id", F.col("fired_at").alias("timestamp"), F.col("in_ord").alias("alert_id"))
    found = asof_join(a, changes, ["incident_id"], "timestamp", ["in_ord"], ["component", "description"], out="c")
    return found.select(
        "incident_id", "alert_id", F.col("timestamp").alias("fired_at"), F.col("c.timestamp").alias("change_ts"),
        F.col("c.in_ord").alias("change_id"),
        F.when(F.col("c").isNotNull(), F.concat(F.lit("Change in "), F.coalesce("c.component", F.lit("unknown")), F.lit(": "),
                                                F.coalesce("c.description", F.lit("")))).alias("root_cause"))
