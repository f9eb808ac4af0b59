"""Metric sources: a registry of named metric providers, saved metric API
responses (instant and range queries), cloud-style period datapoints, metric
selection, label matchers and relabel rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.session import materialize

POINT_SCHEMA = "metric string, ts timestamp_ntz, id long, value double, labels map<string,string>"

INSTANT_SCHEMA = ("struct<status:string,data:struct<result:array<struct<metric:map<string,string>,"
                  "value:array<string>>>>>")
RANGE_SCHEMA = ("struct<status:string,data:struct<result:array<struct<metric:map<string,string>,"
                "values:array<array<string>>>>>>")

Provider = Callable[[SparkSession], DataFrame]


class MetricRegistry:
    """Named providers, each ``fn(spark) -> DataFrame`` of metric points.

    ``collect`` unions the selected providers (all when ``names`` is empty;
    unknown names are skipped) and skips providers that fail, when they are built or when
    they are executed, as the monitor skips a failing collector instead of recording 0.
    Collecting executes each provider once: its points are written to the shared folder."""

    def __init__(self) -> None:
        self._providers: dict[str, Provider] = {}

    def register_metric(self, name: str, fn: Provider) -> None:
        self._providers[name] = fn

    def names(self) -> list[str]:
        return list(self._providers)

    def collect(self, spark: SparkSession, names: Iterable[str] | None = None) -> tuple[DataFrame, list[str]]:
        wanted = [n for n in (names or self._providers) if n in self._providers]
        out, failed = None, []
        for n in wanted:
            try:
                src = self._providers[n](spark)
                df = src.select(
                    F.lit(n).alias("metric"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                    F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"),
                    (F.col("labels") if "labels" in src.columns
                     else F.create_map().cast("map<string,string>")).alias("labels"))
                df = materialize(df, "collected-metric")
            except Exception:  # noqa: BLE001 - a failing collector is skipped
                failed.append(n)
                continue
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = spark.createDataFrame([], POINT_SCHEMA)
        return out, failed


def select_metrics(points: DataFrame, metrics: Sequence[str] | None) -> DataFrame:
    """Listed metrics only; empty or None means all."""
    return points if not metrics else points.where(F.col("metric").isin(list(metrics)))


def parse_instant(responses: DataFrame, col: str = "response") -> DataFrame:
    """Instant-query response -> value of the first series (null when the
    result is empty or the response is unreadable)."""
    r = F.from_json(col, INSTANT_SCHEMA)
    first = F.try_element_at(r["data"]["result"], F.lit(1))
    return responses.withColumn("value", F.get(first["value"], F.lit(1)).try_cast("double"))


def parse_range(responses: DataFrame, col: str = "response") -> DataFrame:
    """Range-query response -> long table (labels, ts, value), one row per sample."""
    s = responses.select("*", F.explode(F.from_json(col, RANGE_SCHEMA)["data"]["result"]).alias("_s"))
    p = s.select("*", F.explode("_s.values").alias("_v"))
    return p.select(*[c for c in responses.columns if c != col], F.col("_s.metric").alias("labels"),
                    F.timestamp_seconds(F.get("_v", F.lit(0)).try_cast("double")).cast("timestamp_ntz").alias("ts"),
                    F.get("_v", F.lit(1)).try_cast("double").alias("value"))


def latest_period_avg(points: DataFrame, key: str = "metric", period_seconds: int = 300) -> DataFrame:
    """Average per period over a look-back of two periods before each key's
    latest point; the answer is the most recent period's average (the
    reference takes an arbitrary datapoint of the two)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    p_us = period_seconds * 1_000_000
    latest = points.groupBy(key).agg(F.max(us).alias("_end"))
    j = points.join(latest, key).where(us > F.col("_end") - 2 * p_us)
    per = j.groupBy(key, F.floor(us / p_us).alias("_p")).agg(F.avg("value").alias("_avg"))
    return per.groupBy(key).agg(F.max_by("_avg", "_p").alias("average"),
                                F.max("_p").alias("_p")).select(
        key, "average", F.timestamp_micros(F.col("_p") * p_us).cast("timestamp_ntz").alias("period_start"))


def _anchored(rx: str) -> str:
    return f"^(?:{rx})$"


def match_labels(df: DataFrame, eq: Mapping[str, str] | None = None, re: Mapping[str, str] | None = None,
                 nre: Mapping[str, str] | None = None, ne: Mapping[str, str] | None = None,
                 labels: str = "labels") -> DataFrame:
    """Label matchers: =, !=, =~ and !~ (regexes anchored at both ends);
    a missing label reads as the empty string."""
    cond = F.lit(True)
    lab = lambda k: F.coalesce(F.col(labels)[k], F.lit(""))
    for k, v in (eq or {}).items():
        cond = cond & (lab(k) == v)
    for k, v in (ne or {}).items():
        cond = cond & (lab(k) != v)
    for k, v in (re or {}).items():
        cond = cond & lab(k).rlike(_anchored(v))
    for k, v in (nre or {}).items():
        cond = cond & ~lab(k).rlike(_anchored(v))
    return df.where(cond)


def relabel(df: DataFrame, rules: Sequence[Mapping], labels: str = "labels") -> DataFrame:
    """Apply relabel rules in order to a MAP<STRING,STRING> label column.

    action 'keep' / 'drop': source labels joined with ';' matched (anchored)
    against ``regex``; 'replace': on a match ``target`` = ``replacement`` with
    capture groups ($1); 'labelmap': labels whose name matches ``regex`` are
    copied under the ``replacement`` name."""
    out = df
    for r in rules:
        act = r.get("action", "replace")
        rx = _anchored(r.get("regex", "(.*)"))
        src = F.concat_ws(r.get("separator", ";"),
                          *[F.coalesce(F.col(labels)[s], F.lit("")) for s in r.get("source_labels", [])])
        if act == "keep":
            out = out.where(src.rlike(rx))
        elif act == "drop":
            out = out.where(~src.rlike(rx))
        elif act == "replace":
            new = F.regexp_replace(src, rx, r.get("replacement", "$1"))
            out = out.withColumn(labels, F.when(src.rlike(rx), F.map_concat(
                F.map_filter(labels, lambda k, v: k != r["target_label"]),
                F.create_map(F.lit(r["target_label"]), new))).otherwise(F.col(labels)))
        elif act == "labelmap":
            renamed = F.transform_keys(F.map_filter(labels, lambda k, v: k.rlike(rx)),
                                       lambda k, v: F.regexp_replace(k, rx, r.get("replacement", "$1")))
            out = out.withColumn(labels, F.map_concat(
                F.map_filter(labels, lambda k, v: ~F.array_contains(F.map_keys(renamed), k)), renamed))
        else:
            raise ValueError(f"unknown relabel action {act}")
    return out


def split_key(key: str | Column) -> Column:
    """'{project}/{variation}/{timestamp}/{file...}' -> struct of the parts."""
    k = F.col(key) if isinstance(key, str) else key
    parts = F.split(k, "/", 4)
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("project", "variation", "stamp", "file"))])
