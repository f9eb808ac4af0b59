"""Capacity planning: linear trend forecast, growth, breach date, right-sizing
and cost. Series are (key, x, y) with x the 0-based position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (must equal the reference's).
MIN_FORECAST_POINTS = 7
DEFAULT_HORIZON = 30
DEFAULT_CAPACITY_THRESHOLD = 100.0
DEFAULT_HOURLY_RATE = 0.0416
PRICE_LIST = [  # instance_type, hourly USD
    ("t3.micro", 0.0104),
    ("t3.small", 0.0208),
    ("t3.medium", 0.0416),
    ("t3.large", 0.0832),
]
CPU_LOW, MEM_LOW, CPU_HIGH, MEM_HIGH = 20.0, 40.0, 80.0, 85.0


def daily_series(df: DataFrame, key: str, day: str, y: str) -> DataFrame:
    """Positions 0..n-1 per key in day order (uneven spacing is ignored).

    The input is one row per (key, day), so each key holds at most one row
    per day and the per-key window stays small."""
    w = Window.partitionBy(key).orderBy(day)
    return df.select(key, day, y, (F.row_number().over(w) - 1).alias("x"))


def trend(series: DataFrame, key: str, min_points: int = MIN_FORECAST_POINTS) -> DataFrame:
    """Least-squares slope/intercept over (x, y), growth of the second half
    over the first half (split at n//2), n and the last day per key."""
    n = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    s = series.join(n, key)
    half = F.floor(F.col("n") / 2)
    t = s.groupBy(key).agg(
        F.first("n").alias("n"),
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
        F.avg("x").alias("_mx"), F.avg("y").alias("_my"),
        F.avg(F.when(F.col("x") < half, F.col("y"))).alias("_h1"),
        F.avg(F.when(F.col("x") >= half, F.col("y"))).alias("_h2"),
        F.max("day").alias("base_day")).where(F.col("n") >= min_points)
    growth = F.when(F.col("_h1") > 0, (F.col("_h2") - F.col("_h1")) / F.col("_h1") * 100).otherwise(0.0)
    return t.select(key, "n", "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"),
                    growth.alias("growth_rate"), "base_day")


def linear_forecast(tr: DataFrame, key: str, horizon: int = DEFAULT_HORIZON) -> DataFrame:
    """value_i = max(0, slope*(n+i) + intercept) on base_day + i, i = 1..horizon."""
    f = tr.select(key, "n", "slope", "intercept", "base_day",
                  F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return f.select(key, "step", F.date_add("base_day", F.col("step")).alias("day"),
                    F.greatest(F.lit(0.0), F.col("slope") * (F.col("n") + F.col("step")) +
                               F.col("intercept")).alias("value"))


def forecast_report(tr: DataFrame, key: str, horizon: int = DEFAULT_HORIZON,
                    threshold: float = DEFAULT_CAPACITY_THRESHOLD) -> DataFrame:
    """Trend + first breach day above ``threshold`` + urgency (<7 days high)."""
    fc = linear_forecast(tr, key, horizon)
    breach = fc.where(F.col("value") > threshold).groupBy(key).agg(
        F.min("step").alias("days_until_breach"), F.min("day").alias("breach_day"))
    return (tr.join(breach, key, "left")
            .withColumn("urgency", F.when(F.col("breach_day").isNull(), F.lit(None).cast("string"))
                        .when(F.col("days_until_breach") < 7, "high").otherwise("medium")))


def _pct0(c: F.Column) -> F.Column:
    # '%.0f' with ties to even, as for short decimals in the reference output
    return F.format_string("%.0f", F.bround(c, 0))


def rightsize(util: DataFrame) -> DataFrame:
    """util(instance_type, avg_cpu, avg_memory) -> recommendation and reason."""
    cpu, mem = F.col("avg_cpu"), F.col("avg_memory")
    text = F.concat(F.lit("(CPU: "), _pct0(cpu), F.lit("%, Memory: "), _pct0(mem), F.lit("%)"))
    rec = (F.when((cpu < CPU_LOW) & (mem < MEM_LOW), "downgrade")
           .when((cpu > CPU_HIGH) | (mem > MEM_HIGH), "upgrade").otherwise("keep"))
    reason = (F.when(rec == "downgrade", F.concat(F.lit("Low utilization "), text))
              .when(rec == "upgrade", F.concat(F.lit("High utilization "), text))
              .otherwise(F.concat(F.lit("Utilization is appropriate "), text)))
    return util.select("*", rec.alias("recommended"), reason.alias("reason"),
                       F.when(rec == "downgrade", "30-50%").alias("estimated_savings"))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICE_LIST, "instance_type string, hourly double")


def estimate_cost(fleet: DataFrame, prices: DataFrame) -> DataFrame:
    """fleet(instance_type, count) -> hourly rate (default 0.0416), monthly and
    yearly estimate (yearly from the unrounded month), rounded to cents."""
    j = fleet.join(F.broadcast(prices), "instance_type", "left")  # price list: a few rows
    rate = F.coalesce(F.col("hourly"), F.lit(DEFAULT_HOURLY_RATE))
    monthly = rate * 24 * 30 * F.col("count")
    return j.select("instance_type", "count", rate.alias("hourly_rate"),
                    F.round(monthly, 2).alias("monthly_usd"),
                    F.round(monthly * 12, 2).alias("yearly_usd"))
