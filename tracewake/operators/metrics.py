"""Counters, histograms, ratios and the daily roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: bucket bounds of the histograms
TOKEN_BOUNDS = tuple(100 * 2**k for k in range(12))
STEP_BOUNDS = tuple(range(1, 97, 5))


def counter(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: tuple[int, ...]) -> DataFrame:
    """le, count (cumulative), with +Inf, and total and sum of the values; one pass, partial sums only."""
    v = F.col(value)
    counts = [F.coalesce(F.sum((v <= b).cast("long")), F.lit(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = df.where(v.isNotNull()).agg(*counts, F.count(v).alias("total"), F.coalesce(F.sum(v), F.lit(0)).alias("sum_value"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return agg.select(F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))), "total", "sum_value")


def share(df: DataFrame, hit: Column, by: list[str] | None = None, name: str = "ratio") -> DataFrame:
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(hit.cast("double")).alias(name), F.count(F.lit(1)).alias("n"))


def daily(tasks: DataFrame, results: DataFrame, hits: DataFrame) -> DataFrame:
    """date, total_tasks, avg_steps, avg_tokens, cache_hit_rate. hits: date, hit."""
    t = tasks.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).cast("int").alias("total_tasks"))
    r = results.groupBy(F.to_date("created_at").alias("date")).agg(F.avg("step_count").cast("decimal(10,2)").alias("avg_steps"), F.avg("token_usage").cast("decimal(10,2)").alias("avg_tokens"))
    h = hits.groupBy("date").agg(F.avg(F.col("hit").cast("double")).cast("decimal(5,4)").alias("cache_hit_rate"))
    return t.join(r, "date", "left").join(h, "date", "left")
