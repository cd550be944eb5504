"""Scaling of columns within a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.helpers import percentiles


def clipped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def robust_minmax(df: DataFrame, columns: list[str], valid: Column | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Each column from its low to its high percentile within stream_id, clipped to 0..1.

    valid: percentiles are taken from these rows only and applied to all. Where both are equal, values are only clipped.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = (df if valid is None else df.where(valid)).select("stream_id", each.alias("x")).select("stream_id", "x.*")
    bounds = percentiles(long, "v", {"lo": low, "hi": high}, ["stream_id", "name"])
    at = lambda c, end: F.max(F.when(F.col("name") == c, F.col(end))).alias(f"__{end}_{c}")
    df = df.join(bounds.groupBy("stream_id").agg(*[at(c, end) for c in columns for end in ("lo", "hi")]), "stream_id", "left")
    for c in columns:
        span = F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
        df = df.withColumn(c, clipped(F.when(span > 0, (F.col(c) - F.col(f"__lo_{c}")) / span).otherwise(F.col(c)))).drop(f"__lo_{c}", f"__hi_{c}")
    return df


def minmax(df: DataFrame, column: str) -> DataFrame:
    bounds = df.groupBy("stream_id").agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(bounds, "stream_id").withColumn(column, F.when(span > 0, (F.col(column) - F.col("__lo")) / span).otherwise(F.col(column))).drop("__lo", "__hi")


def zscore(df: DataFrame, column: str, eps: float = 1e-9) -> DataFrame:
    stats = df.groupBy("stream_id").agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(stats, "stream_id").withColumn(column, (F.col(column) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def mad_scale(df: DataFrame, column: str, eps: float = 1e-9) -> DataFrame:
    """Distance from the median in units of 1.4826 median absolute deviations."""
    df = df.join(percentiles(df, column, {"__med": 0.5}), "stream_id")
    df = df.withColumn("__dev", F.abs(F.col(column) - F.col("__med")))
    df = df.join(percentiles(df, "__dev", {"__mad": 0.5}), "stream_id")
    return df.withColumn(column, (F.col(column) - F.col("__med")) / (1.4826 * F.col("__mad") + eps)).drop("__med", "__dev", "__mad")
