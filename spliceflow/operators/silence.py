"""Silent stretches: finding, keeping the rest, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.helpers import in_line, interval_join, near, running_sum, runs


def is_silent(x: Column, limit: float) -> Column:
    return F.abs(x) <= limit


def loudest_channel(channels: Column) -> Column:
    """Largest magnitude over the channels of a sample; in double, so the lowest 16-bit value is loud."""
    return F.array_max(F.transform(channels, lambda c: F.abs(c.cast("double"))))


def regions(rows: DataFrame, shortest: int = 1) -> DataFrame:
    """stream_id, i0, i1 (half open) of gap-free runs of the rows given, of at least `shortest` rows."""
    out = runs(rows.select("stream_id", "idx")).groupBy("stream_id", "run").agg((F.max("idx") + 1).alias("i1"))
    return out.select("stream_id", F.col("run").alias("i0"), "i1").where(F.col("i1") - F.col("i0") >= shortest)


def silent_regions(signal: DataFrame, limit: float, shortest: int) -> DataFrame:
    return regions(signal.where(is_silent(F.col("x"), limit)), shortest)


def complement(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """What the regions (stream_id, i0, i1) leave of streams of length n (stream_id, n)."""
    ends = found.unionByName(lengths.select("stream_id", F.col("n").alias("i0"), F.col("n").alias("i1")))
    rows = near(in_line(ends, "i0", "i1"), 1, 0, {"__before": lambda w: F.lag("i1").over(w)})
    out = rows.select("stream_id", F.coalesce("__before", F.lit(0)).cast("long").alias("a"), F.col("i0").alias("b"))
    return out.where("b > a").select("stream_id", F.col("a").alias("i0"), F.col("b").alias("i1"))


def removed_stats(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per stream: regions, samples in them, percent of the stream, and length before over length after."""
    sums = found.groupBy("stream_id").agg(F.count("*").alias("n_regions"), F.sum(F.col("i1") - F.col("i0")).alias("removed"))
    out = lengths.join(sums, "stream_id", "left").na.fill(0, ["n_regions", "removed"])
    left = F.col("n") - F.col("removed")
    return out.select("stream_id", "n_regions", "removed", (100.0 * F.col("removed") / F.col("n")).alias("percent"), F.when(left > 0, F.col("n") / left).alias("ratio"))


def renumbered(kept: DataFrame) -> DataFrame:
    """Add out_idx: the place of each row (stream_id, idx) when gaps are closed."""
    out = running_sum(kept, F.lit(1), "__n")
    return out.withColumn("out_idx", (F.col("__n") - 1).cast("long")).drop("__n")


def without_silence(signal: DataFrame, limit: float, shortest: int) -> DataFrame:
    """The samples outside silent regions, moved together: stream_id, idx, x, out_idx."""
    found = silent_regions(signal, limit, shortest).withColumn("__silent", F.lit(True))
    inside = interval_join(signal, found, 4096, "left").where("__silent is null")
    return renumbered(inside.select("stream_id", "idx", "x"))
