"""Segments between boundaries, their features, and what holds within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.helpers import in_line, interval_join, near, percentiles


def segments(bounds: DataFrame, dead_zone: float = 0.0, shortest: float = 0.0) -> DataFrame:
    """Neighbouring boundaries (stream_id, t) as seg_id, t0, t1. dead_zone is cut off at inner edges; empty and short go."""
    rows = in_line(bounds.select("stream_id", "t"), "t")
    n = rows.groupBy("stream_id").agg(F.count("*").alias("n"))
    rows = near(rows, 0, 1, {"t1": lambda w: F.lead("t").over(w)}).join(n, "stream_id").withColumnRenamed("idx", "seg_id").where("t1 is not null")
    t0 = F.when(F.col("seg_id") > 0, F.col("t") + dead_zone).otherwise(F.col("t"))
    t1 = F.when(F.col("seg_id") < F.col("n") - 2, F.col("t1") - dead_zone).otherwise(F.col("t1"))
    rows = rows.select("stream_id", F.col("seg_id").cast("long").alias("seg_id"), t0.alias("t0"), t1.alias("t1")).where("t1 > t0")
    return rows.where(F.col("t1") - F.col("t0") >= shortest) if shortest > 0 else rows


def as_rows(segs: DataFrame, rate: float = 1.0) -> DataFrame:
    """Add i0, i1: the first row at or after t0, and at or after t1 (half open), where row i stands at i / rate."""
    return segs.withColumns({"i0": F.ceil(F.col("t0") * rate).cast("long"), "i1": F.ceil(F.col("t1") * rate).cast("long")})


def within(points: DataFrame, segs: DataFrame, width: int = 4096, how: str = "inner") -> DataFrame:
    """points with the segment (stream_id, seg_id, i0, i1) that each lies in."""
    return interval_join(points, segs.select("stream_id", "seg_id", "i0", "i1"), width, how)


def segment_means(points: DataFrame, segs: DataFrame, columns: list[str]) -> DataFrame:
    inside = within(points, segs)
    means = inside.groupBy("stream_id", "seg_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], F.count("*").alias("n_points"))
    return segs.join(means, ["stream_id", "seg_id"])


def valid_ratio(points: DataFrame, segs: DataFrame, valid: Column, least: float = 0.3) -> DataFrame:
    """segs with the share of their points that are valid; those below `least` go, those without points stay (null)."""
    shares = within(points, segs).groupBy("stream_id", "seg_id").agg(F.avg(valid.cast("int")).alias("valid_ratio"))
    return segs.join(shares, ["stream_id", "seg_id"], "left").where(F.coalesce(F.col("valid_ratio") >= least, F.lit(True)))


def label_summary(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Per label: how many, and means; labels in letters."""
    out = labelled.groupBy("stream_id", "label").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    return out.withColumn("letter", letter(F.col("label")))


def letter(label: Column) -> Column:
    """A, B, ...; beyond Z, Cluster_n."""
    return F.when(label < 26, F.char(label + 65)).otherwise(F.concat(F.lit("Cluster_"), label.cast("string")))


def choose_k(rows: DataFrame, column: str, wide: float, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Per stream: 3 clusters if the column spreads over more than `wide` between two percentiles, else 2."""
    spread = percentiles(rows, column, {"__lo": low, "__hi": high})
    return spread.select("stream_id", (F.col("__hi") - F.col("__lo")).alias("spread"), F.when(F.col("__hi") - F.col("__lo") > wide, 3).otherwise(2).alias("k"))


def truth_hits(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """Per stream: how many true marks (t) have a found one (t) within tolerance, and the share.

    Both are listed by blocks of the tolerance's size; a mark looks at its own block and both neighbours.
    """
    width = max(tolerance, 1e-9)
    near = found.select(F.col("stream_id").alias("s"), F.col("t").alias("f"), F.explode(F.array(*[F.floor(F.col("t") / width) + d for d in (-1, 0, 1)])).alias("b"))
    marks = truth.withColumn("__b", F.floor(F.col("t") / width))
    hit = marks.join(near, (F.col("stream_id") == F.col("s")) & (F.col("__b") == F.col("b")) & (F.abs(F.col("t") - F.col("f")) <= tolerance), "left_semi")
    hits = hit.groupBy("stream_id").agg(F.count("*").alias("n_hit"))
    out = truth.groupBy("stream_id").agg(F.count("*").alias("n_truth")).join(hits, "stream_id", "left").na.fill(0, ["n_hit"])
    return out.withColumn("hit_rate", F.col("n_hit") / F.col("n_truth"))
