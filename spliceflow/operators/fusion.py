"""Fusing the events of several detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.config import Fusion
from spliceflow.helpers import cut, in_line, near
from spliceflow.operators.changepoint import earliest_first


def fused(events: DataFrame, difference: float, bucket: Column) -> DataFrame:
    """Chain events (stream_id, t, method, score) that follow within `difference` of their predecessor.

    Per chain: t (median), methods (sorted), score_sum, score_max, n. bucket: a coarse time for ordering in parallel; an
    event's predecessor is looked for within its bucket, then in the last event of the buckets before.
    """
    e = cut(events).withColumn("__bucket", bucket)
    lasts = e.groupBy("stream_id", "__bucket").agg(F.max("t").alias("__t"))
    before = Window.partitionBy("stream_id").orderBy("__bucket")
    lasts = lasts.withColumn("__earlier", F.lag("__t").over(before)).drop("__t")
    own = Window.partitionBy("stream_id", "__bucket").orderBy("t", "method")
    e = e.join(lasts, ["stream_id", "__bucket"]).withColumn("__prev", F.coalesce(F.lag("t").over(own), "__earlier"))
    new = F.col("__prev").isNull() | (F.col("t") - F.col("__prev") > difference)
    e = e.withColumn("__start", F.when(new, F.struct("t", "method")))
    started = e.groupBy("stream_id", "__bucket").agg(F.max("__start").alias("__s"))
    started = started.withColumn("__carried", F.last("__s", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))).drop("__s")
    e = e.join(started, ["stream_id", "__bucket"]).withColumn("__chain", F.coalesce(F.last("__start", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "__carried"))
    return e.groupBy("stream_id", "__chain").agg(
        F.median("t").alias("t"), F.array_sort(F.collect_set("method")).alias("methods"), F.sum("score").alias("score_sum"), F.max("score").alias("score_max"), F.count("*").alias("n_events"),
    ).drop("__chain")


def prioritised(clusters: DataFrame, fusion: Fusion) -> DataFrame:
    """Without clusters that only weak methods saw; priority 1 for three methods or more, 2 for two, 3 for one."""
    strong = F.size(F.array_except("methods", F.array(*[F.lit(m) for m in fusion.ignore_only]))) > 0
    n = F.size("methods")
    return clusters.where(strong).withColumn("priority", F.when(n >= 3, 1).when(n == 2, 2).otherwise(3))


def boundary_list(ends: DataFrame, inner: DataFrame, shortest: float, eps: float = 1e-6) -> DataFrame:
    """stream_id, t: 0, inner times in range and at least `shortest` apart (the earlier stay), and the stream's end.

    ends: stream_id, t. The end is always a boundary; times within eps of a previous one are the same.
    """
    end = ends.select("stream_id", F.col("t").alias("__end"))
    rows = inner.select("stream_id", "t").join(end, "stream_id").where("t >= 0 and t <= __end")
    rows = rows.unionByName(end.select("stream_id", F.explode(F.array(F.lit(0.0), F.col("__end"))).alias("t"), "__end")).distinct()
    rows = near(in_line(rows.select("stream_id", "t"), "t"), 1, 0, {"__p": lambda w: F.lag("t").over(w)})
    rows = in_line(rows.where(F.col("__p").isNull() | (F.col("t") - F.col("__p") > eps)).select("stream_id", "t"), "t")
    kept = earliest_first(rows, shortest, "t", start=None)
    return kept.select("stream_id", "t").unionByName(end.select("stream_id", F.col("__end").alias("t"))).distinct()
