"""The driver's tables as signals, frames, features and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceflow.helpers import with_index

#: Order and line number do not name a line item alone.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, x: the events' values, a stream for each type, in order of time.

    A minute is numbered in one task: at 44.1 kHz, 2.6 million samples of a stream, however long that is.
    """
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), "ts", "event_id", F.col("value").alias("x"))
    return with_index(rows, ["stream_id"], ["ts", "event_id"], F.date_trunc("minute", "ts")).select("stream_id", "idx", "x")


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal less its stream's mean."""
    rows = signal(spark, sf_dir)
    return rows.join(rows.groupBy("stream_id").agg(F.avg("x").alias("m")), "stream_id").select("stream_id", "idx", (F.col("x") - F.col("m")).alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_id, samples: the embeddings as frames of 64 samples, a stream for each label."""
    rows = read(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("string").alias("stream_id"), "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    return with_index(rows, ["stream_id"], ["vec_id"], F.floor(F.col("vec_id") / 65536), "frame_id").select("stream_id", "frame_id", "samples")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, six feature columns and valid, from line items in order of order and line."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stream_id"), *LINE_ORDER, F.col("l_quantity").alias("centroid"), F.col("l_discount").alias("rms"), F.col("l_tax").alias("rolloff"),
        F.col("l_extendedprice").alias("zcr"), (F.col("l_quantity") * F.col("l_discount")).alias("flux"), (F.col("l_extendedprice") * F.col("l_tax")).alias("bandwidth"), (F.col("l_quantity") >= 5).alias("valid"),
    )
    return with_index(rows, ["stream_id"], LINE_ORDER, F.floor(F.col("l_orderkey") / 65536)).drop(*LINE_ORDER)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track (0 to 2), idx, x: prices of orders by status."""
    rows = read(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O', 'P')").select("o_orderstatus", "o_orderkey", F.col("o_totalprice").alias("x"))
    rows = with_index(rows, ["o_orderstatus"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 65536))
    return rows.select((F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)).alias("track"), "idx", "x")


def track_length(tracks: DataFrame, longest: bool = False) -> int:
    """Of the shortest track, or the longest."""
    return tracks.groupBy("track").count().agg((F.max if longest else F.min)("count")).first()[0] or 0


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of all lengths, from one sample on: the line items of each order by line, a stream for each order."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("stream_id"), *LINE_ORDER, F.col("l_quantity").alias("x"))
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("stream_id").orderBy(*LINE_ORDER)) - 1).cast("long")).select("stream_id", "idx", "x")
