"""Cutting signals into frames, and tapers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hopping(signal: DataFrame, window: int, hop: int, pad: bool = False, per_chunk: int = 2048) -> DataFrame:
    """stream_id, frame_id, samples: all whole windows of `window` samples, `hop` apart. signal: stream_id, idx, x.

    Samples move once, in chunks of per_chunk frames, plus the overlap of neighbouring chunks. pad: a stream shorter than
    the window is one frame, filled up with zeros.
    """
    size = hop * per_chunk
    own = F.floor(F.col("idx") / size)
    over = window - hop
    if over <= 0:
        chunks = F.array(own)
    elif over <= size:
        chunks = F.array(own, F.when((F.col("idx") - own * size < over) & (own > 0), own - 1))
    else:
        chunks = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("idx") - (size - hop) - window + 1) / size)).cast("bigint"), own)
    rows = signal.select("stream_id", "idx", "x", F.explode(F.filter(chunks, lambda c: c.isNotNull())).alias("chunk"))
    packed = rows.groupBy("stream_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s")).withColumn("x", F.col("s.x")).drop("s")
    n = F.size("x")
    frames = F.least(F.lit(per_chunk), F.floor((n - window) / hop).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.struct((F.col("chunk") * per_chunk + i).cast("long").alias("frame_id"), F.slice("x", i * hop + 1, window).alias("samples")))
    whole = packed.where(n >= window).select("stream_id", F.explode(cut).alias("f")).select("stream_id", "f.*")
    if not pad:
        return whole
    short = packed.where((F.col("chunk") == 0) & (n < window))
    return whole.unionByName(short.select("stream_id", F.lit(0).cast("long").alias("frame_id"), F.concat("x", F.array_repeat(F.lit(0.0), F.lit(window) - n)).alias("samples")))


def tumbling(signal: DataFrame, window: int) -> DataFrame:
    """Frames without overlap; an incomplete last one is dropped."""
    return hopping(signal, window, window)


def taper(kind: str, n: int) -> list[float]:
    """Symmetric window of n values: hann, hamming or rect."""
    if kind == "rect" or n == 1:
        return [1.0] * n
    a = {"hann": 0.5, "hamming": 0.54}[kind]
    return [a - (1 - a) * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]


def tapered(samples: Column, kind: str, n: int) -> Column:
    weights = F.array(*[F.lit(v) for v in taper(kind, n)])
    return F.zip_with(samples, weights, lambda x, v: x * v)
