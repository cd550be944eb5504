"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf


def register(spark: SparkSession) -> None:
    """Make frame_bins(TABLE(frames), rate) known to SQL: stream_id, frame_id and k, hz, power of each bin of its spectrum.

    frames: stream_id, frame_id, samples. Frames come in Arrow batches, those of one length are transformed together; a
    null or empty frame has no bins.
    """

    @arrow_udtf(returnType="stream_id string, frame_id long, k int, hz double, power double")
    class FrameBins:
        def eval(self, frames: pa.RecordBatch, rate: pa.Array) -> Iterator[pa.Table]:
            frames = frames.filter(frames.column("samples").is_valid())
            lengths = pc.list_value_length(frames.column("samples")).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0]):
                part = frames.filter(pa.array(lengths == n))
                x = part.column("samples").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, int(n))
                power = np.abs(np.fft.rfft(x, axis=1)) ** 2
                bins = np.tile(np.arange(power.shape[1]), len(x))
                of = pa.array(np.repeat(np.arange(len(x)), power.shape[1]))
                yield pa.table({
                    "stream_id": part.column("stream_id").take(of), "frame_id": part.column("frame_id").take(of), "k": pa.array(bins, pa.int32()), "hz": pa.array(bins * rate[0].as_py() / n), "power": pa.array(power.ravel()),
                })

    spark.udtf.register("frame_bins", FrameBins)
