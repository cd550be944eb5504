"""Change of the sampling rate by a windowed sinc, over chunks with their neighbours' edges, in any number of tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side, its cutoff as a share of the lower Nyquist frequency, and the window's terms
#: (Blackman-Harris): together, what lies beyond the new Nyquist frequency stays below -60 dB.
ZEROS, CUTOFF = 64, 0.92
WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)


def reach_of(rate: int, wanted: int) -> int:
    """Samples on each side that a new one looks at."""
    return math.ceil(ZEROS / (CUTOFF * min(1.0, wanted / rate)))


def kernel(rate: int, wanted: int) -> np.ndarray:
    """Weights by phase: row k for new samples that lie k / (wanted / gcd) after an old one; each row sums to 1."""
    step, reach = wanted // math.gcd(rate, wanted), reach_of(rate, wanted)
    t = np.arange(step)[:, None] / step - np.arange(1 - reach, reach + 1)[None, :]
    cut = CUTOFF * min(1.0, wanted / rate)
    a = np.pi * np.clip(t / reach, -1, 1)
    h = np.sinc(cut * t) * sum(c * np.cos(k * a) for k, c in enumerate(WINDOW))
    return h / h.sum(1, keepdims=True)


def resampled(chunks: DataFrame, wanted: int) -> DataFrame:
    """chunks (stream_id, chunk_id, start_idx, rate, samples) at a rate of `wanted`; beyond a stream's ends it is silent.

    Chunks are of one size, but for a stream's last one. Each keeps its number and gives the new samples whose times fall
    into it, so they may come out with sizes that differ by one. It gets from its neighbours what its edges look at.
    Chunks that have the rate already stay. Samples may be float or double, and stay so.
    """
    kind = chunks.schema["samples"].dataType.elementType.simpleString()
    arrow = {"float": pa.float32(), "double": pa.float64()}[kind]
    here = chunks.where(F.col("rate") == wanted)
    rows = chunks.where(F.col("rate") != wanted).withColumn("n", F.size("samples"))
    reach = F.ceil(ZEROS / (CUTOFF * F.least(F.lit(1.0), wanted / F.col("rate")))).cast("int") + 1
    # where a stream's chunks begin decides who needs a piece; their usual size follows from the first rows
    size = rows.where("chunk_id = 0").select("stream_id", F.col("n").alias("size"))
    rows = rows.join(size, "stream_id").withColumn("reach", reach)
    first = F.floor((F.col("start_idx") - F.col("reach")) / F.col("size"))
    last = F.floor((F.col("start_idx") + F.col("n") - 1 + F.col("reach")) / F.col("size"))
    dealt = rows.withColumn("target", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    low = F.greatest(F.col("start_idx"), F.col("target") * F.col("size") - F.col("reach"))
    high = F.least(F.col("start_idx") + F.col("n"), (F.col("target") + 1) * F.col("size") + F.col("reach"))
    piece = F.slice("samples", (low - F.col("start_idx") + 1).cast("int"), (high - low).cast("int"))
    pieces = dealt.where(high > low).select("stream_id", F.col("target").alias("chunk_id"), "rate", "size", low.alias("at"), piece.alias("samples"), F.when(F.col("target") == F.col("chunk_id"), F.col("n")).alias("own"))

    def change(table: pa.Table) -> pa.Table:
        own = max((n for n in table["own"].to_pylist() if n is not None), default=0)
        schema = pa.schema([("stream_id", pa.string()), ("chunk_id", pa.int64()), ("start_idx", pa.int64()), ("rate", pa.int32()), ("samples", pa.list_(arrow))])
        if not own:  # edges of a chunk that isn't there
            return schema.empty_table()
        rate, size, chunk = table["rate"][0].as_py(), table["size"][0].as_py(), table["chunk_id"][0].as_py()
        reach, start = reach_of(rate, wanted) + 1, chunk * size
        x = np.zeros(own + 2 * reach)
        for at, samples in zip(table["at"].to_pylist(), table["samples"], strict=True):
            v = samples.values.to_numpy(zero_copy_only=False)
            i = at - start + reach
            v = v[: max(0, len(x) - i)]
            x[i : i + len(v)] = v
        first, end = -(-start * wanted // rate), -(-(start + own) * wanted // rate)
        h = kernel(rate, wanted)
        out = np.empty(end - first)
        step = max(1, (1 << 20) // (2 * reach))
        for a in range(first, end, step):
            m = np.arange(a, min(a + step, end))
            place, phase = m * rate // wanted, (m * rate % wanted) // math.gcd(rate, wanted)
            near = place[:, None] + np.arange(2 - reach, reach)[None, :] - start + reach
            out[m - first] = (x[near] * h[phase]).sum(1)
        return pa.Table.from_arrays([pa.array([table["stream_id"][0].as_py()]), pa.array([chunk]), pa.array([first]), pa.array([wanted], pa.int32()), pa.array([out.astype(arrow.to_pandas_dtype())], pa.list_(arrow))], schema=schema)

    schema = f"stream_id string, chunk_id long, start_idx long, rate int, samples array<{kind}>"
    changed = pieces.groupBy("stream_id", "chunk_id").applyInArrow(change, schema)
    return here.select("stream_id", "chunk_id", "start_idx", "rate", "samples").unionByName(changed)
