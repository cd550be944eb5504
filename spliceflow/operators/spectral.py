"""Spectra and features of frames (stream_id, frame_id, samples).

Spectra are computed for whole Arrow batches with NumPy; amplitude features are column expressions. `dft_power` is the
same transform as a join with a table of cosines and sines, for checks in plain SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.functions.signal import rms, zero_crossings
from spliceflow.helpers import cut, interval_join, last_before, near, running_sum
from spliceflow.operators import fourier
from spliceflow.operators.frames import taper

#: Share of the energy below the roll-off frequency; borders of the four bands in Hz.
ROLLOFF, BANDS = 0.85, (1000.0, 3000.0, 6000.0)
#: Samples of a segment that are put into one row.
LONGEST = 1 << 18
_COLUMNS = ("centroid", "centroid_magnitude", "rolloff", "bandwidth", "flatness")


def _matrix(col: pa.ListArray) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 0))


def spectral_features(power: np.ndarray, freqs: np.ndarray, eps: float = 1e-12) -> dict[str, np.ndarray]:
    """Of power spectra in rows. Silent rows (power up to 1e-10) have zeros."""
    total = power.sum(1)
    loud = total > 1e-10
    safe = np.where(loud, total, 1.0)
    magnitude = np.sqrt(power)
    centroid = np.where(loud, power @ freqs / safe, 0.0)
    cum = np.cumsum(power, axis=1)
    first = (cum >= ROLLOFF * cum[:, -1:]).argmax(1)
    spread = ((freqs[None, :] - centroid[:, None]) ** 2 * power).sum(1) / safe
    m = magnitude.sum(1)
    return {
        "centroid": centroid,
        "centroid_magnitude": np.where(m > 0, magnitude @ freqs / np.where(m > 0, m, 1.0), 0.0),
        "rolloff": np.where(loud, freqs[first], 0.0),
        "bandwidth": np.where(loud, np.sqrt(spread), 0.0),
        "flatness": np.exp(np.log(power + eps).mean(1)) / (power.mean(1) + eps),
        "bands": np.stack([power[:, (freqs >= a) & (freqs < b)].sum(1) for a, b in zip((0.0, *BANDS), (*BANDS, np.inf), strict=True)], 1),
        "unit": magnitude / (np.sqrt((magnitude**2).sum(1)) + eps)[:, None],
    }


def with_spectrum(frames: DataFrame, rate: float, window: str = "hann") -> DataFrame:
    """Add spectrum (magnitudes) and spectral features to frames of one length per batch row; samples stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("samples").offsets.to_numpy())
            for n in np.unique(lengths) if batch.num_rows else ():
                part = batch.filter(pa.array(lengths == n)) if (lengths != n).any() else batch
                x = _matrix(part.column("samples")) * np.array(taper(window, int(n)))
                magnitude = np.abs(np.fft.rfft(x, axis=1))
                f = spectral_features(magnitude**2, np.fft.rfftfreq(int(n), 1 / rate))
                lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists(magnitude), *[pa.array(f[c]) for c in _COLUMNS], lists(f["bands"]), lists(f["unit"])], names=[*part.schema.names, "spectrum", *_COLUMNS, "bands", "unit"])

    extra = ", ".join(f"{c} double" for c in _COLUMNS)
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{inner}, spectrum array<double>, {extra}, bands array<double>, unit array<double>")


def flux(frames: DataFrame, usable: Column) -> DataFrame:
    """Add flux: squared distance to the spectrum of the last usable frame; 0 for the first and for unusable ones."""
    frames = last_before(frames.withColumn("idx", F.col("frame_id")), F.when(usable, F.col("spectrum")), "__prev").drop("idx")
    distance = F.aggregate(F.zip_with("spectrum", "__prev", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return frames.withColumn("flux", F.when(usable & F.col("__prev").isNotNull(), distance).otherwise(0.0)).drop("__prev")


def frame_features(frames: DataFrame, rate: float, hop: int, min_amplitude: float = 0.0) -> DataFrame:
    """stream_id, frame_id, t, valid, rms, zcr, centroid, rolloff, bandwidth, flux.

    Frames below min_amplitude are not valid: they keep their rms, and all else is 0. They never reach the transform.
    """
    frames = frames.withColumn("rms", rms(F.col("samples"))).withColumn("valid", F.col("rms") >= min_amplitude)
    loud = with_spectrum(frames.where("valid"), rate).withColumn("zcr", zero_crossings(F.col("samples")))
    loud = flux(loud, F.aggregate("spectrum", F.lit(0.0), lambda acc, v: acc + v * v) > 1e-10)
    names = ["rms", "zcr", "centroid", "rolloff", "bandwidth", "flux"]
    quiet = frames.where("not valid").select("stream_id", "frame_id", "valid", *[F.col(c) if c == "rms" else F.lit(0.0).alias(c) for c in names])
    out = loud.select("stream_id", "frame_id", "valid", *names).unionByName(quiet)
    return out.withColumn("t", F.col("frame_id") * hop / F.lit(float(rate)))


def segment_features(signal: DataFrame, segs: DataFrame, rate: float, quiet: float = 0.0, least: int = 10, longest: int = LONGEST) -> DataFrame:
    """stream_id, seg_id, centroid, rms, rolloff, zcr, power_std, bandwidth of each segment (seg_id, i0, i1).

    The spectrum is that of the whole tapered segment. Segments of fewer than `least` samples, or of an rms below `quiet`,
    have zeros. Segments of more than `longest` samples are never put into one row: see long_segment_features.
    """
    segs = segs.select("stream_id", "seg_id", "i0", "i1")
    short = F.col("i1") - F.col("i0") <= longest
    inside = interval_join(signal, segs.where(short), 4096)
    packed = inside.groupBy("stream_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s")).select("stream_id", "seg_id", F.col("s.x").alias("samples"))
    packed = packed.withColumn("rms", rms(F.col("samples"))).where((F.size("samples") >= least) & (F.col("rms") >= quiet))
    out = with_spectrum(packed, rate)
    power = F.transform("spectrum", lambda m: m * m)
    mean = F.aggregate(power, F.lit(0.0), lambda a, v: a + v) / F.size("spectrum")
    power_std = F.sqrt(F.aggregate(power, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size("spectrum"))
    out = out.select("stream_id", "seg_id", "centroid", "rms", "rolloff", zero_crossings(F.col("samples")).alias("zcr"), power_std.alias("power_std"), "bandwidth")
    if not segs.where(~short).isEmpty():
        out = out.unionByName(long_segment_features(signal, segs.where(~short), rate, quiet, least))
    return segs.select("stream_id", "seg_id").join(out, ["stream_id", "seg_id"], "left").na.fill(0.0)


def long_segment_features(signal: DataFrame, segs: DataFrame, rate: float, quiet: float = 0.0, least: int = 10, local: int = fourier.LOCAL) -> DataFrame:
    """As segment_features, for segments of any length: a row for each sample and for each bin of the transform, and sums over these."""
    name = F.to_json(F.struct("stream_id", "seg_id"))
    inside = interval_join(signal, segs.select("stream_id", "seg_id", "i0", "i1"), 4096)
    rows = cut(inside.select("stream_id", "seg_id", name.alias("seg"), (F.col("idx") - F.col("i0")).alias("idx"), F.col("x").cast("double").alias("x")))
    level = rows.groupBy("stream_id", "seg_id", "seg").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).where((F.col("n") >= least) & (F.col("rms") >= quiet))
    level = cut(level)
    rows = rows.join(level.select("seg", "n"), "seg").select(F.col("seg").alias("stream_id"), "idx", "x", "n")
    crossed = near(rows, 1, 0, {"d": lambda w: F.abs(F.signum("x") - F.lag(F.signum("x")).over(w))}).groupBy("stream_id").agg((F.coalesce(F.sum("d"), F.lit(0.0)) / (2 * F.max("n"))).alias("zcr"))
    tapered = rows.withColumn("x", F.col("x") * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("idx") / (F.col("n") - 1))))
    bins = fourier.transform(tapered.select("stream_id", "idx", "x"), local)
    bins = cut(bins.select("stream_id", F.col("k").alias("idx"), (F.col("k") * rate / F.col("n")).alias("hz"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p")))
    total = bins.groupBy("stream_id").agg(F.sum("p").alias("all"), F.sum(F.col("hz") * F.col("p")).alias("moment"), F.stddev_pop("p").alias("power_std"))
    total = cut(total.withColumn("centroid", F.when(F.col("all") > 1e-10, F.col("moment") / F.col("all")).otherwise(0.0)))
    upto = running_sum(bins, F.col("p"), "upto").join(total.select("stream_id", "all", "centroid"), "stream_id")
    spread = upto.groupBy("stream_id").agg(
        F.min(F.when(F.col("upto") >= ROLLOFF * F.col("all"), F.col("hz"))).alias("rolloff"), F.sqrt(F.sum((F.col("hz") - F.col("centroid")) ** 2 * F.col("p")) / F.max("all")).alias("bandwidth")
    )
    out = level.join(total, level["seg"] == total["stream_id"]).drop(total["stream_id"]).join(spread.withColumnRenamed("stream_id", "seg"), "seg").join(crossed.withColumnRenamed("stream_id", "seg"), "seg")
    loud = lambda c: F.when(F.col("all") > 1e-10, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0).alias(c)
    return out.select("stream_id", "seg_id", "centroid", "rms", loud("rolloff"), "zcr", "power_std", loud("bandwidth"))


def block_features(frames: DataFrame, rate: float, window: int, kind: str = "hann") -> DataFrame:
    """stream_id, frame_id, centroid, rms, rolloff, bandwidth of blocks, each filled up with zeros or cut to `window` samples."""
    n = F.size("samples")
    fitted = F.when(n >= window, F.slice("samples", 1, window)).otherwise(F.concat("samples", F.array_repeat(F.lit(0.0), F.greatest(F.lit(window) - n, F.lit(0)))))
    out = with_spectrum(frames.select("stream_id", "frame_id", fitted.alias("samples")), rate, kind)
    return out.select("stream_id", "frame_id", "centroid", rms(F.col("samples")).alias("rms"), "rolloff", "bandwidth")


def centroid_eps(power: Column, hz: Column, eps: float = 1e-12) -> Column:
    """Power-weighted mean frequency over arrays, with eps in the denominator instead of a test for silence."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    return total(F.zip_with(power, hz, lambda p, f: p * f)) / (total(power) + eps)


def display_spectrum(frames: DataFrame, rate: float, n: int, upto: float) -> DataFrame:
    """stream_id, frame_id, shown (spectrum by half the length, smoothed over five bins; zeros beyond its ends), and peak,
    its largest value in the bins below `upto` Hz. For frames of n samples."""
    half, bins = n / 2, n // 2 + 1
    out = with_spectrum(frames.select("stream_id", "frame_id", "samples"), rate)
    at = lambda i: F.coalesce(F.get("spectrum", i), F.lit(0.0))
    shown = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: sum((F.when(i + d >= 0, at(F.greatest(i + d, F.lit(0)))).otherwise(0.0) for d in (-2, -1, 0, 1, 2)), F.lit(0.0)) / (5 * half))
    out = out.select("stream_id", "frame_id", shown.alias("shown"))
    return out.withColumn("peak", F.array_max(F.slice("shown", 1, max(1, min(bins, int(upto * bins / (rate / 2)))))))


def whole_spectrum(signal: DataFrame, rate: float, low: float = 0.0, high: float = math.inf) -> DataFrame:
    """stream_id, k, hz, magnitude: the transform of each whole stream (n samples) in the bins k * rate / n from low to high."""
    k, n = F.col("k"), F.col("n")
    bins = fourier.transform(signal.select("stream_id", "idx", "x"))
    if low > 0 or high < rate / 2:
        bins = bins.where((k >= F.ceil(F.lit(float(low)) * n / rate)) & (k <= F.floor(F.lit(float(min(high, rate / 2))) * n / rate)))
    return bins.select("stream_id", "k", (k * rate / n).alias("hz"), F.hypot("re", "im").alias("magnitude"))


def dft_power(frames: DataFrame, n: int) -> DataFrame:
    """stream_id, frame_id, k, power: sums over a table of n * (n / 2 + 1) cosines and sines."""
    spark = frames.sparkSession
    base = spark.range(n // 2 + 1).withColumnRenamed("id", "k").crossJoin(spark.range(n).withColumnRenamed("id", "p"))
    angle = F.lit(2 * math.pi / n) * ((F.col("k") * F.col("p")) % n)
    base = base.select("k", "p", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    samples = frames.select("stream_id", "frame_id", F.posexplode("samples").alias("p", "x"))
    sums = samples.join(F.broadcast(base), "p").groupBy("stream_id", "frame_id", "k").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    return sums.select("stream_id", "frame_id", "k", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def global_spectrum(chunks: DataFrame, rate: float, size: int = 4096) -> DataFrame:
    """stream_id, k, hz, power: mean power spectrum over consecutive frames of `size` samples, so that no task needs a
    whole stream. frames: as frames.tumbling gives them."""
    spectra = with_spectrum(chunks, rate, "rect").select("stream_id", F.posexplode("spectrum").alias("k", "m"))
    return spectra.groupBy("stream_id", "k").agg(F.avg(F.col("m") * F.col("m")).alias("power")).withColumn("hz", F.col("k") * rate / size)


def in_band(spectrum: DataFrame, low: float, high: float, rate: float) -> DataFrame:
    """Rows of a spectrum from low to high, at most half the sampling rate."""
    return spectrum.where((F.col("hz") >= low) & (F.col("hz") <= min(high, rate / 2)))
