"""Whole analyses, from a signal to one track for each source, and the smaller operators they leave over, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.config import CHANGE_WEIGHTS, Cfar, Fusion
from spliceflow.functions import signal as fn
from spliceflow.functions.tables import register
from spliceflow.helpers import cut, last_before, near
from spliceflow.operators import changepoint as cp
from spliceflow.operators import cluster, frames, fusion, reconstruct, resample, segments, silence, spectral
from spliceflow.plans import queries as q
from spliceflow.plans import tables as t

QUERIES: dict[str, q.Query] = {}
#: Frames of 88 samples, 22 apart; quieter ones than QUIET are not valid. Times are in samples.
RATE, WINDOW, HOP, QUIET, GAP = 44100, 88, 22, 20.0, 66.0


def query(f: q.Query) -> q.Query:
    QUERIES[f.__name__] = f
    return f


# from frames to sources, with one detector


def frame_rows(signal: DataFrame, quiet: float = QUIET) -> DataFrame:
    """stream_id, idx (of the frame), at (its first sample), valid and six features to 6 places, so that equal ones are equal."""
    out = spectral.frame_features(frames.hopping(signal, WINDOW, HOP), RATE, HOP, quiet)
    return cut(out.select("stream_id", F.col("frame_id").alias("idx"), (F.col("frame_id") * HOP).alias("at"), "valid", *[q.r6(c).alias(c) for c in CHANGE_WEIGHTS]))


def detected(rows: DataFrame, cfar: Cfar | None) -> DataFrame:
    """frame_rows with score and threshold: six scaled features, weighted changes, invalid frames at 0, smoothed; the
    threshold is a percentile of valid frames, or comes from the cells around (cfar)."""
    scored = cp.change_score(rows, CHANGE_WEIGHTS, "valid").withColumn("score", F.round("score", 9))
    scored = cut(scored.select("stream_id", "idx", "at", "valid", "score"))
    return cp.percentile_threshold(scored, "score", 0.85, F.col("valid")) if cfar is None else cp.with_threshold(scored, "score", cfar, F.col("valid"))


def frame_segments(rows: DataFrame, cfar: Cfar | None = None) -> DataFrame:
    """Segments between the peaks of valid frames, in samples; those with too few valid frames go."""
    scored = cut(detected(rows, cfar))
    found = cp.peaks(scored, "score").where("valid")
    segs = cut(segments.as_rows(segments.segments(cp.boundaries(scored, found, GAP, "at"), shortest=GAP)))
    points = rows.select("stream_id", F.col("at").alias("idx"), "valid")
    return cut(segments.valid_ratio(points, segs, F.col("valid")))


def labelled_segments(signal: DataFrame, cfar: Cfar | None = None, quiet: float = QUIET) -> DataFrame:
    """stream_id, seg_id, i0, i1, label: sources by k-means over six features of each segment."""
    segs = frame_segments(frame_rows(signal, quiet), cfar)
    found = cluster.kmeans_pp(spectral.segment_features(signal, segs, RATE, quiet))
    return cut(segs.select("stream_id", "seg_id", "i0", "i1").join(found.select("stream_id", "seg_id", "label"), ["stream_id", "seg_id"]))


def deinterleaved(signal: DataFrame, cfar: Cfar | None = None, quiet: float = QUIET) -> DataFrame:
    """stream_id, idx, label, x: for each source that occurs in a stream the whole stream, 0 where others sound."""
    signal = cut(signal)
    return reconstruct.masked_by_label(signal, labelled_segments(signal, cfar, quiet))


@query
def frame_change_score(spark, sf_dir):
    return q._rounded(detected(frame_rows(t.centred(spark, sf_dir)), None).select("stream_id", "idx", "valid", "score", "threshold"), "score", "threshold")


@query
def cfar_detector(spark, sf_dir):
    return q._rounded(detected(frame_rows(t.centred(spark, sf_dir)), Cfar()).select("stream_id", "idx", "valid", "score", "threshold"), "score", "threshold")


@query
def batch_segments(spark, sf_dir):
    return q._rounded(frame_segments(frame_rows(t.centred(spark, sf_dir))).select("stream_id", "seg_id", "i0", "i1", "valid_ratio"), "valid_ratio")


@query
def deinterleave_batch(spark, sf_dir):
    return q._rounded(deinterleaved(t.centred(spark, sf_dir)), "x")


@query
def segment_features_loud(spark, sf_dir):
    """Six features; segments that are too quiet have zeros."""
    _, segs = q._segments(spark, sf_dir)
    return q._rounded(spectral.segment_features(t.centred(spark, sf_dir), segs, RATE, 40.0), *cluster.FEATURES)


@query
def choose_clusters(spark, sf_dir):
    return cluster.choose_clusters(q.segment_features(spark, sf_dir))


# several detectors, fused


def detector_rows(signal: DataFrame) -> DataFrame:
    """stream_id, idx (of the frame) and what the detectors look at: centroid, level in dB, jump at the frame's start, shape."""
    out = spectral.with_spectrum(frames.tumbling(signal, WINDOW), RATE).withColumn("idx", F.col("frame_id"))
    out = out.select("stream_id", "idx", q.r6("centroid").alias("hz"), q.r6(fn.rms_db(F.col("samples"))).alias("db"), F.get("samples", F.lit(0)).alias("first"), F.get("samples", F.lit(WINDOW - 1)).alias("last"), "unit")
    before = lambda c: (lambda w: F.coalesce(F.lag(c).over(w), F.col(c)))
    rows = near(out, 1, 0, {"__hz": before("hz"), "__db": before("db"), "__last": lambda w: F.coalesce(F.lag("last").over(w), F.col("first")), "__unit": before("unit")})
    changes = {
        "centroid": F.abs(F.col("hz") - F.col("__hz")), "energy": F.abs(F.col("db") - F.col("__db")), "jump": F.abs(F.col("first") - F.col("__last")),
        "shape": F.when(F.col("idx") == 0, 0.0).otherwise(fn.cosine_change(F.col("unit"), F.col("__unit"))),
    }
    return cut(rows.select("stream_id", "idx", "hz", "db", *[F.round(c, 6).alias(n) for n, c in changes.items()]))


def fused_boundaries(rows: DataFrame, share: float = 0.85) -> DataFrame:
    """stream_id, t (in frames): peaks of each detector over its percentile, chained, ranked, and those of two methods or more kept."""
    settings, events = Fusion(max_difference=1.0, min_segment=3.0), []
    for method, weight in settings.weights:
        one = cp.percentile_threshold(rows.select("stream_id", "idx", F.col(method).alias("score")), "score", share)
        one = cp.peaks(one, "score")
        events.append(one.select("stream_id", F.col("idx").cast("double").alias("t"), F.lit(method).alias("method"), (F.col("score") * weight).alias("score")))
    found = events[0].unionByName(events[1]).unionByName(events[2]).unionByName(events[3])
    chosen = fusion.prioritised(fusion.fused(found, settings.max_difference, F.floor(F.col("t") / 65536)), settings).where("priority <= 2")
    ends = rows.groupBy("stream_id").agg((F.max("idx") + 1).cast("double").alias("t"))
    return fusion.boundary_list(ends, chosen, settings.min_segment)


@query
def frame_detectors(spark, sf_dir):
    return detector_rows(t.centred(spark, sf_dir)).select("stream_id", "idx", "centroid", "energy", "jump", "shape")


@query
def frame_fused_boundaries(spark, sf_dir):
    return fused_boundaries(detector_rows(t.centred(spark, sf_dir)))


def fused_tracks(signal: DataFrame, share: float = 0.85) -> DataFrame:
    """One track a source from fused boundaries; sources by k-means over mean centroid and level of each segment's frames."""
    signal = cut(signal)
    return reconstruct.masked_by_label(signal, fused_segments(signal, share))


def fused_segments(signal: DataFrame, share: float = 0.85) -> DataFrame:
    """stream_id, seg_id, i0, i1 (samples), label."""
    rows = detector_rows(signal)
    segs = cut(segments.as_rows(segments.segments(fused_boundaries(rows, share))))
    means = segments.segment_means(rows, segs, ["hz", "db"]).withColumnsRenamed({"mean_hz": "centroid", "mean_db": "rms_db"})
    found = cluster.kmeans_levels(means.select("stream_id", "seg_id", "centroid", "rms_db"))
    segs = segs.withColumns({"i0": F.col("i0") * WINDOW, "i1": F.col("i1") * WINDOW}).join(found.select("stream_id", "seg_id", "label"), ["stream_id", "seg_id"])
    return cut(segs)


@query
def deinterleave_fused(spark, sf_dir):
    return q._rounded(fused_tracks(t.centred(spark, sf_dir)), "x")


@query
def centroid_sources(spark, sf_dir):
    """Change points from the centroid alone, and sources by a running mean centroid within 500 Hz."""
    rows = detector_rows(t.centred(spark, sf_dir))
    scored = cp.percentile_threshold(rows.select("stream_id", "idx", "hz", F.col("centroid").alias("score")), "score", 0.8)
    segs = cut(segments.as_rows(segments.segments(cp.boundaries(scored, cp.peaks(scored, "score"), 3.0))))
    means = segments.segment_means(rows, segs, ["hz"]).withColumn("mean_hz", F.round("mean_hz", 3))
    out = cluster.leaders(means.select("stream_id", "seg_id", "i0", "i1", "mean_hz"), "mean_hz", 500.0)
    return out.select("stream_id", "seg_id", "i0", "i1", "mean_hz", segments.letter(F.col("cluster_id")).alias("letter"))


@query
def silence_report(spark, sf_dir):
    """What is removed and what it leaves of each stream, with the limit taken from the stream's peak."""
    rows = t.centred(spark, sf_dir)
    peak = rows.groupBy("stream_id").agg((F.max(F.abs("x")) * 0.05).alias("limit"), F.count("*").alias("n"))
    quiet = rows.join(peak, "stream_id").where(silence.is_silent(F.col("x"), F.col("limit")))
    return q._rounded(silence.removed_stats(silence.regions(quiet, 2), peak.select("stream_id", "n")), "percent", "ratio")


# calibration, then live blocks


def calibrated(blocks: DataFrame, first: int, least_hz: float = 100.0) -> DataFrame:
    """stream_id, band, low, high from the first blocks of each stream, without low ones."""
    return cluster.kmeans_1d(blocks.where((F.col("frame_id") < first) & (F.col("centroid") > least_hz)), "centroid")


def live(blocks: DataFrame, bands: DataFrame, first: int, block: int, fade: int, target: int = 0, sure: float = 0.3) -> DataFrame:
    """stream_id, frame_id, label, current, gain: after calibration each block is classified, a sure label becomes the
    current source, and blocks of the target source sound, faded in over `fade` samples from the change on. While a stream
    calibrates, all sounds."""
    rows = cluster.classify_bands(blocks.where(F.col("frame_id") >= first), bands.select("stream_id", "band", "low", "high"), "centroid")
    known = F.when(F.col("confidence") >= sure, F.col("label"))
    rows = last_before(rows.withColumn("idx", F.col("frame_id")), known, "current", inclusive=True)
    rows = last_before(cut(rows), known, "__before")
    start = F.when(F.col("current").isNotNull() & (F.col("__before").isNull() | (F.col("__before") != F.col("current"))), F.col("idx"))
    rows = last_before(rows, start, "__since", inclusive=True)
    sounds = (F.col("current") == target) & (F.col("confidence") >= sure)
    gain = F.when(sounds, F.least(F.lit(1.0), (F.col("idx") - F.col("__since")) * block / F.lit(float(fade)))).otherwise(0.0)
    rows = rows.select("stream_id", "frame_id", "label", "current", gain.alias("gain"))
    early = blocks.where(F.col("frame_id") < first).select("stream_id", "frame_id", F.lit(None).cast("int").alias("label"), F.lit(None).cast("int").alias("current"), F.lit(1.0).alias("gain"))
    return early.unionByName(rows)


def _blocks(spark, sf_dir) -> DataFrame:
    """Features of blocks of 16 samples in windows of 12."""
    out = spectral.block_features(frames.tumbling(t.centred(spark, sf_dir), 16), q.RATE, 12)
    return cut(out.withColumn("centroid", F.round("centroid", 6)))


@query
def block_features(spark, sf_dir):
    return q._rounded(_blocks(spark, sf_dir), "rms", "rolloff", "bandwidth")


@query
def calibrate_then_live(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return q._rounded(live(blocks, calibrated(blocks, 6), 6, 16, 64), "gain")


@query
def block_stats(spark, sf_dir):
    """Every ten blocks of a stream: how many, their mean level, and changes of the nearest level."""
    rows = frames.tumbling(t.centred(spark, sf_dir), 16).select("stream_id", F.col("frame_id").alias("idx"), fn.rms(F.col("samples")).alias("rms"))
    rows = near(rows.withColumn("loud", F.col("rms") >= 40), 1, 0, {"changed": lambda w: F.coalesce(F.lag("loud").over(w) != F.col("loud"), F.lit(False))})
    out = rows.groupBy("stream_id", F.floor(F.col("idx") / 10).alias("turn")).agg(F.count("*").alias("n_blocks"), F.avg("rms").alias("mean_rms"), F.count_if("changed").alias("n_changes"))
    return q._rounded(out, "mean_rms")


# smaller ones


@query
def boundaries_in_range(spark, sf_dir):
    return q.boundaries_greedy(spark, sf_dir).where("t > 0 and t < 100")


@query
def plot_data(spark, sf_dir):
    """What a plot of the first 100 samples shows: signal, score, and which samples are boundaries."""
    rows, found = q._peaks(spark, sf_dir)
    marks = cp.boundaries(rows, found, 10.0).select("stream_id", F.col("t").cast("long").alias("idx"), F.lit(True).alias("boundary")).distinct()
    out = rows.where("idx <= 100").join(marks, ["stream_id", "idx"], "left")
    return q._rounded(out.select("stream_id", "idx", "x", "score", F.coalesce("boundary", F.lit(False)).alias("boundary")), "x", "score")


@query
def low_centroid_filter(spark, sf_dir):
    return q._rounded(q._spectra(spark, sf_dir).where("centroid > 2000").select("stream_id", "frame_id", "centroid"), "centroid")


@query
def centroid_eps(spark, sf_dir):
    rows = q._spectra(spark, sf_dir)
    hz = F.array(*[F.lit(k * q.RATE / 64) for k in range(33)])
    return rows.select("stream_id", "frame_id", q.r6(spectral.centroid_eps(F.transform("spectrum", lambda m: m * m), hz)).alias("centroid"))


@query
def display_spectrum(spark, sf_dir):
    out = spectral.display_spectrum(t.frames(spark, sf_dir), q.RATE, 64, 1000.0)
    return out.select("stream_id", "frame_id", q.r6(F.get("shown", F.lit(0))).alias("shown0"), q.r6(F.get("shown", F.lit(9))).alias("shown9"), q.r6("peak").alias("peak"))


@query
def whole_spectrum(spark, sf_dir):
    return q._rounded(spectral.whole_spectrum(cut(t.centred(spark, sf_dir)), q.RATE), "hz", "magnitude")


@query
def frame_bins_sql(spark, sf_dir):
    """The spectrum's bins of each frame, by a table function in SQL."""
    register(spark)
    t.frames(spark, sf_dir).createOrReplaceTempView("spliceflow_frames")
    out = spark.sql(f"SELECT stream_id, frame_id, k, hz, power FROM frame_bins(TABLE(spliceflow_frames), {float(q.RATE)}D)")
    return q._rounded(out, "hz", "power")


@query
def resampled(spark, sf_dir):
    """The signal at three quarters of its rate."""
    rows = t.centred(spark, sf_dir)
    chunks = rows.groupBy("stream_id", F.floor(F.col("idx") / 4096).alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    chunks = cut(chunks.select("stream_id", "chunk_id", (F.col("chunk_id") * 4096).alias("start_idx"), F.lit(q.RATE).cast("int").alias("rate"), F.col("s.x").alias("samples")))
    out = resample.resampled(chunks, int(q.RATE * 3 / 4))
    return q._rounded(out.select("stream_id", "start_idx", F.posexplode("samples").alias("p", "x")).select("stream_id", (F.col("start_idx") + F.col("p")).alias("idx"), "x"), "x")


@query
def removed_head(spark, sf_dir):
    """The first ten silent regions, for a look."""
    return q.silence_regions(spark, sf_dir).orderBy("stream_id", "i0").limit(10)


@query
def raw_samples(spark, sf_dir):
    """Two channels of raw values as 16-bit samples in one line: idx * 2 + channel."""
    rows = t.features(spark, sf_dir).select("stream_id", "idx", F.posexplode(F.array(F.col("zcr"), F.col("centroid") * 10)).alias("channel", "v"))
    return rows.select("stream_id", (F.col("idx") * 2 + F.col("channel")).alias("idx"), fn.raw_to_int16(F.col("v")).cast("int").alias("x"))


@query
def stereo_copy(spark, sf_dir):
    out = t.signal(spark, sf_dir).select("stream_id", "idx", fn.stereo(F.col("x")).alias("y"))
    return out.select("stream_id", "idx", q.r6(F.get("y", F.lit(0))).alias("left"), q.r6(F.get("y", F.lit(1))).alias("right"))


@query
def compact_crossfaded(spark, sf_dir):
    """A masked track's sounding runs joined by crossfades."""
    track = t.signal(spark, sf_dir).withColumn("x", F.when(F.col("x") > 45, F.col("x")).otherwise(0.0))
    return q._rounded(reconstruct.crossfaded(track, cut(reconstruct.sounding_segments(track)), 2), "x")
