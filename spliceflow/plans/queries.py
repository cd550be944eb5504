"""The operators as queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame. Floats are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceflow.config import CHANGE_WEIGHTS, Cfar, Fusion
from spliceflow.functions import signal as fn
from spliceflow.helpers import cut, near, percentiles, running_sum
from spliceflow.operators import changepoint as cp
from spliceflow.operators import cluster, filters, frames, fusion, normalize, reconstruct, segments, silence, spectral
from spliceflow.plans import tables as t
from spliceflow.streaming import jobs
from spliceflow.streaming.online import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RATE = 8000.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, idx, x, score: robustly scaled, differenced, smoothed; 9 places, so that equal sums are equal."""
    rows = normalize.robust_minmax(t.signal(spark, sf_dir).withColumn("y", F.col("x")), ["y"])
    rows = cp.smoothed(near(rows, 1, 0, {"score": cp.first_difference("y")}), "score")
    return cut(rows.select("stream_id", "idx", "x", F.round("score", 9).alias("score")))


def _peaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cp.percentile_threshold(_score(spark, sf_dir), "score", 0.85)
    return rows, cp.peaks(rows, "score")


def _segments(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    rows, found = _peaks(spark, sf_dir)
    return rows, cut(segments.as_rows(segments.segments(cp.boundaries(rows, found, 10.0), **options)))


@query
def segments_flagship(spark, sf_dir):
    rows, segs = _segments(spark, sf_dir)
    return _rounded(segments.segment_means(rows, segs, ["x"]).select("stream_id", "seg_id", "t0", "t1", "n_points", "mean_x"), "mean_x")


QUERIES["segments"] = QUERIES.pop("segments_flagship")


# scaling


@query
def robust_minmax(spark, sf_dir):
    return _rounded(normalize.robust_minmax(t.signal(spark, sf_dir), ["x"]), "x")


@query
def robust_minmax_valid(spark, sf_dir):
    return _rounded(normalize.robust_minmax(t.signal(spark, sf_dir), ["x"], F.col("x") >= 10), "x")


@query
def minmax_scale(spark, sf_dir):
    return _rounded(normalize.minmax(t.signal(spark, sf_dir), "x"), "x")


@query
def zscore(spark, sf_dir):
    return _rounded(normalize.zscore(t.signal(spark, sf_dir), "x"), "x")


@query
def mad_scale(spark, sf_dir):
    return _rounded(normalize.mad_scale(t.signal(spark, sf_dir), "x"), "x")


@query
def exact_percentiles(spark, sf_dir):
    return _rounded(percentiles(t.signal(spark, sf_dir), "x", {"p05": 0.05, "p50": 0.5, "p85": 0.85, "p95": 0.95}), "p05", "p50", "p85", "p95")


# windows over neighbours


@query
def first_diff(spark, sf_dir):
    return _rounded(near(t.signal(spark, sf_dir), 1, 0, {"d": cp.first_difference("x")}).select("stream_id", "idx", "d"), "d")


@query
def moving_avg5(spark, sf_dir):
    return _rounded(cp.smoothed(t.signal(spark, sf_dir), "x"), "x")


@query
def median_filter3(spark, sf_dir):
    return _rounded(near(t.signal(spark, sf_dir), 1, 1, {"x": cp.median_filter("x", 3)}), "x")


@query
def median_filter5(spark, sf_dir):
    return _rounded(near(t.signal(spark, sf_dir), 2, 2, {"x": cp.median_filter("x", 5)}), "x")


@query
def rolling_median_last3(spark, sf_dir):
    last3 = lambda w: F.get(F.array_sort(F.collect_list("x").over(w.rowsBetween(-3, -1))), F.lit(1))
    rows = near(t.signal(spark, sf_dir), 3, 0, {"m": last3, "n": lambda w: F.count("x").over(w.rowsBetween(-3, -1))}).where("n = 3")
    return rows.select("stream_id", "idx", r6("m").alias("m"), r6(fn.relative_change(F.col("x"), F.col("m"), 0.001)).alias("change"))


@query
def cumulative_sum(spark, sf_dir):
    return _rounded(running_sum(t.signal(spark, sf_dir), F.round("x", 2).cast("decimal(18,2)"), "total").select("stream_id", "idx", F.col("total").cast("double").alias("total")), "total")


@query
def boundary_jump(spark, sf_dir):
    rows = near(t.signal(spark, sf_dir), 1, 0, {"jump": lambda w: F.abs(F.col("x") - F.lag("x").over(w))})
    return rows.where("idx % 22 = 0 and idx > 0").select("stream_id", (F.col("idx") / 22).cast("long").alias("frame_id"), r6("jump").alias("jump"))


# change scores, thresholds, peaks


@query
def change_score3(spark, sf_dir):
    weights = {c: CHANGE_WEIGHTS[c] for c in ("centroid", "rms", "rolloff")}
    return _rounded(cp.change_score(t.features(spark, sf_dir), weights).select("stream_id", "idx", "score"), "score")


@query
def change_score6_masked(spark, sf_dir):
    return _rounded(cp.change_score(t.features(spark, sf_dir), CHANGE_WEIGHTS, "valid").select("stream_id", "idx", "valid", "score"), "score")


@query
def pct_threshold_peaks(spark, sf_dir):
    return _rounded(_peaks(spark, sf_dir)[1].select("stream_id", "idx", "score", "threshold"), "score", "threshold")


@query
def peaks_pm3(spark, sf_dir):
    rows = cp.percentile_threshold(_score(spark, sf_dir), "score", 0.85)
    return _rounded(cp.peaks(rows, "score", reach=3).select("stream_id", "idx", "score"), "score")


@query
def peaks_open_ends(spark, sf_dir):
    rows = cp.percentile_threshold(_score(spark, sf_dir), "score", 0.8)
    return _rounded(cp.peaks(rows, "score", open_ends=True).select("stream_id", "idx", "score"), "score")


@query
def boundaries_greedy(spark, sf_dir):
    rows, found = _peaks(spark, sf_dir)
    return cp.boundaries(rows, found, 10.0)


@query
def boundaries_strongest(spark, sf_dir):
    return cp.strongest_first(_peaks(spark, sf_dir)[1], 12, "score").select("stream_id", "idx", r6("score").alias("score"))


@query
def consolidate_peaks(spark, sf_dir):
    return cp.consolidated(_peaks(spark, sf_dir)[1], 5, "score").select("stream_id", "idx", r6("score").alias("score"))


@query
def hysteresis(spark, sf_dir):
    rows = cp.percentile_threshold(_score(spark, sf_dir), "score", 0.7)
    return cp.hysteresis(rows, "score", 3).select("stream_id", "idx", "gate")


@query
def pick_peaks(spark, sf_dir):
    return cp.pick_peaks(_score(spark, sf_dir), "score", 0.8, 8, 10, 2).select("stream_id", "idx", r6("score").alias("score"))


def _cfar(method: str) -> Query:
    def run(spark, sf_dir):
        return _rounded(cp.with_threshold(_score(spark, sf_dir), "score", Cfar(method=method)).select("stream_id", "idx", "threshold"), "threshold")

    return run


QUERIES |= {f"cfar_{m.lower()}": _cfar(m) for m in ("CA", "OS", "SO", "PERCENTILE")}


@query
def cfar_boundaries(spark, sf_dir):
    rows = cp.with_threshold(_score(spark, sf_dir), "score", Cfar(method="CA", alpha=1.5))
    return cp.boundaries(rows, cp.peaks(rows, "score"), 10.0)


@query
def cfar_sweep(spark, sf_dir):
    """26 x 31 settings in one pass over the training cells."""
    grid = spark.range(26).select((F.lit(25) + F.col("id")).alias("a")).crossJoin(spark.range(31).select((F.lit(65) + F.col("id")).alias("k")))
    grid = grid.select(F.col("a").alias("alpha_percent"), F.col("k").alias("k_percent"), (F.col("a") / 10.0).alias("alpha"), (F.col("k") / 100.0).alias("k_fraction"))
    out = cp.cfar_sweep(_score(spark, sf_dir), "score", grid.select("alpha", "k_fraction"), Cfar())
    return out.select("stream_id", F.round(F.col("alpha") * 10).cast("long").alias("alpha_percent"), F.round(F.col("k_fraction") * 100).cast("long").alias("k_percent"), "n_above", "n_cells")


# segments


@query
def segments_deadzone(spark, sf_dir):
    return _segments(spark, sf_dir, dead_zone=2.0, shortest=8.0)[1].select("stream_id", "seg_id", "t0", "t1")


@query
def segment_valid_ratio(spark, sf_dir):
    rows, segs = _segments(spark, sf_dir)
    return _rounded(segments.valid_ratio(rows, segs, F.col("x") >= 40).select("stream_id", "seg_id", "valid_ratio"), "valid_ratio")


@query
def segment_means(spark, sf_dir):
    rows, segs = _segments(spark, sf_dir)
    return _rounded(segments.segment_means(rows, segs, ["x", "score"]).select("stream_id", "seg_id", "mean_x", "mean_score", "n_points"), "mean_x", "mean_score")


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments with label: which third of 0..100 their mean lies in."""
    rows, segs = _segments(spark, sf_dir)
    means = segments.segment_means(rows, segs, ["x"])
    return rows, means.withColumn("label", F.least(F.floor(F.col("mean_x") / 40), F.lit(2)).cast("int"))


@query
def label_summary(spark, sf_dir):
    out = segments.label_summary(_labelled(spark, sf_dir)[1], ["mean_x"])
    return out.select("stream_id", "label", "letter", "n", r6("mean_mean_x").alias("mean_x"))


@query
def choose_k(spark, sf_dir):
    return _rounded(segments.choose_k(_labelled(spark, sf_dir)[1], "mean_x", 60.0), "spread")


# frames and spectra


@query
def frame_hop(spark, sf_dir):
    out = frames.hopping(t.signal(spark, sf_dir), 88, 22)
    return out.select("stream_id", "frame_id", F.size("samples").cast("long").alias("n"), r6(F.get("samples", F.lit(0))).alias("first"), r6(F.get("samples", F.lit(87))).alias("last"))


@query
def frame_tumbling(spark, sf_dir):
    out = frames.tumbling(t.signal(spark, sf_dir), 64)
    return out.select("stream_id", "frame_id", r6(F.get("samples", F.lit(0))).alias("first"), r6(F.get("samples", F.lit(63))).alias("last"))


@query
def frame_padded(spark, sf_dir):
    """Frames of 4 line items of each order; orders of fewer are filled up."""
    out = frames.hopping(t.padded(spark, sf_dir), 4, 4, pad=True)
    return out.select("stream_id", "frame_id", r6(F.get("samples", F.lit(0))).alias("first"), r6(F.get("samples", F.lit(3))).alias("last"))


@query
def taper(spark, sf_dir):
    out = t.frames(spark, sf_dir).withColumn("h", frames.tapered(F.col("samples"), "hann", 64)).withColumn("m", frames.tapered(F.col("samples"), "hamming", 64))
    return out.select("stream_id", "frame_id", r6(fn.rms(F.col("h"))).alias("rms_hann"), r6(fn.rms(F.col("m"))).alias("rms_hamming"))


def _spectra(spark, sf_dir) -> DataFrame:
    return spectral.with_spectrum(t.frames(spark, sf_dir), RATE, "rect")


@query
def dft_power(spark, sf_dir):
    return _rounded(spectral.dft_power(t.frames(spark, sf_dir), 64), "power")


@query
def fft_power(spark, sf_dir):
    out = _spectra(spark, sf_dir).select("stream_id", "frame_id", F.posexplode("spectrum").alias("k", "m"))
    return out.select("stream_id", "frame_id", F.col("k").cast("long").alias("k"), r6(F.col("m") * F.col("m")).alias("power"))


def _spectral(column: str) -> Query:
    return lambda spark, sf_dir: _rounded(_spectra(spark, sf_dir).select("stream_id", "frame_id", column), column)


QUERIES |= {"centroid_power": _spectral("centroid"), "centroid_mag": _spectral("centroid_magnitude"), "rolloff85": _spectral("rolloff"), "bandwidth": _spectral("bandwidth"), "flatness": _spectral("flatness")}


@query
def band_energy(spark, sf_dir):
    return _spectra(spark, sf_dir).select("stream_id", "frame_id", *[r6(F.get("bands", F.lit(i))).alias(f"band{i}") for i in range(4)])


@query
def flux(spark, sf_dir):
    usable = F.col("frame_id") % 7 != 3
    return _rounded(spectral.flux(_spectra(spark, sf_dir), usable).select("stream_id", "frame_id", "flux"), "flux")


@query
def shape_change(spark, sf_dir):
    rows = near(_spectra(spark, sf_dir).withColumn("idx", F.col("frame_id")).select("stream_id", "idx", "unit"), 1, 0, {"prev": lambda w: F.lag("unit").over(w)})
    return rows.select("stream_id", F.col("idx").alias("frame_id"), r6(F.coalesce(fn.cosine_change(F.col("unit"), F.col("prev")), F.lit(0.0))).alias("change"))


@query
def rms_db(spark, sf_dir):
    s = F.col("samples")
    return t.frames(spark, sf_dir).select("stream_id", "frame_id", r6(fn.energy(s)).alias("energy"), r6(fn.rms(s)).alias("rms"), r6(fn.rms_db(s)).alias("rms_db"))


@query
def zcr_signdiff(spark, sf_dir):
    return t.frames(spark, sf_dir).select("stream_id", "frame_id", r6(fn.zero_crossings(F.col("samples"))).alias("zcr"))


@query
def zcr_neq(spark, sf_dir):
    return t.frames(spark, sf_dir).select("stream_id", "frame_id", r6(fn.sign_changes(F.col("samples"))).alias("zcr"))


@query
def frame_features(spark, sf_dir):
    cut = frames.hopping(t.centred(spark, sf_dir), 88, 22)
    out = spectral.frame_features(cut, 44100, 22, 20.0)
    names = ["t", "rms", "zcr", "centroid", "rolloff", "bandwidth", "flux"]
    return _rounded(out.select("stream_id", "frame_id", "valid", *names), *names)


@query
def segment_features(spark, sf_dir):
    """Segments of the event signal, six features each, from frames of the segment's samples."""
    _, segs = _segments(spark, sf_dir)
    out = spectral.segment_features(t.centred(spark, sf_dir), segs, 44100)
    return _rounded(out, *cluster.FEATURES)


@query
def global_spectrum(spark, sf_dir):
    out = spectral.global_spectrum(frames.tumbling(t.centred(spark, sf_dir), 64), RATE, 64)
    return _rounded(spectral.in_band(out, 500.0, 3000.0, RATE).select("stream_id", F.col("k").cast("long").alias("k"), "hz", "power"), "hz", "power")


# clustering


@query
def nearest_center(spark, sf_dir):
    centers = spark.createDataFrame([(0, 20.0), (1, 50.0), (2, 120.0)], "center int, c double")
    return _rounded(cluster.nearest_center(t.signal(spark, sf_dir), centers, "x").select("stream_id", "idx", "center", "distance"), "distance")


@query
def kmeans1d_quartile(spark, sf_dir):
    return _rounded(cluster.kmeans_1d(t.signal(spark, sf_dir), "x"), "center", "low", "high")


@query
def band_classify(spark, sf_dir):
    bands = spark.createDataFrame([(s, b, lo, hi) for s in ("click", "view", "purchase", "signup", "error", "logout", "login", "scroll", "search") for b, lo, hi in ((0, 0.0, 30.0), (1, 20.0, 80.0), (2, 70.0, 400.0))], "stream_id string, band int, low double, high double")
    return _rounded(cluster.classify_bands(t.signal(spark, sf_dir), bands, "x").select("stream_id", "idx", "label", "confidence"), "confidence")


@query
def leader_cluster(spark, sf_dir):
    rows, segs = _segments(spark, sf_dir)
    means = segments.segment_means(rows, segs, ["x"]).withColumn("mean_x", r6("mean_x"))
    return cluster.leaders(means.select("stream_id", "seg_id", "mean_x"), "mean_x", 12.0).select("stream_id", "seg_id", "cluster_id", segments.letter(F.col("cluster_id")).alias("letter"))


@query
def kmeans_pp(spark, sf_dir):
    return cluster.kmeans_pp(segment_features(spark, sf_dir))


@query
def kmeans_levels(spark, sf_dir):
    rows = segment_features(spark, sf_dir).withColumn("rms_db", 20 * F.log10(F.col("rms") + 1e-12))
    return cluster.kmeans_levels(rows.select("stream_id", "seg_id", "centroid", "rms_db"))


@query
def merge_small_clusters(spark, sf_dir):
    return cluster.merge_small_clusters(kmeans_levels(spark, sf_dir), ("centroid", "rms_db"))


@query
def merge_short(spark, sf_dir):
    rows, segs = _segments(spark, sf_dir)
    return cluster.merge_short(segments.segment_means(rows, segs, ["x"]), ["mean_x"], 25.0)


@query
def majority_vote(spark, sf_dir):
    rows = t.signal(spark, sf_dir).withColumn("label", F.least(F.floor(F.col("x") / 40), F.lit(2)).cast("int"))
    out = near(rows, 4, 0, {"vote": lambda w: cluster.majority(w)[0], "share": lambda w: cluster.majority(w)[1]})
    return _rounded(out.select("stream_id", "idx", "vote", "share"), "share")


@query
def label_changes(spark, sf_dir):
    rows = t.signal(spark, sf_dir).withColumn("label", F.least(F.floor(F.col("x") / 40), F.lit(2)).cast("int"))
    out = near(rows, 1, 0, {"changed": lambda w: F.lag("label").over(w) != F.col("label")})
    return out.groupBy("stream_id").agg(F.count_if("changed").alias("n_changes"), F.count_distinct("label").alias("n_labels"))


# detector fusion


def _detector_events(spark, sf_dir) -> DataFrame:
    """stream_id, t, method, score: peaks of four scores of the signal."""
    rows = t.signal(spark, sf_dir)
    d = near(rows, 3, 3, {
        "centroid": lambda w: F.abs(F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))),
        "energy": lambda w: F.abs(F.col("x") * F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x")) * F.coalesce(F.lag("x").over(w), F.col("x"))),
        "jump": lambda w: F.abs(F.col("x") - F.coalesce(F.lag("x", 2).over(w), F.col("x"))),
        "shape": lambda w: F.abs(F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))),
    })
    events = None
    for method, weight in Fusion().weights:
        one = cp.percentile_threshold(d.select("stream_id", "idx", F.round(method, 9).alias("score")), "score", 0.93)
        one = cp.peaks(one, "score").select("stream_id", F.col("idx").cast("double").alias("t"), F.lit(method).alias("method"), (F.col("score") * weight).alias("score"))
        events = one if events is None else events.unionByName(one)
    return events


def _fused(spark, sf_dir) -> DataFrame:
    return fusion.fused(_detector_events(spark, sf_dir), Fusion().max_difference, F.floor(F.col("t") / 65536))


@query
def fuse_events(spark, sf_dir):
    out = _fused(spark, sf_dir)
    return out.select("stream_id", r6("t").alias("t"), F.array_join("methods", ",").alias("methods"), r6("score_sum").alias("score_sum"), r6("score_max").alias("score_max"), "n_events")


@query
def priority_rank(spark, sf_dir):
    return fusion.prioritised(_fused(spark, sf_dir), Fusion()).select("stream_id", r6("t").alias("t"), "priority")


@query
def fused_boundaries(spark, sf_dir):
    found = fusion.prioritised(_fused(spark, sf_dir), Fusion()).where("priority <= 2")
    ends = t.signal(spark, sf_dir).groupBy("stream_id").agg(F.max("idx").cast("double").alias("t"))
    return fusion.boundary_list(ends, found, Fusion().min_segment)


@query
def hit_rate(spark, sf_dir):
    rows, found = _peaks(spark, sf_dir)
    truth = rows.where("idx % 50 = 0 and idx > 0").select("stream_id", F.col("idx").cast("double").alias("t"))
    return _rounded(segments.truth_hits(truth, found.select("stream_id", F.col("idx").cast("double").alias("t")), 3.0), "hit_rate")


# silence


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream_id").agg(F.count("*").alias("n"))


@query
def silence_regions(spark, sf_dir):
    return silence.silent_regions(t.signal(spark, sf_dir), 45.0, 3)


@query
def keep_regions(spark, sf_dir):
    rows = t.signal(spark, sf_dir)
    return silence.complement(silence.silent_regions(rows, 45.0, 3), _lengths(rows))


@query
def removed_stats(spark, sf_dir):
    rows = t.signal(spark, sf_dir)
    return _rounded(silence.removed_stats(silence.silent_regions(rows, 45.0, 3), _lengths(rows)), "percent", "ratio")


@query
def silence_removed(spark, sf_dir):
    return _rounded(silence.without_silence(t.signal(spark, sf_dir), 45.0, 3), "x")


@query
def peak_amplitude(spark, sf_dir):
    rows = t.centred(spark, sf_dir).groupBy("stream_id").agg(F.max(F.abs("x")).alias("peak"))
    return rows.select("stream_id", r6("peak").alias("peak"), r6(F.col("peak") * 0.02).alias("limit"))


@query
def loud_channels(spark, sf_dir):
    rows = t.features(spark, sf_dir).withColumn("top", silence.loudest_channel(F.array(F.col("centroid") / 50, F.col("rms") * 10, F.col("rolloff") * 10)))
    return rows.groupBy("stream_id").agg(F.count_if(silence.is_silent(F.col("top"), 0.5)).alias("n_silent"), F.round(F.max("top"), 6).alias("peak"))


# reconstruction and splicing


@query
def mask_reconstruct(spark, sf_dir):
    rows, segs = _labelled(spark, sf_dir)
    return _rounded(reconstruct.masked(rows, segs, [0, 1, 2]).select("stream_id", "idx", "label", "x"), "x")


@query
def concat_reconstruct(spark, sf_dir):
    rows, segs = _labelled(spark, sf_dir)
    return _rounded(reconstruct.concatenated(rows, segs), "x")


@query
def crossfade_compact(spark, sf_dir):
    rows, segs = _labelled(spark, sf_dir)
    return _rounded(reconstruct.crossfaded(rows, segs, 4), "x")


@query
def crossfade_whole(spark, sf_dir):
    """Crossfades longer than most segments."""
    rows, segs = _labelled(spark, sf_dir)
    return _rounded(reconstruct.crossfaded_whole(rows, segs, 12), "x")


@query
def edge_fade(spark, sf_dir):
    rows, segs = _labelled(spark, sf_dir)
    return _rounded(reconstruct.edge_faded(rows, segs, 4), "x")


@query
def compact_masked(spark, sf_dir):
    rows = t.signal(spark, sf_dir).withColumn("x", F.when(F.col("x") > 45, F.col("x")).otherwise(0.0))
    return _rounded(reconstruct.compacted(rows), "x")


@query
def interleave_fixed(spark, sf_dir):
    rows = t.tracks(spark, sf_dir)
    return reconstruct.interleaved(rows, 3, 10, t.track_length(rows))


@query
def interleave_random(spark, sf_dir):
    rows = t.tracks(spark, sf_dir)
    return reconstruct.interleaved_by(rows, 3, reconstruct.random_rounds(spark, t.track_length(rows), 7, 19, 1))


@query
def interleave_rounds(spark, sf_dir):
    rows = t.tracks(spark, sf_dir)
    return reconstruct.interleaved_by(rows, 3, reconstruct.cycled_rounds(spark, t.track_length(rows), [13, 7, 35, 45, 20]))


@query
def loop_to_length(spark, sf_dir):
    """Every track as long as the longest."""
    tracks = t.tracks(spark, sf_dir)
    rows = tracks.select(F.col("track").cast("string").alias("stream_id"), "idx", "x")
    return reconstruct.loop_to(rows, _lengths(rows), t.track_length(tracks, longest=True))


@query
def int16_round_trip(spark, sf_dir):
    rows = normalize.minmax(t.signal(spark, sf_dir), "x").withColumn("i", fn.to_int16(2 * F.col("x") - 1))
    return rows.select("stream_id", "idx", F.col("i").cast("int").alias("i"), r6(fn.from_int16(F.col("i"))).alias("y"))


# filters


def _filter(kind: str, cutoff) -> Query:
    def run(spark, sf_dir):
        return _rounded(filters.filtered(t.centred(spark, sf_dir), filters.butterworth(5 if kind != "band" else 4, cutoff, RATE, kind)), "x")

    return run


QUERIES |= {"lowpass": _filter("low", 500.0), "highpass": _filter("high", 500.0), "bandpass": _filter("band", (300.0, 1500.0))}


# streams


@query
def stream_sessions(spark, sf_dir):
    return jobs.sessions(t.read(spark, sf_dir, "events"))


@query
def stream_gate(spark, sf_dir):
    """Blocks of 64 samples whose level is over a limit in dB, relative to the largest value."""
    rows = frames.tumbling(t.signal(spark, sf_dir), 64)
    return rows.select("stream_id", "frame_id", (fn.rms(F.col("samples")) > 150 * fn.db_to_linear(F.lit(-9.0))).alias("present"))


@query
def stream_stats(spark, sf_dir):
    """What the online processor tells of every two blocks of a stream."""
    settings = Settings(rate=8000, low=100.0, high=3000.0, every=2)
    return _rounded(jobs.stats(jobs.replay(frames.tumbling(t.signal(spark, sf_dir), 64), settings)), "mean_rms")


@query
def stream_deinterleave(spark, sf_dir):
    """The online processor over blocks of the event signal, as a batch replay."""
    return jobs.replay(frames.tumbling(t.signal(spark, sf_dir), 64)).drop("out", "stats")
