"""Rebuilding sources from labelled segments, and splicing test streams."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.helpers import cut, in_line, interval_join, near, running_max, running_sum
from spliceflow.operators.segments import within
from spliceflow.operators.silence import regions, renumbered


def masked(signal: DataFrame, segs: DataFrame, labels: list[int]) -> DataFrame:
    """stream_id, idx, label, x: for each label the whole stream, 0 outside its segments. segs: seg_id, i0, i1, label."""
    own = interval_join(signal, segs.select("stream_id", "seg_id", "i0", "i1", F.col("label").alias("__own")), 4096, "left")
    rows = own.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    return rows.select("stream_id", "idx", "label", F.when(F.col("__own") == F.col("label"), F.col("x")).otherwise(0.0).alias("x"))


def masked_by_label(signal: DataFrame, segs: DataFrame) -> DataFrame:
    """As masked, for the labels that occur in each stream's own segments. A stream without segments gives nothing."""
    own = interval_join(signal, segs.select("stream_id", "seg_id", "i0", "i1", F.col("label").alias("__own")), 4096, "left")
    labels = segs.groupBy("stream_id").agg(F.array_sort(F.collect_set("label")).alias("__labels"))
    rows = own.join(labels, "stream_id").withColumn("label", F.explode("__labels"))
    return rows.select("stream_id", "idx", "label", F.when(F.col("__own") == F.col("label"), F.col("x")).otherwise(0.0).alias("x"))


def _by_label(segs: DataFrame, place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """segs with the columns that place() adds to each label's segments in line, as though a label were a stream."""
    rows = in_line(segs.withColumn("stream_id", F.struct("stream_id", "label")), "i0")
    return place(rows).withColumn("stream_id", F.col("stream_id.stream_id")).drop("idx")


def concatenated(signal: DataFrame, segs: DataFrame) -> DataFrame:
    """stream_id, label, out_idx, x: each label's segments one after the other."""
    n = F.col("i1") - F.col("i0")
    placed = _by_label(segs, lambda rows: running_sum(rows, n, "offset").withColumn("offset", F.col("offset") - n))
    rows = interval_join(signal, placed.select("stream_id", "seg_id", "i0", "i1", "label", "offset"), 4096)
    return rows.select("stream_id", "label", (F.col("offset") + F.col("idx") - F.col("i0")).cast("long").alias("out_idx"), "x")


def ramp(place: Column, size: Column, curve: str = "linear") -> Column:
    """Gain at `place` of a fade-in over `size` samples; the fade-out is its counterpart at the same place."""
    if curve == "linear":
        return place / size
    if curve == "equal_power":
        return F.sin(F.lit(math.pi / 2) * place / size)
    raise ValueError(f"unknown curve: {curve}")


def fall(place: Column, size: Column, curve: str = "linear") -> Column:
    return 1 - place / size if curve == "linear" else F.cos(F.lit(math.pi / 2) * place / size)


def edge_faded(signal: DataFrame, segs: DataFrame, fade: int, curve: str = "linear") -> DataFrame:
    """Samples of segments with a fade-in at the start and a fade-out at the end, at most half a segment each."""
    rows = within(signal, segs)
    at, n = F.col("idx") - F.col("i0"), F.col("i1") - F.col("i0")
    size = F.least(F.lit(fade), F.floor(n / 2))
    gain = F.when(at < size, ramp(at, size, curve)).when(at >= n - size, fall(at - (n - size), size, curve)).otherwise(1.0)
    return rows.select("stream_id", "seg_id", "idx", (F.col("x") * gain).alias("x"))


def crossfaded(signal: DataFrame, segs: DataFrame, fade: int, curve: str = "linear") -> DataFrame:
    """stream_id, label, out_idx, x: each label's segments joined by crossfades of `fade` samples.

    A join takes no more samples than either segment can give: a segment gives at most half of itself to each side, so
    that gains never meet twice. Each sample is added at its place in the sum of all segments.
    """
    n = F.col("i1") - F.col("i0")
    half = lambda size: F.when(size >= 2 * fade, F.lit(fade)).otherwise(F.floor(size / 2))

    def place(rows: DataFrame) -> DataFrame:
        rows = near(rows.withColumn("n", n), 1, 1, {"before": lambda w: F.lag("n").over(w), "after": lambda w: F.lead("n").over(w)})
        rows = rows.withColumn("f_in", F.when(F.col("before").isNull(), 0).otherwise(F.least(half(F.col("before")), half(F.col("n")))))
        rows = rows.withColumn("f_out", F.when(F.col("after").isNull(), 0).otherwise(F.least(half(F.col("after")), half(F.col("n")))))
        own = F.col("n") - F.col("f_out")
        return running_sum(rows, own, "offset").withColumn("offset", F.col("offset") - own)

    placed = _by_label(segs, place)
    rows = interval_join(signal, placed.select("stream_id", "seg_id", "i0", "i1", "label", "n", "f_in", "f_out", "offset"), 4096)
    at = F.col("idx") - F.col("i0")
    gain = F.when(at < F.col("f_in"), ramp(at, F.col("f_in"), curve)).otherwise(1.0)
    gain = gain * F.when(at >= F.col("n") - F.col("f_out"), fall(at - (F.col("n") - F.col("f_out")), F.col("f_out"), curve)).otherwise(1.0)
    rows = rows.select("stream_id", "label", (F.col("offset") + at).cast("long").alias("out_idx"), (F.col("x") * gain).alias("x"))
    return rows.groupBy("stream_id", "label", "out_idx").agg(F.sum("x").alias("x"))


def crossfaded_whole(signal: DataFrame, segs: DataFrame, fade: int, curve: str = "linear") -> DataFrame:
    """As crossfaded, but a join takes `fade` samples, or all that the segment or what stands before it has.

    Segments are joined one after the other to what the earlier ones gave, so a place may lie in several joins; its gains
    then multiply. What stands before a join is never shorter than before the last one: its length n' = max(n' + max(n -
    fade, 0), n) after a segment of n samples, which is a running sum and a running maximum.
    """
    n = F.col("i1") - F.col("i0")

    def place(rows: DataFrame) -> DataFrame:
        rows = running_sum(rows.withColumn("n", n), F.greatest(n - fade, F.lit(0)), "grown")
        rows = running_max(rows, F.col("n") - F.col("grown"), "least").withColumn("length", F.col("grown") + F.col("least"))
        rows = near(rows, 1, 0, {"before": lambda w: F.coalesce(F.lag("length").over(w), F.lit(0))})
        rows = rows.withColumn("f", F.least(F.lit(fade), "before", "n"))
        return rows.select("stream_id", "seg_id", "i0", "i1", "label", "f", (F.col("before") - F.col("f")).alias("offset"), F.col("idx").alias("turn"))

    placed = cut(_by_label(segs, place))
    line = F.struct("stream_id", "label").alias("stream_id")
    points = interval_join(signal, placed.drop("f"), 4096).select(line, (F.col("offset") + F.col("idx") - F.col("i0")).cast("long").alias("idx"), "turn", "x")
    joins = placed.where("f > 0").select(line, F.col("turn").alias("join"), F.col("offset").alias("i0"), (F.col("offset") + F.col("f")).alias("i1"))
    at, size = F.col("idx") - F.col("i0"), F.col("i1") - F.col("i0")
    gain = F.when(F.col("join") == F.col("turn"), ramp(at, size, curve)).when(F.col("join") > F.col("turn"), fall(at, size, curve)).otherwise(1.0)
    gains = interval_join(points, joins, 4096, "left").select("stream_id", "idx", "turn", "x", gain.alias("gain")).repartition("stream_id", "idx")
    # one exchange serves both groupings
    parts = gains.groupBy("stream_id", "idx", "turn").agg((F.first("x") * F.product("gain")).alias("x"))
    return parts.groupBy("stream_id", "idx").agg(F.sum("x").alias("x")).select("stream_id.stream_id", "stream_id.label", F.col("idx").alias("out_idx"), "x")


def compacted(track: DataFrame, limit: float = 0.0) -> DataFrame:
    """A masked track without its silent samples: stream_id, idx, x, out_idx."""
    return renumbered(track.where(F.abs("x") > limit))


def sounding_segments(track: DataFrame, limit: float = 0.0) -> DataFrame:
    """The runs of a masked track above limit, as segments of label 0, for crossfaded()."""
    return regions(track.where(F.abs("x") > limit)).withColumns({"seg_id": F.col("i0"), "label": F.lit(0)})


def loop_to(signal: DataFrame, lengths: DataFrame, wanted: int) -> DataFrame:
    """Each stream repeated or cut to `wanted` samples. lengths: stream_id, n."""
    rows = signal.join(lengths, "stream_id").where(F.col("idx") < wanted)
    times = F.floor((F.lit(wanted - 1) - F.col("idx")) / F.col("n"))
    rows = rows.withColumn("__turn", F.explode(F.sequence(F.lit(0).cast("bigint"), times)))
    return rows.select("stream_id", (F.col("idx") + F.col("__turn") * F.col("n")).cast("long").alias("idx"), "x")


def interleaved(tracks: DataFrame, n_tracks: int, block: int, total: int) -> DataFrame:
    """track (0 ..), idx, x -> out_idx, track, idx, x: block after block of each track in turn, over the first `total`
    samples of each (the shortest track's length); the last turn is cut short."""
    turn = F.floor(F.col("idx") / block)
    size = F.least(F.lit(block), F.lit(total) - turn * block)
    place = turn * (block * n_tracks) + F.col("track") * size + F.col("idx") - turn * block
    return tracks.where(F.col("idx") < total).select(place.cast("long").alias("out_idx"), "track", "idx", "x")


def interleaved_by(tracks: DataFrame, n_tracks: int, rounds: DataFrame) -> DataFrame:
    """As interleaved, with the rounds' own block lengths: rounds (round, i0, i1), the same for all tracks."""
    spans = rounds.select(F.lit("all").alias("stream_id"), F.col("round").alias("seg_id"), "i0", "i1")
    rows = interval_join(tracks.withColumn("stream_id", F.lit("all")), spans, 4096)
    place = F.col("i0") * n_tracks + F.col("track") * (F.col("i1") - F.col("i0")) + F.col("idx") - F.col("i0")
    return rows.select(place.cast("long").alias("out_idx"), "track", "idx", "x")


def _rounds(spark, total: int, least: int, length: Column) -> DataFrame:
    """round, i0, i1 up to `total`, of the lengths that `length` gives by id; the last is cut. least: the shortest."""
    rows = spark.range(-(-total // least)).select(F.lit("all").alias("stream_id"), F.col("id").alias("idx"), length.alias("len"))
    rows = running_sum(rows, F.col("len"), "end").select(F.col("idx").alias("round"), (F.col("end") - F.col("len")).alias("i0"), F.least("end", F.lit(total)).alias("i1"))
    return rows.where(F.col("i0") < total)


def random_rounds(spark, total: int, low: int, high: int, seed: int) -> DataFrame:
    """Block lengths from low to high by a seeded congruence of the round, which SQL can repeat."""
    return _rounds(spark, total, low, F.lit(low) + (((F.col("id") % 1_000_003) * 7919 + seed * 104_729) % 1_000_003 * 31_337) % 1_000_033 % (high - low + 1))


def cycled_rounds(spark, total: int, lengths: list[int]) -> DataFrame:
    """The given block lengths again and again."""
    return _rounds(spark, total, min(lengths), F.get(F.array(*[F.lit(n).cast("long") for n in lengths]), (F.col("id") % len(lengths)).cast("int")))
