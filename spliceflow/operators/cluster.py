"""Clustering the segments of a stream: k-means with given seeds, leader clustering, merging, band classification.

K-means runs in rounds over Spark (kmeans). Merging short segments and leader clustering are sequential by definition:
they pass through a stream's segments in order, in memory that doesn't grow with them; streams run in parallel.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.helpers import cut, in_order, percentiles
from spliceflow.operators import kmeans

FEATURES = ["centroid", "rms", "rolloff", "zcr", "power_std", "bandwidth"]


def choose_clusters(segs: DataFrame, wide: float = 3000.0, noisy: float = 0.1) -> DataFrame:
    """Per stream: 3 clusters if centroids span more than `wide` or zero crossings more than `noisy`, else 2."""
    span = lambda c: F.max(c) - F.min(c)
    return segs.groupBy("stream_id").agg(F.when((span("centroid") > wide) | (span("zcr") > noisy), 3).otherwise(2).alias("k"))


def kmeans_pp(segs: DataFrame, columns: list[str] | None = None, clusters: int | None = None) -> DataFrame:
    """Add label. segs: stream_id, seg_id and the feature columns."""
    return kmeans.labelled_pp(segs, columns or FEATURES, clusters)


def kmeans_levels(segs: DataFrame, columns: tuple[str, str] = ("centroid", "rms_db"), clusters: int | None = None, least: int = 3) -> DataFrame:
    """Add label: k-means over level and centroid, small clusters merged, labels by centroid."""
    return merge_small_clusters(kmeans.labelled_levels(segs, columns, clusters), columns, least)


def merged_small(counts: np.ndarray, means: np.ndarray, least: int, units: tuple[float, float] = (500.0, 6.0), near: float = 1.8) -> np.ndarray:
    """For each cluster, the number of the one that it ends in. Again and again, the first of fewer than `least` rows joins
    the nearest other one, if that is near in units of the two features."""
    ends, counts, means = np.arange(len(counts)), counts.copy(), means.copy()
    alive = list(range(len(counts)))
    while True:
        for k in alive:
            others = [(np.linalg.norm((means[k] - means[o]) / np.array(units)), o) for o in alive if o != k] if counts[k] < least else []
            if others and min(others)[0] < near:
                o = min(others)[1]
                means[o] = (means[o] * counts[o] + means[k] * counts[k]) / (counts[o] + counts[k])
                counts[o] += counts[k]
                ends[ends == k] = o
                alive.remove(k)
                break
        else:
            return ends


def merge_small_clusters(labelled: DataFrame, columns: tuple[str, str], least: int = 3) -> DataFrame:
    """Replace label after merged_small() and ordering by the first column. Only counts and means of clusters are looked at together."""
    labelled = cut(labelled)
    clusters = labelled.groupBy("stream_id", "label").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("label", ignore_index=True)
        found = merged_small(p["n"].to_numpy(), p[["m0", "m1"]].to_numpy(float), least)
        return pd.DataFrame({"stream_id": p["stream_id"], "label": p["label"], "into": p["label"].to_numpy()[found]})

    into = clusters.groupBy("stream_id").applyInPandas(ends, "stream_id string, label int, into int")
    merged = labelled.join(into, ["stream_id", "label"]).drop("label").withColumnRenamed("into", "label")
    return kmeans.by_mean(merged, columns[0]).select(*labelled.columns)


class Merging:
    """Segments of a stream in order; the first short one joins its nearer neighbour, again and again, two being left.

    All before the current segment are long, so only the last of them can still change, and one row is looked ahead.
    """

    def __init__(self, columns: list[str], shortest: float):
        self.columns, self.shortest = columns, shortest
        self.left = self.here = None
        self.n, self.gone, self.put = None, 0, 0

    def _short(self, seg: list) -> bool:
        return self.n - self.gone > 2 and seg[1] - seg[0] < self.shortest

    def _joined(self, a: list, b: list) -> list:
        self.gone += 1
        u, v = a[1] - a[0], b[1] - b[0]
        return [a[0], b[1], (a[2] * u + b[2] * v) / max(u + v, 1e-9)]

    def _out(self, seg: list | None) -> list[tuple]:
        if seg is None:
            return []
        self.put += 1
        return [(self.stream, self.put - 1, seg[0], seg[1], *map(float, seg[2]))]

    def next(self, row: dict) -> list[tuple]:
        self.stream, self.n = row["stream_id"], row["n"]
        new = [row["t0"], row["t1"], np.array([row[c] for c in self.columns], float)]
        if self.here is not None and self._short(self.here):
            to_left = self.left is not None and np.linalg.norm(self.here[2] - self.left[2]) <= np.linalg.norm(self.here[2] - new[2])
            if not to_left:
                self.here = self._joined(self.here, new)
                return []
            self.left, self.here = self._joined(self.left, self.here), None
        if self.here is None:
            self.here = new
            return []
        out = self._out(self.left)
        self.left, self.here = self.here, new
        return out

    def end(self) -> list[tuple]:
        if self.left is not None and self.here is not None and self._short(self.here):
            self.left, self.here = self._joined(self.left, self.here), None
        return self._out(self.left) + self._out(self.here)


def merge_short(segs: DataFrame, columns: list[str], shortest: float) -> DataFrame:
    """stream_id, seg_id (renumbered), t0, t1 and the feature columns, which are means by length, after Merging."""
    n = segs.groupBy("stream_id").agg(F.count("*").alias("n"))
    kept = segs.join(n, "stream_id").select("stream_id", "seg_id", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), "n", *[F.col(c).cast("double").alias(c) for c in columns])
    schema = "stream_id string, seg_id long, t0 double, t1 double" + "".join(f", {c} double" for c in columns)
    return in_order(kept, "seg_id", lambda: Merging(columns, shortest), schema)


class Leaders:
    """Running means in order of size, each with its cluster's number and count; a value looks at both neighbours only."""

    def __init__(self, radius: float):
        self.radius, self.means, self.ids, self.counts = radius, [], [], []

    def next(self, row: dict) -> list[tuple]:
        v, means = row["v"], self.means
        i = bisect.bisect_left(means, v)
        # of equal means the one of the lower number is the nearest
        sides = [(abs(means[j] - v), j) for j in {bisect.bisect_left(means, means[i - 1]) if i else i, i} if 0 <= j < len(means)]
        best = min(((d, self.ids[j], j) for d, j in sides), default=None)
        if best is None or not best[0] <= self.radius:
            mean, number, count = v, len(means), 1
        else:
            j = best[2]
            mean, number, count = means.pop(j), self.ids.pop(j), self.counts[best[1]] + 1
            mean += (v - mean) / count
        at = bisect.bisect_left(means, mean)
        while at < len(means) and means[at] == mean and self.ids[at] < number:
            at += 1
        means.insert(at, mean)
        self.ids.insert(at, number)
        if number == len(self.counts):
            self.counts.append(count)
        self.counts[number] = count
        return [(row["stream_id"], row["seg_id"], number)]

    def end(self) -> list[tuple]:
        return []


def leaders(segs: DataFrame, column: str, radius: float) -> DataFrame:
    """Add cluster_id: each segment, in order, joins the nearest running mean within radius, or starts a cluster."""
    rows = segs.select("stream_id", F.col("seg_id").cast("long").alias("seg_id"), F.col(column).cast("double").alias("v"))
    found = in_order(rows, "seg_id", lambda: Leaders(radius), "stream_id string, seg_id long, cluster_id int")
    return segs.join(found, ["stream_id", "seg_id"])


def nearest_center(points: DataFrame, centers: DataFrame, column: str) -> DataFrame:
    """Add center (the nearest by column; the lower number among equals) and distance. centers: center, c; a few rows."""
    one = centers.agg(F.array_sort(F.collect_list(F.struct("center", "c"))).alias("__centers"))
    best = F.array_min(F.transform("__centers", lambda x: F.struct(F.abs(F.col(column) - x["c"]).alias("distance"), x["center"].alias("center"))))
    return points.crossJoin(F.broadcast(one)).withColumn("__b", best).select(*points.columns, F.col("__b.center").alias("center"), F.col("__b.distance").alias("distance"))


def kmeans_1d(points: DataFrame, column: str, rounds: int = 20, margin: float = 0.3) -> DataFrame:
    """Three frequency bands per stream: k-means from the quarter, half and three-quarter values, a fixed number of rounds.

    stream_id, band (0 to 2 by center), center, low, high, n: each cluster's range widened by margin. Equal values count
    as one, with a weight; each round sums them up to three numbers per stream, and its centers are written down, so that
    plans stay short.
    """
    rows = points.where(F.col(column).isNotNull()).select("stream_id", F.col(column).cast("double").alias("v"))
    values = cut(rows.groupBy("stream_id", "v").agg(F.count("*").alias("m")))
    centers = percentiles(rows, "v", {"c0": 0.25, "c1": 0.5, "c2": 0.75}, at_place=True)
    d = [F.abs(F.col("v") - F.col(f"c{i}")) for i in range(3)]
    nearest = F.when((d[0] <= d[1]) & (d[0] <= d[2]), 0).when(d[1] <= d[2], 1).otherwise(2)

    def mean(i: int) -> Column:
        mine = F.col("b") == i
        return F.coalesce(F.sum(F.when(mine, F.col("v") * F.col("m"))) / F.sum(F.when(mine, F.col("m"))), F.first(f"c{i}")).alias(f"c{i}")

    for turn in range(rounds):
        centers = values.join(centers, "stream_id").withColumn("b", nearest).groupBy("stream_id").agg(*[mean(i) for i in range(3)])
        if turn % 5 == 4:
            centers = cut(centers)
    found = values.join(centers, "stream_id").withColumn("b", nearest)
    out = found.groupBy("stream_id", "b").agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("center"), (F.min("v") * (1 - margin)).alias("low"), (F.max("v") * (1 + margin)).alias("high"), F.sum("m").alias("n"))
    band = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("low") + F.col("high"))) - 1
    return out.select("stream_id", band.cast("int").alias("band"), "center", "low", "high", "n")


def classify_bands(points: DataFrame, bands: DataFrame, column: str) -> DataFrame:
    """Add label and confidence of the surest band (stream_id, band, low, high) that holds the value; null if none does.

    Confidence falls from 1 in the middle of a band to 0 at its edges; the lower band wins among equals.
    """
    lists = bands.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("band", "low", "high"))).alias("__bands"))
    v = F.col(column)
    sure = lambda b: F.least(F.greatest(1 - F.abs(v - (b["low"] + b["high"]) / 2) / ((b["high"] - b["low"]) / 2), F.lit(0.0)), F.lit(1.0))
    fits = F.transform(F.filter("__bands", lambda b: (b["low"] <= v) & (v <= b["high"])), lambda b: F.struct((-sure(b)).alias("c"), b["band"].alias("label")))
    out = points.join(lists, "stream_id", "left").withColumn("__b", F.array_min(F.filter(fits, lambda x: x["c"] < 0)))
    return out.drop("__bands").withColumns({"label": F.col("__b.label"), "confidence": F.coalesce(-F.col("__b.c"), F.lit(0.0))}).drop("__b")


def majority(w, size: int = 5) -> tuple[Column, Column]:
    """Most frequent label (the lowest among equals) of the last `size` rows with one, and its share, over window w."""
    around = F.collect_list("label").over(w.rowsBetween(1 - size, 0))
    votes = F.transform(F.array_distinct(around), lambda v: F.struct((-F.size(F.filter(around, lambda x: x == v))).alias("n"), v.alias("label")))
    best = F.array_min(votes)
    return best["label"], -best["n"] / F.size(around)
