"""Change scores, thresholds, peaks and boundaries along a stream (stream_id, idx, ...)."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.config import Cfar
from spliceflow.helpers import CHUNK, cut, discard, in_order, last_before, near, percentiles
from spliceflow.operators.normalize import robust_minmax


def first_difference(column: str) -> Callable:
    """|x - previous x|, 0 at the start."""
    return lambda w: F.abs(F.col(column) - F.coalesce(F.lag(column).over(w), F.col(column)))


def moving_average(column: str, size: int = 5) -> Callable:
    """Centred; what lies beyond the ends counts as 0, and the divisor is always `size`."""
    half = size // 2
    return lambda w: F.sum(column).over(w.rowsBetween(-half, half)) / float(size)


def median_filter(column: str, size: int) -> Callable:
    """Centred median of an odd number of values; the ends are repeated outwards."""
    half = size // 2

    def at(w):
        around = F.collect_list(column).over(w.rowsBetween(-half, half))
        left = F.count("*").over(w.rowsBetween(-half, -1))
        right = F.count("*").over(w.rowsBetween(1, half))
        first = F.first(column).over(w.rowsBetween(-half, half))
        last = F.last(column).over(w.rowsBetween(-half, half))
        fill = lambda c, n: F.array_repeat(c, (half - n).cast("int"))
        return F.element_at(F.array_sort(F.concat(fill(first, left), around, fill(last, right))), half + 1)

    return at


def smoothed(df: DataFrame, column: str, size: int = 5) -> DataFrame:
    return near(df, size // 2, size // 2, {column: moving_average(column, size)})


def change_score(df: DataFrame, weights: dict[str, float], valid: str | None = None, size: int = 5) -> DataFrame:
    """Add `score`: weighted mean of the changes of robustly scaled features, smoothed.

    With `valid`, scaling looks at valid rows, and invalid rows have score 0 before smoothing.
    """
    ok = None if valid is None else F.col(valid)
    scaled = robust_minmax(df.withColumns({f"__{c}": F.col(c).cast("double") for c in weights}), [f"__{c}" for c in weights], ok)
    total = sum(weights.values())

    def score(w):
        out = sum((first_difference(f"__{c}")(w) * k for c, k in weights.items()), F.lit(0.0)) / total
        return out if ok is None else F.when(ok, out).otherwise(0.0)

    scaled = near(scaled, 1, 0, {"score": score}).drop(*[f"__{c}" for c in weights])
    return smoothed(scaled, "score", size)


def percentile_threshold(df: DataFrame, column: str, share: float, valid: Column | None = None) -> DataFrame:
    """Add `threshold`: the percentile of the stream's (valid) values."""
    return df.join(percentiles(df if valid is None else df.where(valid), column, {"threshold": share}), "stream_id", "left").na.fill(0.0, ["threshold"])


def cfar_threshold(column: str, cfar: Cfar) -> Callable:
    """Add as a window column: alpha times the noise around a cell, without the guard cells next to it.

    CA: mean of the training cells. OS: their k-th smallest. SO: the smaller of both sides' means; if one is 0, the other.
    """
    reach, guard = cfar.guard + cfar.train, cfar.guard

    def at(w):
        left, right = w.rowsBetween(-reach, -guard - 1), w.rowsBetween(guard + 1, reach)
        if cfar.method == "OS":
            cells = F.array_sort(F.concat(F.collect_list(column).over(left), F.collect_list(column).over(right)))
            k = F.greatest(F.lit(0), F.least(F.floor(F.size(cells) * F.lit(cfar.k_fraction)).cast("int"), F.size(cells) - 1))
            noise = F.get(cells, k)
        elif cfar.method == "CA":
            n = F.count(column).over(left) + F.count(column).over(right)
            noise = (F.coalesce(F.sum(column).over(left), F.lit(0.0)) + F.coalesce(F.sum(column).over(right), F.lit(0.0))) / F.when(n > 0, n)
        else:
            a, b = (F.coalesce(F.avg(column).over(x), F.lit(0.0)) for x in (left, right))
            noise = F.when((a > 0) & (b > 0), F.least(a, b)).otherwise(F.greatest(a, b))
        return F.coalesce(noise, F.lit(0.0)) * cfar.alpha

    return at


def with_threshold(df: DataFrame, column: str, cfar: Cfar, valid: Column | None = None) -> DataFrame:
    if cfar.method == "PERCENTILE":
        return percentile_threshold(df, column, cfar.percentile, valid)
    reach = cfar.guard + cfar.train
    return near(df, reach, reach, {"threshold": cfar_threshold(column, cfar)})


def noise_cells(df: DataFrame, column: str, cfar: Cfar) -> DataFrame:
    """Add `cells`: the sorted training cells, from which a sweep over (alpha, k) takes thresholds without a new window."""
    reach, guard = cfar.guard + cfar.train, cfar.guard
    cells = lambda w: F.array_sort(F.concat(F.collect_list(column).over(w.rowsBetween(-reach, -guard - 1)), F.collect_list(column).over(w.rowsBetween(guard + 1, reach))))
    return near(df, reach, reach, {"cells": cells})


def cfar_sweep(df: DataFrame, column: str, grid: DataFrame, cfar: Cfar) -> DataFrame:
    """Per stream and (alpha, k_fraction) of grid: how many cells exceed their OS threshold. The grid is a few hundred rows.

    A cell gives one row for each k_fraction: the factor up to which it exceeds its noise. Alphas are compared within it.
    """
    alphas = grid.groupBy("k_fraction").agg(F.array_sort(F.collect_list("alpha")).alias("alphas"))
    rows = noise_cells(df, column, cfar).select("stream_id", column, "cells").crossJoin(F.broadcast(alphas))
    k = F.greatest(F.lit(0), F.least(F.floor(F.size("cells") * F.col("k_fraction")).cast("int"), F.size("cells") - 1))
    rows = rows.withColumn("noise", F.coalesce(F.get("cells", k), F.lit(0.0)))
    # equal rows by which alphas are exceeded count as one before alphas are listed
    over = F.transform("alphas", lambda a: F.col(column) > a * F.col("noise"))
    counts = rows.groupBy("stream_id", "k_fraction", over.alias("over")).agg(F.first("alphas").alias("alphas"), F.count("*").alias("n"))
    each = counts.select("stream_id", "k_fraction", "n", F.explode(F.arrays_zip("alphas", "over")).alias("x"))
    return each.groupBy("stream_id", F.col("x.alphas").alias("alpha"), "k_fraction").agg(F.coalesce(F.sum(F.when(F.col("x.over"), F.col("n"))), F.lit(0)).alias("n_above"), F.sum("n").alias("n_cells"))


def peaks(df: DataFrame, column: str, reach: int = 1, open_ends: bool = False) -> DataFrame:
    """Rows above `threshold` that are not below their neighbours within reach; both ends are out unless open_ends.

    open_ends: a missing neighbour counts as lower, and reaching the threshold is enough.
    """

    def is_peak(w):
        around = w.rowsBetween(-reach, reach)
        top = F.col(column) >= F.max(column).over(around)
        if open_ends:
            return top & (F.col(column) >= F.col("threshold"))
        return top & (F.col(column) > F.col("threshold")) & (F.count("*").over(around) == 2 * reach + 1)

    return near(df, reach, reach, {"__peak": is_peak}).where("__peak").drop("__peak")


def _near_groups(candidates: DataFrame, gap: float, position: str) -> DataFrame:
    """Add `__run`: candidates less than gap from the previous one share its run. Runs don't influence one another."""
    candidates = candidates.where(f"{position} is not null")
    prev = last_before(candidates, F.col(position), "__prev")
    new = F.col("__prev").isNull() | (F.col(position) - F.col("__prev") >= gap)
    return last_before(prev, F.when(new, F.col("idx")), "__run", inclusive=True).drop("__prev")


def _jumps(p: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted place, the first one at least gap on (len(p): none), and the last one that is kept if it is."""
    # the test itself is p[j] - p[i] >= gap; the search may be off by one where a sum is rounded
    to = np.maximum(np.searchsorted(p, p + gap), np.arange(1, len(p) + 1))
    to -= (to > 0) & (p[np.maximum(to - 1, 0)] - p >= gap) & (to - 1 > np.arange(len(p)))
    short = to < len(p)
    to[short] += p[to[short]] - p[short] < gap
    last, jump = np.arange(len(p)), to
    while (jump < len(p)).any():  # twice as far each time
        on = jump < len(p)
        last[on] = last[jump[on]]
        jump = np.where(on, jump[np.minimum(jump, len(p) - 1)], jump)
    return to, last


class Carried:
    """The last place kept, from chunk to chunk of a stream."""

    def __init__(self, start: float, gap: float):
        self.last, self.gap = start, gap

    def next(self, row: dict) -> list[tuple]:
        out = [(row["stream_id"], row["chunk"], self.last)]
        # the first place that is far enough from the last one leads to this chunk's last one
        for reach, end in zip(row["reach"], row["ends"], strict=True):
            if reach - self.last >= self.gap:
                self.last = end
                break
        return out

    def end(self) -> list[tuple]:
        return []


def earliest_first(candidates: DataFrame, gap: float, position: str = "idx", start: float | None = 0.0, chunk: int = CHUNK) -> DataFrame:
    """Greedy from the left: keep a candidate at least `gap` after the last one kept, `start` counting as kept.

    Each chunk of idx finds by itself, for each candidate it could begin with, where it would end (chains of jumps soon
    meet, so there are few different ends). Through one row for each chunk its true beginning is known; then each chunk
    keeps its own, wherever candidates stand close together.
    """
    candidates = cut(candidates)
    low = float("-inf") if start is None else float(start)
    rows = candidates.where(f"{position} is not null").select("stream_id", F.floor(F.col("idx") / chunk).alias("chunk"), "idx", F.col(position).cast("double").alias("p"))

    def ends(table: pa.Table) -> pa.Table:
        p = np.unique(table["p"].to_numpy())
        last = p[_jumps(p, gap)[1]]
        # of candidates that lead to the same end, the last one says how far a beginning reaches it
        own = np.append(last[1:] != last[:-1], True)
        one = lambda v: pa.array([v.tolist()], pa.list_(pa.float64()))
        return pa.Table.from_arrays([table["stream_id"][:1], table["chunk"][:1], one(p[own]), one(last[own])], ["stream_id", "chunk", "reach", "ends"])

    found = rows.groupBy("stream_id", "chunk").applyInArrow(ends, "stream_id string, chunk long, reach array<double>, ends array<double>")
    begins = in_order(found, "chunk", lambda: Carried(low, gap), "stream_id string, chunk long, last double")

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by([("p", "ascending"), ("idx", "ascending")])
        p = table["p"].to_numpy()
        to, i, kept = _jumps(p, gap)[0], int(np.argmax(p - table["last"][0].as_py() >= gap)), []
        while i < len(p) and (kept or p[i] - table["last"][0].as_py() >= gap):
            kept.append(i)
            i = int(to[i])
        return table.select(["stream_id", "idx"]).take(pa.array(kept, pa.int64()))

    kept = rows.join(begins, ["stream_id", "chunk"]).groupBy("stream_id", "chunk").applyInArrow(keep, "stream_id string, idx long")
    return candidates.join(kept, ["stream_id", "idx"], "left_semi")


def _decided(p: np.ndarray, score: np.ndarray, state: np.ndarray, mine: np.ndarray, gap: float) -> np.ndarray:
    """New states (0 open, 1 kept, 2 gone) of the candidates that are mine, as far as these and their surroundings tell.

    By score, the earlier first among equals: near a kept one a candidate goes; near an open one that is stronger it stays
    open; else it is kept. Kept and open places are held in order, so only the nearest ones on both sides are looked at.
    """
    state = state.copy()
    kept, still = np.sort(p[state == 1]).tolist(), []
    near = lambda held, x: (i := bisect.bisect_left(held, x)) < len(held) and abs(held[i] - x) < gap or i > 0 and abs(x - held[i - 1]) < gap
    for i in np.lexsort((p, -score)):
        if state[i]:
            continue
        x = float(p[i])
        if near(kept, x):
            state[i] = 2
        elif not mine[i] or near(still, x):
            bisect.insort(still, x)
        else:
            state[i] = 1
            bisect.insort(kept, x)
    return state


def strongest_first(candidates: DataFrame, gap: float, score: str, position: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Greedy by score, the earlier first among equals: keep a candidate at least `gap` from all kept ones.

    In rounds: each chunk of places, with what stands up to gap beyond its ends, decides what it can, in order of score.
    Only what depends on an open candidate beyond an end waits for the next round, so there is mostly a second one for
    the borders; a slope of scores over many chunks takes one for each of them.
    """
    candidates = cut(candidates)
    step = float(chunk) if position == "idx" else candidates.select((F.max(position) / F.greatest(F.max("idx"), F.lit(1)) * chunk)).first()[0]
    width = max(step or 1.0, 2 * gap)
    rows = cut(candidates.where(f"{position} is not null").select("stream_id", "idx", F.col(position).cast("double").alias("p"), F.col(score).cast("double").alias("s"), F.lit(0).alias("state")))

    def decide(table: pa.Table) -> pa.Table:
        col = lambda c: table[c].to_numpy()
        own = col("own") == col("chunk")
        state = _decided(col("p"), col("s"), col("state"), own, gap)
        return pa.Table.from_arrays([table["stream_id"], table["idx"], table["p"], table["s"], pa.array(state.astype("int32"))], ["stream_id", "idx", "p", "s", "state"]).filter(pa.array(own & (state < 2)))

    while True:
        own = F.floor(F.col("p") / width)
        at = F.col("p") - own * width
        places = F.array(own, F.when(at < gap, own - 1), F.when(at >= width - gap, own + 1))
        dealt = rows.withColumn("own", own).withColumn("chunk", F.explode(F.filter(places, lambda x: x.isNotNull())))
        nxt = cut(dealt.groupBy("stream_id", "chunk").applyInArrow(decide, "stream_id string, idx long, p double, s double, state int"))
        discard(rows)
        rows = nxt
        if rows.where("state = 0").isEmpty():
            return candidates.join(rows, ["stream_id", "idx"], "left_semi")


def consolidated(candidates: DataFrame, window: int, score: str) -> DataFrame:
    """Of candidates that follow one another within `window`, the strongest; the earliest among equals."""
    candidates = cut(candidates)
    rows = _near_groups(candidates, window + 1, "idx")
    best = rows.groupBy("stream_id", "__run").agg(F.min_by("idx", F.struct(-F.col(score), "idx")).alias("idx"))
    return candidates.join(best.select("stream_id", "idx"), ["stream_id", "idx"], "left_semi")


def hysteresis(df: DataFrame, column: str, size: int) -> DataFrame:
    """Add `gate`: the value and its size - 1 predecessors all exceed threshold. The first rows of a run stay closed."""
    over = lambda w: F.count_if(F.col(column) > F.col("threshold")).over(w.rowsBetween(1 - size, 0)) == size
    return near(df, size - 1, 0, {"gate": over})


def pick_peaks(df: DataFrame, column: str, share: float, gap: int, window: int, size: int) -> DataFrame:
    """Percentile threshold (without the first value), hysteresis, local maxima, strongest-first gap, consolidation."""
    df = df.join(percentiles(df.where("idx > 0"), column, {"threshold": share}), "stream_id")
    if size > 1:
        df = hysteresis(df, column, size).withColumn(column, F.when(F.col("gate"), F.col(column)).otherwise(0.0)).drop("gate")
    return consolidated(strongest_first(peaks(df, column), gap, column), window, column)


def boundaries(df: DataFrame, candidates: DataFrame, gap: float, position: str = "idx") -> DataFrame:
    """stream_id, t: 0, the candidates at least `gap` apart, and the last row's position without a gap test.

    Fewer than two candidates in a stream count as none.
    """
    candidates = cut(candidates)
    counts = candidates.groupBy("stream_id").agg(F.count("*").alias("__n")).where("__n > 1")
    inner = earliest_first(candidates.join(counts, "stream_id", "left_semi"), gap, position)
    ends = df.groupBy("stream_id").agg(F.max(position).alias("t")).select("stream_id", F.explode(F.array(F.lit(0.0), F.col("t").cast("double"))).alias("t"))
    return ends.unionByName(inner.select("stream_id", F.col(position).cast("double").alias("t")))
