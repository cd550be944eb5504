"""The online processor: which source sounds in a stream of blocks, decided block by block with a small state.

Times are sample times, so a replay gives what the live stream gave.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np

from spliceflow.operators.filters import butterworth, run_sections, steady_state
from spliceflow.streaming.ring import Ring


@dataclass(frozen=True)
class Settings:
    """Fixed values of the method: levels, windows in ms, relative changes that count, distances between sources."""

    rate: int = 44100
    low: float = 80.0
    high: float = 12000.0
    order: int = 4
    gate_db: float = -40.0
    window_ms: float = 50.0
    delay_ms: float = 50.0
    ring_ms: float = 600.0
    min_segment_ms: float = 10.0
    silence_ms: float = 200.0
    quiet: float = 0.001
    centroid_change: float = 0.3
    rms_change: float = 0.5
    max_sources: int = 3
    new_source: float = 0.4
    adapt: float = 0.1
    target: int = 0
    #: Blocks between two rows of statistics.
    every: int = 100


@dataclass
class State:
    """What is kept of a stream: typed, of a size that doesn't grow with the stream."""

    filter: list = field(default_factory=list)
    present: bool = False
    waiting: list = field(default_factory=list)  # (id, samples) of blocks in the ring that are not yet put out
    filled: int = 0
    centroids: list = field(default_factory=list)
    levels: list = field(default_factory=list)
    clock: int = 0
    changed_at: int = -(1 << 60)
    profiles: list = field(default_factory=list)
    label: int = -1
    silent_blocks: int = 0

    blocks: int = 0
    #: Since the last row of statistics: blocks, those with a source, changes, levels, and blocks that have a level.
    counted: list = field(default_factory=lambda: [0, 0, 0, 0.0, 0])
    ring: Ring | None = None


def centroid_and_level(x: np.ndarray, rate: int) -> tuple[float, float]:
    """Spectral centroid of the tapered samples and their rms; 0, 0 for fewer than ten."""
    if len(x) < 10:
        return 0.0, 0.0
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
    total = power.sum()
    freqs = np.fft.rfftfreq(len(x), 1 / rate)
    return float((freqs * power).sum() / total) if total > 1e-10 else 0.0, float(np.sqrt(np.mean(x**2)))


def _relative(value: float, before: float, floor: float) -> float:
    return abs(value - before) / max(before, floor)


class Online:
    def __init__(self, settings: Settings):
        self.s = settings
        self.sos = butterworth(settings.order, (settings.low, settings.high), settings.rate, "band")

    def classify(self, st: State, centroid: float, level: float) -> int:
        """The nearest source's number; sources are numbered by centroid. -1 if too quiet.

        Distance: eight tenths of the relative change in centroid, two of that in level. Nothing near and room left: a new
        source, put in its place among the others, which may renumber them. Else the nearest one moves a little.
        """
        if level < self.s.quiet:
            return -1
        distance = lambda p: 0.8 * _relative(centroid, p[0], 100.0) + 0.2 * _relative(level, p[1], 0.01)
        near, best = min(((distance(p), i) for i, p in enumerate(st.profiles)), default=(np.inf, 0))
        if near > self.s.new_source and len(st.profiles) < self.s.max_sources or not st.profiles:
            best = bisect.bisect_right([p[0] for p in st.profiles], centroid)
            st.profiles.insert(best, [centroid, level])
            return best
        old = st.profiles[best]
        st.profiles[best] = [old[i] + self.s.adapt * (new - old[i]) for i, new in enumerate((centroid, level))]
        return best

    def changed(self, st: State, centroid: float, level: float) -> bool:
        """A jump against the median of the last three, no sooner than the shortest segment after the last change."""
        early = (st.clock - st.changed_at) * 1000 < self.s.min_segment_ms * self.s.rate
        out = False
        if not early and len(st.centroids) >= 3:
            out = _relative(centroid, float(np.median(st.centroids[-3:])), 100.0) > self.s.centroid_change or _relative(level, float(np.median(st.levels[-3:])), 0.001) > self.s.rms_change
        st.centroids, st.levels = [*st.centroids, centroid][-10:], [*st.levels, level][-10:]
        if out:
            st.changed_at = st.clock
        return out

    def _stats(self, st: State, out: dict) -> dict | None:
        c = st.counted
        st.counted = [c[0] + 1, c[1] + (out["label"] >= 0), c[2] + out["changed"], c[3] + (out["rms"] or 0.0), c[4] + (out["rms"] is not None)]
        st.blocks += 1
        if st.blocks % self.s.every:
            return None
        n, labelled, changes, levels, heard = st.counted
        st.counted = [0, 0, 0, 0.0, 0]
        return {"n_blocks": n, "n_labelled": labelled, "n_changes": changes, "mean_rms": levels / heard if heard else None}

    def block(self, st: State, block_id: int, samples: np.ndarray) -> dict:
        """Take one block; returns what is known after it and which block is put out now (null: silence), with its samples.

        Blocks come out delay_ms after they came in, or as soon as a window is full where that is later. Every `every`
        blocks of a stream, `stats` tells of these; else it is null.
        """
        out = self._decided(st, block_id, samples)
        return out | {"stats": self._stats(st, out)}

    def _decided(self, st: State, block_id: int, samples: np.ndarray) -> dict:
        state = np.array(st.filter) if st.filter else steady_state(self.sos)
        y, state = run_sections(self.sos, samples, state)
        st.filter = state.tolist()
        st.clock += len(y)
        out = {"block_id": block_id, "present": st.present, "centroid": None, "rms": None, "changed": False, "label": st.label, "out_block": None, "n_sources": len(st.profiles), "out": []}
        if not st.present:
            st.present = bool(np.sqrt(np.mean(y**2)) > 10 ** (self.s.gate_db / 20))
            if not st.present:
                return out
            out["present"] = True
        size = lambda ms: int(ms * self.s.rate / 1000)
        window = size(self.s.window_ms)
        if st.ring is None:
            st.ring = Ring(max(size(self.s.ring_ms), window, size(self.s.delay_ms) + 2 * len(y)))
        fresh = not st.waiting and not st.filled
        lost = st.ring.write(y)
        st.filled += len(y)
        st.waiting.append((block_id, len(y)))
        while lost > 0:  # what was overwritten before it was read
            first, n = st.waiting.pop(0)
            lost -= n
            if lost < 0:
                st.waiting.insert(0, (first, -lost))
        if fresh or st.filled < max(window, size(self.s.delay_ms)):
            return out
        centroid, level = centroid_and_level(st.ring.newest(window), self.s.rate)
        change = self.changed(st, centroid, level)
        if change:
            st.label = self.classify(st, centroid, level)
        shown, n = st.waiting.pop(0)
        heard = st.ring.read(n)
        audible = st.label == self.s.target
        out |= {"out": heard.tolist() if audible else [0.0] * n, "centroid": centroid, "rms": level, "changed": change, "label": st.label, "n_sources": len(st.profiles), "out_block": shown if audible else None}
        st.silent_blocks = st.silent_blocks + 1 if level < self.s.quiet else 0
        if st.silent_blocks * len(y) * 1000 > self.s.silence_ms * self.s.rate:
            # the session ends: all is forgotten but the clock and the statistics
            st.__dict__.update(State(clock=st.clock, blocks=st.blocks, counted=st.counted).__dict__)
            out |= {"out_block": None, "out": [0.0] * n}
        return out
