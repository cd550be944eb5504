"""Settings of the analyses. Defaults are fixed values of the problem: milliseconds, weights, limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Frames:
    window_ms: float = 2.0
    hop_ms: float = 0.5
    min_amplitude: float = 0.01

    def samples(self, rate: int) -> tuple[int, int]:
        """Window (made even) and hop in samples; both are cut to whole samples, so frame times drift from nominal ones."""
        window = int(self.window_ms * rate / 1000)
        return window + window % 2, int(self.hop_ms * rate / 1000)


@dataclass(frozen=True)
class Cfar:
    method: str = "OS"
    guard: int = 3
    train: int = 15
    alpha: float = 3.5
    k_fraction: float = 0.75
    percentile: float = 0.85

    def __post_init__(self) -> None:
        if self.method not in ("CA", "OS", "SO", "PERCENTILE"):
            raise ValueError(f"unknown CFAR method: {self.method}")


@dataclass(frozen=True)
class Fusion:
    """Weights of the four detectors, the largest distance of events that belong together, and what counts as a boundary."""

    weights: tuple[tuple[str, float], ...] = (("centroid", 1.0), ("energy", 0.8), ("jump", 0.6), ("shape", 1.2))
    max_difference: float = 3.0
    ignore_only: tuple[str, ...] = ("energy", "jump")
    min_segment: float = 10.0


#: Weights of changes in centroid, rms, rolloff, zero crossings, flux and bandwidth.
CHANGE_WEIGHTS = {"centroid": 2.0, "rms": 1.0, "rolloff": 1.5, "zcr": 1.0, "flux": 1.0, "bandwidth": 1.0}
