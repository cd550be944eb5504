"""Butterworth filters: design in closed form, zero-phase filtering of whole streams, block-wise filtering with state.

Long streams are filtered in pieces with overlap: an infinite response has no finite halo, but it has died down below
rounding after as many samples as the largest pole says.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, cutoff: float | tuple[float, float], rate: float, kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a low, high or band pass, by the bilinear transform.

    Cutoffs are kept within 0.001 and 0.999 of half the sampling rate.
    """
    edge = np.clip(np.atleast_1d(np.asarray(cutoff, float)) / (rate / 2), 0.001, 0.999)
    warped = 4 * np.tan(np.pi * edge / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "low":
        poles, zeros, gain = poles * warped[0], np.empty(0, complex), warped[0] ** order
    elif kind == "high":
        gain = np.real(1 / np.prod(-poles))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    elif kind == "band":
        width, middle = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - middle**2)
        poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(order, complex), width**order
    else:
        raise ValueError(f"unknown filter: {kind}")
    gain *= np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    digital = lambda s: (4 + s) / (4 - s)
    poles = digital(poles)
    # conjugate pairs together; what is real is paired by size
    upper = poles[poles.imag > 1e-12]
    real = np.sort(poles[np.abs(poles.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    pairs += [(-real[-1], 0.0)] if len(real) % 2 else []
    # zeros are 1 or -1: one of each to a section of a band pass, two of a kind to other full sections
    left = {"low": [-1.0] * len(poles), "high": [1.0] * len(poles), "band": [1.0, -1.0] * order}[kind]
    sos = np.zeros((len(pairs), 6))
    for i, (a1, a2) in enumerate(pairs):
        if len(real) % 2 and i == len(pairs) - 1:
            sos[i] = (1, -left[0], 0, 1, a1, a2)
        else:
            sos[i] = (1, -(left[0] + left[1]), left[0] * left[1], 1, a1, a2)
    sos[0, :3] *= gain
    return sos


def steady_state(sos: np.ndarray) -> np.ndarray:
    """State of each section (transposed form) after a long input of ones."""
    out, level = np.zeros((len(sos), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y = (b0 + b1 + b2) / (1 + a1 + a2) * level
        z2 = b2 * level - a2 * y
        out[i] = (b1 * level - a1 * y + z2, z2)
        level = y
    return out


def run_sections(sos: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Filter x; returns output and new state. Blocks of samples are one product with the sections' block response."""
    x, state = np.asarray(x, float), state.copy()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        a = np.array([[-a1, 1.0], [-a2, 0.0]])
        b, c = np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
        powers = [np.eye(2)]
        for _ in range(block):
            powers.append(a @ powers[-1])
        response = np.array([b0, *(c @ p @ b for p in powers[: block - 1])])
        lag = np.subtract.outer(np.arange(block), np.arange(block))
        toeplitz = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        seen = np.stack([c @ p for p in powers[:block]])
        drive = np.stack([p @ b for p in powers[:block][::-1]], 1)
        whole = len(x) // block * block
        y, s = np.empty(len(x)), state[i]
        direct = x[:whole].reshape(-1, block) @ toeplitz.T
        pushed = x[:whole].reshape(-1, block) @ drive.T
        for k in range(whole // block):
            y[k * block : (k + 1) * block] = direct[k] + seen @ s
            s = powers[block] @ s + pushed[k]
        for k in range(whole, len(x)):
            y[k] = b0 * x[k] + s[0]
            s = a @ s + b * x[k]
        state[i], x = s, y
    return x, state


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with the ends continued by point reflection. Too short a signal is returned as it is."""
    order = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    pad = 3 * order
    if len(x) <= pad:
        return np.asarray(x, float)
    long = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    start = steady_state(sos)
    y = run_sections(sos, long, start * long[0])[0]
    return run_sections(sos, y[::-1], start * y[-1])[0][::-1][pad:-pad]


def settling(sos: np.ndarray, left: float = 1e-15) -> int:
    """Samples after which the response to what came before is `left` of itself, with a margin for close poles."""
    radius = max(float(np.abs(np.roots(section[3:])).max()) for section in sos)
    return 64 + (math.ceil(1.5 * math.log(left) / math.log(radius)) if radius > 0 else 0)


def filtered(signal: DataFrame, sos: np.ndarray, channel: str | None = None, piece: int | None = None, settle: int | None = None) -> DataFrame:
    """stream_id, (channel,) idx, x after zero-phase filtering, in pieces of `piece` samples with `settle` more around.

    By default, settle follows the filter, and a piece is at least four times as long.
    """
    settle = settle or settling(sos)
    piece = piece or max(1 << 20, 4 * settle)
    keys = ["stream_id", *([channel] if channel else [])]
    own = F.floor(F.col("idx") / piece)
    at = F.col("idx") - own * piece
    parts = F.filter(F.array(own, F.when(at >= piece - settle, own + 1), F.when((at < settle) & (own > 0), own - 1)), lambda v: v.isNotNull())
    rows = signal.select(*keys, "idx", F.col("x").cast("double").alias("x"), F.explode(parts).alias("piece"))

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("idx")
        p = p.assign(x=zero_phase(sos, p["x"].to_numpy()))
        return p[p["idx"] // piece == p["piece"]].drop(columns="piece")

    return rows.groupBy(*keys, "piece").applyInPandas(apply, signal.select(*keys, "idx", F.lit(0.0).alias("x")).schema)
