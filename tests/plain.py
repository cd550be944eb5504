"""Plain versions on one machine, as the definitions say, that tests hold the Spark ones against."""

from collections.abc import Callable

import numpy as np


def _lloyd(x: np.ndarray, centers: np.ndarray, rounds: int, on_empty: Callable[[], np.ndarray] | None = None) -> np.ndarray:
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        for k in range(len(centers)):
            if (labels == k).any():
                centers[k] = x[labels == k].mean(0)
            elif on_empty:
                centers[k] = on_empty()
    return labels


def _by_mean(labels: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Renumber labels that occur by the mean of values, from 0."""
    used = np.unique(labels)
    order = used[np.argsort([values[labels == k].mean() for k in used], kind="stable")]
    return np.array([int(np.flatnonzero(order == k)[0]) for k in labels], int)


def kmeans_labels(x: np.ndarray, clusters: int | None = None) -> np.ndarray:
    """k-means++ on min-max scaled rows (first column: centroid, fourth: zero crossings), labels by mean centroid.

    Seeded with 42 in the legacy generator. As many clusters as rows or more give one label per row; rows that are all
    equal give one label.
    """
    span = np.ptp(x, axis=0)
    scaled = np.where(span > 0, (x - x.min(0)) / np.where(span > 0, span, 1), x)
    if clusters is None:
        clusters = 3 if span[0] > 3000 or (x.shape[1] > 3 and span[3] > 0.1) else 2
    if clusters >= len(x):
        return np.arange(len(x))
    rng = np.random.RandomState(42)
    centers = [scaled[rng.randint(len(x))]]
    while len(centers) < clusters:
        d = np.min([((scaled - c) ** 2).sum(1) for c in centers], axis=0)
        if not d.sum() > 0:
            break
        centers.append(scaled[rng.choice(len(x), p=d / d.sum())])
    return _by_mean(_lloyd(scaled, np.array(centers), 100), x[:, 0])


def merged_small(x: np.ndarray, labels: np.ndarray, least: int = 3, units: tuple[float, float] = (500.0, 6.0), near: float = 1.8) -> np.ndarray:
    """Clusters of fewer than `least` rows join the nearest other one, if it is near in units of the two features."""
    labels = labels.copy()
    for _ in range(len(np.unique(labels)) + 1):
        used, counts = np.unique(labels, return_counts=True)
        means = {k: x[labels == k].mean(0) for k in used}
        for k, n in zip(used, counts, strict=True):
            others = [(np.linalg.norm((means[k] - means[o]) / np.array(units)), o) for o in used if o != k and (labels == o).any()]
            if n < least and others and min(others)[0] < near:
                labels[labels == k] = min(others)[1]
                break
        else:
            break
    return labels


def level_labels(x: np.ndarray, clusters: int | None = None, seed: int = 7, rounds: int = 60, least: int = 3) -> np.ndarray:
    """k-means on (centroid in Hz, level in dB) in robust units, random start, empty clusters started anew; then small
    clusters are merged and labels ordered by centroid."""
    mid = np.median(x, axis=0)
    scaled = (x - mid) / (1.4826 * np.median(np.abs(x - mid), axis=0) + 1e-9)
    if clusters is None:
        clusters = 3 if np.percentile(x[:, 0], 90) - np.percentile(x[:, 0], 10) > 1500 else 2
    rng = np.random.default_rng(seed)
    centers = scaled[rng.choice(len(x), min(clusters, len(x)), replace=False)].copy()
    labels = _lloyd(scaled, centers, rounds, lambda: scaled[rng.integers(0, len(x))])
    return _by_mean(merged_small(x, labels, least), x[:, 0])


def merged_short(t0: list[float], t1: list[float], x: np.ndarray, shortest: float) -> tuple[list[float], list[float], np.ndarray]:
    """Again and again, the first short segment joins the neighbour that is nearer in features (the left one among
    equals); features are means by length. Two segments are left at least."""
    spans, feats = list(zip(t0, t1, strict=True)), list(x)
    while len(spans) > 2:
        i = next((k for k, (a, b) in enumerate(spans) if b - a < shortest), None)
        if i is None:
            break
        sides = [j for j in (i - 1, i + 1) if 0 <= j < len(spans)]
        j = min(sides, key=lambda k: np.linalg.norm(feats[i] - feats[k]))
        w = [spans[k][1] - spans[k][0] for k in (i, j)]
        a, b = min(i, j), max(i, j)
        feats[a] = (feats[i] * w[0] + feats[j] * w[1]) / max(sum(w), 1e-9)
        spans[a] = (spans[a][0], spans[b][1])
        del spans[b], feats[b]
    return [a for a, _ in spans], [b for _, b in spans], np.array(feats)


def leaders(values: list[float], radius: float) -> list[int]:
    means, counts, out = [], [], []
    for v in values:
        far = [abs(m - v) for m in means]
        best = far.index(min(far)) if far and min(far) <= radius else len(means)
        if best == len(means):
            means.append(v)
            counts.append(1)
        else:
            counts[best] += 1
            means[best] += (v - means[best]) / counts[best]
        out.append(best)
    return out


def earliest_first(places: list[float], gap: float, last: float) -> list[float]:
    kept = []
    for p in sorted(places):
        if p - last >= gap:
            kept.append(p)
            last = p
    return kept


def strongest_first(rows: list[tuple[float, float]], gap: float) -> list[float]:
    """rows: (place, score)"""
    kept: list[float] = []
    for p, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(p - k) >= gap for k in kept):
            kept.append(p)
    return sorted(kept)
