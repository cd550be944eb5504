"""A ring buffer of samples, packed so that it can be kept as a stream's state."""

from __future__ import annotations

import numpy as np


class Ring:
    """Holds at most `size` samples. Those that are read, and the oldest where room is short, give way to new ones."""

    def __init__(self, size: int, data: bytes | None = None, end: int = 0, unread: int = 0):
        self.data = np.zeros(size) if data is None else np.frombuffer(data).copy()
        self.end, self.unread = end, unread  # all samples ever written, and those not yet read

    def _places(self, first: int, n: int) -> np.ndarray:
        return np.arange(first, first + n) % len(self.data)

    def write(self, x: np.ndarray) -> int:
        """Put samples in; returns how many unread ones were overwritten."""
        kept = x[-len(self.data) :]
        self.data[self._places(self.end + len(x) - len(kept), len(kept))] = kept
        self.end += len(x)
        self.unread += len(x)
        lost = max(0, self.unread - len(self.data))
        self.unread -= lost
        return lost

    def peek(self, n: int) -> np.ndarray:
        """The oldest n unread samples, which stay; fewer where there are fewer."""
        return self.data[self._places(self.end - self.unread, min(n, self.unread))]

    def read(self, n: int) -> np.ndarray:
        """The oldest n unread samples, which are then free to be overwritten."""
        out = self.peek(n)
        self.unread -= len(out)
        return out

    def newest(self, n: int) -> np.ndarray:
        """The last n samples that were written, read or not."""
        n = min(n, self.end, len(self.data))
        return self.data[self._places(self.end - n, n)]

    def packed(self) -> tuple[int, bytes, int, int]:
        return len(self.data), self.data.tobytes(), self.end, self.unread
