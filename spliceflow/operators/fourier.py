"""The Fourier transform of whole streams of any length, in n log n, without a stream in one task.

A stream of rows * columns samples is a matrix, sample columns * i + j in row i and column j. Its transform is one of
each column, a turn of each value, and one of each row. Blocks of columns go to tasks, then blocks of rows: both hold
about LOCAL values (more only where a single row or column does, beyond LOCAL squared samples), and each value is
shuffled once between the two. A length without two balanced factors becomes a convolution of a power of two (Bluestein),
which takes the way there and back: rows, where both transforms are multiplied, then columns again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceflow.helpers import cut

#: Values that one task transforms at a time.
LOCAL = 1 << 20
_PLAN = ["n", "rows", "columns", "padded"]
_PLAN_TYPES = "n long, rows long, columns long, padded boolean"
_BLOCKS = f"stream_id string, {_PLAN_TYPES}, part long, first long, kind int, data binary"
_BINS = "stream_id string, n long, k long, re double, im double"


def matrix_of(n: int, local: int = LOCAL) -> tuple[int, int, bool]:
    """rows, columns, and whether the stream is padded. Up to `local` samples are one column."""
    if n <= local:
        return n, 1, False
    d = np.arange(1, math.isqrt(n) + 1)
    most = int(d[n % d == 0][-1])
    if n // most <= 16 * most:
        return n // most, most, False
    bits = (2 * n - 2).bit_length()
    return 1 << (bits - bits // 2), 1 << (bits // 2), True


def squares(j: np.ndarray, m: int) -> np.ndarray:
    """j * j mod m for 0 <= j < m < 2**47, fifteen bits of one factor at a time."""
    out = np.zeros_like(j)
    for shift in (45, 30, 15, 0):
        out = (((out << 15) % m) + j * ((j >> shift) & 0x7FFF) % m) % m
    return out


def chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi j^2 / n)"""
    return np.exp(1j * np.pi * squares(j, 2 * n) / n)


def _turn(k: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """exp(-2 pi i k j / n) for all pairs."""
    return np.exp(-2j * np.pi * ((k[:, None] * j[None, :]) % n) / n)


class Layout:
    """Where a group's block lies. Blocks are `wide` columns, or `high` rows."""

    def __init__(self, table: pa.Table, local: int):
        self.stream, self.n, self.rows, self.columns, self.padded, self.part = (table.column(c)[0].as_py() for c in ["stream_id", *_PLAN, "part"])
        self.wide, self.high = max(1, local // self.rows), max(1, local // self.columns)

    def block(self, size: int, of: int) -> np.ndarray:
        return np.arange(self.part * size, min((self.part + 1) * size, of))

    def cut_into(self, size: int, blocks: dict[int, np.ndarray], first: int) -> pa.Table:
        """Rows of the matrices in blocks, for the groups that take `size` of them each. blocks: by kind."""
        out = [(i // size, kind, np.ascontiguousarray(m[i : i + size]).tobytes()) for kind, m in blocks.items() for i in range(0, len(m), size)]
        part, kind, data = zip(*out, strict=True)
        same = [pa.repeat(pa.scalar(v, t), len(out)) for v, t in ((self.stream, pa.string()), (self.n, pa.int64()), (self.rows, pa.int64()), (self.columns, pa.int64()), (self.padded, pa.bool_()))]
        rest = [pa.array(part, pa.int64()), pa.repeat(pa.scalar(first, pa.int64()), len(out)), pa.array(kind, pa.int32()), pa.array(data, pa.binary())]
        return pa.Table.from_arrays([*same, *rest], ["stream_id", *_PLAN, "part", "first", "kind", "data"])

    def put_together(self, table: pa.Table, kind: int, length: int, mine: int) -> np.ndarray:
        """A matrix of length x mine from pieces of mine x (some of length) that other groups cut."""
        out = np.empty((length, mine), complex)
        for first, k, data in zip(table["first"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True):
            if k == kind:
                piece = np.frombuffer(data.as_buffer(), complex).reshape(mine, -1)
                out[first : first + piece.shape[1]] = piece.T
        return out

    def bins(self, k: np.ndarray, values: np.ndarray) -> pa.Table:
        kept = k.ravel() <= self.n // 2
        v, k = values.ravel()[kept], k.ravel()[kept]
        same = [pa.repeat(pa.scalar(x, t), len(k)) for x, t in ((self.stream, pa.string()), (self.n, pa.int64()))]
        return pa.Table.from_arrays([*same, pa.array(k), pa.array(v.real.copy()), pa.array(v.imag.copy())], ["stream_id", "n", "k", "re", "im"])


def _short(table: pa.Table) -> pa.Table:
    at = Layout(table, 1)
    x = np.zeros(at.n)
    x[table["idx"].to_numpy()] = table["x"].to_numpy()
    return at.bins(np.arange(at.n // 2 + 1), np.fft.rfft(x))


def _columns(table: pa.Table, local: int) -> pa.Table:
    at = Layout(table, local)
    j = at.block(at.wide, at.columns)
    idx = table["idx"].to_numpy()
    m = np.zeros((at.rows, len(j)), complex)
    m[idx // at.columns, idx % at.columns - j[0]] = table["x"].to_numpy()
    found = {0: m}
    if at.padded:
        total = at.rows * at.columns
        place = at.columns * np.arange(at.rows)[:, None] + j[None, :]
        back = np.minimum(place, total - place)  # the chirp goes both ways from 0
        wave = np.where(back < at.n, chirp(np.minimum(back, at.n), at.n), 0)
        found = {0: np.where(place < at.n, m * wave.conj(), 0), 1: wave}
    turn = _turn(np.arange(at.rows), j, at.rows * at.columns)
    return at.cut_into(at.high, {kind: np.fft.fft(v, axis=0) * turn for kind, v in found.items()}, int(j[0]))


def _rows(table: pa.Table, local: int) -> pa.Table:
    at = Layout(table, local)
    i = at.block(at.high, at.rows)
    found = np.fft.fft(at.put_together(table, 0, at.columns, len(i)), axis=0)
    if not at.padded:
        return at.bins(i[None, :] + at.rows * np.arange(at.columns)[:, None], found)
    found *= np.fft.fft(at.put_together(table, 1, at.columns, len(i)), axis=0)
    back = np.fft.ifft(found, axis=0) * _turn(np.arange(at.columns), i, at.rows * at.columns).conj()
    return at.cut_into(at.wide, {0: back}, int(i[0]))


def _columns_back(table: pa.Table, local: int) -> pa.Table:
    at = Layout(table, local)
    j = at.block(at.wide, at.columns)
    k = at.columns * np.arange(at.rows)[:, None] + j[None, :]
    found = np.fft.ifft(at.put_together(table, 0, at.rows, len(j)), axis=0)
    return at.bins(k, found * np.where(k <= at.n // 2, chirp(np.minimum(k, at.n), at.n).conj(), 0))


def transform(signal: DataFrame, local: int = LOCAL) -> DataFrame:
    """stream_id, n (samples), k, re, im for k from 0 to n / 2. signal: stream_id, idx from 0 without holes, x.

    Streams of up to `local` samples are transformed in one task each. Streams of 2**46 samples or more raise an error.
    """

    @F.pandas_udf("rows long, columns long, padded boolean")
    def planned(n: pd.Series) -> pd.DataFrame:
        if (n >= 1 << 46).any():
            raise ValueError("a stream has more than 2**46 samples")
        return pd.DataFrame([matrix_of(int(v), local) for v in n], columns=["rows", "columns", "padded"])

    plan = signal.groupBy("stream_id").agg(F.count("*").alias("n")).withColumn("p", planned("n")).select("stream_id", "n", "p.*")
    plan = cut(plan)
    kinds = plan.agg(F.max((F.col("columns") == 1).cast("int")), F.max((F.col("columns") > 1).cast("int")), F.max(((F.col("columns") > 1) & ~F.col("padded")).cast("int")), F.max(F.col("padded").cast("int"))).first()
    short, long, balanced, padded = (bool(k) for k in kinds)
    rows = signal.join(plan, "stream_id").select("stream_id", *_PLAN, "idx", F.col("x").cast("double").alias("x"))
    found = []
    if short or not long:
        alone = rows.where("columns = 1").withColumn("part", F.lit(0).cast("long"))
        found.append(alone.groupBy("stream_id").applyInArrow(_short, _BINS))
    if long:
        wide = F.greatest(F.lit(1).cast("long"), F.expr(f"{local} div rows"))
        dealt = rows.where("columns > 1").withColumn("part", F.floor(F.col("idx") % F.col("columns") / wide))
        blocks = dealt.groupBy("stream_id", "part").applyInArrow(lambda t: _columns(t, local), _BLOCKS)
        blocks = cut(blocks) if balanced and padded else blocks
        if balanced:
            found.append(blocks.where("not padded").groupBy("stream_id", "part").applyInArrow(lambda t: _rows(t, local), _BINS))
        if padded:
            back = blocks.where("padded").groupBy("stream_id", "part").applyInArrow(lambda t: _rows(t, local), _BLOCKS)
            found.append(back.groupBy("stream_id", "part").applyInArrow(lambda t: _columns_back(t, local), _BINS))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
