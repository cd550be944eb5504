"""Column expressions over sample arrays and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def energy(samples: Column) -> Column:
    return _sum(F.transform(samples, lambda x: x.cast("double") * x)) / F.size(samples)


def rms(samples: Column) -> Column:
    return F.sqrt(energy(samples))


def rms_db(samples: Column, eps: float = 1e-12) -> Column:
    return 20 * F.log10(F.sqrt(energy(samples) + eps) + eps)


def _signs(samples: Column) -> tuple[Column, Column]:
    s = F.transform(samples, lambda x: F.signum(x))
    n = F.size(samples)
    return F.slice(s, 2, n), F.slice(s, 1, n - 1)


def zero_crossings(samples: Column) -> Column:
    """Sum of sign changes over twice the length; touching 0 counts half."""
    a, b = _signs(samples)
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / (2 * F.size(samples))


def sign_changes(samples: Column) -> Column:
    """Share of neighbours whose signs differ."""
    a, b = _signs(samples)
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))) / (F.size(samples) - 1)


def cosine_change(unit: Column, previous: Column) -> Column:
    """1 - cosine of two unit spectra."""
    dot = _sum(F.zip_with(unit, previous, lambda a, b: a * b))
    return 1 - F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def relative_change(value: Column, previous: Column, floor: float) -> Column:
    return F.abs(value - previous) / F.greatest(previous, F.lit(floor))


def to_int16(x: Column) -> Column:
    """Samples of -1..1 as 16-bit numbers, cut towards 0."""
    return (F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("smallint")


def from_int16(x: Column) -> Column:
    return x / F.lit(32768.0)


def raw_to_int16(x: Column) -> Column:
    """Raw sample values clipped to 16 bits, cut towards 0."""
    return F.least(F.greatest(x, F.lit(-32768.0)), F.lit(32767.0)).cast("smallint")


def stereo(x: Column) -> Column:
    """A sample for both channels of a device."""
    return F.array(x, x)
