"""The transform of long streams against NumPy's, and the features of long segments against those of short ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.operators import fourier, spectral


def streams(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    x = {f"s{n}": rng.normal(size=n).round(4) for n in lengths}
    return x, spark.createDataFrame([(s, i, float(v)) for s, a in x.items() for i, v in enumerate(a)], "stream_id string, idx long, x double").repartition(5)


@pytest.mark.parametrize("local", [1 << 20, 64, 7, 1])
def test_transform(spark, local):
    """Primes, powers, products of a small and a large factor; in one task, in blocks, and one row or column at a time."""
    x, signal = streams(spark, [1, 2, 3, 11, 64, 97, 120, 202, 509, 1024])
    got = {}
    for r in fourier.transform(signal, local).collect():
        got.setdefault(r.stream_id, {})[r.k] = complex(r.re, r.im)
    for s, a in x.items():
        assert sorted(got[s]) == list(range(len(a) // 2 + 1))
        assert np.allclose([got[s][k] for k in sorted(got[s])], np.fft.rfft(a), rtol=0, atol=1e-9)
    assert fourier.transform(signal.limit(0), local).count() == 0


def test_matrices():
    for n in (3 * 2**20, 10**7, 2**31 - 1, 5_292_000, 2 * (10**9 + 7)):
        rows, columns, padded = fourier.matrix_of(n)
        assert rows * columns >= (2 * n - 1 if padded else n) and (padded or rows * columns == n)
        assert max(rows, columns) <= 16 * min(rows, columns) and rows * columns < 4 * n
    rng = np.random.default_rng(2)
    for m in (2 * 97, 2**32 + 14, 2**46 + 1):
        j = rng.integers(0, m, 50)
        assert fourier.squares(j, m).tolist() == [int(v) ** 2 % m for v in j]


@pytest.mark.parametrize("n", [1 << 22, (1 << 21) + 17])
def test_a_stream_of_many_tasks(spark, n):
    """Two tones and a step in millions of samples, in blocks of 2**20 at most: balanced, and padded."""
    tone = lambda k, a: F.lit(a) * F.cos(F.lit(2 * np.pi) * ((F.col("id") * k) % n) / n)
    signal = spark.range(n).select(F.lit("s").alias("stream_id"), F.col("id").alias("idx"), (tone(1000, 2.0) + tone(700_001, 0.5)).alias("x"))
    rows, columns, padded = fourier.matrix_of(n)
    assert padded == (n % 2 == 1) and max(rows, columns) < 1 << 13
    found = fourier.transform(signal).where("hypot(re, im) > 1e-3").orderBy("k").collect()
    assert [(r.k, round(r.re / n, 9), round(r.im / n, 9)) for r in found] == [(1000, 1.0, 0.0), (700_001, 0.25, 0.0)]


def test_features_of_long_segments(spark):
    """Sums over bins give what one row's spectrum gives, silent and quiet segments included."""
    x, signal = streams(spark, [700, 301])
    signal = signal.withColumn("x", F.when((F.col("stream_id") == "s700") & F.col("idx").between(100, 199), 0.0).otherwise(F.col("x")))
    segs = [("s700", 0, 0, 100), ("s700", 1, 100, 200), ("s700", 2, 200, 205), ("s700", 3, 205, 700), ("s301", 0, 0, 900), ("s301", 7, 900, 950)]
    segs = spark.createDataFrame(segs, "stream_id string, seg_id long, i0 long, i1 long")
    take = lambda df: {(r.stream_id, r.seg_id): r[2:] for r in df.collect()}
    for quiet in (0.0, 0.5):
        whole, parts = (take(spectral.segment_features(signal, segs, 8000.0, quiet, longest=n)) for n in (1 << 18, 20))
        assert whole.keys() == parts.keys() and len(whole) == 6
        for key, values in whole.items():
            assert np.allclose(values, parts[key], rtol=1e-9), key
