"""Sound files by ranges, as streams and back; change of rate against one piece and against theory."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.operators import resample
from spliceflow.sources import wav
from spliceflow.streaming import jobs


def by_idx(df, column="x"):
    return [r[column] for r in df.orderBy("stream_id", "idx").collect()]


def test_files_there_and_back(spark, tmp_path):
    x = (np.sin(np.arange(3000) / 9) * 0.9).astype(np.float32)
    names = {"a": x, "b": x[:100], "up/../and %2F down": x[:50], "..": x[:20], ".hiddené": x[:30]}
    for name, data in (("a", x), ("b", x[:100])):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(data, 8000))
    signal = wav.as_signal(wav.read_wav(spark, str(tmp_path)))
    got = {s: by_idx(signal.where(F.col("stream_id") == s)) for s in ("a", "b")}
    assert np.allclose(got["a"], x, atol=1e-4) and len(got["b"]) == 100
    rows = spark.createDataFrame([(s, i, float(v)) for s, a in names.items() for i, v in enumerate(a)], "stream_id string, idx long, x double")
    out = f"{tmp_path}/out/there"
    wav.write_wav(wav.as_chunks(rows, 8000, 700), out)
    assert len(os.listdir(out)) == 5 and os.listdir(f"{tmp_path}/out") == ["there"] and not any(f.startswith(".") for f in os.listdir(out))
    again = wav.as_signal(wav.read_wav(spark, f"file://{out}"))
    for s, a in names.items():
        assert np.allclose(by_idx(again.where(F.col("stream_id") == s)), a, atol=2e-4)
    wav.write_wav(wav.as_chunks(rows.where("stream_id = 'a'"), 8000), out, "overwrite")
    assert os.listdir(out) == ["a.wav"]


def head(tag, channels, bits, rate, n, extra=b"", size=None):
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * block, block, bits)
    return b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", n * block if size is None else size)


@pytest.mark.parametrize(("tag", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_formats(tag, bits):
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.75])
    if tag == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = (x * 128 + 128).astype("u1").tobytes()
    elif bits == 24:
        data = b"".join(int(v * 8388608).to_bytes(3, "little", signed=True) for v in x)
    else:
        data = (x * 2.0 ** (bits - 1)).astype(f"<i{bits // 8}").tobytes()
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    for size in (None, 0xFFFFFFFF):  # a length that was never filled in
        got, rate = wav.decode(head(tag, 1, bits, 8000, 6, odd, size) + data)
        assert rate == 8000 and got.tolist() == x.tolist()
    assert wav.decode(head(tag, 2, bits, 8000, 3) + data)[0].tolist() == x.reshape(3, 2).mean(1).tolist()
    with pytest.raises(ValueError, match="not supported"):
        wav.decode(head(6, 1, 8, 8000, 1) + b"x")


def test_a_file_of_three_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    """A sparse file: its ranges are planned from its head, and each is read by its own task."""
    n = 1_600_000_000
    with open(tmp_path / "big.wav", "wb") as f:
        f.write(head(1, 1, 16, 44100, n))
        f.truncate(44 + 2 * n)
        f.seek(44 + 2 * 1_234_567_890)
        f.write(struct.pack("<h", 16384))
    reader = wav._Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == -(-n // (wav.CHUNK * wav.CHUNKS_A_TASK)) > 300 and parts[-1].end == n
    chunks = wav.read_wav(spark, str(tmp_path))
    assert chunks.rdd.getNumPartitions() == len(parts)
    (part,) = [p for p in parts if p.first <= 1_234_567_890 < p.end]
    loud = [(b.column("start_idx")[0].as_py() + int(i)) for b in reader.read(part) for i in np.flatnonzero(b.column("samples")[0].values.to_numpy())]
    assert loud == [1_234_567_890]


def test_files_replayed_as_a_stream(spark, tmp_path):
    x = np.sin(np.arange(5000) / 9)
    (tmp_path / "in").mkdir()
    for name, n in (("a", 5000), ("b", 1100)):
        (tmp_path / "in" / f"{name}.wav").write_bytes(wav.encode(x[:n], 8000))
    wav.register(spark)
    blocks = spark.readStream.format("wav_blocks").option("blockSize", 512).load(f"{tmp_path}/in")
    jobs.save(blocks, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("stream_id", "block_id").collect()
    assert [(r.stream_id, r.block_id) for r in got] == [("a", i) for i in range(9)] + [("b", 0), ("b", 1)]
    assert np.allclose([v for r in got[:9] for v in r.samples], x[: 9 * 512], atol=1e-4)
    assert (got[8].ts - got[0].ts).total_seconds() == pytest.approx(8 * 512 / 8000, abs=1e-6)


def chunked(spark, x, rate, size):
    rows = [("s", k, k * size, rate, x[k * size : (k + 1) * size].tolist()) for k in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "stream_id string, chunk_id long, start_idx long, rate int, samples array<double>").repartition(3)


@pytest.mark.parametrize(("rate", "wanted"), [(8000, 6000), (8000, 11025), (44100, 8000), (8000, 8000)])
def test_pieces_equal_the_whole(spark, rate, wanted):
    x = np.random.default_rng(1).normal(size=2500)
    take = lambda df: np.concatenate([r.samples for r in df.orderBy("chunk_id").collect()])
    whole = take(resample.resampled(chunked(spark, x, rate, 4096), wanted))
    assert len(whole) == -(-2500 * wanted // rate)
    for size in (1000, 97):  # chunks shorter than the filter, too
        assert np.allclose(take(resample.resampled(chunked(spark, x, rate, size), wanted)), whole, rtol=0, atol=1e-12)
    if rate == wanted:
        assert whole.tolist() == x.tolist()


def test_tones_and_aliases(spark):
    """A tone below the new Nyquist frequency stays as it is; one above it is gone by 60 dB and more."""
    t = np.arange(20000) / 44100
    level = lambda hz: np.abs(np.concatenate([r.samples for r in resample.resampled(chunked(spark, np.sin(2 * np.pi * hz * t), 44100, 4096), 16000).orderBy("chunk_id").collect()])[300:-300]).max()
    assert 20 * np.log10(level(8000 * 1.001)) < -60 and 20 * np.log10(level(15000)) < -60
    low = np.concatenate([r.samples for r in resample.resampled(chunked(spark, np.sin(2 * np.pi * 1000 * t), 44100, 4096), 16000).orderBy("chunk_id").collect()])
    assert np.allclose(low[300:-300], np.sin(2 * np.pi * 1000 * np.arange(len(low)) / 16000)[300:-300], atol=1e-4)


def test_loading_at_one_rate_and_length(spark, tmp_path):
    for name, rate, n in (("a", 8000, 3000), ("b", 16000, 1000)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(np.full(n, 0.5), rate))
    got = wav.load(spark, str(tmp_path), 8000, 2000)
    assert got.groupBy("stream_id").agg(F.count("*").alias("n"), F.max("idx").alias("m")).orderBy("stream_id").collect() == [("a", 2000, 1999), ("b", 2000, 1999)]
    b = by_idx(got.where("stream_id = 'b'"))
    assert b[:500] == b[500:1000] and abs(b[250] - 0.5) < 1e-3
