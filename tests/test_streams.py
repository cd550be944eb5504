"""The online processor: ring buffer, live stream against replay, restarts, ends of sessions, statistics, timings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spliceflow.plans import timing
from spliceflow.streaming import jobs
from spliceflow.streaming.online import Online, Settings, State
from spliceflow.streaming.ring import Ring

RATE, BLOCK = 8000, 200
COLUMNS = [c for c in "stream_id,block_id,present,centroid,rms,changed,label,out_block,n_sources,out,stats".split(",")]


def tones(n=16000):
    t = np.arange(n) / RATE
    return np.where((np.arange(n) // 2000) % 2 == 0, np.sin(2 * np.pi * 300 * t), 0.6 * np.sin(2 * np.pi * 1800 * t))


def blocks_of(spark, x, streams=("s",), first=0, start="2024-01-01"):
    n = len(x) // BLOCK
    parts = [pd.DataFrame({"stream_id": s, "block_id": range(first, first + n), "ts": pd.Timestamp(start) + pd.to_timedelta((first + np.arange(n)) * 25, "ms"), "samples": [x[i * BLOCK : (i + 1) * BLOCK].tolist() for i in range(n)]}) for s in streams]
    return spark.createDataFrame(pd.concat(parts), jobs.BLOCKS)


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=lambda r: r[:2])


def test_ring_buffer():
    ring = Ring(5)
    assert ring.write(np.arange(3.0)) == 0 and ring.peek(2).tolist() == [0, 1] and ring.read(2).tolist() == [0, 1]
    assert ring.write(np.arange(3.0, 7.0)) == 0 and ring.unread == 5 and ring.newest(3).tolist() == [4, 5, 6]
    assert ring.write(np.array([7.0, 8.0])) == 2 and ring.peek(9).tolist() == [4, 5, 6, 7, 8]  # the oldest two gave way
    again = Ring(*ring.packed())
    assert again.read(9).tolist() == [4, 5, 6, 7, 8] and again.read(1).tolist() == [] and again.newest(9).tolist() == [4, 5, 6, 7, 8]
    assert again.write(np.arange(12.0)) == 7 and again.read(9).tolist() == [7, 8, 9, 10, 11]
    rng, plain, ring = np.random.default_rng(1), [], Ring(37)
    for i in range(500):
        x = rng.normal(size=rng.integers(0, 30))
        plain = [*plain, *x]
        lost = max(0, len(plain) - 37)
        assert ring.write(x) == lost
        plain = plain[lost:]
        n = int(rng.integers(0, 30))
        assert ring.peek(n).tolist() == plain[:n] == ring.read(n).tolist()
        plain = plain[n:]


def test_sources_are_numbered_by_centroid():
    online, st = Online(Settings()), State()
    assert [online.classify(st, c, 0.1) for c in (500.0, 3000.0, 100.0, 510.0, 9000.0, 3000.0)] == [0, 1, 0, 1, 2, 2]
    assert len(st.profiles) == 3 and online.classify(st, 500.0, 0.0) == -1
    assert st.profiles[1][0] == pytest.approx(501.0)


def test_stream_equals_replay(spark, tmp_path):
    """Four micro-batches, then a restart from the checkpoint with two more; two streams at once."""
    x, streams = tones(24000), ("s", "t")
    settings = Settings(rate=RATE, low=100.0, high=3000.0, every=20)
    run = lambda: jobs.save(jobs.deinterleave(jobs.read_blocks(spark, f"{tmp_path}/in", 1), settings), f"{tmp_path}/out", f"{tmp_path}/cp")
    table = blocks_of(spark, x, streams).cache()
    for i in range(4):
        table.where(f"block_id div 20 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    for i in (4, 5):
        table.where(f"block_id div 20 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    decided = spark.read.parquet(f"{tmp_path}/out")
    live, replay = rows(decided), rows(jobs.replay(table.withColumnRenamed("block_id", "frame_id"), settings))
    assert live == replay and len(live) == 240
    assert {0, 1} <= {r[6] for r in live if r[1] > 20}
    heard = {r.block_id: r.samples for r in jobs.sound(decided.where("stream_id = 's'")).collect()}
    shown = [r for r in live if r[7] is not None and r[0] == "s"]
    assert shown and all(len(heard[r[1]]) == BLOCK and heard[r[1]][0][0] == heard[r[1]][0][1] for r in shown)
    quiet = [b for b, samples in heard.items() if b not in {r[1] for r in shown}]
    assert all(not np.any(heard[b]) for b in quiet) and any(np.any(heard[r[1]]) for r in shown)
    told = jobs.stats(decided).orderBy("stream_id", "block_id").collect()
    assert [(r.stream_id, r.block_id, r.n_blocks) for r in told] == [(s, 20 * i + 19, 20) for s in streams for i in range(6)]
    assert sum(r.n_changes for r in told) == sum(r[5] for r in live)


def test_state_ends_and_statistics_run(spark, tmp_path):
    """After an hour without blocks a stream starts anew; each micro-batch reports what it saw."""
    settings = Settings(rate=RATE, low=100.0, high=3000.0)
    for part in (blocks_of(spark, tones(8000)), blocks_of(spark, tones(2000), ("other",), start="2024-01-01 01:00:00"), blocks_of(spark, tones(2000), ("other",), 10, "2024-01-01 01:30:00"), blocks_of(spark, tones(4000), first=40, start="2024-01-01 02:00:00")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    progress = jobs.Progress()
    spark.streams.addListener(progress)
    try:
        decided = jobs.observed(jobs.deinterleave(jobs.read_blocks(spark, f"{tmp_path}/in", 1), settings))
        jobs.save(decided, f"{tmp_path}/out", f"{tmp_path}/cp")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(progress)
    got = [r for r in rows(spark.read.parquet(f"{tmp_path}/out")) if r[0] == "s"]
    anew = rows(jobs.replay(blocks_of(spark, tones(4000), first=40).withColumnRenamed("block_id", "frame_id"), settings))
    assert len(got) == 60 and [r[:10] for r in got[40:]] == [r[:10] for r in anew]
    assert sum(r["n_blocks"] for r in progress.rows) == 80 and all(r["seconds"] > 0 for r in progress.rows)


def test_delay_of_the_online_processor(spark):
    x = np.sin(2 * np.pi * 300 * np.arange(8000) / 8000)
    frames = spark.createDataFrame([("s", i, x[i * 200 : (i + 1) * 200].tolist()) for i in range(40)], "stream_id string, frame_id long, samples array<double>")
    first = {}
    for delay in (50.0, 200.0, 700.0):
        first[delay] = jobs.replay(frames, Settings(rate=8000, low=100.0, high=3000.0, delay_ms=delay)).where("size(out) > 0").agg(F.min("block_id")).first()[0]
    assert first[200.0] - first[50.0] == 6 and first[700.0] - first[200.0] == 20  # 150 and 500 ms in blocks of 25 ms


def test_state_does_not_grow():
    online, st = Online(Settings()), State()
    x = np.random.default_rng(1).normal(size=512)
    for i in range(400):
        online.block(st, i, x)
    assert len(st.ring.data) == int(0.6 * 44100) and len(st.waiting) < 60 and len(st.centroids) <= 10 and len(st.profiles) <= 3


def test_sessions_of_a_stream(spark, tmp_path):
    events = pd.DataFrame({"event_type": ["a"] * 5 + ["b"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 00:14", "2024-01-01 01:00", "2024-01-01 09:00", "2024-01-01 09:00"]), "value": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]})
    spark.createDataFrame(events).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = jobs.sessions(spark.readStream.schema("event_type string, ts timestamp, value double").parquet(f"{tmp_path}/in"))
    jobs.save(live, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.stream_id, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, 4.0), ("a", 3, 6.0)]  # those at nine may still go on


def test_display_of_the_last_blocks(spark):
    got = jobs.latest(blocks_of(spark, tones(4000), ("s", "t")), 0.2).orderBy("stream_id", "block_id").collect()
    assert [(r.stream_id, r.block_id) for r in got] == [(s, b) for s in "st" for b in range(12, 20)]
    x = tones(4000)[-1600:]
    one = jobs.scope(blocks_of(spark, tones(4000), ("s", "t")), RATE).orderBy("stream_id").collect()
    assert len(one) == 2 and np.allclose(one[1].samples, x, atol=1e-6)
    whole = np.abs(np.fft.rfft(x * np.hanning(1600))) / 800
    assert np.allclose(one[0].shown, np.convolve(whole, np.ones(5) / 5, "same"), atol=1e-6) and one[0].peak == pytest.approx(max(one[0].shown))
    assert jobs.scope(blocks_of(spark, tones(600)), RATE).count() == 0


def test_timings_of_a_run(spark, tmp_path):
    seconds, stages = timing.timed_run(spark, lambda: spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count(), f"{tmp_path}/out")
    assert seconds["run"] == pytest.approx(seconds["calculation"] + seconds["output"]) and min(seconds.values()) > 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    got = stages.collect()
    assert got and any(r.tasks == 4 and r.shuffle_mb > 0 for r in got) and all(r.seconds >= 0 for r in got)
