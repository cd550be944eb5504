"""Structured Streaming jobs, and the same as batch replays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from spliceflow.functions.signal import stereo
from spliceflow.operators.spectral import display_spectrum
from spliceflow.streaming.online import Online, Settings, State
from spliceflow.streaming.ring import Ring

STATS = "n_blocks long, n_labelled long, n_changes long, mean_rms double"
OUT_DDL = f"stream_id string, block_id long, present boolean, centroid double, rms double, changed boolean, label int, out_block long, n_sources int, out array<double>, stats struct<{STATS.replace(' ', ':').replace(',:', ', ')}>"
BLOCKS = "stream_id string, block_id long, ts timestamp, samples array<float>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CORE = "filter array<array<double>>, present boolean, filled long, centroids array<double>, levels array<double>, clock long, changed_at long, profiles array<array<double>>, label int, silent_blocks int, blocks long, counted array<double>, last_ms long"
_RING = "size int, data binary, end long, unread int"
_WAITING = "block_id long, n int"


def _rows(online: Online, state: State, stream_id: str, blocks: Iterator[tuple[int, object]]) -> list[dict]:
    return [{"stream_id": stream_id} | online.block(state, int(b), np.asarray(x, float)) for b, x in blocks]


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in "stream_id,block_id,present,centroid,rms,changed,label,out_block,n_sources,out,stats".split(",")])
    return out.astype({"block_id": "int64", "out_block": "Int64", "label": "int32", "n_sources": "int32", "centroid": "float64", "rms": "float64"})


class BlockProcessor(StatefulProcessor):
    """The online processor as a stateful operator: what it knows, the ring of samples and the blocks waiting in it are
    typed states of a stream; a timer in event time ends a stream that is silent for idle_ms."""

    def __init__(self, settings: Settings, idle_ms: int):
        self.settings, self.idle_ms = settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.online = handle, Online(self.settings)
        self.core, self.ring, self.waiting = handle.getValueState("core", _CORE), handle.getValueState("ring", _RING), handle.getListState("waiting", _WAITING)

    def _load(self) -> State:
        if not self.core.exists():
            return State()
        names = [f.split(" ")[0] for f in _CORE.split(", ")]
        held = dict(zip(names, self.core.get(), strict=True))
        held.pop("last_ms")
        lists = {k: [list(x) if hasattr(x, "__len__") else x for x in held[k]] for k in ("filter", "centroids", "levels", "profiles", "counted")}
        ring = Ring(*self.ring.get()) if self.ring.exists() else None
        return State(**(held | lists), ring=ring, waiting=[tuple(x) for x in self.waiting.get()] if self.waiting.exists() else [])

    def _store(self, st: State, last_ms: int) -> None:
        self.core.update((st.filter, st.present, st.filled, st.centroids, st.levels, st.clock, st.changed_at, st.profiles, st.label, st.silent_blocks, st.blocks, [float(v) for v in st.counted], last_ms))
        if st.ring is None:
            self.ring.clear()
        else:
            self.ring.update(st.ring.packed())
        if st.waiting:
            self.waiting.put(st.waiting)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Spark gives a stream's rows of a micro-batch in pieces; blocks are taken in order of their numbers
        arrived = pd.concat(list(rows)).sort_values("block_id")
        state = self._load()
        yield _frame(_rows(self.online, state, key[0], zip(arrived["block_id"], arrived["samples"], strict=True)))
        last = max(int(arrived["ms"].max()), self.core.get()[-1] if self.core.exists() else 0)
        self._store(state, last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.core.clear()
        self.ring.clear()
        self.waiting.clear()
        return iter([])

    def close(self) -> None:
        pass


def deinterleave(blocks: DataFrame, settings: Settings, idle: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """A stream of blocks (stream_id, block_id, ts, samples) -> one row per block; `out` is the sound put out then.

    A stream's state ends when the watermark, `late` behind the newest block of all, is `idle` past its last one.
    Micro-batches must bring a stream's blocks in order; within one they are sorted. State lies in RocksDB: the session
    needs spark.sql.streaming.stateStore.providerClass = PROVIDER.
    """
    amount, unit = idle.split()
    idle_ms = int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    timed = blocks.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("stream_id").transformWithStateInPandas(BlockProcessor(settings, idle_ms), OUT_DDL, "Append", "EventTime")


def replay(frames: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The same over a finished table of frames (stream_id, frame_id, samples), frame after frame of each stream.

    A stream goes to one task, as its state demands, in batches of bounded size: memory doesn't grow with it.
    """
    chosen = settings or Settings(rate=8000, low=100.0, high=3000.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        online, state, stream = Online(chosen), State(), None
        for batch in batches:
            rows = []
            for stream_id, frame_id, samples in zip(batch["stream_id"], batch["frame_id"], batch["samples"], strict=True):
                if stream_id != stream:
                    state, stream = State(), stream_id
                rows += _rows(online, state, stream_id, iter([(frame_id, samples)]))
            if rows:
                yield _frame(rows)

    ordered = frames.select("stream_id", "frame_id", "samples").repartition("stream_id").sortWithinPartitions("stream_id", "frame_id")
    return ordered.mapInPandas(run, OUT_DDL)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """stream_id, start, n, total: sessions of events (event_type, ts, value) that end after `gap` without one.

    Works on a stream too: there, sessions come out when the watermark, `late` behind, has passed them.
    """
    rows = events.select(F.col("event_type").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "stream_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("stream_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n", "total")


def read_blocks(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """Blocks that arrive as Parquet files."""
    return spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", per_batch).parquet(path)


def latest(blocks: DataFrame, seconds: float = 0.2) -> DataFrame:
    """The samples of the last `seconds` of each stream, for a display: stream_id, block_id, samples."""
    last = blocks.groupBy("stream_id").agg(F.max("ts").alias("__last"))
    return blocks.join(last, "stream_id").where(F.unix_micros("ts") > F.unix_micros("__last") - round(seconds * 1e6)).drop("__last")


def scope(blocks: DataFrame, rate: int, seconds: float = 0.2, upto: float = 5000.0) -> DataFrame:
    """What a live display shows of each stream: stream_id, samples (the last `seconds`), shown (their smoothed spectrum)
    and peak (its largest value below `upto` Hz). A stream of less than that much sound is not shown."""
    n = int(rate * seconds)
    parts = latest(blocks, seconds).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "samples"))).alias("b"))
    sound = parts.select("stream_id", F.lit(0).cast("long").alias("frame_id"), F.flatten(F.transform("b", lambda x: x["samples"])).cast("array<double>").alias("samples"))
    sound = sound.where(F.size("samples") >= n).withColumn("samples", F.slice("samples", -n, n))
    shown = display_spectrum(sound, float(rate), n, upto)
    return sound.select("stream_id", "samples").join(shown.drop("frame_id"), "stream_id")


def save(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what a stream gives as Parquet files under path, until all that is there has been read. checkpoint: a shared
    folder; a run that is started again goes on where the last one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stats(decided: DataFrame) -> DataFrame:
    """Every so many blocks of a stream (Settings.every): blocks, those with a source, changes and mean level. A running
    stream gives these rows as they come, since the processor counts; decided: as deinterleave or replay gives."""
    return decided.where("stats is not null").select("stream_id", "block_id", "stats.*")


def observed(decided: DataFrame, name: str = "blocks") -> DataFrame:
    """decided, with sums that a listener gets for each micro-batch: blocks, changes, and blocks put out."""
    return decided.observe(name, F.count("*").alias("n_blocks"), F.count_if("changed").alias("n_changes"), F.count("out_block").alias("n_out"))


class Progress(StreamingQueryListener):
    """Collects what observed() counts, by micro-batch, with its seconds: add it with spark.streams.addListener."""

    def __init__(self, name: str = "blocks"):
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name in p.observedMetrics:
            self.rows.append({"batch": p.batchId, "seconds": p.batchDuration / 1000, **p.observedMetrics[self.name].asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def sound(decided: DataFrame) -> DataFrame:
    """stream_id, block_id, samples (both channels of each) of a finished run: what was put out when each block came in."""
    return decided.where(F.size("out") > 0).select("stream_id", "block_id", F.transform("out", stereo).alias("samples"))
