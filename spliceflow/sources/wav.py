"""WAV files as tables of sample chunks, as streams of blocks, and back: a data source for each way.

Files are read by ranges of bytes, so that one file may go to many tasks; their heads are read once, when a read is
planned. Paths are those of pyarrow.fs: mounted folders, or URIs of stores that it knows.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from spliceflow.helpers import cut
from spliceflow.operators.reconstruct import loop_to
from spliceflow.operators.resample import resampled

CHUNK_SCHEMA = "stream_id string, chunk_id long, start_idx long, rate int, samples array<float>"
BLOCK_SCHEMA = "stream_id string, block_id long, ts timestamp, samples array<float>"
#: Samples per chunk: a few hundred kilobytes. Chunks that one task reads.
CHUNK, CHUNKS_A_TASK = 1 << 16, 64


@dataclass(frozen=True)
class Head:
    """What a file's RIFF chunks say: where its samples lie and how they are stored."""

    offset: int
    frames: int
    channels: int
    width: int
    rate: int
    floats: bool

    @classmethod
    def read(cls, f: io.BufferedIOBase | pa.NativeFile, size: int) -> Head:
        kind, _, form = struct.unpack("<4sI4s", f.read(12))
        if kind not in (b"RIFF", b"RF64") or form != b"WAVE":
            raise ValueError("not a WAV file")
        fmt, at, long = None, 12, None
        while at + 8 <= size:
            f.seek(at)
            name, n = struct.unpack("<4sI", f.read(8))
            at += 8
            if name == b"ds64":
                long = struct.unpack("<QQ", f.read(16))[1]
            elif name == b"fmt ":
                fmt = f.read(n)
            elif name == b"data":
                tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", fmt[:16])
                tag = struct.unpack("<H", fmt[24:26])[0] if tag == 0xFFFE else tag
                width, floats = bits // 8, tag == 3
                if tag not in (1, 3) or width not in ((4, 8) if floats else (1, 2, 3, 4)):
                    raise ValueError(f"format {tag} of {bits} bits is not supported")
                # a length that was never filled in, or doesn't fit 32 bits: up to the file's end
                n = long if n == 0xFFFFFFFF and long else n
                return cls(at, min(n, size - at) // block, channels, width, rate, floats)
            at += n + n % 2
        raise ValueError("a WAV file without samples")

    def decode(self, raw: bytes) -> np.ndarray:
        """Mono samples in -1..1; channels are averaged."""
        if self.floats:
            x = np.frombuffer(raw, f"<f{self.width}").astype(float)
        elif self.width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 8388608.0
        else:
            kind, scale = {1: ("u1", 128.0), 2: ("<i2", 32768.0), 4: ("<i4", 2147483648.0)}[self.width]
            x = np.frombuffer(raw, kind).astype(float)
            x = (x - 128.0 if self.width == 1 else x) / scale
        return (x.reshape(-1, self.channels).mean(1) if self.channels > 1 else x).astype(np.float32)

    def samples(self, f: pa.NativeFile, first: int, n: int) -> np.ndarray:
        f.seek(self.offset + first * self.channels * self.width)
        return self.decode(f.read(n * self.channels * self.width))


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> tuple[pa.fs.FileSystem, list[pa.fs.FileInfo]]:
    store, inner = _store(path)
    info = store.get_file_info(inner)
    found = [info] if info.is_file else store.get_file_info(pa.fs.FileSelector(inner, recursive=True))
    return store, sorted((f for f in found if f.is_file and f.base_name.endswith(".wav") and not f.base_name.startswith(".")), key=lambda f: f.path)


def stream_of(file_name: str) -> str:
    return unquote(file_name.removesuffix(".wav"))


def file_of(stream_id: str) -> str:
    """A file name for any id: signs that mean something in paths are written as %XX."""
    name = quote(stream_id, safe=" !#$&'()+,;=@[]^_`{}~-.")
    return (f"%2E{name[1:]}" if name.startswith(".") else name) + ".wav"


@dataclass
class Range(InputPartition):
    path: str
    stream: str
    head: Head
    first: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("chunksPerTask", CHUNKS_A_TASK))

    def partitions(self) -> list[Range]:
        store, files = _files(self.path)
        out = []
        for info in files:
            with store.open_input_file(info.path) as f:
                head = Head.read(f, info.size)
            step = CHUNK * self.per_task
            out += [Range(info.path, stream_of(info.base_name), head, a, min(a + step, head.frames)) for a in range(0, head.frames, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with _store(self.path)[0].open_input_file(partition.path) as f:
            for at in range(partition.first, partition.end, CHUNK):
                x = partition.head.samples(f, at, min(CHUNK, partition.end - at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.stream]), pa.array([at // CHUNK]), pa.array([at]), pa.array([partition.head.rate], pa.int32()), pa.array([x], pa.list_(pa.float32()))],
                    names=["stream_id", "chunk_id", "start_idx", "rate", "samples"],
                )


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """A stream's chunks, in order in one task, go to a file aside; when all tasks are done, files get their names."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].removeprefix("file://").removeprefix("file:"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        name, out, moves, done = None, None, [], set()
        for batch in iterator:
            for stream, rate, x in zip(batch.column("stream_id").to_pylist(), batch.column("rate").to_pylist(), batch.column("samples"), strict=True):
                if stream != name:
                    if out:
                        out.close()
                    if stream in done:
                        raise ValueError("chunks must be sorted by stream_id and chunk_id within a partition")
                    name, aside = stream, f"{self.folder}/.{uuid.uuid4().hex}"
                    done.add(stream)
                    moves.append((aside, f"{self.folder}/{file_of(stream)}"))
                    out = _writer(aside, rate)
                out.writeframes(_pcm(x.values.to_numpy(zero_copy_only=False)))
        if out:
            out.close()
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        moves = [m for message in messages if message for m in message.moves]
        if len({to for _, to in moves}) < len(moves):
            raise ValueError("a stream's chunks came from several partitions")
        if self.overwrite and os.path.isdir(self.folder):
            kept = {to for _, to in moves}
            for f in os.listdir(self.folder):
                if f.endswith(".wav") and f"{self.folder}/{f}" not in kept:
                    os.remove(f"{self.folder}/{f}")
        for aside, to in moves:
            os.replace(aside, to)

    def abort(self, messages: list[_Written | None]) -> None:
        for aside in (m[0] for message in messages if message for m in message.moves):
            if os.path.exists(aside):
                os.remove(aside)


class WavSource(DataSource):
    """Format "wav": chunks of samples, by ranges of files' bytes. Option chunksPerTask."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


class _BlockReader(DataSourceStreamReader):
    """Offsets are numbers of blocks, the same for all files; blocks carry the time at which they would sound."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("blockSize", 512))
        self.start, self.per_batch = datetime.fromisoformat(options.get("start", "2000-01-01")), int(options.get("blocksPerBatch", 0))
        self.sent = 0

    def _heads(self) -> list[tuple[str, str, Head]]:
        store, files = _files(self.path)
        out = []
        for info in files:
            with store.open_input_file(info.path) as f:
                out.append((info.path, stream_of(info.base_name), Head.read(f, info.size)))
        return out

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        total = max((head.frames // self.size for _, _, head in self._heads()), default=0)
        self.sent = min(total, self.sent + self.per_batch) if self.per_batch else total
        return {"block": self.sent}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.sent = max(self.sent, end["block"])
        step = max(1, CHUNK * CHUNKS_A_TASK // self.size)
        return [Range(path, stream, head, a, min(a + step, end["block"], head.frames // self.size)) for path, stream, head in self._heads() for a in range(start["block"], min(end["block"], head.frames // self.size), step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with _store(self.path)[0].open_input_file(partition.path) as f:
            for block in range(partition.first, partition.end):
                x = partition.head.samples(f, block * self.size, self.size)
                yield partition.stream, block, self.start + timedelta(seconds=block * self.size / partition.head.rate), x.tolist()


class WavBlocks(DataSource):
    """Format "wav_blocks": files replayed as a stream, block by block; what is left at a file's end is dropped. Options
    blockSize, blocksPerBatch (default: all that is there), start (a time)."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def streamReader(self, schema) -> _BlockReader:
        return _BlockReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
    spark.dataSource.register(WavBlocks)


def _writer(target: str | io.BytesIO, rate: int) -> wave.Wave_write:
    w = wave.open(target, "wb")
    w.setnchannels(1)
    w.setsampwidth(2)
    w.setframerate(rate)
    return w


def _pcm(x: np.ndarray) -> bytes:
    return (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()


def encode(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono: clipped to -1..1, times 32767, cut towards 0."""
    out = io.BytesIO()
    with _writer(out, rate) as w:
        w.writeframes(_pcm(x))
    return out.getvalue()


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and the rate of a whole file in memory."""
    head = Head.read(io.BytesIO(raw), len(raw))
    return head.decode(raw[head.offset : head.offset + head.frames * head.channels * head.width]), head.rate


def read_wav(spark: SparkSession, path: str, rate: int | None = None, chunks_per_task: int = CHUNKS_A_TASK) -> DataFrame:
    """stream_id (file name without ending), chunk_id, start_idx, rate, samples: all WAV files under path, at `rate` if given."""
    register(spark)
    chunks = spark.read.format("wav").option("chunksPerTask", chunks_per_task).load(path)
    return resampled(chunks, rate) if rate else chunks


def load(spark: SparkSession, path: str, rate: int, length: int) -> DataFrame:
    """stream_id, idx, x: all files at one rate and of one length, cut or repeated from the start."""
    signal = cut(as_signal(read_wav(spark, path, rate)))
    return loop_to(signal, signal.groupBy("stream_id").agg(F.count("*").alias("n")), length)


def as_signal(chunks: DataFrame) -> DataFrame:
    """stream_id, idx, x."""
    rows = chunks.select("stream_id", "start_idx", F.posexplode("samples").alias("p", "x"))
    return rows.select("stream_id", (F.col("start_idx") + F.col("p")).alias("idx"), F.col("x").cast("double").alias("x"))


def as_chunks(signal: DataFrame, rate: int, size: int = CHUNK) -> DataFrame:
    """A signal packed for storage: stream_id, chunk_id, start_idx, rate, samples."""
    rows = signal.groupBy("stream_id", F.floor(F.col("idx") / size).alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("x").cast("float").alias("x")))).alias("s"))
    return rows.select("stream_id", "chunk_id", F.get("s", F.lit(0))["idx"].alias("start_idx"), F.lit(rate).alias("rate"), F.col("s.x").alias("samples"))


def write_wav(chunks: DataFrame, folder: str, mode: str = "append") -> None:
    """Write each stream as a file in folder (16-bit mono), by one task and chunk by chunk; see file_of for its name.

    Files appear when all are written. folder must be mounted where tasks run.
    """
    register(chunks.sparkSession)
    columns = [f.split(" ")[0] for f in CHUNK_SCHEMA.split(", ")]
    ordered = chunks.select(*columns).repartition("stream_id").sortWithinPartitions("stream_id", "chunk_id")
    ordered.write.format("wav").mode(mode).save(folder)
