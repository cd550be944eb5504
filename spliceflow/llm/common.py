"""Helpers shared by the corpus operators: Arrow text to word hashes, and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

#: Bytes of text that are worked on at a time (work arrays take some 40 times as much), and of a batch between Spark and
#: its Python workers.
SLICE, BATCH = 256 << 10, 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_SPACE = bytes(range(0x09, 0x0E)) + b" "
#: Byte tables: which bytes of UTF-8 text belong to a word, for the two word rules in use.
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(_SPACE)] = False
ALNUM = np.zeros(256, bool)
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: makes the low-entropy sums below behave like random 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = _SYMBOL.copy()
_LOWER[65:91] = _SYMBOL[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


#: Bytes that are hashed at a time, and a word's length from which its hash is another one (the sum is weak on long words).
HASHED, LONG_WORD = 1 << 16, 500
_UP, _DOWN = _powers(BYTE_BASE, HASHED), _powers(pow(BYTE_BASE, -1, 1 << 64), HASHED)


def flat_text(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and each row's first offset (one more than rows). Null is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    at = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more than rows)."""
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    inside = np.zeros(len(raw) + 2, bool)  # with a byte outside of words at both ends
    inside[1:-1] = in_word[raw]
    starts, ends = [], []
    for a in range(0, len(raw) + 1, 1 << 20):
        b = min(a + (1 << 20), len(raw) + 1)
        before, after = inside[a:b], inside[a + 1 : b + 1]
        starts.append(np.flatnonzero(after & (~before | cut[a:b])) + a)
        ends.append(np.flatnonzero(before & (~after | cut[a:b])) + a)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z. Words are taken in runs of at most HASHED bytes."""
    symbols = _LOWER if lower else _SYMBOL
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + HASHED - 1, side="right")))
        n = ends[b - 1] - lo
        if n < HASHED:
            total = np.zeros(n + 1, U64)
            np.cumsum(symbols[raw[lo : lo + n]] * _UP[:n], out=total[1:])
            s = starts[a:b] - lo
            out[a:b] = mix((total[ends[a:b] - lo] - total[s]) * _DOWN[s])
        a = b
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = raw[starts[i] : ends[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of words[p:p+k] for every p at which k words are left, whatever rows they belong to."""
    if len(words) < k:
        return np.empty(0, U64)
    h, n = words, 1  # polynomials over n words; n grows to k bit by bit
    for bit in bin(k)[3:]:
        h = h[:-n] + h[n:] * U64(pow(WORD_BASE, n, 1 << 64))
        n *= 2
        if bit == "1":
            h = h[:-1] + words[n:] * U64(pow(WORD_BASE, n, 1 << 64))
            n += 1
    return mix(h)


def span_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words[first:end] for each pair, of a few words each."""
    n, out = end - first, np.zeros(len(first), U64)
    for j in range(int(n.max(initial=0))):
        has = n > j
        out[has] += words[first[has] + j] * U64(pow(WORD_BASE, j, 1 << 64))
    return mix(out)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text, so that work arrays stay small."""
    at = flat_text(batch.column(text))[1]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(fn, schema); a session whose batches may have more than BATCH bytes gets that bound."""
    conf = df.sparkSession.conf
    bound = (conf.get(BATCH_CONF) or "").rstrip("b")
    if bound.isdigit() and int(bound) > BATCH:
        conf.set(BATCH_CONF, f"{BATCH}b")
    return df.mapInArrow(fn, schema)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str = "text") -> DataFrame:
    """Apply fn to runs of rows of bounded text size, inside Spark's tasks. Only a single text may be larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)
            pa.default_memory_pool().release_unused()

    return in_arrow(df, run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share (spark.checkpoint.dir)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "/tmp/spliceflow-checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/spliceflow-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: later reads survive lost executors and don't compute them again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table that written() made, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Hot keys that may be broadcast; more of them are met in so many salted tasks each.
MAX_HOT, SALTS = 100_000, 64


def joined_with_hot_keys(rows: DataFrame, table: DataFrame, key: str, spread: Column, hot: int) -> DataFrame:
    """rows.join(table, key) where a key may hold a large share of rows. table: key, places (its rows), and other columns.

    Keys of more than `hot` places are few for their number of rows; their columns come by broadcast where they are at
    most MAX_HOT, else from salted tasks. All others come by a join in which the rows of hot keys, matched already, are
    dealt out by `spread` (a long).
    """
    others = [c for c in table.columns if c != key]
    often = written(table.where(F.col("places") > hot))
    often = often.select(key, F.struct(*others).alias("__hot"))
    if often.count() <= MAX_HOT:
        marked = rows.join(F.broadcast(often), key, "left")
    else:
        salted = often.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], "left").drop("__salt")
    marked = marked.withColumn("__spread", F.when(F.col("__hot").isNotNull(), F.pmod(spread, F.lit(1024)) + 1).otherwise(0))
    cold = table.where(F.col("places") <= hot).select(key, F.lit(0).cast("long").alias("__spread"), F.struct(*others).alias("__cold"))
    found = marked.join(cold, [key, "__spread"], "left").withColumn("__cold", F.coalesce("__hot", "__cold")).where("__cold is not null")
    return found.select(*rows.columns, *[F.col("__cold")[c].alias(c) for c in others])
