"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Learning: FTRL-proximal, with per-coordinate rates and L1, goes over a bounded sample of labelled documents (SAMPLE, the
smallest by a hash of doc_id) in a fixed order. Most weights end at exactly 0; the others, at most DIMENSIONS of them,
are small enough to broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, U64, flat_text, in_arrow, map_text, mix, slices, word_hashes, word_spans

BITS = 20
DIMENSIONS = 1 << BITS
#: Labelled documents learnt from, at most; a documented bound, not a share.
SAMPLE, EPOCHS = 24_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 1.0
#: The bias where there is nothing to learn from: unknown texts count as clean.
UNTAUGHT = -2.0
#: Bytes of a word that stand for its stem: a slur with another ending keeps it.
STEMS = (4, 5)


def features(text: pa.Array, of_use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row, end to end, distinct within the row, and each row's first (one more than rows).

    Words (A-Z lowered), their stems (longer words' first bytes), pairs of neighbours, and pairs with one word between.
    Null and empty rows have none. of_use: by coordinate, which features to give.
    """
    raw, at = flat_text(text)
    starts, ends, first = word_spans(raw, at, ALNUM)
    h = word_hashes(raw, starts, ends, lower=True)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    keys = []  # row and coordinate in one number

    def add(hashed: np.ndarray, of: np.ndarray) -> None:
        place = (hashed & U64(DIMENSIONS - 1)).astype(np.int64)
        if of_use is not None:
            keep = of_use[place]
            place, of = place[keep], of[keep]
        keys.append((of << BITS) | place)

    add(h, row)
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        add(mix(word_hashes(raw, starts[longer], starts[longer] + size, lower=True) + U64(size)), row[longer])
    for gap in (1, 2):
        a, b = h[:-gap], h[gap:]
        same = row[:-gap] == row[gap:]
        add(mix(a[same] * U64(2 * gap + 1) + b[same]), row[:-gap][same])
    key = np.unique(np.concatenate(keys))
    return key & (DIMENSIONS - 1), np.searchsorted(key >> BITS, np.arange(len(n) + 1))


class Ftrl:
    """FTRL-proximal logistic regression over binary features; the last coordinate is the bias, without L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == DIMENSIONS, 0.0, L1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Weights by coordinate. labelled: doc_id, y (0 or 1). Rows with null ids, labels or texts teach nothing.

    Of rows that repeat a doc_id one teaches: that of the smallest features, so that the weights don't depend on the run;
    an id that has both labels counts as 1. Texts become features where they are read. One task learns from the sample,
    as FTRL is sequential; it streams the rows, in a fixed order and once for each epoch, so its memory is that of the
    model.
    """
    chosen = labelled.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
    # at most `sample` rows of two numbers
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).where("text is not null").select("doc_id", "text", "y")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = features(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int32()), lists], names=["doc_id", "y", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            first = batch.column("x").offsets.to_numpy()
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, y in zip((first - first[0])[:-1], (first - first[0])[1:], batch.column("y").to_pylist(), strict=True):
                model.learn(np.append(values[a:b], DIMENSIONS), y)
        w = model.weights(np.arange(DIMENSIONS + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["i", "w"])

    seen = map_text(rows, extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x array<int>")
    seen = seen.groupBy("doc_id", "y").agg(F.min("x").alias("x")).repartition(1)
    seen = seen.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    ordered = seen.sortWithinPartitions("epoch", F.xxhash64("doc_id", F.lit(7)), "doc_id")
    # collected: at most DIMENSIONS + 1 rows
    learnt = {r["i"]: r["w"] for r in in_arrow(ordered.select("y", "x"), fit, "i long, w double").collect()}
    return learnt or {DIMENSIONS: UNTAUGHT}


def scored(df: DataFrame, weights: dict[int, float], into: str = "score") -> DataFrame:
    """df with `into`, the probability of the label, as a last column; its other columns stay.

    Null and empty texts get what the bias alone says, and repeated rows equal scores. A long text costs work arrays of
    some 100 bytes a word. A column that is called like `into` is not allowed. No shuffle.
    """
    index = np.array(sorted(weights), np.int64)
    packed = (index, np.array([weights[i] for i in index], np.float32))
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIMENSIONS + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            yield from (_score(part, w, into) for part in slices(batch))
            pa.default_memory_pool().release_unused()

    schema = df.select("*", F.lit(None).cast("double").alias(into)).schema
    return in_arrow(df, score, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))


def _score(batch: pa.RecordBatch, w: np.ndarray, into: str) -> pa.RecordBatch:
    values, first = features(batch.column("text"), w != 0)
    total = np.concatenate(([0.0], np.cumsum(w[values])))
    s = 1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + w[DIMENSIONS], -35, 35)))
    return batch.append_column(into, pa.array(s))


def learning_rows(labels: DataFrame) -> DataFrame:
    """doc_id, y of labels whose crc32(doc_id as text) mod 5 is not 0: the others are held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("toxic").alias("y"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: held_out, score and predicted; other columns of docs and labels don't matter.

    A null doc_id is not held out. Null and empty texts get the bias's score. Without labels all texts count as clean.
    """
    weights = train(docs.select("doc_id", "text"), learning_rows(labels))
    out = scored(docs.select("doc_id", "text"), weights)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
