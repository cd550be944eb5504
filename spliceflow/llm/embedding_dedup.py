"""Near-duplicate vectors by a pivot-permutation index, verified by cosine in double precision.

1. Equal vectors of a label become one class with a weight.
2. Reference vectors, the pivots, are spread ones of a bounded sample; larger tables get more of them. Each class is described by its nearest
   ones, in order. It is posted in the inverted lists of some of them; two classes that share at least SHARED of their
   nearest meet in one of these lists at least.
3. In a list, pairs with enough shared pivots are candidates, and their cosine is computed. A pair counts in the first
   list in which it meets, so that links can be counted where they are found; what leaves a list is a count for each
   class and links that span its components, never all pairs. Long lists are dealt into blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, joined_with_hot_keys, written
from .components import components

LEAST_COSINE = 0.93
#: Pivots: a power of two near the root of the number of classes, within these bounds; the sample has four times as many.
FEWEST, MOST = 64, 16_384
#: Pivots that two classes share at least to be compared.
SHARED = 3
BLOCK = 1024
#: Distances of vectors to pivots that a worker holds at a time.
WORKED = 1 << 21
#: Pivots have a cosine below this with each other.
SPREAD = 0.6


def nearest_of(pivots: int) -> int:
    """How many nearest pivots describe a vector: more where there are many pivots, as near vectors then share a smaller
    part. By simulation, pairs of 64 dimensions at a cosine of 0.93 share SHARED of them in 0.99 (256 pivots, 8 nearest)
    to 0.98 (32,768 pivots, 12 nearest) of cases."""
    return 8 if pivots <= 256 else 12


def _spread(sample: np.ndarray, size: int, wanted: int) -> list[np.ndarray]:
    """Up to `wanted` unit vectors of the sample, none close to another, so that a large group of near copies doesn't take
    all pivots; random directions make them FEWEST at least."""
    out, k = np.empty((wanted, size)), 0
    for a in range(0, len(sample), 512):
        x = sample[a : a + 512] / np.linalg.norm(sample[a : a + 512], axis=1)[:, None]
        apart = (x @ out[:k].T).max(1) < SPREAD if k else np.ones(len(x), bool)
        before = k
        for v in x[apart]:
            if k < wanted and (k == before or (out[before:k] @ v).max() < SPREAD):
                out[k] = v
                k += 1
    rest = np.random.default_rng(size).normal(size=(max(0, FEWEST - k), size))
    return [*out[:k], *(rest / np.linalg.norm(rest, axis=1)[:, None])]


def _described(classes: DataFrame, pivots: list[np.ndarray], sizes: list[int], nearest: int) -> DataFrame:
    """cls, weight, label, dims, v (double), near (pivots by distance, by index), of classes whose size has pivots."""
    shared = classes.sparkSession.sparkContext.broadcast((pivots, sizes))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sizes = shared.value
        for batch in batches:
            lists = batch.column("v")
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            near = np.zeros((batch.num_rows, nearest), np.int32)
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                own = np.array([i for i, s in enumerate(sizes) if s == size])
                to = np.array([pivots[i] for i in own]).T
                take = min(nearest, len(own))
                # a few rows at a time, so that rows times pivots stay small however many pivots there are
                for part in np.array_split(rows, -(-len(rows) * len(own) // WORKED)):
                    x = flat[start[part][:, None] + np.arange(size)]
                    far = -((x / np.linalg.norm(x, axis=1)[:, None]) @ to)
                    best = np.sort(np.argpartition(far, take - 1, axis=1)[:, :take], axis=1)
                    # equal distances by pivot number: sort is stable
                    best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
                    near[part] = np.pad(own[best], ((0, 0), (0, nearest - take)), mode="edge")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * nearest), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    kind = classes.schema["cls"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    return in_arrow(classes.select("cls", "weight", "label", "v"), describe, f"cls {kind}, weight long, label {label}, v array<double>, near array<int>")


def _lists(described: DataFrame, nearest: int) -> DataFrame:
    """One row for each list that a class is posted in, dealt into block pairs: label, dims, pivot, i, j, left, right.

    A class is posted under its lowest-numbered nearest - SHARED + 1 pivots: of SHARED common pivots of two classes, the
    lowest-numbered is among these for both.
    """
    described = described.withColumn("dims", F.size("v")).withColumn("posted", F.slice(F.array_sort(F.array_distinct("near")), 1, nearest - SHARED + 1))
    key = ["label", "dims", "pivot"]
    rows = described.withColumn("pivot", F.explode("posted"))
    rows = rows.withColumn("list", F.struct(*key))
    sizes = written(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.count("*").alias("places")).where("places > 1"))
    rows = joined_with_hot_keys(rows, sizes, "list", F.xxhash64("cls"), BLOCK).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own, other = F.col("own"), F.col("other")
    return rows.select(*key, F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own <= other).alias("left"), (own >= other).alias("right"), "cls", "weight", "v", "near", "posted")


def _compared(lists: DataFrame, least: float) -> DataFrame:
    """cls, n (weight of partners found here), other (a link that joins components, or null)."""

    def compare(table: pa.Table) -> pa.Table:
        cls, weight = table.column("cls").to_numpy(), table.column("weight").to_numpy()
        pivot = table.column("pivot")[0].as_py()
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        v = np.stack(table.column("v").to_numpy())
        norm = np.sqrt((v * v).sum(1))
        near = np.stack(table.column("near").to_numpy())
        used, near_at = np.unique(near, return_inverse=True)
        has = np.zeros((len(cls), len(used)), np.float32)
        np.put_along_axis(has, near_at.reshape(near.shape), 1, 1)
        need = np.minimum(SHARED, has.sum(1))  # vectors of a rare length may have fewer pivots
        n = np.zeros(len(cls), np.int64)
        root = list(range(len(cls)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for a in range(0, len(left), 128):
            some = left[a : a + 128]
            shared = has[some] @ has[right].T
            x, y = np.nonzero(shared >= need[some][:, None])
            x, y = some[x], right[y]
            keep = (x < y) if same else (cls[x] != cls[y])
            x, y = x[keep], y[keep]
            cosine = np.empty(len(x))
            for b in range(0, len(x), 4096):
                p, q = x[b : b + 4096], y[b : b + 4096]
                cosine[b : b + 4096] = (v[p] * v[q]).sum(1) / (norm[p] * norm[q])
            x, y = x[cosine >= least], y[cosine >= least]
            # the pair's first common pivot must be this list's
            both = (has[x] > 0) & (has[y] > 0)
            first = used[both.argmax(1)] == pivot if len(x) else np.empty(0, bool)
            x, y = x[first], y[first]
            np.add.at(n, x, weight[y])
            np.add.at(n, y, weight[x])
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                r, s = find(p), find(q)
                if r != s:
                    root[max(r, s)] = min(r, s)
                    links.append((p, q))
        at = np.flatnonzero(n)
        p, q = (np.array(z, np.int64) for z in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
        id_type = table.schema.field("cls").type
        mine = pa.array(np.concatenate((cls[at], cls[p])), id_type)
        other = pa.concat_arrays([pa.nulls(len(at), id_type), pa.array(cls[q], id_type)])
        return pa.table({"cls": mine, "n": pa.array(np.concatenate((n[at], np.zeros(len(p), np.int64)))), "other": other})

    kind = lists.schema["cls"].dataType.simpleString()
    return lists.groupBy("label", "dims", "pivot", "i", "j").applyInArrow(compare, f"cls {kind}, n long, other {kind}")


def _sample(classes: DataFrame, n: int, size: int) -> list[np.ndarray]:
    """About `size` of n vectors, or all where there are fewer, as arrays: those with the smallest hashes, in their order.

    Which hashes are small follows from n, so each task sends its own share and none has to order what others found.
    """
    h = F.xxhash64("cls", "v")
    # six standard deviations more, of which the surplus is cut off
    wanted = size + 6 * math.sqrt(size)
    few = classes.select(h.alias("h"), "v") if n <= wanted else classes.select(h.alias("h"), "v").where(h < F.lit(int(-(1 << 63) + wanted / n * (1 << 64))))
    table = few.toArrow().sort_by("h").slice(0, size)
    return [x.values.to_numpy(zero_copy_only=False) for x in table.column("v")]


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, wanted: int | None = None) -> DataFrame:
    """One row per vector of (vec_id, embedding, label): n_links, component_id, kept.

    Linked are vectors of one label with cosine >= least. Null, zero and non-finite vectors, those with null components
    and those of null label link with nothing. Vectors of different lengths don't link. Repeated rows are copies: each
    counts as a vector. A vec_id that is null has a null component and is kept. An empty table gives an empty one; other
    columns don't matter. wanted: pivots at most, in place of a number that follows the table.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    sound &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(sound, v).alias("v"))
    valid = rows.where("v is not null")
    classes = written(valid.groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("weight")))
    n = classes.count()
    wanted = wanted or min(MOST, max(FEWEST, 1 << round(math.log2(max(2.0, math.sqrt(n) / 2)))))
    sample = _sample(classes, n, 4 * wanted)
    pivots: list[np.ndarray] = []
    for r in classes.select(F.size("v").alias("size")).distinct().orderBy("size").collect():
        own = [x for x in sample if len(x) == r["size"]]
        pivots += _spread(np.array(own, float).reshape(len(own), r["size"]), r["size"], wanted)
    sizes = [len(p) for p in pivots]
    nearest = nearest_of(wanted)
    found = written(_compared(_lists(_described(classes, pivots, sizes, nearest), nearest), least))
    counts = found.groupBy("cls").agg(F.sum("n").alias("others"))
    comp = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cls")
    classes = classes.join(counts, "cls", "left").join(comp, "cls", "left")
    classes = classes.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    out = rows.join(classes, ["label", "v"], "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
