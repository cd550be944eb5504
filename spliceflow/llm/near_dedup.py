"""Near-duplicate documents by an LSH forest over MinHash signatures, verified on full shingle sets.

The forest has TREES sorted orders. In each, a document's label is its signature's values in that tree's order: BASE of
them as one hash, then DEEPER more, a byte each. Documents whose labels agree in BASE values at least are a region of the
order, and the longer the common prefix of two labels, the nearer they stand.

1. Documents with equal sets become one class; the rest works on classes.
2. Orders are sorted by range partitioning. Each region has a hub, its smallest class; links to hubs are verified on full
   sets. This joins nearly all groups, at a few pairs for each document, whatever their size.
3. Regions that still hold several components are sorted again. A region of at most REGION classes gives all pairs across
   components. Crowded ones go deeper, each part of the order until at most REGION classes are left in it, and there each
   class gives its neighbour of longest common prefix in another component.
4. What crowded regions still hold apart then is compared in blocks by signature, so that adaptive depth loses no link.
   Pairs that may reach the threshold are verified on full sets. Where a pair of blocks has very many such pairs, as with
   families of texts that are all somewhat alike, it is verified as a whole, and gives the links that join its
   components, not its pairs.
5. Components are taken over all links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, U64, flat_text, in_arrow, map_text, mix, span_hashes, window_hashes, word_hashes, word_spans, written
from .components import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
VALUES, TREES, BASE, DEEPER = 80, 20, 4, 12
#: Classes in a region, or a part of one, up to which it goes no deeper; and classes in a block.
REGION, BLOCK = 24, 256
#: Rows of a crowded region are dealt out so many ways; classes of a region that a task holds at a time.
SALTS, HELD = 64, 500_000
#: Signatures agreeing in fewer values than this many standard deviations below the threshold belong to sets below it, but
#: for one pair in 10^7.
DEVIATIONS = 6

#: Pairs whose ids may be broadcast, to move fewer texts.
MAX_BROADCAST = 500_000

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SHIFTS = mix(np.arange(101, VALUES + 101, dtype=U64) * U64(0x9E3779B97F4A7C15))


def least_share(percent: int) -> float:
    """The share of values in which signatures of a pair at the threshold agree at least; 0.6 for 85."""
    p = percent / 100
    return max(0, math.floor(VALUES * p - DEVIATIONS * math.sqrt(VALUES * p * (1 - p)))) / VALUES


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and each row's first (one more than rows)."""
    raw, at = flat_text(text)
    starts, ends, first = word_spans(raw, at, NON_SPACE)
    h = word_hashes(raw, starts, ends, lower=True)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h))
    w = window_hashes(h, SHINGLE)
    whole = pos[: len(w)] + SHINGLE <= first[1:][row[: len(w)]]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    values = np.concatenate((w[whole], span_hashes(h, first[short], first[short + 1])))
    rows = np.concatenate((row[: len(w)][whole], short))
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(len(n) + 1))


def _segment(fn: np.ufunc, x: np.ndarray, first: np.ndarray, empty: int) -> np.ndarray:
    """fn over each row's run of x; empty rows get `empty`."""
    n = np.diff(first)
    out = np.full(len(n), empty, x.dtype)
    full = n > 0
    if full.any():
        out[full] = fn.reduceat(x, first[:-1][full])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, k1 and k2 (a hash of the set; null if empty), signature (VALUES x 32 bits)."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch.column("text"))
        n = np.diff(first)
        k1 = _segment(np.add, mix(values ^ U64(0x5851F42D4C957F2D)), first, 0)
        k2 = _segment(np.add, mix(values ^ U64(0x14057B7EF767814F)), first, 0)
        sig = np.empty((len(n), VALUES), np.uint32)
        for j in range(VALUES):
            x = (values ^ (values >> U64(29)) ^ _SHIFTS[j]) * _FACTORS[j]
            sig[:, j] = _segment(np.minimum, (x >> U64(32)).astype(np.uint32), first, 0)
        none = n == 0
        width = VALUES * 4
        binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(n), [None, pa.py_buffer(np.ascontiguousarray(sig))])
        long = lambda x: pa.array(x.astype(np.int64) if x.dtype != U64 else x.view(np.int64), mask=none)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), long(k1), long(k2), binary.cast(pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "k1", "k2", "signature"],
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), sign, f"doc_id {id_type}, text_hash long, n_shingles long, k1 long, k2 long, signature binary")


def _orders() -> np.ndarray:
    """The values of each tree's labels in order: BASE of its own, then DEEPER others."""
    rng, own = np.random.default_rng(TREES), (np.arange(TREES)[:, None] * BASE + np.arange(BASE)[None, :]) % VALUES
    return np.array([[*o, *rng.permutation(np.setdiff1d(np.arange(VALUES), o))[:DEEPER]] for o in own])


def labels(classes: DataFrame) -> DataFrame:
    """(label, cls), one row for each tree. A label is 8 + DEEPER bytes; its first 8 are the hash of the tree and BASE values."""
    orders = _orders()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
            out = np.empty((len(sig), TREES, 8 + DEEPER), np.uint8)
            for t, order in enumerate(orders):
                k = np.full(len(sig), mix(np.array([t + 1], U64))[0])
                for j in order[:BASE]:
                    k = mix(k ^ sig[:, j].astype(U64)) + U64(t)
                out[:, t, :8] = k.astype(">u8").view(np.uint8).reshape(-1, 8)
                out[:, t, 8:] = sig[:, order[BASE:]] & 255
            cls = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), TREES)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 + DEEPER), len(cls), [None, pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([flat.cast(pa.binary()), pa.array(cls, batch.schema.field("cls").type)], names=["label", "cls"])

    return in_arrow(classes.select("cls", "signature"), label, f"label binary, cls {classes.schema['cls'].dataType.simpleString()}")


def _in_order(df: DataFrame, held: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Sort df (label, cls, ...) by label over all partitions, and apply held(rows, labels, starts, edge) to runs of regions.

    starts has each region's first row. A region at the border of a partition, or of more than HELD rows, comes in pieces;
    edge is true for these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        cut = True  # the waiting rows' first region may have begun before

        def done(table: pa.Table, label: np.ndarray, open_start: bool, open_end: bool) -> Iterator[pa.RecordBatch]:
            region = label[:, :8].copy().view(">u8").ravel()
            start = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
            edge = np.zeros(len(start), bool)
            edge[0], edge[-1] = open_start, edge[-1] | open_end | (open_start and len(start) == 1)
            yield from held(table, label, start, edge).to_batches()

        def matrix(table: pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(table.column("label").to_pylist()), np.uint8).reshape(-1, 8 + DEEPER)

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            n += batch.num_rows
            if n < HELD:
                continue
            table = pa.Table.from_batches(waiting)
            label = matrix(table)
            same = (label[:, :8] == label[-1, :8]).all(1)
            last = len(same) - int(same.sum())  # where the last region, which may go on, starts
            if last:
                yield from done(table.slice(0, last), label[:last], cut, False)
                waiting, cut = table.slice(last).to_batches(), False
            else:
                yield from done(table, label, True, True)
                waiting, cut = [], True
            n = sum(b.num_rows for b in waiting)
        if n:
            table = pa.Table.from_batches(waiting)
            yield from done(table, matrix(table), cut, True)

    return in_arrow(df.repartitionByRange("label", "cls").sortWithinPartitions("label", "cls"), run, schema)


def regions(labelled: DataFrame) -> DataFrame:
    """Rows of regions of two classes or more: region, label, cls, hub, n and edge. In pieces, hub and n are the piece's."""

    def held(table: pa.Table, label: np.ndarray, start: np.ndarray, edge: np.ndarray) -> pa.Table:
        cls = table.column("cls").to_numpy()
        n = np.diff(np.append(start, len(cls)))
        hub = np.repeat(np.minimum.reduceat(cls, start), n)
        region = label[:, :8].copy().view(">u8").ravel().astype(U64).view(np.int64)
        out = pa.table({"region": region, "label": table.column("label"), "cls": table.column("cls"), "hub": pa.array(hub, table.schema.field("cls").type), "n": np.repeat(n, n), "edge": np.repeat(edge, n)})
        return out.filter(pa.array(np.repeat((n > 1) | edge, n)))

    kind = labelled.schema["cls"].dataType.simpleString()
    return _in_order(labelled, held, f"region long, label binary, cls {kind}, hub {kind}, n long, edge boolean")


def _stars(crowd: DataFrame) -> DataFrame:
    """(a, b, parts): hubs with their classes, and hubs of a region's pieces with each other. parts: see _sides_of."""
    spokes = crowd.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"), "n")
    pieces = crowd.where("edge and cls = hub").select("region", "hub")  # two at most for each partition
    first = pieces.groupBy("region").agg(F.min("hub").alias("a"))
    between = pieces.join(first, "region").where("a <> hub").select("a", F.col("hub").alias("b"), F.lit(1).cast("long").alias("n"))
    return spokes.unionByName(between).groupBy("a", "b").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("parts"))


def _sides_of(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs (a, b, parts) with column_a and column_b from table (cls, column).

    An `a` that stands in very many pairs is dealt into `parts` by b, so that no task gets all of its pairs.
    """
    table = table.select("cls", column)  # both joins read one exchange of it
    left = pairs.groupBy("a").agg(F.max("parts").alias("most")).join(table, F.col("a") == F.col("cls"))
    left = left.select(F.col("a").alias("a2"), F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("part2"), F.col(column).alias(f"{column}_a"))
    right = pairs.join(table, F.col("b") == F.col("cls")).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int"))
    right = right.withColumnRenamed(column, f"{column}_b")
    return right.join(left, (F.col("a") == F.col("a2")) & (F.col("part") == F.col("part2"))).drop("cls", "part", "a2", "part2")


def _some(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts; where few ids (k) are asked for, only these, so that the others don't move."""
    ids = written(ids.distinct())
    return texts.join(F.broadcast(ids), F.col("cls") == F.col("k"), "left_semi") if ids.count() <= MAX_BROADCAST else texts


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, parts) whose full shingle sets reach the threshold, as (a, b). texts: cls, text."""
    both = _sides_of(pairs, texts, "text").select("a", "b", "text_a", "text_b")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        (va, fa), (vb, fb) = shingles(batch.column("text_a")), shingles(batch.column("text_b"))
        ok = []
        for i in range(batch.num_rows):
            # both lists are sorted and distinct: in the sorted whole, a shared value stands next to itself
            both = np.sort(np.concatenate((va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]])))
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(shared > 0 and 100 * shared >= percent * (len(both) - shared))
        keep = pa.array(ok, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return map_text(both, check, f"a {kind}, b {kind}", text="text_a").distinct()


def _salted(rows: DataFrame, by_region: DataFrame) -> DataFrame:
    """rows (region, cls, n) with the columns of by_region (region, size, ...); rows of crowded regions meet them in SALTS tasks.

    No piece of a region of at most REGION classes has more, so its rows have salt 0.
    """
    salt = F.when(F.col("n") > REGION, F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("size") > REGION, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("salt", salt).join(by_region.withColumn("salt", F.explode(salts)), ["region", "salt"]).drop("salt")


def _mixed(crowd: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of regions that hold several components: region, label, cls, n, comp, size (of the region)."""
    joined = joined.select(F.col("node").alias("k"), F.col("component").alias("comp"))
    rows = crowd.join(joined, F.col("cls") == F.col("k"), "left").select("region", "label", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    mixed = rows.groupBy("region").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("size")).where("c1 < c2").select("region", "size")
    return _salted(rows, mixed)


def _parts(label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sorted labels of one region that share a prefix: deeper, until at most REGION are in a run or labels end."""
    stack = [(0, len(label), 8)]
    while stack:
        a, b, depth = stack.pop()
        if b - a <= REGION or depth == label.shape[1]:
            yield a, b
            continue
        cuts = np.flatnonzero(label[a + 1 : b, depth] != label[a : b - 1, depth]) + a + 1
        stack += [(s, e, depth + 1) for s, e in zip([a, *cuts], [*cuts, b], strict=True)]


def _neighbours(mixed: DataFrame) -> DataFrame:
    """(a, b, region): pairs across components. From a small region all, and from a crowded one, at adaptive depth, each
    class's nearest before it in another component. A small region that lies in pieces is named instead (a, b null)."""

    def held(table: pa.Table, label: np.ndarray, start: np.ndarray, edge: np.ndarray) -> pa.Table:
        cls, comp, size, region = (table.column(c).to_numpy() for c in ("cls", "comp", "size", "region"))
        a, b, apart = [], [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(cls)], strict=True):
            if size[s] <= REGION and e - s < size[s]:
                apart.append(int(region[s]))
            elif size[s] <= REGION:
                i, j = np.nonzero(np.triu(comp[s:e, None] != comp[None, s:e]))
                a += cls[s + i].tolist()
                b += cls[s + j].tolist()
            else:
                for p, q in _parts(label[s:e]):
                    c = comp[s + p : s + q]
                    new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                    before = np.repeat(new - 1, np.diff(np.append(new, len(c))))  # the last one of another component
                    has = before >= 0
                    a += cls[s + p + before[has]].tolist()
                    b += cls[s + p : s + q][has].tolist()
        id_type, a, b = table.schema.field("cls").type, np.array(a, np.int64), np.array(b, np.int64)
        one, two = (pa.concat_arrays([pa.array(x, id_type), pa.nulls(len(apart), id_type)]) for x in (np.minimum(a, b), np.maximum(a, b)))
        return pa.table({"a": one, "b": two, "region": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(apart, pa.int64())])})

    kind = mixed.schema["cls"].dataType.simpleString()
    return _in_order(mixed, held, f"a {kind}, b {kind}, region long")


_DEALT = ["region", "kind", "i", "j"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Crowded regions dealt into pairs of blocks of about BLOCK classes: region, kind, i, j, cls, comp, left, right.

    rows: region, cls, n, comp, size. Only pairs across components matter, and one component, the region's largest, may
    hold nearly all of it. So its blocks (kind 0, left) meet the blocks of the rest, not each other; these also meet each
    other (kind 1). A class is named by block as often as it has partners there.
    """
    sizes = rows.groupBy("region", "comp").agg(F.count("*").alias("of"), F.first("size").alias("size"))
    most = F.max(F.struct("of", "comp"))
    sizes = sizes.groupBy("region").agg(most["comp"].alias("main"), most["of"].alias("of_main"), (F.sum("of") - most["of"]).alias("rest"), F.first("size").alias("size"))
    sizes = sizes.where("rest > 0").select("region", "size", "main", F.ceil(F.col("of_main") / BLOCK).cast("int").alias("n0"), F.ceil(F.col("rest") / BLOCK).cast("int").alias("n1"))
    rows = _salted(rows.drop("size"), sizes)
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("cls"), F.when(is_main, F.col("n0")).otherwise(F.col("n1")).cast("long")).cast("int")
    rows = rows.select("region", "cls", "comp", "n0", "n1", is_main.alias("is_main"), own.alias("own"))
    key = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    no, yes, mine = F.lit(False), F.lit(True), F.col("own")
    to_rest = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda x: key(0, mine, x, yes, no))
    to_main = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda x: key(0, x, mine, no, yes))
    among = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda x: key(1, F.least(mine, x), F.greatest(mine, x), mine <= x, mine >= x))
    return rows.select("region", "cls", "comp", F.explode(F.when(F.col("is_main"), to_rest).otherwise(F.concat(to_main, among))).alias("x")).select("region", "x.*", "cls", "comp")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cls, comp = (table.column(c).to_numpy() for c in ("cls", "comp"))
    left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
    return cls, comp, left, right


def _signed_pairs(dealt: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Block pairs -> pairs (a, b) whose signatures agree in enough values; or, where these are many, the block's key."""
    kind = classes.schema["cls"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, VALUES)
        cls, comp, left, right = _sides(table)
        a, b = [], []
        for x in left:
            y = right[(comp[right] != comp[x]) & (cls[right] != cls[x])]
            y = y[(sig[y] == sig[x]).mean(1) >= least]
            a += [cls[x]] * len(y)
            b += cls[y].tolist()
        key = [table.column(c)[0].as_py() for c in _DEALT]
        id_type = table.schema.field("cls").type
        if len(a) > 2 * len(cls):
            return pa.table({**{c: pa.array([v], table.schema.field(c).type) for c, v in zip(_DEALT, key, strict=True)}, "a": pa.nulls(1, id_type), "b": pa.nulls(1, id_type)})
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        none = {c: pa.nulls(len(a), table.schema.field(c).type) for c in _DEALT}
        return pa.table({**none, "a": pa.array(np.minimum(a, b), id_type), "b": pa.array(np.maximum(a, b), id_type)})

    return dealt.join(classes.select("cls", "signature"), "cls").groupBy(*_DEALT).applyInArrow(compare, f"region long, kind int, i int, j int, a {kind}, b {kind}")


def _linked_in_blocks(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Block pairs with full texts -> links (a, b) that join their components: a spanning forest, not all pairs."""
    kind = dealt.schema["cls"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        cls, comp, left, right = _sides(table)
        values, first = shingles(table.column("text"))
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count[column] > 1)
        _, column = np.unique(column[shared], return_inverse=True)
        row = row[shared]
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (c, c + 4096))
            held = np.zeros((len(n), 4096), np.float32)
            held[row[a:b], column[a:b] - c] = 1
            both += held[left] @ held[right].T
        union = n[left][:, None] + n[right][None, :] - both
        linked = (both > 0) & (100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :])
        root = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out: set[tuple[int, int]] = set()
        for x, y in zip(*np.nonzero(linked), strict=True):
            r, s = find(int(comp[left[x]])), find(int(comp[right[y]]))
            if r != s:
                root[max(r, s)] = min(r, s)
                out.add((int(min(cls[left[x]], cls[right[y]])), int(max(cls[left[x]], cls[right[y]]))))
        pairs = sorted(out)
        id_type = table.schema.field("cls").type
        return pa.table({"a": pa.array([x for x, _ in pairs], id_type), "b": pa.array([y for _, y in pairs], id_type)})

    return dealt.join(texts, "cls").groupBy(*_DEALT).applyInArrow(compare, f"a {kind}, b {kind}")


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b, parts) whose signatures agree in a share of at least `least` of their values."""
    both = _sides_of(pairs, classes, "signature").select("a", "b", "parts", "signature_a", "signature_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, VALUES) for c in ("signature_a", "signature_b"))
            keep = pa.array((a == b).mean(1) >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "parts")], names=["a", "b", "parts"])

    kind = pairs.schema["a"].dataType.simpleString()
    return in_arrow(both, compare, f"a {kind}, b {kind}, parts int")


def _links_of_regions(crowd: DataFrame, joined: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, least: float) -> DataFrame:
    """Further links (a, b) that join components: neighbours at adaptive depth first, then what crowded regions hold apart."""
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("k"))
    single = F.lit(1).alias("parts")
    mixed = written(_mixed(crowd, joined))
    near = written(_neighbours(mixed))
    pairs = written(_alike(near.where("a is not null").select("a", "b", single).distinct(), classes, least))
    linked = written(_verified(pairs, _some(texts, ids(pairs)), percent))
    # small regions in pieces, and crowded ones, are compared in full where several components are left
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked))
    open_regions = mixed.where(F.col("size") > REGION).select("region").unionByName(near.where("a is null").select("region")).distinct()
    sizes = mixed.groupBy("region").agg(F.first("size").alias("size")).join(open_regions, "region")
    rows = written(_mixed(_salted(mixed.drop("size", "comp"), sizes).drop("size"), joined))
    few = rows.where(F.col("size") <= REGION).select("region", "cls", "comp")
    other = few.select("region", F.col("cls").alias("cls2"), F.col("comp").alias("comp2"))
    few = few.join(other, "region").where("comp <> comp2 and cls < cls2").select(F.col("cls").alias("a"), F.col("cls2").alias("b"), single).distinct()
    dealt = _dealt(rows.where(F.col("size") > REGION).drop("label"))
    signed = written(_signed_pairs(dealt, classes, least))
    pairs = written(_alike(few, classes, least).select("a", "b").unionByName(signed.where("a is not null").select("a", "b")).distinct())
    dense = written(dealt.join(signed.where("a is null").select(*_DEALT), _DEALT))
    texts = _some(texts, ids(pairs).unionByName(dense.select(F.col("cls").alias("k"))))
    return linked.unionByName(_verified(pairs.withColumn("parts", F.lit(1)), texts, percent)).unionByName(_linked_in_blocks(dense, texts, percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members has doc_id, text_hash, n_shingles, k1, k2 of each row; classes k1, k2, n_shingles, component.

    A doc_id (an integer) names one text; rows that repeat it are the same document. Rows of null id and empty sets are
    in no class.
    """
    slim = docs.select("doc_id", "text")
    key = ["k1", "k2", "n_shingles"]
    least = least_share(percent)
    members = written(signatures(slim))
    classes = members.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("cls"), F.first("signature").alias("signature"))
    classes = written(classes)
    crowd = written(regions(labels(classes)))
    texts = slim.select(F.col("doc_id").alias("cls"), "text").where("cls is not null")
    linked = written(_verified(_alike(_stars(crowd), classes, least), texts, percent))
    joined = components(linked)
    more = _links_of_regions(crowd, joined, classes, texts, percent, least)
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    found = classes.select(*key, "cls").join(joined, F.col("cls") == F.col("node"), "left")
    return members, found.select(*key, F.coalesce("component", "cls").alias("component"))


def with_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (own doc_id if linked with nothing; null for null ids), kept."""
    members, classes = near_duplicates(docs, percent)
    key = ["k1", "k2", "n_shingles"]
    joined = members.select("doc_id", "text_hash", *key).join(classes, key, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def near_duplicate_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: the size of its shingle set, its component's smallest doc_id, and whether it is that one.

    Null and empty texts have empty sets and are linked with nothing; texts of fewer than five words are one shingle;
    repeated rows get equal results; an empty table gives an empty one. A long text costs its task some 100 bytes a word.
    Other columns of docs don't matter.
    """
    return with_components(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document (the smallest id) of each component. Empty texts and null ids stay; of repeated rows all stay."""
    drop = with_components(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs["doc_id"] == F.col("__drop"), "left_anti")
