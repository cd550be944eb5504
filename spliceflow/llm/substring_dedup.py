"""Repeated passages across documents, by a compacted de Bruijn graph of word k-mers with source coordinates.

Edges are the windows of K words. Only edges that repeat matter, and most do not, so a sparse set of shorter k-mers is
looked at first: each window names its smallest SEED-mer (by hash), equal windows name equal ones, and windows whose
seed stands once in the corpus are unique.

1. Seeds are counted; the places of repeated ones go back to their documents.
2. Documents send the windows of those seeds to the seed, packed as the runs in which they stand. There each window
   meets its equals and learns its first source (document, start). Seeds with very many places are dealt out by hash and
   their windows are counted with map-side combining, then joined.
3. Runs meet at the nodes between them (K - 1 words at a coordinate). Where a node is left as often as it is reached, by
   runs whose sources advance in step, the path doesn't branch: the node goes, and each path becomes one span (start,
   words, source, source start). Both sides of that join share one exchange, as a grouping by node.
4. Both ends of each span are read again at their coordinates. Where the words differ, as two passages share a hash, the
   windows of the span are compared by their words with all windows of that hash, and find their true first sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, U64, flat_text, in_arrow, joined_with_hot_keys, map_text, window_hashes, word_hashes, word_spans, written

K, SEED = 20, 5
#: Places of a seed from which its windows take the way for hot keys.
HOT = 20_000
#: Copies of a hot window's first source, each for a part of its places.
COPIES = 16

_SPAN = "start long, n long, src long, src_start long"


def _windows(text: pa.Array, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of K words within rows: row, start in the row, hash, word index of the seed, row's first words, seed hashes."""
    raw, at = flat_text(text)
    starts, ends, first = word_spans(raw, at, NON_SPACE)
    h = word_hashes(raw, starts, ends, lower=False)
    w = window_hashes(h, K) >> U64(64 - bits)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.flatnonzero(np.arange(len(w)) + K <= first[1:][row[: len(w)]]) if len(w) else np.empty(0, np.int64)
    s = window_hashes(h, SEED)
    seed_at = sliding_window_view(s, K - SEED + 1).argmin(1)[p] + p if len(p) else p
    return row[p], p - first[row[p]], w[p], seed_at, first, s


def keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """uid, doc_id, text. Rows equal in doc_id and text share a uid: they are one document.

    Where different rows meet in a uid, a second hash tells them apart, so no two documents are taken for one.
    """
    rows = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - bits).alias("uid"), F.xxhash64("text", "doc_id").alias("__other"), "doc_id", "text")
    twins = rows.groupBy("uid").agg((F.min("__other") != F.max("__other")).alias("__twins")).where("__twins")
    if twins.isEmpty():
        return rows.drop("__other")
    rows = rows.join(written(twins), "uid", "left")
    return rows.withColumn("uid", F.when(F.col("__twins"), F.xxhash64("uid", "__other")).otherwise(F.col("uid"))).drop("__other", "__twins")


def _seeds(docs: DataFrame) -> DataFrame:
    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, _, _, seed_at, first, s = _windows(batch.column("text"))
        new = np.ones(len(seed_at), bool)
        new[1:] = seed_at[1:] != seed_at[:-1]
        at, row = seed_at[new], row[new]
        return pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), batch.column("uid").take(pa.array(row)), pa.array((at - first[row]).astype(np.int32))], names=["seed", "uid", "pos"])

    return map_text(docs.select("uid", "text"), find, "seed long, uid long, pos int")


def _edges(docs: DataFrame, bits: int) -> DataFrame:
    """docs with marks (2 * seed position + hot) -> one row for each marked seed place: its windows from p1 on."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, w, seed_at, first, s = _windows(batch.column("text"), bits)
        marks = batch.column("marks")
        values = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(first[:-1], np.diff(marks.offsets.to_numpy()))
        kind = np.zeros(first[-1] + 1, np.int8)
        kind[of + values // 2] = 1 + values % 2
        keep = np.flatnonzero(kind[seed_at] > 0)
        row, start, w, seed_at = row[keep], start[keep], w[keep], seed_at[keep]
        new = np.ones(len(keep), bool)
        new[1:] = seed_at[1:] != seed_at[:-1]
        at = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keep)).astype(np.int32)), pa.array(w.view(np.int64)))
        take = pa.array(row[at])
        return pa.RecordBatch.from_arrays(
            [pa.array(s[seed_at[at]].view(np.int64)), pa.array(kind[seed_at[at]] == 2), batch.column("doc_id").take(take), batch.column("uid").take(take), pa.array(start[at].astype(np.int32)), lists],
            names=["seed", "hot", "doc_id", "uid", "p1", "hashes"],
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("uid", "doc_id", "text", "marks"), find, f"seed long, hot boolean, doc_id {id_type}, uid long, p1 int, hashes array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _edges, sorted by seed, doc_id, uid, p1 -> runs of windows that have an earlier equal."""
    kept_seed, kept = None, (np.empty(0, np.int64),) * 3  # of the last seed: hashes (sorted), uids, starts
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        h = lists.flatten().to_numpy(zero_copy_only=False)
        n = np.diff(offsets)
        row = np.repeat(np.arange(batch.num_rows), n)
        seed = batch.column("seed").to_numpy(zero_copy_only=False)
        uid = batch.column("uid").to_numpy(zero_copy_only=False)[row]
        start = batch.column("p1").to_numpy(zero_copy_only=False).astype(np.int64)[row] + np.arange(len(h)) - (offsets[:-1] - offsets[0])[row]
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        src, src_start = uid[first], start[first]
        if len(kept[0]):
            at = np.minimum(np.searchsorted(kept[0], distinct), len(kept[0]) - 1)
            known = kept[0][at] == distinct
            src, src_start = np.where(known, kept[1][at], src), np.where(known, kept[2][at], src_start)
        last = seed[row[first]] == seed[-1]
        fresh = (distinct[last], src[last], src_start[last])
        if kept_seed == seed[-1]:
            both = [np.concatenate(x) for x in zip(kept, fresh, strict=True)]
            _, one = np.unique(both[0], return_index=True)
            kept = tuple(x[one] for x in both)
        else:
            kept = fresh
        kept_seed = seed[-1]
        src, src_start = src[inverse], src_start[inverse]
        hit = np.flatnonzero((src != uid) | (src_start != start))
        row, uid, start, src, src_start = row[hit], uid[hit], start[hit], src[hit], src_start[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (src[1:] != src[:-1]) | (src_start[1:] != src_start[:-1] + 1)
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(hit)))
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (uid, start)] + [pa.array(length)] + [pa.array(x[at]) for x in (src, src_start)], names=["uid", "start", "n", "src", "src_start"])


def _compacted(runs: DataFrame) -> DataFrame:
    """Runs of edges -> uid, spans: the words of nonbranching paths.

    A run reaches from one node (K - 1 words at a coordinate) to another. Runs of one document that take the same step
    ahead to the same source meet at their nodes: a node that is left as often as it is reached lies inside a path, which
    doesn't branch there, and is compacted away. What stays are the first and the last nodes of paths, in turn. Repeated
    rows of a document leave and reach nodes equally often, so they change nothing.
    """
    ends = F.array(F.struct(F.col("start").alias("place"), F.lit(1).alias("way")), F.struct((F.col("start") + F.col("n")).alias("place"), F.lit(-1).alias("way")))
    # one exchange by document serves both groupings
    halves = runs.repartition("uid").select("uid", "src", (F.col("src_start") - F.col("start")).alias("ahead"), F.inline(ends))
    nodes = halves.groupBy("uid", "src", "ahead", "place").agg(F.sum("way").alias("degree")).where("degree <> 0")
    per_doc = nodes.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("src", "ahead", "place"))).alias("ends"))
    path = "'start', ends[2 * i].place, 'n', ends[2 * i + 1].place - ends[2 * i].place + words, 'src', ends[2 * i].src, 'src_start', ends[2 * i].place + ends[2 * i].ahead"
    spans = F.expr(f"transform(sequence(0, cast(size(ends) / 2 as int) - 1), i -> named_struct({path}))")
    return per_doc.withColumn("words", F.lit(K - 1).cast("long")).select("uid", spans.alias("spans"))


def spans(docs: DataFrame, bits: int = 64) -> DataFrame:
    """uid, spans: the words of each document that windows with an earlier equal cover. docs: as keyed() gives them."""
    seeds = _seeds(docs)
    counts = written(seeds.groupBy("seed").agg(F.count("*").alias("places")).where("places > 1"))
    has_hot = not counts.where(F.col("places") > HOT).isEmpty()
    placed = joined_with_hot_keys(seeds, counts, "seed", F.col("uid"), HOT) if has_hot else seeds.join(counts, "seed")
    marks = placed.groupBy("uid").agg(F.collect_list((F.col("pos") * 2 + (F.col("places") > HOT).cast("int"))).alias("marks"))
    edges = _edges(docs.join(marks, "uid").select("uid", "doc_id", "text", "marks"), bits)
    salt = F.when(F.col("hot"), F.pmod(F.col("uid"), F.lit(1024))).otherwise(0)
    dealt = edges.repartition("seed", salt)
    runs = in_arrow(dealt.where("not hot").sortWithinPartitions("seed", "doc_id", "uid", "p1"), _runs, f"uid long, {_SPAN}")
    if has_hot:
        hot = dealt.where("hot").select("doc_id", "uid", "p1", F.posexplode("hashes").alias("i", "h")).select("doc_id", "uid", (F.col("p1") + F.col("i")).cast("long").alias("p"), "h")
        firsts = hot.groupBy("h").agg(F.min(F.struct("doc_id", "uid", "p")).alias("f"), F.count("*").alias("places")).where("places > 1")
        # a window's rows are many where its first source is one row: that one is copied
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        later = hot.withColumn("salt", F.pmod(F.col("uid"), F.lit(COPIES)).cast("int")).join(firsts, ["h", "salt"]).where("uid <> f.uid or p <> f.p").select("uid", F.col("p").alias("start"), F.lit(1).cast("long").alias("n"), F.col("f.uid").alias("src"), F.col("f.p").alias("src_start"))
        runs = runs.unionByName(later)
    return _compacted(runs)


def _cut(words: list[bytes], found: list[dict]) -> list[bytes]:
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for x in found:
        gone[x["start"]] += 1
        gone[x["start"] + x["n"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _applied(rows: DataFrame, with_text: bool) -> DataFrame:
    """uid, doc_id, text, spans, asked -> the result per document, with digests of its spans and of those asked for."""

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digest, texts, own, asked = [], [], [], [], [], []
        for text, found, ask in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "asked")), strict=True):
            words = (text or "").encode("utf-8").split()
            kept = _cut(words, found or [])
            raw = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(raw).hexdigest())
            if with_text:
                texts.append(raw.decode())
            seen = lambda s, n: xxhash.xxh3_128_hexdigest(b" ".join(words[s : s + n]))  # noqa: B023, E731
            own.append([{"src": x["src"], "start": x["src_start"], "n": x["n"], "digest": seen(x["start"], x["n"])} for x in found or []])
            asked.append([{"start": x["start"], "n": x["n"], "digest": seen(x["start"], x["n"])} for x in ask or []])
        long = pa.int64()
        said = [("start", long), ("n", long), ("digest", pa.string())]
        arrays = [batch.column("uid"), batch.column("doc_id"), pa.array(n_words, long), pa.array(n_removed, long), pa.array(digest, pa.string())]
        arrays += [pa.array(own, pa.list_(pa.struct([("src", long), *said]))), pa.array(asked, pa.list_(pa.struct(said)))] + [pa.array(texts, pa.string())] * with_text
        return pa.RecordBatch.from_arrays(arrays, names=["uid", "doc_id", "n_words", "n_removed", "kept_sha256", "own", "seen", *["kept_text"] * with_text])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    said = "start:long,n:long,digest:string"
    schema = f"uid long, doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, own array<struct<src:long,{said}>>, seen array<struct<{said}>>" + ", kept_text string" * with_text
    return map_text(rows.select("uid", "doc_id", "text", "spans", "asked"), apply, schema)


def _by_words(docs: DataFrame, wrong: DataFrame, bits: int) -> DataFrame:
    """uid, found: windows of K words that also start earlier, for all windows that share a hash with one inside of the spans
    `wrong` (uid, spans). Here windows are equal if their words are (by SHA-256)."""

    def inside(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, w, seed_at, first, s = _windows(batch.column("text"), bits)
        lists = batch.column("spans")
        flat, of = lists.flatten(), np.repeat(first[:-1], np.diff(lists.offsets.to_numpy()))
        a, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
        marks = np.zeros(first[-1] + 1, np.int64)
        np.add.at(marks, of + a, 1)
        np.add.at(marks, of + a + n - K + 1, -1)
        keep = np.flatnonzero(np.cumsum(marks)[first[row] + start] > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (s[seed_at], w)], names=["seed", "h"])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for doc, uid, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "text", "places")), strict=True):
            words = (text or "").encode("utf-8").split()
            for p in places:
                for column, value in zip(out, (doc, uid, p, hashlib.sha256(b" ".join(words[p : p + K])).digest()), strict=True):
                    column.append(value)
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "uid", "p", "said"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    asked = written(map_text(docs.join(wrong, "uid").select("text", F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))).alias("spans")), inside, "seed long, h long").distinct())
    marks = _seeds(docs).join(asked.select("seed").distinct(), "seed", "left_semi").groupBy("uid").agg(F.collect_list(F.col("pos") * 2).alias("marks"))
    edges = _edges(docs.join(marks, "uid").select("uid", "doc_id", "text", "marks"), bits)
    windows = edges.select("uid", "seed", (F.posexplode("hashes").alias("i", "h")), "p1").select("uid", "seed", "h", (F.col("p1") + F.col("i")).cast("long").alias("p"))
    places = windows.join(asked, ["seed", "h"], "left_semi").groupBy("uid").agg(F.collect_set("p").alias("places"))
    said = written(map_text(docs.join(places, "uid").select("doc_id", "uid", "text", "places"), read, f"doc_id {id_type}, uid long, p long, said binary"))
    firsts = said.groupBy("said").agg(F.min(F.struct("doc_id", "uid", "p")).alias("f"))
    later = said.join(firsts, "said").where("uid <> f.uid or p <> f.p")
    span = F.struct(F.col("p").alias("start"), F.lit(K).cast("long").alias("n"), F.col("f.uid").alias("src"), F.col("f.p").alias("src_start"))
    return later.groupBy("uid").agg(F.collect_set(span).alias("found"))


def without_repeats(docs: DataFrame, with_text: bool = False, bits: int = 64) -> DataFrame:
    """One row per document: words, words removed and a digest of those kept (with_text: also the text of these).

    A word goes if a window of K words that covers it also starts earlier: in a smaller doc_id (null is smallest), or
    earlier in its own document. Windows are judged on the input. Null and empty texts have no words; documents of fewer
    than K words lose none. Rows equal in doc_id and text are one document and get one result each; rows that differ in
    text under one doc_id are ordered by a hash. Very long texts are compared whole; an empty table gives no rows, and
    other columns play no part. bits: how many bits the hashes of documents and windows have; the result is the same.
    """
    texts = keyed(docs, bits)
    found = spans(texts, bits)
    asked = found.select(F.explode("spans").alias("x")).select(F.col("x.src").alias("uid"), F.col("x.src_start").alias("start"), F.col("x.n").alias("n")).distinct()
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    result = written(_applied(texts.join(found, "uid", "left").join(asked, "uid", "left"), with_text))
    own = result.select("uid", F.explode("own").alias("x")).select("uid", "x.*").distinct()
    seen = result.select(F.col("uid").alias("src"), F.explode("seen").alias("x")).select("src", "x.*").distinct()
    wrong = written(own.join(seen, ["src", "start", "n", "digest"], "left_anti").select("uid", "src", "start", "n"))
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    if wrong.isEmpty():
        return result.select(*cols)
    # two different passages had one hash: the windows of these spans are looked at by their words
    bad = wrong.groupBy("uid").agg(F.collect_set(F.struct("src", "start", "n")).alias("bad"))
    held = found.join(bad, "uid")
    is_bad = lambda x: F.array_contains("bad", F.struct(x["src"].alias("src"), x["src_start"].alias("start"), x["n"].alias("n")))
    exact = _by_words(texts, held.select("uid", F.filter("spans", is_bad).alias("spans")), bits)
    good = held.select("uid", F.filter("spans", lambda x: ~is_bad(x)).alias("good")).join(exact, "uid", "left")
    mended = texts.join(good.select("uid", F.concat("good", F.coalesce("found", F.array().cast(found.schema["spans"].dataType))).alias("spans")), "uid")
    again = _applied(mended.withColumn("asked", F.lit(None).cast("array<struct<start:long,n:long>>")), with_text)
    return result.join(bad, "uid", "left_anti").unionByName(again).select(*cols)
