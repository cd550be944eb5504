"""An interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays and memory-mapped.

1. Words are counted by hash; the sorted hashes are the vocabulary, and a word's place among them is its id.
2. Bigrams become 64-bit keys of a shard: the context's place in its shard, and the word id. Tasks merge their own, then
   send sorted runs to shards by context, where they are merged; a shard holds all successors of its contexts, so it knows their totals and how many followed
   once, twice, more often. A context that is frequent enough to fill a shard has several of its own, by the second word,
   and what these know of it is added up. Shards pass on in how many contexts each word was seen, the lower order's counts.
3. Shards are NumPy files in the shared folder. Workers map them, so a model larger than memory costs page cache only.
   The folder (spark.checkpoint.dir) must be a mounted one (file:) for that.

What is collected is one row for each shard of the vocabulary and for each frequent context, and sums over the others.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import NON_SPACE, U64, flat_text, in_arrow, map_text, shared_folder, slices, word_hashes, word_spans, written

#: Stands for the end of a text among word hashes.
END = U64(0xE5D1A3B7C9F24680)
#: Bigrams that a task merges before it sends them on, and those for which a shard is meant; a context that stands more
#: often has shards of its own.
RUN, SHARD = 1_500_000, 2_000_000
#: Tasks that merge shards at most, each one shard after the other, and shards whose files share a folder.
MERGERS, IN_FOLDER = 20_000, 4096
#: What a shard of bigrams, and of words, has to say.
_RUN = pa.struct([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
MERGED = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("classes", pa.list_(pa.int64())), ("part", pa.list_(pa.int64())), ("runs", pa.list_(_RUN))])
WORDS = pa.schema([("classes", pa.list_(pa.int64())), ("more", pa.int64())])


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words (A-Z lowered) and its end, all rows in a line, and each row's first (one more than rows)."""
    raw, at = flat_text(text)
    starts, ends, first = word_spans(raw, at, NON_SPACE)
    h = word_hashes(raw, starts, ends, lower=True)
    out = np.insert(h, first[1:], END)
    return out, first + np.arange(len(first))


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the same significance together: sorted keys then compress well on their way."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _file(folder: str, name: str, shard: int) -> str:
    return f"{folder}/{shard // IN_FOLDER:05d}/{name}-{shard % IN_FOLDER:04d}.npy"


def _save(path: str, x: np.ndarray) -> None:
    """Written aside and renamed: a task that runs twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as f:
        np.save(f, x)
    os.replace(temporary, path)


class _Mapped:
    """Files of the model as this process maps them, opened once."""

    _open: dict[str, np.ndarray] = {}

    @classmethod
    def get(cls, path: str) -> np.ndarray:
        if path not in cls._open:
            if len(cls._open) > 4000:
                cls._open.clear()
            cls._open[path] = np.load(path, mmap_mode="r")
        return cls._open[path]


def _local(uri: str) -> str:
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files: spark.checkpoint.dir must be a mounted folder (file:), not {uri}")
    return parsed.path


@dataclass
class Vocabulary:
    """Sorted hashes in shards (files), the first hash and first id of each, and their counts.

    often: ids of the words that stand more than SHARD times, in order, and how often.
    """

    folder: str
    first_hash: np.ndarray
    first_id: np.ndarray
    size: int
    total: int
    often: tuple[np.ndarray, np.ndarray]

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted distinct hashes, -1 for those not known, and their counts (0)."""
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        if not len(self.first_hash):
            return out, count
        shard = np.searchsorted(self.first_hash, h, side="right") - 1
        cut = np.searchsorted(shard, np.arange(len(self.first_hash) + 1))
        for s in np.unique(shard[shard >= 0]):
            a, b = cut[s], cut[s + 1]
            known = _Mapped.get(f"{self.folder}/hash-{s:05d}.npy")
            at = np.minimum(np.searchsorted(known, h[a:b]), len(known) - 1)
            same = known[at] == h[a:b]
            out[a:b] = np.where(same, at + self.first_id[s], -1)
            count[a:b] = np.where(same, _Mapped.get(f"{self.folder}/count-{s:05d}.npy")[at], 0)
        return out, count


def _vocabulary(docs: DataFrame, folder: str) -> Vocabulary:
    most = SHARD

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = _counted(tokens(batch.column("text"))[0])
        return pa.RecordBatch.from_arrays([pa.array((h ^ U64(1 << 63)).view(np.int64)), pa.array(n)], names=["h", "n"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = [(b.column("h").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if got:
            h = np.concatenate([x for x, _ in got]).view(U64) ^ U64(1 << 63)
            n = np.concatenate([x for _, x in got])
            _save(f"{folder}/hash-p{part}.npy", h)
            _save(f"{folder}/count-p{part}.npy", n)
            often = np.flatnonzero(n > most)
            told = [pa.array([x]) for x in (part, int(h[0]) >> 1, len(h), int(n.sum()))] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (often, n[often])]
            yield pa.RecordBatch.from_arrays(told, names=["part", "first", "size", "total", "often", "times"])

    os.makedirs(folder, exist_ok=True)
    # shifted by 2**63, signed order is the order of the hashes
    counts = map_text(docs.select("text"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    ordered = counts.repartitionByRange("h").sortWithinPartitions("h")
    shards = sorted(ordered.mapInArrow(save, "part long, first long, size long, total long, often array<long>, times array<long>").collect(), key=lambda r: r["part"])
    first = []
    for s, r in enumerate(shards):
        for kind in ("hash", "count"):
            os.replace(f"{folder}/{kind}-p{r['part']}.npy", f"{folder}/{kind}-{s:05d}.npy")
        first.append(_Mapped.get(f"{folder}/hash-{s:05d}.npy")[0])
    sizes = [r["size"] for r in shards]
    first_id = np.concatenate(([0], np.cumsum(sizes)))[: len(sizes)].astype(np.int64)
    often = [(at + int(i), n) for i, r in zip(first_id, shards, strict=True) for at, n in zip(r["often"], r["times"], strict=True)]
    often = tuple(np.array(x, np.int64) for x in zip(*often, strict=True)) if often else (np.empty(0, np.int64),) * 2
    return Vocabulary(folder, np.array(first, U64), first_id, sum(sizes), sum(r["total"] for r in shards), often)


def _bigrams(text: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' ids (-1: not known) and counts; each token's word and context among these (their number: the start),
    and each row's first token."""
    h, first = tokens(text)
    distinct, word = np.unique(h, return_inverse=True)
    ids, counts = vocabulary.ids(distinct)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = len(distinct)
    return ids, counts, word, context, first


@dataclass
class Dealt:
    """The shard of a bigram: of its context, with `width` contexts each; by its word where the context is one of `often`
    (sorted), which has `parts` shards from `first` on. A key has the context's place in the shard above the word's bits,
    so that any number of words fits."""

    size: int
    shards: int
    width: int
    often: np.ndarray
    parts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Dealt:
        ids, times = vocabulary.often
        # the end is no context, and stands as often as the start, which is one
        end = vocabulary.ids(np.array([END]))[0][0]
        start = ids == end
        ids, times = np.append(ids[~start], ids[start] * 0 + vocabulary.size), np.append(times[~start], times[start])
        parts, size = -(-times // SHARD), vocabulary.size
        width = max(1, min(-(-(size + 1) // max(1, -(-vocabulary.total // SHARD))), 1 << (63 - size.bit_length())))
        shards = size // width + 1
        return cls(size, shards, width, ids, parts, shards + np.cumsum(parts) - parts)

    @property
    def total(self) -> int:
        return self.shards + int(self.parts.sum())

    @property
    def bits(self) -> int:
        return self.size.bit_length()

    def frequent(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the frequent contexts stand, and which of `often` they are."""
        at = np.searchsorted(self.often, context)
        where = np.flatnonzero(np.append(self.often, -1)[at] == context)
        return where, at[where]

    def of_bigrams(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards and keys. A word that is not known counts as the first one."""
        word = np.maximum(word, 0)
        shard, place = context // self.width, context % self.width
        where, k = self.frequent(context)
        shard[where] = self.first[k] + word[where] // (-(-self.size // self.parts[k]))
        place[where] = 0
        return shard, (place.astype(U64) << U64(self.bits)) | word.astype(U64)


def _emit(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(shard[a]), _planes(keys[a:b]), _planes(counts[a:b].astype(np.int64))


def _runs(docs: DataFrame, vocabulary: Vocabulary, dealt: Dealt) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            to, keys, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.lexsort((keys, to))
            to, keys, counts = to[order], keys[order], counts[order]
            new = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (keys[1:] != keys[:-1]))))
            rows = list(_emit(keys[new], np.add.reduceat(counts, new), to[new]))
            shard, k, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], names=["shard", "keys", "counts"])

        for batch in batches:
            for part in slices(batch):
                ids, _, word, context, _ = _bigrams(part.column("text"), vocabulary)
                pair, n = np.unique(context * len(ids) + word, return_counts=True)
                waiting.append((*dealt.of_bigrams(np.append(ids, vocabulary.size)[pair // len(ids)], ids[pair % len(ids)]), n))
                if sum(len(k) for _, k, _ in waiting) > RUN:
                    yield flush()
                    waiting.clear()
        if waiting:
            yield flush()

    return in_arrow(docs.select("text"), run, "shard long, keys binary, counts binary")


def _by_shard(df: DataFrame, shards: int, kind: type, finish: Callable[[int, np.ndarray, np.ndarray], dict], schema: pa.Schema) -> DataFrame:
    """Merge the runs of each shard, one shard in memory at a time, and turn it into one row by finish(shard, keys, counts)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = -1, []

        def done() -> pa.RecordBatch:
            keys, counts = _counted(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            return pa.RecordBatch.from_pylist([finish(at, keys, counts)], schema)

        for batch in batches:
            for shard, k, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "counts")), strict=True):
                if shard != at and waiting:
                    yield done()
                    waiting.clear()
                at = shard
                waiting.append((_from_planes(k, kind), _from_planes(n, np.int64)))
                if len(waiting) > 1 and sum(len(k) for k, _ in waiting[1:]) > max(SHARD, len(waiting[0][0])):
                    waiting[:] = [_counted(*(np.concatenate(x) for x in zip(*waiting, strict=True)))]
        if waiting:
            yield done()

    return df.repartition(min(shards, MERGERS), "shard").sortWithinPartitions("shard").mapInArrow(merge, from_arrow_schema(schema))


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many items have counts 1 to 4.

    Where there are too few to tell, fixed ones: something must be left for what was not seen.
    """
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    ratio = lambda a, b: a / b if b else 0.0
    d = (1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3))
    return tuple(min(max(x, 0.0), float(c)) for x, c in zip(d, (1, 2, 3), strict=True))


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


@dataclass
class Model:
    """Scores texts. All arrays it needs are mapped from `folder`; it pickles small."""

    vocabulary: Vocabulary
    folder: str
    dealt: Dealt
    totals: np.ndarray  # of the frequent contexts, what stats has of others
    range_width: int
    discount: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_left: float  # the lower order's weight for the uniform distribution
    bigrams: int

    def _word(self, ids: np.ndarray) -> np.ndarray:
        """The lower order's probability of sorted distinct ids (-1: not known)."""
        size = self.vocabulary.size
        p = np.full(len(ids), self.lower_left / (size + 1))
        if self.bigrams:
            part = ids // self.range_width
            for r in np.unique(part[ids >= 0]):
                mine = np.flatnonzero((part == r) & (ids >= 0))
                known = _Mapped.get(_file(self.folder, "word", r))
                at = np.minimum(np.searchsorted(known, ids[mine]), len(known) - 1)
                n = np.where(known[at] == ids[mine], _Mapped.get(_file(self.folder, "seen", r))[at].astype(np.int64), 0)
                p[mine] += (n - np.array((0.0, *self.lower))[np.minimum(n, 3)]) / self.bigrams
        return p

    def log10(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of tokens with these word ids (-1: not known) after these contexts (the vocabulary's size: the start)."""
        words, word = np.unique(ids, return_inverse=True)
        contexts, place = np.unique(context, return_inverse=True)
        return self._log10(words, word, contexts, place)

    def _log10(self, words: np.ndarray, word: np.ndarray, contexts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """As log10, of words[word] after contexts[place]."""
        sorted_words, back = np.unique(words, return_inverse=True)
        low = self._word(sorted_words)[back][word]
        # tokens whose context is known, by distinct bigram
        at = np.flatnonzero(contexts[place] >= 0)
        key, back = np.unique(place[at] * len(words) + word[at], return_inverse=True)
        u, w = contexts[key // max(1, len(words))], words[key % max(1, len(words))]
        shard, asked = self.dealt.of_bigrams(u, w)
        order = np.argsort(shard, kind="stable")
        used, cut = np.unique(shard[order], return_index=True)
        n, stats = np.zeros(len(key), np.int64), np.zeros((len(key), 4), np.int64)
        for s, mine in zip(used, np.split(order, cut[1:]), strict=False):
            if not os.path.exists(_file(self.folder, "key", s)):
                continue
            load = lambda name, s=s: _Mapped.get(_file(self.folder, name, s))
            if s < self.dealt.shards:
                contexts = load("context")
                i = np.minimum(np.searchsorted(contexts, u[mine]), len(contexts) - 1)
                stats[mine] = np.where((contexts[i] == u[mine])[:, None], load("stats")[i], 0)
            keys = load("key")
            j = np.minimum(np.searchsorted(keys, asked[mine]), len(keys) - 1)
            n[mine] = np.where((keys[j] == asked[mine]) & (w[mine] >= 0), load("count")[j].astype(np.int64), 0)
        where, k = self.dealt.frequent(u)
        stats[where] = self.totals[k]
        d, total = np.array((0.0, *self.discount)), np.maximum(stats[:, 0], 1).astype(float)
        direct = (n - d[np.minimum(n, 3)]) / total
        left = np.where(stats[:, 0] > 0, (stats[:, 1:] * d[1:]).sum(1) / total, 1.0)
        p = low.copy()
        p[at] = direct[back] + left[back] * low[at]
        return np.log10(p)


def train(docs: DataFrame) -> Model:
    """Learn from all texts of docs (null: empty)."""
    folder = _local(shared_folder(docs.sparkSession))
    vocabulary = _vocabulary(docs, f"{folder}/vocabulary")
    size = vocabulary.size
    dealt = Dealt.of(vocabulary)
    range_width = SHARD
    ranges = max(1, -(-size // range_width))

    def finish(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        context = (keys >> U64(dealt.bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        stats = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
        small = counts.astype(next(t for t in (np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(t).max))
        known = () if shard >= dealt.shards else (("context", context[first] + shard * dealt.width), ("stats", stats))
        for name, x in (("key", keys), ("count", small), *known):
            _save(_file(f"{folder}/model", name, shard), x)
        words, seen = _counted((keys & U64((1 << dealt.bits) - 1)).astype(np.int64))
        rows = list(_emit(words, seen, words // range_width))
        part = [] if known else stats[0].tolist()
        return {"shard": shard, "n": len(keys), "classes": _classes(counts).tolist(), "part": part, "runs": [{"shard": s, "keys": k, "counts": c} for s, k, c in rows]}

    runs = _runs(docs, vocabulary, dealt)
    merged = written(_by_shard(runs, dealt.total, U64, finish, MERGED))
    totals = np.zeros((len(dealt.often), 4), np.int64)
    for r in merged.where("size(part) > 0").select("shard", "part").collect():
        totals[np.searchsorted(dealt.first, r["shard"], side="right") - 1] += r["part"]

    def finish_words(part: int, words: np.ndarray, seen: np.ndarray) -> dict:
        _save(_file(f"{folder}/model", "word", part), words)
        _save(_file(f"{folder}/model", "seen", part), seen)
        return {"classes": _classes(seen).tolist(), "more": int((seen > 2).sum())}

    parts = merged.select(F.explode("runs").alias("r")).select("r.*")
    lower = written(_by_shard(parts, ranges, np.int64, finish_words, WORDS))
    sums = lambda df, *more: df.agg(*[F.coalesce(F.sum(F.get("classes", F.lit(i))), F.lit(0)) for i in range(4)], *[F.coalesce(F.sum(c), F.lit(0)) for c in more]).first()
    *classes, bigrams = sums(merged, "n")
    *low_classes, more = sums(lower, "more")
    low = _discounts(low_classes)
    rest = (low[0] * low_classes[0] + low[1] * low_classes[1] + low[2] * more) / bigrams if bigrams else 1.0
    return Model(vocabulary, f"{folder}/model", dealt, totals, range_width, _discounts(classes), low, float(rest), bigrams)


def scored(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigrams), score (the model), both log10 probabilities of the text."""
    vocabulary = model.vocabulary

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, word, context, first = _bigrams(batch.column("text"), vocabulary)
        base = np.log10((counts + 1) / (vocabulary.total + vocabulary.size + 1))[word]
        score = model._log10(ids, word, np.append(ids, vocabulary.size), context)
        of_row = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.empty(0)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(of_row((counts > 0).astype(np.int64)[word]).astype(np.int64)), pa.array(of_row(base)), pa.array(of_row(score))],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    return map_text(df.select("doc_id", "text"), score, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def lm_report(docs: DataFrame) -> DataFrame:
    """One row per document: held_out, token counts, the base score, and the score of a model learnt from the others.

    Null and empty texts are one token, the end. A null doc_id is not held out; repeated rows teach as often as they
    stand. Without training texts all probabilities are uniform over one unknown word. Very long texts are scored whole, in
    proportion to their length; an empty table gives no rows, and other columns play no part.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = train(docs.where(~held).select("text"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
