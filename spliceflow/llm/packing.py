"""Packing token sequences: vector bin packing by the dot-product heuristic, within Spark's partitions.

Every bin (sequence) has three limits: tokens, segments and loss-bearing tokens. The open bin takes, again and again,
the waiting piece whose vector has the largest dot product with what the bin has left. Where nothing fits, a piece is
cut so as to fill the bin. A bin that stays short of tokens, as the partition's last one or by another limit, is split
into powers of two, which need no padding. Partitions pack alone, so there is no shuffle, and a lost task is run again with the same result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, in_arrow, slices

CAPACITY = 4096
END_ID = 2
MAX_SEGMENTS = 256
#: Pieces that wait before a bin is closed, for the heuristic's choice; more of them wait where they don't fill a bin yet.
WAITING = 128
#: Distinct pieces of text whose ids a worker remembers: this many at least, twice as many and a batch's at most.
REMEMBERED = 200_000

#: For texts of plain characters only: what the tokenizer's own way of cutting text takes for pieces, besides runs of letters.
_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-įı-ſ]*\Z")


class Memory(dict):
    """Remembers what was learned of keys. When there are more than `most`, the older go, but for what is asked for meanwhile."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def values_of(self, keys: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of each key, given once each; learn gives the values of those that are not remembered."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        out = list(map(self.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            out[i] = self.old.get(keys[i])
        new = [i for i in missing if out[i] is None]
        for i, x in zip(new, learn([keys[i] for i in new]), strict=True):
            out[i] = x
        self.update((keys[i], out[i]) for i in missing)
        return out


class WordTokenizer:
    """Ids of texts. Pieces of texts are looked up among those seen before; new ones go to the tokenizer's model together.

    The tokenizer lowers case, cuts text by a pattern that never crosses white space, and encodes each piece alone, so
    pieces may be kept, and new ones need only its map of bytes and its merges: their characters are normal and in lower
    case. A piece ends with its only token of the kind that ends words. Arrow cuts texts, finds the distinct pieces, each of
    which is looked up once, and puts the ids together. Texts with characters beyond Latin letters and common signs, or
    that may hold a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self.pieces = Memory(REMEMBERED)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            raw = ids.tobytes()
            if len(cut) == len(part) + 1:
                out += [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
            else:
                out += [self._ids(w).tobytes() for w in part]  # ends are marked otherwise: each alone
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """As the tokenizer gives them, without special tokens around."""
        plain = [_PLAIN.match(t) is not None and "<|" not in t for t in texts]
        lower = pa.array([t.lower() for t, p in zip(texts, plain, strict=True) if p], pa.string())
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _SIGNS, r" \0 "))
        found = cut.values.dictionary_encode()
        pieces, which = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices
        self.pieces[""] = b""  # at both ends of texts
        known = self.pieces.values_of(pieces, self._learn)
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.frombuffer(b"".join(known), "<u4")))
        ids = each.take(which).flatten().to_numpy()
        ends = np.append(0, np.cumsum(n[which.to_numpy()]))[cut.offsets.to_numpy()].tolist()
        spans = zip(ends, ends[1:], strict=False)
        return [ids[slice(*next(spans))] if p else self._ids(t) for t, p in zip(texts, plain, strict=True)]


@functools.cache
def _tokenizer(path: str | None) -> WordTokenizer:
    return WordTokenizer(path)


Piece = tuple[int, int, int, int]  # document, start, length, loss-bearing tokens


class Packer:
    """Packs (document, tokens, loss) items into bins; yields (bin, offset, document, start, length) when a bin is full."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int):
        self.limits = np.array([capacity, max_segments, max_loss], float)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.waiting: list[Piece] = []
        self.tokens = 0  # of those that wait
        self.bins = 0

    def add(self, doc: int, n: int, loss: int) -> Iterator[tuple[int, int, int, int, int]]:
        """loss: how many of the item's tokens bear loss, counted from its end (an answer follows its prompt)."""
        start = 0
        while n - start >= self.capacity and (bears := self._loss(start, self.capacity, n, loss)) <= self.max_loss:
            yield from self._close([(doc, start, self.capacity, bears)])
            start += self.capacity
        if start < n:
            self._wait(doc, start, n - start, n, loss)
            # a bin is closed by a limit, never for the number that waits
            while len(self.waiting) >= WAITING and (self.tokens >= self.capacity or len(self.waiting) >= self.max_segments):
                yield from self._close_filled()

    @staticmethod
    def _loss(start: int, length: int, n: int, loss: int) -> int:
        return max(0, min(start + length, n) - max(start, n - loss))

    def _wait(self, doc: int, start: int, length: int, n: int, loss: int) -> None:
        while length:
            # what no empty bin could hold is cut at the limits
            bears = self._loss(start, length, n, loss)
            take = min(length, self.capacity)
            if self._loss(start, take, n, loss) > self.max_loss:
                take = max(0, n - loss - start) + self.max_loss
            bears = self._loss(start, take, n, loss)
            self.waiting.append((doc, start, take, bears))
            self.tokens += take
            start, length = start + take, length - take

    def _fill(self) -> list[Piece]:
        items = np.array([(p[2], 1, p[3]) for p in self.waiting], float)
        left, free, chosen = self.limits.copy(), np.ones(len(items), bool), []
        while free.any() and left[0] > 0 and left[1] > 0:
            fits = free & (items <= left).all(1)
            if left[1] == 1:  # the last place goes to what fills the bin
                fits &= items[:, 0] >= left[0]
            if not fits.any():
                break
            score = (items / self.limits) @ (left / self.limits)
            k = int(np.argmax(np.where(fits, score, -1)))
            free[k] = False
            chosen.append(self.waiting[k])
            left -= items[k]
        self.waiting = [p for p, f in zip(self.waiting, free, strict=True) if f]
        if left[0] > 0 and left[1] > 0 and self.waiting:
            k = max(range(len(self.waiting)), key=lambda i: self.waiting[i][2])
            doc, start, length, bears = self.waiting[k]
            lead = length - bears  # tokens without loss come first
            take = int(min(left[0], length, lead + left[2]))
            if take:
                chosen.append((doc, start, take, max(0, take - lead)))
                if take < length:
                    self.waiting[k] = (doc, start + take, length - take, bears - max(0, take - lead))
                else:
                    self.waiting.pop(k)
        self.tokens -= sum(p[2] for p in chosen)
        return chosen

    def _close_filled(self) -> Iterator[tuple[int, int, int, int, int]]:
        pieces = self._fill()
        yield from self._close(pieces, split=sum(p[2] for p in pieces) < self.capacity)

    def _close(self, pieces: list[Piece], split: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
        total = sum(p[2] for p in pieces)
        room = 1 << (total.bit_length() - 1) if split else total
        offset = 0
        for doc, start, length, _ in pieces:
            while length:
                if not room:
                    self.bins, offset = self.bins + 1, 0
                    room = 1 << (total.bit_length() - 1)
                take = min(length, room)
                yield self.bins, offset, doc, start, take
                start, length, offset, room, total = start + take, length - take, offset + take, room - take, total - take
        self.bins += 1

    def finish(self) -> Iterator[tuple[int, int, int, int, int]]:
        while self.waiting:
            yield from self._close_filled()


def packed(df: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, tokenizer: str | None = None, with_ids: bool = False, loss_share: str | None = None) -> DataFrame:
    """Tokenise text, end each document with END_ID and pack all ids; one row per piece.

    df: doc_id, text and, if only part of a document's tokens bears loss, a column that `loss_share` names (0 to 1, from
    the end; null: all).
    Null text is empty: one token. A very long text is tokenised whole, and cut where sequences end. Repeated rows are
    packed each, an empty table gives no rows, and other columns play no part. A sequence's id has its partition in the upper bits.
    with_ids adds the piece's ids.
    """
    max_loss = capacity if max_loss is None else max_loss
    has_share = loss_share is not None
    field = df.schema["doc_id"]
    schema = f"doc_id {field.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TaskContext.get().partitionId() << 40
        packer, encoder = Packer(capacity, max_segments, max_loss), _tokenizer(tokenizer)
        docs: dict[int, tuple[object, np.ndarray]] = {}  # those with pieces that wait
        left: dict[int, int] = {}
        n_docs = 0

        def rows(pieces: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for seq, offset, doc, start, length in pieces:
                key, ids = docs[doc]
                part = ids[start : start + length]
                row = [key, start, length, zlib.crc32(part.tobytes()), len(ids), top + seq, offset] + [part.tolist()] * with_ids
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                left[doc] -= length
                if not left[doc]:
                    del docs[doc], left[doc]
            kinds = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, most=BATCH):
                done = []
                encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                shares = part.column("loss_share").to_pylist() if has_share else [None] * len(encoded)
                for key, ids, share in zip(part.column("doc_id").to_pylist(), encoded, shares, strict=True):
                    ids = np.append(ids, np.array([END_ID], "<u4"))
                    docs[n_docs], left[n_docs] = (key, ids), len(ids)
                    done += packer.add(n_docs, len(ids), len(ids) if share is None else round(min(1.0, max(0.0, share)) * len(ids)))
                    n_docs += 1
                if done:
                    yield rows(done)
            pa.default_memory_pool().release_unused()
        if rest := list(packer.finish()):
            yield rows(rest)

    cols = [F.col("doc_id"), F.col("text")] + [F.col(c).cast("double").alias("loss_share") for c in [loss_share] if c]
    return in_arrow(df.select(*cols), run, schema)
