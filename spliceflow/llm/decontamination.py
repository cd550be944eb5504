"""Benchmark decontamination in DataFrame functions: a broadcast table of test n-grams, probed from training windows.

Every n-gram is filed under one of its words, its anchor: the word that the fewest n-grams share. Documents are scanned
word by word against the broadcast table; at an anchor, the window that the n-gram would take is cut out, hashed, and a
hit is verified word by word. So each window of a document that is a test n-gram is found, and windows without an
anchor, nearly all, cost one probe. What is broadcast at once has about MAX_NGRAMS rows and MAX_BYTES bytes: the n-grams
are counted, and a larger benchmark is probed in several passes, each with its share of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .secret_scans import let, scanned

N = 10
#: What one pass broadcasts: n-grams, and bytes of them and of their items.
MAX_NGRAMS, MAX_BYTES = 1_000_000, 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[\p{Alnum}\P{ASCII}]+"  # digits, letters and all beyond ASCII; A-Z not yet lowered


def lowered(c: Column) -> Column:
    """A-Z to a-z; no other letter changes."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """A text's words in order, A-Z not yet lowered. Null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ngrams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct n-grams: anchor, back (words before it), size, gram (joined by spaces), gram_hash, items (sorted ids).

    An item of fewer than n words, but not none, is one n-gram. Items without words, or of null id, have none; an item
    that occurs in several rows counts once.
    """
    per_item = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.transform(words(F.col("text")), lowered).alias("w")).where(F.size("w") > 0)
    size = F.least(F.lit(n), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    grams = per_item.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("g"))
    grams = grams.groupBy("g").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    each = grams.select("g", "items", F.posexplode("g").alias("back", "anchor"))
    shared = each.groupBy("anchor").agg(F.count_distinct("g").alias("shared"))
    best = Window.partitionBy("g").orderBy("shared", F.desc(F.length("anchor")), "back")
    each = each.join(shared, "anchor").withColumn("rank", F.row_number().over(best)).where("rank = 1")
    gram = F.array_join("g", " ")
    return each.select("anchor", "back", F.size("g").alias("size"), gram.alias("gram"), F.xxhash64(gram).alias("gram_hash"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document with a hit (key: see keyed): hit_spans as sorted, merged struct(s, e) of word positions, and items."""
    table = ngrams(benchmark, n)
    table = written(table.select(F.lower("anchor").alias("key"), "back", "size", "gram", "gram_hash", "items"))
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("gram") + 8 * F.size("items") + 64), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["rows"] // MAX_NGRAMS), -(-size["bytes"] // MAX_BYTES))
    # lower() may merge more than A-Z does; that only adds candidates, which the verification drops
    at = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w")).select("doc_id", "text_hash", "w", F.posexplode("w").alias("p", "word"))
    parts = [table if passes == 1 else table.where(F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(passes)) == i) for i in range(passes)]
    near = reduce(DataFrame.unionAll, [at.join(F.broadcast(part), F.lower("word") == F.col("key")) for part in parts])
    near = near.where("p >= back and p - back + size <= size(w)")
    window = near.select("doc_id", "text_hash", (F.col("p") - F.col("back")).alias("s"), "size", "gram", "gram_hash", "items", lowered(F.array_join(F.slice("w", F.col("p") - F.col("back") + 1, F.col("size")), " ")).alias("cut"))
    same = window.where((F.xxhash64("cut") == F.col("gram_hash")) & (F.col("cut") == F.col("gram")))
    spans = F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("size")).alias("e"))))
    return same.groupBy("doc_id", "text_hash").agg(_merged(spans).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one: a span begins anew where it starts beyond all ends so far."""
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def joined(all_: Column) -> Column:
        reach = scanned(F.transform(all_, lambda x: x["e"]), F.lit(-1), lambda a, e: F.greatest(a, e))
        first = F.filter(F.zip_with(all_, reach, lambda x, r: F.struct(x["s"].alias("s"), r.alias("r"))), lambda x: x["s"] > x["r"])
        # a span ends where the ends had come to when the next one begins
        ends = lambda f: F.array_append(F.slice(F.transform(f, lambda x: x["r"]), 2, F.greatest(F.size(f) - 1, F.lit(0))), F.array_max(F.transform(all_, lambda x: x["e"])))
        return let(first, lambda f: F.zip_with(f, ends(f), lambda x, e: span(x["s"], e)))

    return let(spans, joined)


def _between(spans: Column, n: Column) -> Column:
    """What merged spans leave of 0 to n, as struct(s, e)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    return F.zip_with(starts, F.array_append(F.transform(spans, lambda x: x["s"]), n), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def keyed(docs: DataFrame) -> DataFrame:
    """Add text_hash. Rows equal in doc_id and text share a key, and get equal results."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def matched(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """All of docs (with text_hash) and hit_spans, items: null for documents without a hit. Null ids match null ids.

    Hits are few and written first, so that Spark knows their size: where it is small, documents stay where they are.
    """
    found = written(hits(docs, benchmark, n)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (docs["text_hash"] == F.col("__hash")), "left").drop("__id", "__hash")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, the words inside a test n-gram, the items hit and a digest of their ids.

    Null and empty texts have no words; an empty benchmark hits nothing; equal rows get equal results. Other columns play
    no part. A text's words are met one by one, so its length adds to time only in proportion.
    """
    slim = keyed(docs.select("doc_id", "text"))
    counted = slim.select("doc_id", "text_hash", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    found = written(hits(slim, benchmark)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    joined = counted.join(found, counted["doc_id"].eqNullSafe(F.col("__id")) & (counted["text_hash"] == F.col("__hash")), "left")
    n_hit = F.coalesce(F.aggregate("hit_spans", F.lit(0), lambda a, x: a + x["e"] - x["s"]), F.lit(0)).cast("long")
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.8, n: int = N) -> DataFrame:
    """docs without test n-grams: words inside a hit go, and a document goes of which at least drop_share would.

    What stands between removed words (blanks, marks) goes with them; n_chars, where there is one, is set anew. Columns,
    whatever their names, and clean documents stay as they are. Null and empty texts stay, a null doc_id is an id of its
    own, equal rows get equal results; an empty benchmark removes nothing. Time grows with a text's length and with the
    number of its hits in proportion.
    """
    cols = docs.columns
    found = matched(keyed(docs.select("doc_id", "text", F.struct(*[c for c in cols if c != "text"]).alias("__row"))), benchmark, n)
    w = words(F.col("text"))
    n_hit = F.aggregate("hit_spans", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    gaps = F.split(F.col("text"), WORD, -1)
    # each word with what follows it; both arrays are made once, not once for each word
    pieces = F.zip_with(w, F.slice(gaps, 2, 1 << 30), lambda word, after: F.concat(word, after))
    keep = let(pieces, lambda p: F.flatten(F.transform(_between(F.col("hit_spans"), F.size(p)), lambda x: F.slice(p, x["s"] + 1, x["e"] - x["s"]))))
    kept = F.concat(F.get(gaps, F.lit(0)), F.array_join(keep, ""))
    found = found.where(F.col("hit_spans").isNull() | (n_hit < drop_share * F.size(w)))
    text = F.when(F.col("hit_spans").isNull(), F.col("text")).otherwise(kept)
    out = found.withColumn("__text", text)
    return out.select(*[F.col("__text").alias(c) if c == "text" else F.coalesce(F.length("__text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("__row")[c].alias(c) for c in cols])
