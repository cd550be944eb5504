"""How five quality filters act together: what each removes alone, after others, and on average over all orders.

Words are dealt out by document, exploded, counted by (document, word) and then by document; joined with the other flags, each document fails
a set of filters, one of 32. Counts for these 32 sets in each part of the corpus are all that 120 orders need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Fewest words, least percent of distinct words, most percent of A-Z, and characters of markup.
WORDS, DISTINCT, CAPITALS, MARKUP = 200, 50, 3, "[#$%&*|]"
#: What stands between words, and what names a document: its id and a hash of its text, as ids may be null or stand for several texts.
SPACES = r"[\x20\x09-\x0D]+"
KEY = ["doc_id", "h"]
#: Characters of a text whose words one task counts.
SHARE = 1_000_000


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h, text): n_words and n_distinct by (doc_id, h). Rows of one key have one text and count once.

    A row's equal words are made one, next to the number of all, and dealt out by document as a list, which is smaller and
    takes less time than a row for each word; there the lists are exploded, and counted by (document, word). The words of
    a text longer than SHARE characters are exploded before that and dealt out by word too, into a share for each SHARE
    characters, so that no text is too long for a task. An empty list stands for a null word, which keeps rows without any.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    found = docs.select(*KEY, F.floor(F.length(text) / SHARE).alias("shares"), words.alias("words"))
    found = found.select(*KEY, "shares", F.size("words").cast("long").alias("n"), F.array_distinct("words").alias("words"))
    lists = F.when(F.col("shares") == 0, F.array("words")).otherwise(F.array_append(F.transform("words", lambda w: F.array(w)), F.array().cast("array<string>")))
    each = found.select(*KEY, "n", "shares", F.explode(lists).alias("words"))
    share = F.when(F.col("shares") > 0, F.pmod(F.xxhash64("words"), F.col("shares") + 1)).otherwise(0)
    dealt = each.select(*KEY, "n", share.alias("share"), "words").repartition(*KEY, "share")
    once = dealt.select(*KEY, "n", "share", F.explode_outer("words").alias("word")).groupBy(*KEY, "share", "word").agg(F.max("n").alias("n"))
    return once.groupBy(*KEY).agg(F.max("n").alias("n_words"), F.count("word").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, part, n, fails): n documents of an id, a text's hash and a part fail the filters in fails, 1 for A to 16 for E.

    Filter E fails where a smaller doc_id has the same text, by SHA-256; a null doc_id is neither smaller nor larger.
    Copies are looked for by text, but met by text and id, so a large group of copies is dealt out.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h"), "text", "lang")
    c = 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS * F.length(text)
    flags = keyed.select(*KEY, F.coalesce("lang", F.lit("")).alias("part"), c.alias("c"), text.rlike(MARKUP).alias("d"), F.sha2(text, 256).alias("same"))
    flags = written(flags.groupBy(*KEY, "part", "c", "d", "same").agg(F.count("*").alias("n")))
    least = flags.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first")).where("doc_id is not null")
    rows = flags.join(least, ["same", "doc_id"], "left").withColumn("e", F.col("doc_id").isNotNull() & F.col("first").isNull())
    counts = word_counts(keyed).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    rows = rows.join(counts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
    a, b = F.col("n_words") < WORDS, 100 * F.col("n_distinct") < DISTINCT * F.col("n_words")
    fails = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate([a, b, F.col("c"), F.col("d"), F.col("e")])), F.lit(0))
    return rows.select(*KEY, "part", "n", fails.alias("fails"))


def _sum_where(counts: Column, holds) -> Column:
    """The sum of counts over the sets (0 to 31) for which holds."""
    return F.aggregate(F.filter(F.transform(counts, lambda n, s: F.when(holds(s), n).otherwise(0)), lambda n: n > 0), F.lit(0).cast("long"), lambda acc, n: acc + n)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part of the corpus (lang; null: empty), order of the filters, and step; counts of documents.

    Null text is empty: it fails A, and E where a smaller id is empty too. Each row is a document of its own, repeats
    included; rows of one id never make each other fail E. A doc_id has a label where any of its rows in labels says so;
    null ids have none. Other columns play no part. An empty table has no parts and gives no rows. Texts of any length
    are counted by word in many tasks.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids have no label; as keys of the join they are told apart by their texts, so that they don't meet in one task
    alone = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(0).alias("alone")
    rows = failures(docs).select("*", alone).join(said.withColumn("alone", F.lit(0).cast("long")), ["doc_id", "alone"], "left")
    # all the conditional counts in one pass: for each set of failed filters, all documents, the good and the toxic ones
    kinds = {"all": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    count = lambda s, has: F.coalesce(F.sum(F.when((F.col("fails") == s) & has, F.col("n"))), F.lit(0))
    sets = rows.groupBy("part").agg(*[count(s, has).alias(f"{kind}_{s}") for kind, has in kinds.items() for s in range(32)])
    sets = sets.select("part", *[F.array(*[f"{kind}_{s}" for s in range(32)]).alias(kind) for kind in kinds])
    removed = lambda of, f, before: _sum_where(F.col(of), lambda s: (s.bitwiseAND(f) != 0) & (s.bitwiseAND(before) == 0))
    bits = lambda letters: F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc + F.pow(F.lit(2), F.ascii(x) - ord("A")).cast("int"))
    each = sets.select("*", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.explode(F.lit([1, 2, 3, 4, 5])).alias("step"))
    each = each.withColumns({"f": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    f, before = F.col("f"), F.col("before")
    # of the filters that a document fails, each goes first in an equal share of the orders
    shares = F.transform("all", lambda n, s: F.when(s.bitwiseAND(f) != 0, n * (F.lit(len(ORDERS)) / F.bit_count(s)).cast("long")).otherwise(0))
    return each.select(
        "part", "filter_order", F.col("step"), _sum_where(F.col("all"), lambda s: s.bitwiseAND(f.bitwiseOR(before)) == 0).alias("kept"),
        removed("all", f, before).alias("removed"), _sum_where(F.col("all"), lambda s: (s.bitwiseAND(f) != 0) & (s.bitwiseAND(before) != 0)).alias("redundant"),
        F.get("all", f).alias("unique_fails"), removed("good", f, before).alias("good_lost"), removed("toxic", f, before).alias("toxic_lost"), F.aggregate(shares, F.lit(0).cast("long"), lambda acc, n: acc + n).alias("shapley"),
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS fails
  FROM d LEFT JOIN said USING (doc_id)),
steps AS (
  SELECT o AS filter_order, s::INT AS step, 1 << (ascii(o[s]) - 65) AS bit, coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(o[1:s - 1], '') IF x <> '']), 0)::INT AS before
  FROM (SELECT unnest([{", ".join(f"'{o}'" for o in ORDERS)}]) AS o) CROSS JOIN range(1, 6) AS t(s)),
counts AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
each AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
  FROM counts CROSS JOIN steps GROUP BY ALL)
SELECT * EXCLUDE bit, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM each"""
