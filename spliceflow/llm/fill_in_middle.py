"""Fill-in-the-middle: a text is cut at two token ranks and put together again as prefix, suffix, middle.

Texts are cut into chunks of CHUNK characters, each seen together with the first character of the next one. Whether a
token ends between two neighbouring characters depends on these two only, so each chunk counts the ends inside it by
itself. Prefix sums over the chunks' counts say which chunk owns a rank, and only that chunk is scanned again for the
place. All of it is column expressions within one pass over the rows, without a shuffle: the pieces of a text are needed
whole in the row that is put out, so chunks are spread over a row and rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk.
CHUNK = 8192
#: Blanks, and the marks of the forms.
SPACE = r"\x20\x09-\x0D"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _chunks(text: Column) -> Column:
    """The text in order, as array<string> of CHUNK code points each."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def _overlapping(chunks: Column) -> Column:
    """Each chunk with the character that follows it; the text's end counts as a blank."""
    return F.transform(chunks, lambda c, i: F.concat(c, F.coalesce(F.left(F.get(chunks, i + 1), F.lit(1)), F.lit(" "))))


def _word_ends(chunks: Column) -> Column:
    """For each chunk, the number of words that end in it: a character that is no blank, before a blank."""
    return F.transform(_overlapping(chunks), lambda c: F.regexp_count(c, F.lit(f"[^{SPACE}][{SPACE}]")))


def _owner(counts: Column, rank: Column) -> Column:
    """struct(owner, into): the chunk in whose prefix sum the rank is reached first, and the rank within that chunk."""
    long = lambda v: F.lit(v).cast("long")
    zero = F.struct(long(0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("owner"), long(0).alias("into"))

    def step(acc: Column, n: Column) -> Column:
        reached = (acc["owner"] < 0) & (acc["sum"] + n >= rank)
        owner, into = F.when(reached, acc["i"]).otherwise(acc["owner"]), F.when(reached, rank - acc["sum"]).otherwise(acc["into"])
        return F.struct((acc["sum"] + n).alias("sum"), (acc["i"] + 1).alias("i"), owner.alias("owner"), into.alias("into"))

    return F.aggregate(counts, zero, step, lambda acc: F.struct(acc["owner"].alias("owner"), acc["into"].cast("int").alias("into")))


def _place(chunks: Column, at: Column) -> Column:
    """Code points up to the end of a word, given by _owner. Only that chunk is scanned.

    Where a chunk begins inside of a word, its first match is the rest of that word, which ends here.
    """
    pieces = F.regexp_extract_all(F.get(chunks, at["owner"]), F.lit(f"[{SPACE}]*+[^{SPACE}]++"), F.lit(0))
    inside = F.aggregate(F.slice(pieces, 1, at["into"]), F.lit(0), lambda acc, p: acc + F.length(p))
    return at["owner"].cast("long") * CHUNK + inside


def _random(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first groups of 8 digits of a SHA-256, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs and `fim`: struct(n, form, prefix_chars, middle_chars, output), chosen by doc_id and seed alone.

    A token is a word with the blanks before it, or the blanks at the text's end. Both cuts are ranks from 0 to n. `percent`
    of the documents are put into a form, of these `spm_percent` as suffix, prefix, middle; the rest stays plain, as does
    an empty text and one that holds a mark. Null text is empty text; a null doc_id draws as an empty one. Rows are
    treated one by one: equal rows get equal results, an empty table gives no rows, and other columns stay whatever their
    names, but for `fim`, which is replaced. Time and memory grow with a text's length in proportion.
    """
    h1, h2, h3, h4 = _random(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    row = docs.select(F.struct(*[c for c in docs.columns if c != "fim"]).alias("row"), text.alias("text"), _chunks(text).alias("chunks"), *[h.alias(f"h{i}") for i, h in enumerate([h1, h2, h3, h4], 1)])
    row = row.withColumn("ends", _word_ends(F.col("chunks")))
    words = F.aggregate("ends", F.lit(0).cast("long"), lambda acc, n: acc + n)
    row = row.withColumn("words", words).withColumn("n", words + F.when(F.right("text", F.lit(1)).rlike(f"^[{SPACE}]$"), 1).otherwise(0))
    row = row.withColumns({"a": F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)), "b": F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1))})
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    row = row.withColumn("form", form)
    # past the last word, the blanks at the end are the last token
    past = lambda rank: F.col(rank) > F.col("words")
    owned = lambda rank: F.when((F.col("form") != "plain") & (F.col(rank) > 0) & ~past(rank), _owner(F.col("ends"), F.col(rank)))
    row = row.withColumns({"at_a": owned("a"), "at_b": owned("b")})
    cut = lambda rank: F.when(F.col("form") == "plain", None).when(past(rank), F.length("text").cast("long")).otherwise(F.coalesce(_place(F.col("chunks"), F.col(f"at_{rank}")), F.lit(0).cast("long")))
    row = row.select("row", "text", "n", "form", cut("a").alias("p"), cut("b").alias("m"))
    part = lambda start, length: F.substring(F.col("text"), start, length)
    prefix, middle, suffix = F.left("text", F.col("p").cast("int")), part((F.col("p") + 1).cast("int"), (F.col("m") - F.col("p")).cast("int")), part((F.col("m") + 1).cast("int"), F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    )
    made = F.struct("n", "form", F.col("p").alias("prefix_chars"), (F.col("m") - F.col("p")).alias("middle_chars"), output.alias("output"))
    return row.select("row.*", made.alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle was given, from its output and form alone.

    A mark begins with a character that stands nowhere else in marks, so none can arise where pieces meet: the first
    place of each mark is the one that was put there.
    """
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    first = lambda mark: F.substring_index(body, mark, 1)
    after = lambda mark: F.substring_index(body, mark, -1)
    between = lambda a, b: F.substring_index(F.substring_index(body, a, -1), b, 1)
    psm = F.concat(first(SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), first(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """One row per document: tokens, form, lengths, and digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    f = F.col("fim")
    return made.select(
        "doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"),
        F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(restored(f["output"], f["form"]), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents),
ranked AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS r2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(r1, r2)], '') AS p, array_to_string(t[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
    array_to_string(t[greatest(r1, r2) + 1:], '') AS s
  FROM ranked)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
