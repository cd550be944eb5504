"""Secret scans in column expressions: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Main path: built-in functions only, no shuffle, one pass over the rows.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: A candidate is a whole run of these characters, of at least WINDOW of them and with a digit.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits per character from which a window of a class counts as random; the most that WINDOW characters can have is 4.32.
#: Each window is of the narrowest class that has all its characters, whatever stands around it in the run.
CLASSES = (("hex", "0123456789ABCDEFabcdef", 3.0), ("alnum", ALPHABET[:62], 3.6), ("base64", ALPHABET, 3.8))
#: Strings that look random and are not secrets. Placeholders, keyboard runs, UUIDs, words and numbers joined by signs.
ALLOW = (
    "(?i)example|sample|placeholder|change_?me|dummy|redacted|xxxx|01234567|12345678|abcdefgh|qwerty",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^(?:[A-Za-z]+|[0-9]+)?(?:[-+/_=]+(?:[A-Za-z]+|[0-9]+)?)*$",
)


#: Elements that one fold appends to; a scan goes over blocks of so many.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element, op folded over all elements before it, from zero.

    A fold that appends copies its array at each step, so it goes over blocks: first over each block's own fold, then
    within the blocks from what lies before them. Time grows nearly in proportion with the array.
    """

    def running(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)), lambda acc: F.slice(acc, 1, F.size(block)))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    # op as a function of two named arguments: aggregate refuses variadic ones, as F.greatest
    starts = lambda bs: running(F.transform(bs, lambda block: F.aggregate(block, zero, lambda acc, x: op(acc, x))), zero)
    each = lambda bs: let(starts(bs), lambda st: F.flatten(F.zip_with(bs, st, running)))
    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), each)).otherwise(F.slice(v, 1, 0)))


def _spans(text: Column, pattern: str, may: Column) -> Column:
    """Matches as array<struct<s, e, m>> in code points, from what lies between them. may: false where no match is possible."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    steps = lambda p: F.transform(p, lambda x: x["gap"] + F.length(x["m"]))
    placed = lambda p: F.zip_with(p, scanned(steps(p), F.lit(0), lambda a, n: a + n), lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))
    # split gives one string more than there are matches
    return F.when(may, let(F.filter(pairs, lambda x: x["m"].isNotNull()), placed)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _outside(runs: Column, base: Column) -> Column:
    """The runs that no base span holds: as they come from the left, those that reach beyond all base spans begun so far."""
    none = F.lit("")
    events = F.concat(F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("run"), b["e"].alias("e"), none.alias("m"))), F.transform(runs, lambda r: F.struct(r["s"].alias("s"), F.lit(1).alias("run"), r["e"].alias("e"), r["m"].alias("m"))))
    reach = lambda ev: scanned(F.transform(ev, lambda x: F.when(x["run"] == 0, x["e"]).otherwise(0)), F.lit(0), lambda a, e: F.greatest(a, e))
    marked = lambda ev: F.zip_with(ev, reach(ev), lambda x, r: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), ((x["run"] == 1) & (r < x["e"])).alias("free")))
    left = let(F.array_sort(events), lambda ev: F.transform(F.filter(marked(ev), lambda x: x["free"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))))
    return F.when((F.size(runs) > 0) & (F.size(base) > 0), left).otherwise(runs)


def _least_sums(chars: Column) -> Column:
    """For each class, the least sum of c * log2(c) over the windows of WINDOW characters that have only its characters.

    chars: positions in ALPHABET, from 1. One character enters and one leaves at each step. The counts change in those two
    places, and with them the sum, which gives a window's entropy as log2(WINDOW) - sum / WINDOW. 1e9: no such window.
    """
    clogc = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    kinds = [k for k, _, _ in CLASSES]
    #: by position, the first class that has the character, from 1
    first = F.array(*[F.lit(1 + next(i for i, (_, held, _) in enumerate(CLASSES) if c in held)) for c in ALPHABET])
    none = [F.lit(1e9).alias(k) for k in kinds]
    runs = [F.lit(0).alias(f"run_{k}") for k in kinds[:-1]]
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), *runs, *none)

    def step(acc: Column, i: Column) -> Column:
        new, old = F.get(chars, i), F.when(i >= WINDOW, F.get(chars, i - WINDOW)).otherwise(0)
        n_new, n_old = F.get(acc["n"], new - 1), F.when(old > 0, F.get(acc["n"], old - 1)).otherwise(0)
        change = F.get(clogc, n_new + 1) - F.get(clogc, n_new) + F.when(old > 0, F.get(clogc, n_old - 1) - F.get(clogc, n_old)).otherwise(0.0)
        total = F.when(new == old, acc["sum"]).otherwise(acc["sum"] + change)
        counts = F.transform(acc["n"], lambda n, j: n + F.when(j + 1 == new, 1).otherwise(0) - F.when(j + 1 == old, 1).otherwise(0))
        runs = {k: F.when(F.get(first, new - 1) <= c, acc[f"run_{k}"] + 1).otherwise(0) for c, k in enumerate(kinds[:-1], 1)}
        whole = {**{k: run >= WINDOW for k, run in runs.items()}, kinds[-1]: i >= WINDOW - 1}
        least = [F.when(whole[k], F.least(acc[k], total)).otherwise(acc[k]).alias(k) for k in kinds]
        return F.struct(counts.alias("n"), total.alias("sum"), *[run.alias(f"run_{k}") for k, run in runs.items()], *least)

    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, step, lambda acc: F.struct(*[acc[k].alias(k) for k in kinds]))


def _entropy(least: Column) -> Column:
    return F.lit(math.log2(WINDOW)) - least / WINDOW


def window_entropy(chars: Column) -> Column:
    """The largest Shannon entropy, in bits per character, of WINDOW consecutive characters (positions in ALPHABET, from 1)."""
    return _entropy(_least_sums(chars)[CLASSES[-1][0]])


def _is_secret(m: Column) -> Column:
    chars = F.transform(F.split(m, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # one element, so that the fold is written once
    sums = F.array(let(chars, _least_sums))
    random = F.exists(sums, lambda x: functools.reduce(operator.or_, (_entropy(x[k]) >= bits for k, _, bits in CLASSES)))
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | m.rlike(pattern)
    # the fold is the dear part: only where the cheap tests leave a string
    return F.when(~m.rlike("[0-9]") | allowed, F.lit(False)).otherwise(random)


def secret_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `base` and `added`: arrays of struct(s, kind, e) with kind a position in KINDS, code points, end exclusive.

    Null text is empty text and has no spans. Every row is judged alone, so repeated rows get equal spans; other columns
    stay. A string of the entropy kind is left out where a base span holds it. Time and memory grow with a text's length,
    and with the number of its spans, in proportion; an empty table gives no rows. Columns base and added are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    run = "[A-Za-z0-9+/_=-]"
    df = df.withColumns({
        "__assign": _spans(t, ASSIGN, (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN)),
        "__access": _spans(t, ACCESS, t.contains("AKIA")),
        "__hex": _spans(t, HEX, t.rlike(HEX)),
        "__run": _spans(t, f"(?<!{run}){run}{{{WINDOW},}}+", t.rlike(f"{run}{{{WINDOW}}}")),
    })
    kept = {
        "assign": F.filter("__assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8),
        "access": F.filter("__access", lambda x: x["e"] - x["s"] >= 16),
        "hex": F.col("__hex"),
    }
    as_kind = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("kind"), x["e"].alias("e")))
    df = df.withColumn("base", F.array_sort(F.concat(*[as_kind(v, k) for k, v in kept.items()])))
    df = df.withColumn("__free", _outside(F.col("__run"), F.col("base")))
    df = df.withColumn("added", as_kind(F.filter("__free", lambda x: _is_secret(x["m"])), "entropy"))
    return df.drop("__assign", "__access", "__hex", "__run", "__free")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as text.

    Only doc_id (null too) and text are looked at. Equal rows give equal rows; all else is as in secret_spans.
    """
    found = secret_spans(df.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
