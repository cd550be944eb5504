"""Personal data, also where it is disguised, with offsets into the text as it stands.

Base identifiers are found in the raw text. For disguised ones a text is copied to a tape whose symbols know the source
characters they stand for. Transducers rewrite the tape (look-alike letters, at/dot disguises, spelled digits), the
identifiers are looked for on it, and what is found is mapped back.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns. The e-mail pattern is applied around each @ (see emails), so long runs cost no more.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CARD_MAYBE = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones. Full-width and styled forms follow from NFKC.
HOMOGLYPHS = dict(zip(
    "аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅαοινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhlABEKMHOPCTXIJSaoivptukABEZHIKMNOPTYX",
    strict=True,
))
INVISIBLE = frozenset("​‌‍‎‏⁠﻿­")
# Digits as words, in the languages of the corpus.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NUMBER = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r"|[0-9])(?![^\W\d_])"
_PLUS = r"(?:\bplus[ ,-]+|\+ ?)"
#: At least four digits in a row, with one separator or two between them; a full stop and a blank end a sentence.
_SPELLED = re.compile(rf"{_PLUS}?(?<![^\W_]){_NUMBER}(?:[ ,;-]{{0,2}}(?:dot[ ,]+|point[ ,]+|\.)?(?<![^\W\d_]){_NUMBER}){{3,}}", re.I)
_WORD_OR_SIGN = re.compile(rf"(?P<plus>plus\b|\+)|(?P<dot>dot\b|point\b|\.)|(?P<n>{_NUMBER})", re.I)
#: What announces a telephone number, in the languages of the corpus. Ten and more digit words without a
#: plus are one only after such a word, or if digits stand among them; otherwise somebody is counting.
_CUE = re.compile(r"(?<![^\W\d_])(?:phone|telephone|mobile|cell|call|tel|dial|fax|whatsapp|sms|text|number|reach|contact|telefon|telefonnummer|nummer|handy|anrufen|ruf|téléphone|numéro|appelez|appeler|portable|teléfono|telefono|número|llama|llame|llamar|móvil)(?![^\W\d_])", re.I)
CUE_REACH = 60
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: Signs of a disguised address, without the white space around them: in brackets, in underscores, or as words.
_AT = re.compile(rf"(?P<sure>{_OPEN}\s*(?:at|@)\s*{_CLOSE}|_at_)|(?<!\S)at(?!\S)|@", re.I)
_DOT = re.compile(rf"(?P<sure>{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}|_dot_)|(?<!\S)dot(?!\S)", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
#: Last labels that make an address of plain words ("jane at host dot org"); a country's takes two dots.
LAST_LABELS = frozenset("com org net edu gov mil int info biz name pro dev app".split())

# Which texts may hold a disguise at all. A spelled run has three digit words with nothing else than digits, separators
# and dots between them; the pattern takes all such places, and more, in folded text.
_ODD = re.compile("[" + "".join(sorted(INVISIBLE)) + "Ͱ-ԯᴀ-ᶿ⁰-ₜ①-⓿！-～\U0001d400-\U0001d7ff]")
_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_MAY_SPELL = re.compile(rf"(?<![^\W\d_]){_WORD}(?:(?:[ ,;.0-9-]|dot|point)*{_WORD}){{2}}")

Span = tuple[str, int, int]


def folded(s: str) -> str:
    """Lower case, also of the letters that patterns without case take for s and i."""
    return s.replace("ſ", "s").replace("ı", "i").replace("İ", "i").lower()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the name is what stands before it, back to the last match at most."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    if _CARD_MAYBE.search(text):
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


class Tape:
    """Text whose symbol i stands for the source characters from start[i] to end[i]."""

    def __init__(self, text: str, start: list[int], end: list[int]):
        self.text, self.start, self.end = text, start, end

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.start[s], self.end[e - 1]

    def rewrite(self, found: Iterable[tuple[int, int, list[tuple[str, int, int]]]]) -> Tape:
        """Each (from, to) of `found`, in order, is replaced by symbols, each with the part of the tape that it stands for."""
        text, start, end, last = [], [], [], 0
        for a, b, new in found:
            text.append(self.text[last:a])
            start += self.start[last:a]
            end += self.end[last:a]
            for c, s, e in new:
                text.append(c)
                start.append(self.start[s])
                end.append(self.end[e - 1])
            last = b
        text.append(self.text[last:])
        return Tape("".join(text), start + self.start[last:], end + self.end[last:])


def _look_alikes(text: str) -> Tape:
    out, start, end = [], [], []
    for i, c in enumerate(text):
        if c in INVISIBLE:
            if end:
                end[-1] = i + 1 if i + 1 < len(text) and text[i + 1] not in " \n" else end[-1]
            continue
        if c > "ÿ":
            plain = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
            c = plain if len(plain) == 1 else c
        out.append(c)
        start.append(i)
        end.append(i + 1)
    return Tape("".join(out), start, end)


def _spelled(text: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    """Spelled runs as digits, plus and dots, without what separates them."""
    for m in _SPELLED.finditer(text):
        found = list(_WORD_OR_SIGN.finditer(m[0]))
        digits = [x for x in found if x["n"]]
        if len(digits) >= 4 and sum(not x["n"].isdigit() for x in digits) >= 3:
            at = m.start()
            sign = lambda x: "+" if x["plus"] else "." if x["dot"] else x["n"] if x["n"].isdigit() else str(DIGITS[folded(x["n"])])
            yield *m.span(), [(sign(x), at + x.start(), at + x.end()) for x in found]


def _with_blanks(text: str, start: int, end: int) -> tuple[int, int]:
    while start and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


def _hidden(text: str) -> Iterator[tuple[int, int, list[tuple[str, int, int]]]]:
    """Disguised addresses with plain signs; a sign stands for all of its disguise.

    From each at sign the name is read backwards and the domain onwards, over disguised dots. A name never reaches back
    over another at sign, so each character is read a few times at most. A sure at sign makes any dots do, others take a
    disguised one; where all signs are plain words, the last label must be a likely one.
    """
    dots = [(*_with_blanks(text, *m.span()), bool(m["sure"])) for m in _DOT.finditer(text)]
    opens, closes = {a: (b, sure) for a, b, sure in dots}, {b: a for a, b, _ in dots}
    last = 0
    for at in _AT.finditer(text):
        left, right = _with_blanks(text, *at.span())
        floor, last = last, max(last, at.end())
        if left < floor:
            continue
        word = text[at.start() : at.end()].lower() == "at"
        name, start = [], left
        while True:
            a = start
            while a > floor and text[a - 1] in _LOCAL_CHARS and a not in closes:
                a -= 1
            if a == start:
                break
            name.append((a, start))
            start = a
            if a not in closes or closes[a] <= floor:
                break
            start = closes[a]
        if not name:
            continue
        start = name[-1][0]
        domain, signs, end = [], [], right
        while m := _LABEL.match(text, end):
            domain.append(m.span())
            end = m.end()
            if end in opens:
                signs.append((end, *opens[end]))
                end = opens[end][0]
            elif text[end : end + 1] == ".":
                signs.append((end, end + 1, None))
                end += 1
            else:
                break
        if len(domain) < 2:
            continue
        signs, end = signs[: len(domain) - 1], domain[-1][1]
        hidden = [sure for _, _, sure in signs if sure is not None]
        label = text[slice(*domain[-1])].lower()
        likely = label in LAST_LABELS or (len(label) == 2 and label.isalpha() and len(signs) > 1)
        if not at["sure"] and (not hidden or (word and not any(hidden) and not likely)):
            continue
        out: list[tuple[str, int, int]] = []
        for i, (a, b) in enumerate(reversed(name)):
            if i:
                out.append((".", out[-1][2], a))
            out += [(text[k], k, k + 1) for k in range(a, b)]
        out.append(("@", left, right))
        for i, (a, b) in enumerate(domain):
            out += [(text[k], k, k + 1) for k in range(a, b)]
            if i < len(signs):
                out.append((".", signs[i][0], signs[i][1]))
        yield start, end, out
        last = end


def disguised_spans(text: str) -> list[Span]:
    """Identifiers that show only on the rewritten tape, as source spans."""
    low = folded(text)
    odd, spell = _ODD.search(text), _MAY_SPELL.search(low)
    at_dot = "dot" in low or "[at]" in low or "(at)" in low or "_at_" in low or re.search(rf"{_OPEN}\s*(?:at|@|\.)\s*{_CLOSE}", low)
    if not (odd or spell or at_dot):
        return []
    tape = _look_alikes(text) if odd else Tape(text, list(range(len(text))), list(range(1, len(text) + 1)))
    out = []
    if odd:
        out += [(k, *tape.source(s, e)) for k, s, e in base_spans(tape.text)]
    if at_dot or odd:
        mail = tape.rewrite(_hidden(tape.text))
        out += [("email", *mail.source(s, e)) for s, e in emails(mail.text)]
    if spell or odd:
        number = tape.rewrite(_spelled(tape.text))
        if number.text != tape.text:
            out += [(k, *number.source(s, e)) for k, s, e in base_spans(number.text) if k != "email"]
            for m in re.finditer(r"(?<![+0-9.])[0-9]{10,15}(?![0-9.])", number.text):  # spelled out without a plus
                s, e = number.source(*m.span())
                announced = any(c.isdigit() for c in text[s:e]) or _CUE.search(text, max(0, s - CUE_REACH), s)
                if e - s > 2 * (m.end() - m.start()) and announced:
                    out.append(("phone", s, e))
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those the method adds: disguised ones that touch no other span of their kind, unless they hold a
    base span and more. Both by kind, start."""
    base = base_spans(text)
    of_kind = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    ends = {k: [e for _, e in spans] for k, spans in of_kind.items()}
    added: list[Span] = []
    for kind, s, e in sorted(set(disguised_spans(text)), key=lambda x: (KINDS.index(x[0]), x[1], -x[2])):
        if added and added[-1][0] == kind and added[-1][2] > s:
            continue
        i = bisect.bisect_right(ends[kind], s)
        while i < len(ends[kind]) and of_kind[kind][i][0] < e and s <= of_kind[kind][i][0] and ends[kind][i] <= e and (s, e) != of_kind[kind][i]:
            i += 1
        if i == len(ends[kind]) or of_kind[kind][i][0] >= e:
            added.append((kind, s, e))
    return base, added


def join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def pii_report(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as text.

    Null is empty text, without spans. Each row is judged alone; repeated rows get equal results. Time and memory grow
    with a text's length (some 100 bytes a character where it holds a disguise). Other columns don't matter. No shuffle.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [all_spans(t or "") for t in batch.column("text").to_pylist()]
        count = lambda kind: pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64())
        digest = [hashlib.sha256(join(base).encode()).hexdigest() for base, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(count, KINDS), pa.array(digest, pa.string()), pa.array([join(base + added) for base, added in rows], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    id_type = df.schema["doc_id"].dataType.simpleString()
    return map_text(df.select("doc_id", "text"), find, f"doc_id {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with each identifier replaced by its kind, as <EMAIL>; spans that meet count as the first's kind."""
    base, added = all_spans(text)
    out, last = [], 0
    for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind.upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in `text` replaced (null stays null); n_chars, where there is one, is set anew.

    All other columns stay, whatever their names. Empty texts stay; repeated rows get equal texts.
    """
    at = df.columns.index(text)
    has_n = "n_chars" in df.columns

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = map_text(df, apply, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]), text)
    if has_n:
        out = out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))
    return out
