"""The corpus operators against plain versions, on tables with nulls, empties, ties, repeats and clashing names."""

import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spliceflow.llm import common, decontamination, embedding_dedup, license_scans, lm_scoring, near_dedup, packing, pii, secret_scans, stages, substring_dedup, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seed string, region string, base string, score string"
HEX = "0123456789abcdef0f1e2d3c4b5a6978"
BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item here"), (3, None), (4, "..."), (5, "ONE two three four five six seven eight nine ten eleven other")]


def documents():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Straße", "Étage", "naïve", "x", "the", "of", "foo-bar", "a.b"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    long = text(6000)
    near = text(300)
    passage = text(45)
    docs = [
        (0, text(50)), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, near), (7, near.replace("alpha", "ALPHA")),
        (8, near + " tail"), (9, f"{text(30)} {passage} {text(10)}"), (10, f"{passage} {passage}"), (11, f"x {passage}"),
        (12, "w1 w2 w3"), (13, "W1  w2\nw3"), (14, f"api_key = '{HEX}' AKIA{'Q7' * 8} token:short PASSWORD=\"abcdefgh\" token=secret: password123"),
        (15, "TOKEN==abc+/def12345 ſecret=abcdefghij " + HEX * 3 + " é" + HEX + "g"), (16, "so One, two three FOUR five six seven eight nine ten eleven twelve. short item here"),
        (17, "short item herÉ one two three four five six seven eight nine ten"), (18, "a" * 5000 + "@" + "1" * 5000), (19, "mail a.b@c.de@f.gh x@y 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (555) 123-4567."),
        (20, "All rights reserved. CC-BY cc by! GNU General Public\nLicense all rights reserved"), (21, "𝒳 😀 " + "émoji😀x1 " * 30), (None, text(40)), (None, None),
    ]
    return docs + [docs[4], docs[12]]  # repeated rows


def table(spark, docs=None):
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "x", "y", "z", "w") for d, t in (documents() if docs is None else docs)], SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(x):
    return sorted(map(tuple, x), key=lambda r: tuple((v is not None, v) for v in r))


def test_secrets(spark):
    got = secret_scans.secret_report(table(spark)).collect()
    exp = ordered((d, *c.values(), h) for d, t in documents() for c, h in [brute.secrets(t)])
    assert ordered((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == exp
    random_string = "q7Rk2Zp9Xw4Lm8Tb3Vn6"
    extra = [(1, f"key {random_string} end"), (2, "uuid 3f2b8c1e-9d47-4a6b-8e15-7c0d2f9a6b34"), (3, "aaaaaaaaaaaaaaaaaaaaaaaa1111"), (4, "example" + random_string), (5, "some-long-name-of-2024-thing-here")]
    spans = {r.doc_id: r.spans for r in secret_scans.secret_report(table(spark, extra)).collect()}
    assert spans == {1: "entropy:4:24", 2: "", 3: "", 4: "", 5: ""}
    assert secret_scans.secret_report(table(spark, [])).count() == 0


def test_secrets_joined_to_names(spark):
    rng = random.Random(8)
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    joined = [(f"AUTH={key(32, '0123456789ABCDEF')}") for _ in range(40)] + [f"deploy/{key(24, '0123456789abcdef')}" for _ in range(40)] + [f"0x{key(32, '0123456789ABCDEF')}" for _ in range(40)]
    names = ["path/to/some_long-name/2024/12/index_of_things=3", "id=3f2b8c1e-9d47-4a6b-8e15-7c0d2f9a6b34", "order=" + "12" * 15, "example=" + key(32, "0123456789ABCDEF")]
    got = {r.doc_id: r.spans for r in secret_scans.secret_report(table(spark, list(enumerate(joined + names)))).collect()}
    assert sum(got[i] == f"entropy:0:{len(t)}" for i, t in enumerate(joined)) >= 115
    assert [got[len(joined) + i] for i in range(len(names)) if i != 1] == ["", "", ""]


def test_window_entropy(spark):
    s = "abcabcdefghijklmnopqrstuvwaaaaaaaaaaaaaaaaaaaa9"
    chars = F.transform(F.split(F.lit(s), ""), lambda c: F.instr(F.lit(secret_scans.ALPHABET), c))
    got = spark.range(1).select(secret_scans.window_entropy(chars)).first()[0]
    plain = []
    for i in range(len(s) - 19):
        p = np.unique(list(s[i : i + 20]), return_counts=True)[1] / 20
        plain.append(-(p * np.log2(p)).sum())
    assert got == pytest.approx(max(plain))


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_NGRAMS", most)
    bench = spark.createDataFrame([*BENCH, BENCH[0]], "item_id long, text string")
    exp = ordered(brute.contamination(documents(), BENCH))
    assert rows(decontamination.contamination_report(table(spark), bench)) == exp
    assert not any(r[5] for r in rows(decontamination.contamination_report(table(spark), bench.limit(0))))
    assert decontamination.contamination_report(table(spark, []), bench).count() == 0


def test_removal_of_contamination(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = [(1, "Keep this (one two three four five six seven eight nine ten) and the rest stays as it is, word by word."), (2, "one two three four five six seven eight nine ten"), (3, None), (4, "clean text")]
    out = {r.doc_id: r for r in decontamination.remove_contamination(table(spark, docs), bench).collect()}
    assert out.keys() == {1, 3, 4}
    assert out[1].text == "Keep this (and the rest stays as it is, word by word." and out[1].n_chars == len(out[1].text)
    assert out[3].text is None and out[4].text == "clean text"
    assert decontamination.remove_contamination(table(spark, docs), bench).columns == table(spark).columns


@pytest.mark.parametrize(("hot", "most"), [(20_000, 100_000), (1, 100_000), (1, 0)])
def test_substring_dedup(spark, monkeypatch, hot, most):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(common, "MAX_HOT", most)
    docs = [(d, t) for d, t in documents() if d is not None]
    exp = dict((r[0], r) for r in brute.substring_dedup(docs))
    assert rows(substring_dedup.without_repeats(table(spark, docs))) == ordered(exp[d] for d, _ in docs)
    assert len(rows(substring_dedup.without_repeats(table(spark)))) == len(documents())
    assert substring_dedup.without_repeats(table(spark, [])).count() == 0
    kept = {r.doc_id: r.kept_text for r in substring_dedup.without_repeats(table(spark, docs), with_text=True).collect()}
    assert kept[11] == "" or kept[11] == "x" and kept[10] == ""


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substring_dedup_where_hashes_clash(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    words = lambda n: [f"w{rng.randrange(12)}" for _ in range(n)]
    docs = [(d, t) for d, t in documents() if d is not None]
    for d in range(100, 140):
        a = rng.randrange(30)
        docs.append((d, " ".join(words(rng.randrange(20)) + passage[a : a + rng.randrange(25, 31)] + words(rng.randrange(30)))))
    exp = ordered(brute.substring_dedup(docs + docs[-3:]))
    exp = ordered(next(r for r in exp if r[0] == d) for d, _ in docs)
    clashes = []
    by_words = substring_dedup._by_words
    monkeypatch.setattr(substring_dedup, "_by_words", lambda *a: clashes.append(1) or by_words(*a))
    assert rows(substring_dedup.without_repeats(table(spark, docs), bits=2)) == exp and clashes
    clashes.clear()
    assert rows(substring_dedup.without_repeats(table(spark, docs))) == exp and not clashes


def test_language_model(spark):
    docs = [(d, t) for d, t in documents()[:22]]
    got, exp = rows(lm_scoring.lm_report(table(spark, docs))), ordered(brute.lm(docs))
    assert [r[:5] for r in got] == [r[:5] for r in exp]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in exp])
    held = [(2, "only held out"), (9, None)]
    held = [(d, "held") for d in range(60) if __import__("zlib").crc32(str(d).encode()) % 7 == 2] or held
    assert all(r[4] == 0 for r in rows(lm_scoring.lm_report(table(spark, held))))
    assert lm_scoring.lm_report(table(spark, [])).count() == 0
    assert len(rows(lm_scoring.lm_report(table(spark)))) == len(documents())


@pytest.mark.parametrize("size", [500, 40])
def test_language_model_in_shards(spark, monkeypatch, size):
    monkeypatch.setattr(lm_scoring, "SHARD", size)
    docs = [(d, t) for d, t in documents()[:22]]
    assert np.allclose([r[6] for r in rows(lm_scoring.lm_report(table(spark, docs)))], [r[6] for r in ordered(brute.lm(docs))])


def test_language_model_sums_to_one(spark, tmp_path):
    model = lm_scoring.train(spark.createDataFrame([("a b a c a b",), ("b b c",)], "text string"))
    size = model.vocabulary.size
    for context in range(-1, size + 1):
        p = 10 ** model.log10(np.arange(-1, size), np.full(size + 1, context))
        assert p.sum() == pytest.approx(1)


def test_toxicity(spark):
    rng = random.Random(3)
    plain = ["the", "of", "river", "stone", "light", "wind", "tree", "road", "night", "day"] + [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(plain) for _ in range(40)) + (" you vile moron" if i % 4 == 0 else "")) for i in range(900)] + [(None, "x"), (5000, None), (5001, ""), (3, "repeated")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(900)] + [(None, 1, 1), (7000, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(table(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    assert not any(r.predicted for r in toxicity.toxicity_report(table(spark, docs), labels.limit(0)).collect())
    assert toxicity.toxicity_report(table(spark, []), labels).count() == 0


def test_ftrl_is_sparse():
    model, rng = toxicity.Ftrl(), np.random.default_rng(1)
    for k in range(600):
        x = np.unique(rng.integers(10, 5000, 30))
        model.learn(np.append(np.append(x, 3) if k % 2 else x, toxicity.DIMENSIONS), k % 2)
    w = model.weights(np.arange(5000))
    assert w[3] > 1 and (w != 0).sum() < 400


def test_pii(spark):
    got = pii.pii_report(table(spark)).collect()
    assert ordered((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == ordered((d, *brute.pii(t)) for d, t in documents())
    assert pii.pii_report(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "hit"),
    [
        ("mail john.doe [at] example [dot] com today", "email", "john.doe [at] example [dot] com"),
        ("jane at host dot org", "email", "jane at host dot org"),
        ("ｊａｎｅ＠ｈｏｓｔ．ｏｒｇ", "email", "ｊａｎｅ＠ｈｏｓｔ．ｏｒｇ"),
        ("to jаne@exаmple.com now", "email", "jаne@exаmple.com"),
        ("plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("card four one one one one one one one one one one one one one one one!", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, hit):
    _, added = pii.all_spans(text)
    assert [(k, text[s:e]) for k, s, e in added] == [(kind, hit)]
    assert pii.redact(text) == text.replace(hit, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("plus four 9 one 5 two 0 three 4 six 7", "phone"), ("+4 nine 1 five 5 zero 1 two 3 four", "phone"), ("five five 5 one two 3 four five 6 seven", "phone"),
        ("one dot two dot three dot four", "ip"), ("one.two.three.four", "ip"), ("plus one ſıx 5 five 1 two three 4 fİve", "phone"),
    ],
)
def test_digits_and_words_mixed(text, kind):
    assert pii.redact(f"x: {text}!") == f"x: <{kind.upper()}>!"


def test_spelled_numbers_that_are_announced():
    text = "call me: five five five one two three four five six seven, thanks"
    assert pii.redact(text) == "call me: <PHONE>, thanks" and pii.redact(text.replace("call me", "recall it")) == text.replace("call me", "recall it")


def test_spelling_gate(monkeypatch):
    rng = random.Random(9)
    parts = [*pii.DIGITS, *map(str, range(10)), *"0123456789", "plus", "+", "dot", "point", ".", "Two", "SIX", "ſeven", "sİx", "at", "tone"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", ", ", "-", "", "  ", ". "]) for _ in range(rng.randrange(4, 30))) for _ in range(4000)]
    gated = [pii.all_spans(t) for t in texts]
    monkeypatch.setattr(pii, "_MAY_SPELL", pii.re.compile(""))
    assert gated == [pii.all_spans(t) for t in texts]
    assert sum(bool(added) for _, added in gated) > 200


@pytest.mark.parametrize("text", ["look at this. And dot the i", "meet at noon at the dot", "one two three", "", "at dot", "Привет мир, как дела", "I said one. Two. Three. Four. And left.", "seats: one one two two three three four four five five", "Punkt eins. zwei. drei. vier."])
def test_no_disguise(text):
    assert pii.all_spans(text) == ([], [])


def test_licenses(spark):
    got = license_scans.license_report(table(spark)).collect()
    assert ordered((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == ordered((d, *brute.licenses(t)) for d, t in documents())
    mit = license_scans.TEMPLATES[0][1]
    broken = mit.replace("without restriction including", "with some restriction and including")
    by = {r.doc_id: r for r in license_scans.license_report(table(spark, [(1, f"x {mit.title()}. y"), (2, broken), (3, "of the software and"), (4, "MIT License, released under")])).collect()}
    assert by[1].labels == by[2].labels == "mit" and by[1].score == 1.0 and 0.9 < by[2].score < 1.0
    assert by[3].labels == by[4].labels == "" and by[3].score < 0.2
    assert by[1].spans.startswith("mit:1:")


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("The code is licensed under the terms of the MIT License.", "mit"), ("Released under the permissive MIT license", "mit"),
        ("Licensed under the 2-clause BSD license", "bsd"), ("Distributed under the Apache License, Version 2.0", "apache-2.0"),
        ("licensed under the GNU Affero General Public License v3", "agpl,gpl"), ("You should have received a copy of the GNU Lesser General Public License along with this library", "gpl,lgpl"),
        ("licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), ("licensed under CC BY 4.0", "cc-by"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"), ("The MIT campus is under the bridge, the license office next to it", ""),
        ("licensed under the law of the state and seven other acts, not the MIT license", ""), ("copy of the software under the terms", ""),
    ],
)
def test_notices(text, labels):
    assert ",".join(license_scans.scan(text)[5]) == labels


def chained(template, doc, least, gap):
    """The most words of a template that one chain of its maximal matches in a text covers, by trying all of them."""
    matches = [(d, p, n) for d in range(len(doc)) for p in range(len(template)) for n in [next((n for n in range(min(len(doc) - d, len(template) - p), 0, -1) if doc[d : d + n] == template[p : p + n]), 0)] if n >= least and (not d or not p or doc[d - 1] != template[p - 1])]
    best = {}
    for d, p, n in sorted(matches):
        best[d, p, n] = n
        for (d0, p0, n0), c in list(best.items()):
            over = max(0, d0 + n0 - d, p0 + n0 - p)
            if (d0, p0, n0) != (d, p, n) and over < n and p + over >= p0 + n0 and d + over >= d0 + n0 and max(d - d0 - n0, p - p0 - n0) <= gap:
                best[d, p, n] = max(best[d, p, n], c + n - over)
    return max(best.values(), default=0)


def test_chains_against_all_chains(monkeypatch):
    rng = random.Random(4)
    template = [f"t{i}" for i in range(20)]
    monkeypatch.setattr(license_scans, "TEMPLATES", (("x", " ".join(template)),))
    license_scans._built.cache_clear()
    try:
        for _ in range(300):
            doc, at = [], 0
            while at < 20:
                n = rng.randrange(1, 9)
                doc += template[at : at + n] + ["y"] * rng.choice([0, 1, 3, 11, 14])
                at += n + rng.choice([0, 0, 1, 2, -2]) if at + n > 2 else n
            got = max((share for _, share, _, _ in license_scans.chains([w.encode() for w in doc])), default=0)
            assert got == pytest.approx(min(1.0, chained(template, doc, 4, 12) / 20))
    finally:
        license_scans._built.cache_clear()


def test_suffix_automaton():
    rng = random.Random(5)
    texts = [[rng.randrange(4) for _ in range(40)] for _ in range(3)]
    automaton = license_scans.SuffixAutomaton(texts)
    doc = [rng.randrange(5) for _ in range(300)]
    inside = lambda a, b: [(t, i) for t, x in enumerate(texts) for i in range(len(x)) if x[i - (b - a) + 1 : i + 1] == doc[a:b] and i - (b - a) + 1 >= 0]
    for end, n, state in automaton.maximal_matches(doc):
        assert sorted(automaton.ends[state]) == inside(end - n, end)
        assert end - n == 0 or not inside(end - n - 1, end)
        assert end == len(doc) or not inside(end - n, end + 1)


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(i, t) for i, (_, t) in enumerate(documents())] + [(100, "It's '' '!' don't ''s 12'34 ﬁ İ x <|endoftext|> l'été a\x1cb ’s"), (101, "ǅ ß́ é")]
    got = packing.packed(table(spark, docs)).collect()
    wrong, padding = brute.packing_errors(got, dict(docs), tokenizer)
    assert not wrong and padding < 0.01
    assert packing.packed(table(spark, [])).count() == 0


def test_plain_texts_need_no_whole_tokenizer():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    plain = [c for c in map(chr, range(0x180)) if packing._PLAIN.match(c)]
    rng = random.Random(8)
    texts = ["", " ", "</w>", "İ <|endoftext|> 詞", *plain] + ["".join(rng.choices(plain, k=rng.randrange(200))) for _ in range(300)]
    texts += [" ".join("".join(rng.choices("aeßnöst.,'1", k=rng.randrange(1, 12))) for _ in range(3000))]
    encoder = packing.WordTokenizer(None)
    encoder.pieces.most = 20  # so that pieces are forgotten, and learned again
    assert [e.tolist() for i in range(0, len(texts), 50) for e in encoder.encode(texts[i : i + 50])] == ids(texts)
    encoder = packing.WordTokenizer(None)
    encoder.tokenizer = None  # what is cut and in lower case already doesn't go through it again
    texts = [t for t in texts if packing._PLAIN.match(t) and "<|" not in t]
    assert len(texts) > 500 and [e.tolist() for e in encoder.encode(texts)] == ids(texts)
    assert encoder.encode([]) == []


def test_packing_limits():
    rng = random.Random(2)
    packer = packing.Packer(64, 5, 40)
    items = [(n, rng.randrange(n + 1)) for n in (rng.randrange(1, 150) for _ in range(2500))]
    out = [x for d, (n, loss) in enumerate(items) for x in packer.add(d, n, loss)] + list(packer.finish())
    bins, at = {}, {}
    for b, offset, d, start, length in out:
        assert length > 0
        bins.setdefault(b, []).append((offset, d, start, length))
        at.setdefault(d, []).append((start, length))
    for d, (n, _) in enumerate(items):
        end = 0
        for s, length in sorted(at[d]):
            assert s == end
            end += length
        assert end == n
    for pieces in bins.values():
        assert sum(p[3] for p in pieces) <= 64 and len(pieces) <= 5
        assert sum(packer._loss(s, length, *items[d]) for _, d, s, length in pieces) <= 40
        assert [p[0] for p in sorted(pieces)] == [sum(q[3] for q in sorted(pieces)[:i]) for i in range(len(pieces))]


@pytest.mark.parametrize("size", [3, 10, 20, 31])
def test_packing_of_short_items(size):
    packer = packing.Packer(packing.CAPACITY, packing.MAX_SEGMENTS, packing.CAPACITY)
    added = [x for d in range(3000) for x in packer.add(d, size, size)]
    bins = {}
    for b, offset, d, _, length in added + list(packer.finish()):
        bins.setdefault(b, []).append((offset, length, d))
    totals = [sum(p[1] for p in pieces) for pieces in bins.values()]
    assert sum(totals) == 3000 * size and max(map(len, bins.values())) <= packing.MAX_SEGMENTS
    assert sum(packing.CAPACITY - t for t in totals if t & (t - 1)) < 0.01 * sum(totals)
    if size * packing.MAX_SEGMENTS > packing.CAPACITY:
        assert totals[0] == packing.CAPACITY
    else:
        assert max(map(len, bins.values())) > packing.WAITING


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = np.concatenate([base + rng.normal(size=(40, 16)) * s for s in (0, 0.05, 0.2, 0.35)] + [base[:5]])
    sound = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None, *[1.0] * 15], 1), (1004, sound[0][1], None), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.001], 1), (None, sound[0][1], 0)]
    df = spark.createDataFrame(sound + odd, "vec_id long, embedding array<float>, label int")
    got = rows(embedding_dedup.near_vectors(df))
    exp = ordered([*brute.near_vectors(sound), *((i, int(i in (1006, 1007)), 1006 if i == 1007 else i, i != 1007) for i, _, _ in odd)])
    assert got == exp
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(size=(30, 8)) * 0.1 for c in rng.normal(size=(3, 8))])
    sound = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    got, exp = rows(embedding_dedup.near_vectors(spark.createDataFrame(sound, "vec_id long, embedding array<float>, label int"))), ordered(brute.near_vectors(sound))
    assert all(a[1] <= b[1] for a, b in zip(got, exp, strict=True))  # links are verified
    assert sum(a[1] for a in got) >= 0.9 * sum(b[1] for b in exp)


def family(n, size, edits, seed):
    """Copies of one text with a few words changed: texts that are all somewhat alike, some of them linked."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"n{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("region", "block"), [(24, 256), (2, 8)])
def test_near_duplicates(spark, monkeypatch, region, block):
    monkeypatch.setattr(near_dedup, "REGION", region)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = [(d, t) for d, t in documents() if d is not None] + [(200 + i, t) for i, t in enumerate(family(90, 120, 9, 1))]
    exp = {r[0]: r for r in brute.near_duplicates(docs)}
    assert rows(near_dedup.near_duplicate_report(table(spark, docs))) == ordered(exp[d] for d, _ in docs)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicate_report(table(spark, [])).count() == 0
    got = rows(near_dedup.near_duplicate_report(table(spark, [(1, None), (2, ""), (None, "a b"), (3, "a b")])))
    assert got == [(None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_components(spark):
    from spliceflow.llm.components import components

    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(rows(components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def test_stages_keep_columns(spark, tmp_path):
    docs = table(spark)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (stages.toxicity, stages.near_duplicates, stages.decontaminate, stages.redact_pii):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 10
    assert stages.near_duplicates(spark, docs, str(tmp_path)).where("doc_id in (5, 7, 8, 13)").count() == 0
    assert stages.pack(spark, docs, str(tmp_path)).where("length < 1").count() == 0


def test_stage_joins_near_duplicates_from_80_percent(spark):
    rng = random.Random(10)
    docs = []
    for i in range(60):
        w = [f"w{rng.random()}" for _ in range(49)]
        docs += [(3 * i, " ".join(w)), (3 * i + 1, " ".join([*w[:24], "new", *w[25:]])), (3 * i + 2, " ".join([*w[:20], "a", *w[21:30], "b", *w[31:]]))]
    # 40 of 50 shingles shared is 0.8, 35 of 55 is less
    exp = {r[0] for r in brute.near_duplicates(docs, 80) if r[3]}
    assert len(exp) == 120
    assert {r.doc_id for r in stages.near_duplicates(spark, table(spark, docs), "").collect()} == exp


@pytest.mark.parametrize("text", ["contact me at noon dot and then", "look at main dot py", "error at line dot two", "arrive at rue dot fr"])
def test_prose_with_at_and_dot(text):
    assert pii.all_spans(text) == ([], [])
    assert pii.redact(text) == text


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("x john dot doe at mail dot host dot com y", "john dot doe at mail dot host dot com"), ("me_at_host_dot_org", "me_at_host_dot_org"), ("a@b [at] host.fr!", "b [at] host.fr"),
        ("write jo {at} site (dot) fr.", "jo {at} site (dot) fr"), ("ann at shop dot co dot uk", "ann at shop dot co dot uk"), ("bo @ home dot net", "bo @ home dot net"),
    ],
)
def test_addresses(text, hit):
    assert [text[s:e] for _, s, e in pii.all_spans(text)[1]] == [hit]


@pytest.mark.parametrize("scan", [lambda t: pii.all_spans(t), lambda t: pii.redact(t), license_scans.scan])
@pytest.mark.parametrize("unit", ["x dot ", "a at b dot ", "a_at_", "a [at] b.com ", "one two ", "cc by ", "1.2.3.4 ", "the software is provided as is ", "plus - ", "at ", " ", "@ "])
def test_time_grows_with_length(scan, unit):
    """Twenty times the text takes about twenty times as long: far from the hundreds of a quadratic scan."""
    import time

    def took(n):
        text, least = unit * (n // len(unit)), 1e9
        for _ in range(2):
            began = time.perf_counter()
            scan(text)
            least = min(least, time.perf_counter() - began)
        return least

    assert took(400_000) < 80 * took(20_000) + 0.2


def test_each_copy_of_a_licence():
    mit = license_scans.TEMPLATES[0][1]
    n = len(mit.split())
    *_, score, spans = license_scans.scan(f"{mit} and again {mit}")
    assert score == 1.0 and spans == [("mit", 0, n), ("mit", n + 2, 2 * n + 2)]


def toxic_rows(n=300, seed=3):
    rng = random.Random(seed)
    plain = ["the", "of", "river", "stone", "light", "wind", "tree", "road", "night", "day"] + [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(plain) for _ in range(40)) + (" you vile moron" if i % 4 == 0 else "")) for i in range(n)]
    return docs, [(i, 1, int(i % 4 == 0)) for i in range(n)]


def plain_weights(spark, docs, labels):
    """The order of learning is a hash of the id that Spark computes; all else is plain."""
    kept = {d: y for d, _, y in labels if zlib.crc32(str(d).encode()) % 5}
    ids = spark.createDataFrame([(d,) for d in kept], "doc_id long").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").collect()
    texts = {d: toxicity.features(pa.array([t]))[0].tolist() for d, t in docs if d in kept}
    rows = [(texts[r.doc_id], kept[r.doc_id]) for r in ids if r.doc_id in texts]
    return brute.ftrl(rows, toxicity.DIMENSIONS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.EPOCHS)


def test_weights_are_those_of_plain_ftrl(spark):
    docs, labels = toxic_rows()
    got = toxicity.train(table(spark, docs), toxicity.learning_rows(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    plain = plain_weights(spark, docs, labels)
    assert got.keys() == plain.keys() and len(got) < 3000
    assert np.allclose([got[i] for i in sorted(got)], [plain[i] for i in sorted(plain)])


def test_repeated_ids_teach_the_same_whatever_the_order(spark):
    docs, labels = toxic_rows(60)
    docs += [(d, "another text of the same id") for d, _ in docs[:20]]
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.train(table(spark, docs).orderBy("text"), toxicity.learning_rows(rows))
    two = toxicity.train(table(spark, docs).orderBy(F.desc("text")).repartition(5), toxicity.learning_rows(rows))
    assert one == two


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    docs, labels = toxic_rows()
    rng = random.Random(1)
    near = " ".join(f"n{rng.random()}" for _ in range(60))
    docs += [(1000, near), (1001, near + " tail"), (1002, f"Keep ({BENCH[0][1]}) and the rest of this text, word by word, as it is."), (1003, "one two three four five six seven eight nine ten"),
             (1004, "mail a.b@c.de or jane at host dot org, card 4111 1111-1111 1111"), (1005, None), (1006, ""), (1007, "late " * 9000)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    w = plain_weights(spark, docs, labels)
    clean = [(d, t) for d, t in docs if sum(w.get(i, 0.0) for i in toxicity.features(pa.array([t], pa.string()))[0].tolist()) + w.get(toxicity.DIMENSIONS, 0.0) < 0]
    kept = {r[0] for r in brute.near_duplicates(clean, stages.NEAR_PERCENT) if r[3]}
    left = brute.decontaminated([(d, t) for d, t in clean if d in kept], BENCH)
    exp = {d: None if t is None else pii.redact(t) for d, t in left}
    assert 1001 not in exp and 1003 not in exp and "<EMAIL>" in exp[1004] and "one two" not in exp[1002] and len(exp) < 0.8 * len(docs)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wrong, padding = brute.packing_errors(got, exp, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert not wrong and padding < 0.01


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [])
    for stage in (stages.toxicity, stages.near_duplicates, stages.decontaminate, stages.redact_pii):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert stages.pack(spark, docs, str(tmp_path)).count() == 0
    assert license_scans.license_report(docs).count() == 0


def test_compaction_of_paths(spark):
    runs = [
        (1, 0, 3, 9, 10), (1, 3, 2, 9, 13),  # in step: one path
        (1, 5, 1, 9, 40),  # the source jumps
        (1, 6, 4, 8, 41),  # another source
        (1, 20, 2, 9, 30),  # a gap, at the step of the first path
        (2, 7, 1, 1, 0), (2, 7, 1, 1, 0), (2, 8, 5, 1, 1), (2, 8, 5, 1, 1),  # a repeated row
    ]
    df = spark.createDataFrame(runs, f"uid long, {substring_dedup._SPAN}").repartition(5)
    got = {r.uid: sorted(map(tuple, r.spans)) for r in substring_dedup._compacted(df).collect()}
    more = substring_dedup.K - 1
    assert got == {1: [(0, 5 + more, 9, 10), (5, 1 + more, 9, 40), (6, 4 + more, 8, 41), (20, 2 + more, 9, 30)], 2: [(7, 6 + more, 1, 0)]}


def test_null_ids_in_substring_dedup(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.without_repeats(table(spark, [(None, passage), (1, passage), (None, None)])).collect()}
    assert got == {(None, 0), (1, 30)}  # null stands before all ids


def test_loss_share_in_spark(spark):
    docs = table(spark, [(i, "alpha beta gamma " * (40 + i)) for i in range(200)]).withColumn("share", F.when(F.col("doc_id") % 3 > 0, F.lit(0.25)))
    got = packing.packed(docs, capacity=512, max_loss=200, loss_share="share", with_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    loss, ids = {}, {}
    for r in got:
        n = r.doc_tokens
        bearing = n if r.doc_id % 3 == 0 else round(0.25 * n)
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + packing.Packer._loss(r.start, r.length, n, bearing)
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert max(loss.values()) <= 200
    for d, parts in ids.items():
        assert sum((p for _, p in sorted(parts)), []) == [*tokenizer.encode("alpha beta gamma " * (40 + d), add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("what", ["near_dedup.shingles(t)", "toxicity.features(t)", "substring_dedup._windows(t)", "lm_scoring.tokens(t)", "packing.WordTokenizer(None).encode(t.to_pylist())"])
def test_memory_of_a_long_text(what):
    """One text of 20 MB in a process of its own: no more than 1.3 GB at its peak."""
    code = f"""
import resource, random
import pyarrow as pa
from spliceflow.llm import lm_scoring, near_dedup, packing, substring_dedup, toxicity
rng = random.Random(1)
words = ["w%d" % i for i in range(50000)]
t = pa.array([" ".join(rng.choices(words, k=3_300_000))])
assert len(t[0].as_py()) > 20_000_000
{what}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1300


@pytest.mark.parametrize("wanted", [None, 1024])
def test_recall_of_shared_pivots(spark, wanted):
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(1200, 64)), 4, 0) + rng.normal(size=(4800, 64)) * np.repeat(rng.uniform(0.1, 0.35, 1200), 4)[:, None]
    sound = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(sound, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit("x"), "cls": F.lit(1)})
    got = rows(embedding_dedup.near_vectors(df, wanted=wanted))
    exp = ordered(brute.near_vectors(sound))
    assert all(a[1] <= b[1] for a, b in zip(got, exp, strict=True))
    assert sum(a[1] for a in got) >= 0.98 * sum(b[1] for b in exp) > 1000
