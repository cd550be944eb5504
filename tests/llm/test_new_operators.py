"""URL filters, fill-in-the-middle and the filter audit against plain versions."""

import hashlib
import random
import re
import subprocess
import sys
import time
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from spliceflow.llm import decontamination, embedding_dedup, fill_in_middle, filter_audit, secret_scans, url_filters

from . import brute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PAGES = "page_id long, url string, html string, rule string, host string, address string, row string, token string, judgement string"


def rows(df):
    return ordered(map(tuple, df.collect()))


def ordered(x):
    return sorted(x, key=lambda r: tuple((v is not None, v) for v in r))


def urls():
    rng = random.Random(4)
    hosts = ["a.net", "NET", "xnet", "example.net", "www.Example.NET", "example.com", "de.example.com", "b.org", "org", "casino-win.example.com", "a-casino.org", "adult.example.org", "ads-x.net", "é.net", "", "a.net:80", "casino-win.net"]
    paths = ["", "/", "/en/", "/en/1", "/de/", "/de", "/fr/x", "/EN/", "/wp-login.php", "/x/feed/", "/docs", "/a//en/"]
    tails = ["", "?a=1", "#top", "?u=http://a.net/en/", "#x?y"]
    out = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(400)]
    return out + [None, "", "no scheme/en/", "://", "x://y://net/", "http://a\nb.net/en/\nx", "HTTP://[::1]/", "http://a.net?x://org/fr/", "http://docs.org/" + "a/b-" * 50_000, *["http://a.net/x"] * 5]


def plain_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = {}
    for tier, rules in ((1, url_filters.BASE_RULES), (0, url_filters.OWN_RULES)):
        fits = []
        for verdict, rule in rules:
            h, slash, p = rule.partition("/")
            pattern = ("" if h else "[^/]*") + "[^/]*".join(map(re.escape, h.split("*"))) + (".*".join(map(re.escape, ("/" + p).split("*"))) if slash else "(?![^/])")
            labels = host.split(".")
            if any(re.match(pattern, ".".join(labels[i:]) + path, re.S) for i in range(len(labels))):
                fits.append((len(rule), verdict == "allow", rule, verdict))
        best[tier] = max(fits, default=(0, True, None, None))
    (_, _, base, v1), (_, _, own, v0) = best[1], best[0]
    return host, path, base, v1 or v0 or "allow", None if base else own


@pytest.mark.parametrize("most", [1000, 0])
def test_url_filters(spark, monkeypatch, most):
    monkeypatch.setattr(url_filters, "MAX_RULES", most)
    monkeypatch.setattr(url_filters, "HOT", 10)
    listed = [(None if i % 9 == 0 else i // 2, u, "h", "r", "x", "y", "z", "t", "j") for i, u in enumerate(urls())]
    pages = spark.createDataFrame(listed, PAGES).repartition(3)
    assert rows(url_filters.url_report(pages)) == ordered((r[0], *plain_verdict(r[1])) for r in listed)
    assert url_filters.url_report(pages.limit(0)).count() == 0


def test_rules_and_index(spark, monkeypatch):
    given = [
        ("block", "a.b/x-y/z", 0), ("allow", "*foo*/q", 0), ("block", "c.net", 0), ("allow", "c.net", 0), ("block", "/only/path/", 0), (None, "n.net", 0), ("block", None, 0), ("block", "", 0),
        ("other", "o.net", 0), ("block", r"we.ird/\E[x]\Q", 0), ("block", "a*.b/*x/", 0),
    ]
    rules = spark.createDataFrame(given, "verdict string, rule string, tier int")
    found = {r.rule: r for r in url_filters.compiled(rules).collect()}
    assert {k: sorted(r.literals) for k, r in found.items()} == {
        "a.b/x-y/z": ["a", "b", "x", "y"], "*foo*/q": [], "c.net": ["c", "net"], "/only/path/": ["only", "path"], r"we.ird/\E[x]\Q": ["E", "ird", "we", "x"], "a*.b/*x/": ["b"],
    }
    assert found["c.net"].verdict == "allow"
    pages = spark.createDataFrame([(u,) for u in ["x://c.net", "x://c.net/y", "x://d.c.net?z", "x://cc.net", "x://c.net.org/", "x://any/only/path/1", "x://q/only/pathx", r"x://WE.ird/\E[x]\Q1", "x://zzfoo/q1", "x://a1.b/uxx/", "x://a.b/x-y/zz"]], "url string")
    got = {r.url: r.judgement.rule for r in url_filters.judged(pages, rules).collect()}
    assert list(got.values()) == ["c.net", "c.net", "c.net", None, None, "/only/path/", None, r"we.ird/\E[x]\Q", "*foo*/q", "a*.b/*x/", "a.b/x-y/z"]
    addresses = spark.createDataFrame([("c.net",), ("d.net",), ("a.b/x-q",)], "address string")
    assert {r.rule: r.token for r in url_filters.index(rules, addresses).collect()} == {
        "a.b/x-y/z": "y", "*foo*/q": "", "c.net": "c", "/only/path/": "only", r"we.ird/\E[x]\Q": "ird", "a*.b/*x/": "b",
    }
    assert {r.judgement.verdict for r in url_filters.judged(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_rules_are_linear(spark):
    """Hosts and paths on which nested backtracking would take hours."""
    rules = spark.createDataFrame([("block", r, 0) for r in ("ads-*-x*-y.net/", "*a*b*c*d/", "z.*q/*/e*/f*/g", "a.a.a/")], "verdict string, rule string, tier int")
    pages = spark.createDataFrame([("x://" + "ads-.-x.a.b.c.z.q" * 20_000 + "/" + "u/e1/f2/" * 20_000,), ("x://ads-1-x2-y.net/",), ("x://yacbdcd/",), ("x://z.aqbq/u/e/f1/g",), ("x://yadbccd.net/",)], "url string")
    assert [r.judgement.rule for r in url_filters.judged(pages, rules).select("url", "judgement").collect()] == [None, "ads-*-x*-y.net/", "*a*b*c*d/", "z.*q/*/e*/f*/g", None]


def fim_documents():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["ab", "é", "😀", " ", "  ", "\n", "x", "\u00a0", "<", "P>"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    return docs + [(400, None), (401, ""), (402, "   "), (403, "has <S> mark"), (404, "one"), (405, " lead"), (406, "trail \t"), (None, "null id text here"), (None, None), (407, "w" * 3000), *docs[:20]]


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(tokens)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 3, 8192])
def test_fill_in_middle(spark, monkeypatch, chunk):
    monkeypatch.setattr(fill_in_middle, "CHUNK", chunk)
    docs = spark.createDataFrame([(d, t, "f", "n", "c") for d, t in fim_documents()], "doc_id long, text string, form string, n string, chunks string").repartition(3)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    exp = ordered((d, *f[:4], sha(f[4]), sha(t)) for d, t in fim_documents() for f in [plain_fim(d, t)])
    assert rows(fill_in_middle.fim_report(docs)) == exp
    made = fill_in_middle.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim"]
    assert ordered((r.doc_id, r.text, *r.fim) for r in made.collect()) == ordered((d, t, *plain_fim(d, t)) for d, t in fim_documents())
    assert fill_in_middle.fim_report(docs.limit(0)).count() == 0
    assert {f for f in made.select("fim.form").distinct().toPandas()["form"]} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_long_texts(spark):
    text = F.concat(F.repeat(F.lit("some words é "), 400_000), F.col("id").cast("string"))
    docs = spark.range(6).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = rows(fill_in_middle.fim_report(docs))
    assert all(r[5] != r[6] or r[2] == "plain" for r in got) and {r[1] for r in got} == {1_200_001}
    assert [r[6] for r in got] == [r[0] for r in docs.orderBy("doc_id").select(F.sha2("text", 256)).collect()]


AUDITED = "doc_id long, text string, lang string, part string, h string, n string, word string, fails string"


def audited():
    rng = random.Random(6)
    text = lambda n, of: " ".join(rng.choice(["w", "W", "Ä", "x|y", "a#"] if rng.random() < 0.02 else ["word"]) + str(rng.randrange(of)) for _ in range(n))
    docs = [(i, text(rng.choice([3, 199, 200, 201, 400]), rng.choice([5, 90, 4000])), rng.choice(["en", "de", None, ""])) for i in range(250)]
    copies = [(1000 + i, docs[7][1], "en") for i in range(30)] + [(0, docs[9][1], "fr")]
    odd = [(2000, None, "en"), (2001, "", "en"), (None, "", "de"), (None, docs[7][1], None), (None, None, "de"), (2002, "A " * 300, "en"), (2003, "AAAA" + "b" * 129, "en"), (2004, " \t", "en")]
    return docs + copies + odd + docs[:12] + copies[:2]


def plain_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    texts = {}
    for d, t, _ in docs:
        if d is not None:
            texts[t or ""] = min(d, texts.get(t or "", d))
    found = []
    for d, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > texts[t]}
        found.append((lang or "", {f for f, v in fails.items() if v}, d in good, d in toxic))
    out = []
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {x[0] for x in found}:
        mine = [x[1:] for x in found if x[0] == part]
        shapley = {f: sum(f in s and not s & set(o[: o.index(f)]) for s, _, _ in mine for o in orders) for f in "ABCDE"}
        for o in orders:
            for i, f in enumerate(o):
                gone = [x for x in mine if f in x[0] and not x[0] & set(o[:i])]
                out.append((
                    part, o, i + 1, sum(not x[0] & set(o[: i + 1]) for x in mine), len(gone), sum(f in x[0] and bool(x[0] & set(o[:i])) for x in mine), sum(x[0] == {f} for x in mine),
                    sum(x[1] for x in gone), sum(x[2] for x in gone), shapley[f],
                ))
    return ordered(out)


def test_filter_audit(spark):
    rng = random.Random(7)
    docs = audited()
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1), (7, 1, 0), (7, 0, 1), (1003, 1, 1)]
    table = spark.createDataFrame([(*d, "p", "h", "n", "w", "f") for d in docs], AUDITED).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows(filter_audit.filter_audit(table, said)) == plain_audit(docs, labels)
    assert rows(filter_audit.filter_audit(table, said.limit(0))) == plain_audit(docs, [])
    assert filter_audit.filter_audit(table.limit(0), said).count() == 0


def test_words_of_a_very_long_text(spark):
    docs = spark.range(2).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: (i % 70_000).cast("string"))).alias("text"))
    got = filter_audit.word_counts(docs.select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("h"), "text"))
    assert rows(got) == [(0, 1, 1_000_000, 70_000), (1, 1, 1_000_000, 70_000)]


@pytest.mark.parametrize("share", [40, 300, 1_000_000])
def test_words_are_exploded_where_they_are_counted(spark, monkeypatch, share):
    """What is dealt out is a list of words for each ordinary text; results are the same where texts are dealt out by word."""
    monkeypatch.setattr(filter_audit, "SHARE", share)
    texts = [*{t or "" for _, t, _ in audited()}, " " * 500, " \t" * 20 + "x" + " " * 300]
    docs = [(i % 50 or None, i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(docs + docs[:20] + [(1, -1, None)], "doc_id long, h long, text string").repartition(3)
    got = filter_audit.word_counts(table)
    words = [(d, h, WORDS.findall(t)) for d, h, t in docs] + [(1, -1, [])]
    assert rows(got) == ordered((d, h, len(w), len(set(w))) for d, h, w in words)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Generate explode[^\n]*\[word#.*REPARTITION_BY_COL", plan, re.S)


@pytest.mark.parametrize("module", [url_filters, fill_in_middle, filter_audit])
def test_sql_of_new_operators(spark, tmp_path, module):
    """The SQL too holds on the odd rows above."""
    con = duckdb.connect()
    documents = [(d, t, lang) for d, t, lang in audited()] + [(d, t, None) for d, t in fim_documents()]
    tables = {
        "documents": spark.createDataFrame(documents, "doc_id long, text string, lang string"), "pages": spark.createDataFrame(list(enumerate(urls())), "page_id long, url string"),
        "labels": spark.createDataFrame([(d, d % 2, int(d % 3 == 0)) for d in range(0, 200, 3)], "doc_id long, quality int, toxic int"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
        tables[name] = spark.read.parquet(str(tmp_path / name))
    report = {url_filters: lambda: url_filters.url_report(tables["pages"]), fill_in_middle: lambda: fill_in_middle.fim_report(tables["documents"]), filter_audit: lambda: filter_audit.filter_audit(tables["documents"], tables["labels"])}
    df = report[module]()
    exp = con.execute(module.ORACLE_SQL)
    names = [c[0] for c in exp.description]
    assert rows(df.select(*names)) == ordered(map(tuple, exp.fetchall()))


def seconds(df):
    began = time.perf_counter()
    return df.collect(), time.perf_counter() - began


@pytest.mark.parametrize("what", ["secrets", "entropy", "contamination"])
def test_many_spans_in_one_text(spark, what):
    """Through Spark: a text of 5 MB full of spans takes far less than the square of the time of a short one."""
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    unit = {"secrets": "token=abcdefgh1 ", "entropy": "api_key=q7Rk2Zp9Xw4Lm8Tb3Vn6 q7Rk2Zp9Xw4Lm8Tb3Vn6 ", "contamination": "one two three four five six seven eight nine ten pad word and this stays "}[what]
    run = {"secrets": secret_scans.secret_report, "entropy": secret_scans.secret_report, "contamination": lambda df: decontamination.remove_contamination(df, bench, drop_share=2.0)}[what]
    size = 250_000 if what == "entropy" else 5_000_000
    table = lambda n: spark.createDataFrame([(1, n)], "doc_id long, n long").select("doc_id", F.expr(f"repeat('{unit}', n)").alias("text"))
    short, long = (size // 50 // len(unit), size // len(unit))
    seconds(run(table(2)))
    _, few = seconds(run(table(short)))
    got, many = seconds(run(table(long)))
    assert many < 120 * few and many < 100
    if what == "secrets":
        assert got[0].n_assign == long and got[0].spans.endswith(f",assign:{16 * long - 16}:{16 * long - 1}")
    elif what == "entropy":
        one, n = len(unit), min(3, long)
        assert got[0].spans.split(",")[: 2 * n] == [x for i in range(n) for x in (f"assign:{one * i}:{one * i + 28}", f"entropy:{one * i + 29}:{one * i + 49}")]
    else:
        assert got[0].text == "pad word and this stays " * long


def test_scan_over_blocks(spark):
    rng = random.Random(2)
    for n in (0, 1, 127, 128, 129, 1000):
        values = [rng.randrange(100) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, tops = df.select(secret_scans.scanned(F.col("v"), F.lit(0), lambda a, b: a + b), secret_scans.scanned(F.col("v"), F.lit(-1), F.greatest)).first()
        assert sums == [sum(values[:i]) for i in range(n)] and tops == [max(values[:i], default=-1) for i in range(n)]


def test_merging_and_removing_spans(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(60))) for i in range(60)]
    bench = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(3))) for i in range(4)]
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert rows(decontamination.contamination_report(*given)) == ordered(brute.contamination(docs, bench))
    assert rows(decontamination.remove_contamination(*given)) == ordered(brute.decontaminated(docs, bench))


def test_memory_of_many_pivots(spark):
    """A batch of vectors against 16,384 pivots, in a process of its own: no more than 0.6 GB beyond what it starts with."""
    code = """
import resource
import numpy as np
import pyarrow as pa
from spliceflow.llm import embedding_dedup as e
held = {}
class Classes:
    schema = {k: type('F', (), {'dataType': type('T', (), {'simpleString': lambda self: 'bigint'})()})() for k in ('cls', 'label')}
    class sparkSession:
        class sparkContext:
            broadcast = staticmethod(lambda v: type('B', (), {'value': v})())
    def select(self, *names):
        return self
e.in_arrow = lambda df, fn, schema: held.update(fn=fn)
rng = np.random.default_rng(1)
pivots = list(rng.normal(size=(16384, 64)))
e._described(Classes(), pivots, [64] * 16384, 12)
x = rng.normal(size=(7700, 64))
batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(7701, dtype=np.int32) * 64, pa.array(x.ravel()))], ['v'])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
(out,) = held['fn'](iter([batch]))
near = np.array(out.column('near').to_pylist())
for i in (0, 5000, 7699):
    like = np.array(pivots) @ x[i]
    assert near[i].tolist() == np.argsort(-like, kind='stable')[:12].tolist()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 600


def test_sample_for_pivots(spark):
    df = spark.range(20_000).select(F.col("id").alias("cls"), F.array(F.col("id").cast("double")).alias("v"))
    got = embedding_dedup._sample(df, 20_000, 500)
    assert len(got) == 500 and len({float(x[0]) for x in got}) == 500
    assert [x.tolist() for x in embedding_dedup._sample(df.repartition(7), 20_000, 500)] == [x.tolist() for x in got]
    assert len(embedding_dedup._sample(df.limit(40), 40, 500)) == 40


def test_steps_of_components(spark, monkeypatch):
    """Random links against a plain union, with no step once the links are stars."""
    from spliceflow.llm import components

    taken, step = [], components._step
    monkeypatch.setattr(components, "_step", lambda edges: taken.append(1) or step(edges))
    rng = random.Random(4)
    stars = [(3 * i, 3 * i + j) for i in range(20) for j in (1, 2)]
    chance = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    for links, steps in ((stars, 0), ([(b, a) for a, b in stars] + stars, 0), ([], 0), ([(1, 1), (None, 2)], 0), (chance, None), ([(i, i + 1) for i in range(30)], None)):
        taken.clear()
        root = {x: x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
        for _ in root:
            for a, b in links:
                if a in root and b in root:
                    root[a] = root[b] = min(root[a], root[b])
        got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted(root.items())
        assert len(taken) == steps if steps is not None else taken
