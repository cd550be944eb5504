"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re

ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def secrets(text):
    text = text or ""
    kinds = {"assign": [], "access": [], "hex": []}
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            kinds["assign"].append(m.span())
    kinds["access"] = [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    kinds["hex"] = [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = sorted((s, list(kinds).index(k), e, k) for k, v in kinds.items() for s, e in v)
    return {k: len(v) for k, v in kinds.items()}, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in order))


def contamination(docs, bench, n=10):
    grams = {}
    for item, text in bench:
        w = ALNUM_WORD.findall(lower(text))
        for i in range(len(w) - min(n, len(w)) + 1) if w else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, items = ALNUM_WORD.findall(lower(text)), set(), set()
        for i in range(len(w)):
            for size in sizes:
                if (found := grams.get(tuple(w[i : i + size]))) and i + size <= len(w):
                    hit |= set(range(i, i + size))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return out


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    spans = [(k, *m.span()) for k, p, ok in found for m in re.finditer(p, text) if ok(m[0])]
    counts = tuple(sum(x[0] == k for x in spans) for k, _, _ in found)
    return (*counts, sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans)))


def licenses(text):
    w = ALNUM_WORD.findall(lower(text))
    at, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def packing_errors(rows, docs, tokenizer, end=2, capacity=4096):
    """What is wrong with packed rows; and the padding as a share of the tokens."""
    import zlib

    import numpy as np

    wrong, by_doc, by_seq = [], {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    if by_doc.keys() != docs.keys():
        wrong.append("documents differ")
    for doc, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            if r.start != at or r.doc_tokens != len(ids) or r.ids_crc32 != zlib.crc32(part):
                wrong.append(("piece", r))
            at += r.length
        if at != len(ids):
            wrong.append(("document", doc))
    pad = total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            if r.offset != at:
                wrong.append(("offset", r))
            at += r.length
        if at > capacity:
            wrong.append("too long")
        pad += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return wrong, pad / max(1, total)


def near_duplicates(docs, percent=85):
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    for d, s in sets.items():
        shared = {}
        for g in s:
            for o in where[g]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def substring_dedup(docs, k=20):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", text or "") for d, text in docs}
    first = {}
    out = []
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), (d, i)) != (d, i):
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha(kept)))
    return out


def lm(docs):
    """Base scores and an interpolated modified Kneser-Ney bigram model, from Counters."""
    import math
    import zlib
    from collections import Counter

    toks = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    uni, bi = Counter(), Counter()
    for d, w in toks.items():
        if not held[d]:
            uni.update(w)
            bi.update(zip(["<start>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        c = Counter(min(x, 5) for x in counts)
        if not c[1] or not c[2]:
            return [0.0, 0.5, 1.0, 1.5]
        y = c[1] / (c[1] + 2 * c[2])
        return [0.0] + [min(max(k - (k + 1) * y * (c[k + 1] / c[k] if c[k] else 0), 0), k) for k in (1, 2, 3)]

    context, follows, seen = Counter(), {}, Counter()
    for (u, w), c in bi.items():
        context[u] += c
        follows.setdefault(u, Counter())[min(c, 3)] += 1
        seen[w] += 1
    d2, d1 = discounts(bi.values()), discounts(seen.values())
    rest = sum(d1[min(c, 3)] for c in seen.values()) / len(bi)
    p1 = lambda w: (seen[w] - d1[min(seen[w], 3)]) / len(bi) + rest / (v + 1)

    def p2(u, w):
        if u not in context:
            return p1(w)
        c = bi[u, w]
        return (c - d2[min(c, 3)]) / context[u] + sum(d2[k] * m for k, m in follows[u].items()) / context[u] * p1(w)

    out = []
    for d, w in toks.items():
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p2(u, x)) for u, x in zip(["<start>", *w], w, strict=False))
        out.append((d, held[d], len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def near_vectors(rows, least=0.93):
    """rows: (id, vector, label), all sound. (id, n_links, component, kept) by comparing all pairs of a label."""
    import numpy as np

    out = []
    for label in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == label), key=lambda r: r[0])
        x = np.array([r[1] for r in mine], float)
        norm = np.sqrt((x * x).sum(1))
        linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
        np.fill_diagonal(linked, False)
        comp = list(range(len(mine)))
        for i in range(len(mine)):
            if comp[i] == i:
                stack = [i]
                while stack:
                    for j in np.flatnonzero(linked[stack.pop()]).tolist():
                        if comp[j] == j and j != i:
                            comp[j] = i
                            stack.append(j)
        out += [(r[0], int(linked[i].sum()), mine[comp[i]][0], comp[i] == i) for i, r in enumerate(mine)]
    return out


def ftrl(rows, dims, alpha, beta, l1, l2, epochs):
    """FTRL-proximal from its formulas, one coordinate at a time. rows: (features, y) in order of learning."""
    import math

    z, n = {}, {}

    def weight(i):
        penalty = 0.0 if i == dims else l1
        if abs(z.get(i, 0.0)) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for features, y in rows:
            at = [*features, dims]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in at:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i]
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def decontaminated(docs, bench, n=10, drop_share=0.8):
    """(doc, text) without hit words and what follows them; without documents that consist of them for the most part."""
    grams = set()
    for _, text in bench:
        w = ALNUM_WORD.findall(lower(text))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        spans = [m.span() for m in ALNUM_WORD.finditer(text or "")]
        w = [lower(text[a:b]) for a, b in spans]
        hit = {j for i in range(len(w)) for size in sizes if i + size <= len(w) and tuple(w[i : i + size]) in grams for j in range(i, i + size)}
        if not hit:
            out.append((doc, text))
        elif len(hit) < drop_share * len(w):
            ends = [a for a, _ in spans[1:]] + [len(text)]
            out.append((doc, text[: spans[0][0]] + "".join(text[a:e] for i, ((a, _), e) in enumerate(zip(spans, ends, strict=True)) if i not in hit)))
    return out
