"""Licence texts in documents: matching statistics from a suffix automaton of licence tokens, chained into template spans.

The automaton is of fixed size (the templates below), so each task builds its own once. A document is streamed
through it word by word; runs without enough licence words never enter.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, map_text

# Wordings of public licences and notices, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "licensed under the bsd license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "shared under cc by 4 0"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2.0", "distributed under the apache license version 2 0"),
    ("apache-2.0", "licensed under apache 2 0"),
    ("bsd", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd", "distributed under the bsd license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2.0", "licensed under the mozilla public license"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("reserved", "all rights reserved"),
)
# The base phrases and their labels.
PHRASES = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

#: A match of fewer words is no anchor. In a notice, a template of at most NOTICE words, SHORT_MATCH will do, or all of it.
MIN_MATCH, SHORT_MATCH, NOTICE = 4, 2, 8
#: Words that a chain may skip between two anchors, in a notice (only of the document) and in others, and the share of a template that makes its label.
NOTICE_GAP, MAX_GAP, ENOUGH = 4, 12, 0.7


def _rule(words: int) -> tuple[int, int, int]:
    """The shortest anchor, and the widest gap in the document and in the template, for a template of so many words."""
    return (min(words, 3 if words <= 3 else SHORT_MATCH), NOTICE_GAP, 0) if words <= NOTICE else (MIN_MATCH, MAX_GAP, MAX_GAP)


_TO_SPACE = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE).split(b" ") if text else []


class SuffixAutomaton:
    """Of several token sequences, each closed by a token of its own, so that no match runs over an end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        last = 0
        for n, tokens in enumerate(sequences):
            for i, c in enumerate([*tokens, -1 - n]):
                last = self._extend(last, c)
                if i < len(tokens):
                    self.ends[last].append((n, i))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]

    def _extend(self, last: int, c: int) -> int:
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy] = self.link[q]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def _state(self, to: dict[int, int], length: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(0)
        self.ends.append([])
        return len(self.next) - 1

    def maximal_matches(self, tokens: list[int]):
        """(end, length, state) for each longest match that the next token can't lengthen."""
        state = length = 0
        for i, c in enumerate(tokens):
            if c not in self.next[state]:
                if length >= 1:
                    yield i, length, state
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            else:
                state = length = 0
        if length:
            yield len(tokens), length, state


def _shorter(automaton: SuffixAutomaton, sequences: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """For each state (template, last word, length) of the places where only a shorter end of its match stands."""
    out: list[list[tuple[int, int, int]]] = []
    for state in range(len(automaton.link)):
        seen, found, up = set(automaton.ends[state]), [], automaton.link[state]
        while up > 0:
            found += [(t, i, automaton.length[up]) for t, i in automaton.ends[up] if (t, i) not in seen and automaton.length[up] >= _rule(len(sequences[t]))[0]]
            seen.update(automaton.ends[up])
            up = automaton.link[up]
        out.append(found)
    return out


@functools.cache
def _built() -> tuple[dict[bytes, int], list[list[int]], SuffixAutomaton, list[list[tuple[int, int, int]]], int]:
    vocabulary: dict[bytes, int] = {}
    sequences = [[vocabulary.setdefault(w, len(vocabulary)) for w in t.encode().split()] for _, t in TEMPLATES]
    automaton = SuffixAutomaton(sequences)
    return vocabulary, sequences, automaton, _shorter(automaton, sequences), min(_rule(len(t))[0] for t in sequences)


def chains(doc: list[bytes]) -> list[tuple[int, float, int, int]]:
    """(template, share of its words that the chain covers, and the chain's word span), of one template without overlaps.

    Matches are chained in order of both texts with gaps of a few words (see _rule). Chains with more words go first; a
    place where a template stands again gives another chain.
    """
    vocabulary, sequences, automaton, shorter, least = _built()
    ids = np.fromiter((vocabulary.get(w, -1) for w in doc), np.int32, len(doc))
    known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
    anchors: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
        if b - a < least:
            continue
        for end, n, state in automaton.maximal_matches(ids[a:b].tolist()):
            if n >= least:
                for t, i in automaton.ends[state]:
                    if n >= _rule(len(sequences[t]))[0]:
                        anchors.setdefault(t, []).append((a + end - n, i - n + 1, n))
                for t, i, m in shorter[state]:
                    anchors.setdefault(t, []).append((a + end - m, i - m + 1, m))
    out = []
    for t, found in anchors.items():
        found.sort()
        _, gap, skips = _rule(len(sequences[t]))
        done: list[tuple[int, int, int, int]] = []  # document end, template end, covered, document start of the chain
        for d, p, n in found:
            covered, first = n, d
            for d_end, p_end, c, f in reversed(done):
                if d - d_end > gap + len(sequences[t]):
                    break
                over = max(0, d_end - d, p_end - p)
                if over < n and p + over >= p_end and d + over >= d_end and d - d_end <= gap and p - p_end <= skips and c + n - over > covered:
                    covered, first = c + n - over, f
            done.append((d + n, p + n, covered, first))
        taken: list[tuple[int, int]] = []
        for end, _, covered, first in sorted(done, key=lambda x: (-x[2], x[3], x[0])):
            i = bisect.bisect(taken, (first, end))
            if (not i or taken[i - 1][1] <= first) and (i == len(taken) or taken[i][0] >= end):
                taken.insert(i, (first, end))
                out.append((t, min(1.0, covered / len(sequences[t])), first, end))
    return out


def best(found: list[tuple[int, float, int, int]], n_words: int) -> list[tuple[str, int, int]]:
    """(label, start, end) of the chains that make a label. Where texts of several licences fit the same words, the one
    with more words covered stays; of these, the one that is covered to a larger share."""
    owner, numbers, out = np.zeros(n_words, np.int16), {}, []
    for t, _, s, e in sorted((x for x in found if x[1] >= ENOUGH), key=lambda x: (-round(x[1] * len(TEMPLATES[x[0]][1].split())), -x[1], x[2], x[0])):
        number = numbers.setdefault(TEMPLATES[t][0], len(numbers) + 1)
        part = owner[s:e]
        if ((part == 0) | (part == number)).all():
            part[:] = number
            out.append((TEMPLATES[t][0], s, e))
    return sorted(out)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float, list[tuple[str, int, int]]]:
    """n_words, n_base, first and last base word, base labels, all labels, score, and (label, start, end) word spans."""
    doc = [w for w in words(text) if w]
    joined = b" " + b" ".join(doc) + b" "
    places: list[int] = []
    base = set()
    for phrase, label in PHRASES:
        word = last = 0
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            word, last = word + joined.count(b" ", last, at), at
            places.append(word)
            base.add(label)
            at = joined.find(b" " + phrase + b" ", at + 1)
    found = chains(doc) if doc else []
    spans = best(found, len(doc))
    score = max([1.0 * bool(base), *(share for _, share, _, _ in found)])
    return len(doc), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | {x[0] for x in spans}), score, spans


def license_report(df: DataFrame) -> DataFrame:
    """One row per document: places of the base phrases, labels, and as score the best share of a licence text found.

    Null and empty texts have no words and score 0. Rows are judged alone, so repeated rows get equal results. The
    spans column lists label:start:end in words, for each copy of a licence text. Time and memory grow with a text's
    length (some 100 bytes a word). Other columns don't matter. No shuffle.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        n_words, n_base, first, last, base, labels, score, spans = zip(*rows, strict=True) if rows else [()] * 8
        long = lambda x: pa.array(x, pa.int64())
        text = lambda x: pa.array([",".join(v) for v in x], pa.string())
        told = [[f"{k}:{s}:{e}" for k, s, e in x] for x in spans]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), long(n_words), long(n_base), long(first), long(last), text(base), text(labels), pa.array(score, pa.float64()), text(told)],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    id_type = df.schema["doc_id"].dataType.simpleString()
    return map_text(df.select("doc_id", "text"), find, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
