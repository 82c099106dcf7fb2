"""License scans by template-markup matching.

A template is plain wording with two kinds of marked regions: ``<<optional>>...<</optional>>`` may be
absent, ``<<var words=a-b>>`` stands for any a to b words. A template is compiled to an automaton over
word tokens: a state for each word, epsilon moves over optional regions, and counted wildcard states
for replaceable ones. It accepts where all mandatory wording follows word for word; case, punctuation
and white space are no part of words. Texts are searched whole, at every word that can begin a match.

Besides, plain phrases are looked for in each text (``PHRASES``); a text's labels are those of the
phrases and of the templates that match.

Work is row by row in Arrow batches, without a shuffle; memory is bounded by the longest text.

Templates of a few words find mentions of a licence; those that end in ``-notice`` are the whole standard
notices, and MIT, ISC, both BSD and the Unlicense are whole texts, every mandatory word of them.

Defined results: null text counts as empty (0 words, no labels, score 0); texts are searched whole, however
long; repeated rows repeat their results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import filled, map_rows, strings

#: Bytes that stand in words: digits, letters (A-Z lower-cased) and all beyond ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND <<var words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var words=1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL <<var words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at <<var words=4-8>> Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
_GNU_NOTICE = """is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version. <<var words=2-6>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public
License for more details."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at <<var words=4-6>>"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<var words=0-1>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. <<var words=0-1>> Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
#: Label and template.
TEMPLATES = [
    ("apache-2.0", "<<optional>>Licensed under<</optional>> the Apache License, Version 2.0"),
    ("apache-2.0", "<<optional>>Licensed under the<</optional>> Apache License <<optional>>Version<</optional>> 2.0"),
    ("cc-by-4.0", "CC BY <<optional>>Creative Commons Attribution<</optional>> 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International <<optional>>Public License<</optional>>"),
    ("cc-by-nc-4.0", "CC BY NC 4.0"),
    ("cc-by-nc-4.0", "Creative Commons Attribution NonCommercial 4.0 <<optional>>International<</optional>>"),
    ("cc-by-nc-nd-4.0", "CC BY NC ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY NC SA 4.0"),
    ("cc-by-nd-4.0", "CC BY ND 4.0"),
    ("cc-by-sa-4.0", "CC BY SA 4.0"),
    ("cc0-1.0", "CC0 1.0 <<optional>>Universal<</optional>>"),
    ("gpl-2.0", "<<optional>>licensed under the<</optional>> GNU General Public License <<optional>>as published by the Free Software Foundation either<</optional>> version 2"),
    ("gpl-3.0", "<<optional>>licensed under the<</optional>> GNU General Public License <<optional>>as published by the Free Software Foundation either<</optional>> version 3"),
    ("mit", "<<optional>>Released under<</optional>> the MIT License"),
    ("mit", "<<optional>>The MIT License<</optional>> <<optional>>Copyright <<var words=1-12>><</optional>> " + _MIT_BODY),
    ("isc", _ISC_BODY),
    ("bsd-3-clause", _BSD_HEAD + " <<var words=0-1>> Neither the name of <<var words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("bsd-2-clause", _BSD_HEAD + " " + _BSD_TAIL),
    ("unlicense", _UNLICENSE),
    ("apache-2.0-notice", _APACHE_NOTICE),
    ("gpl-2.0-notice", _GNU_NOTICE.format(name="", version="2")),
    ("gpl-3.0-notice", _GNU_NOTICE.format(name="", version="3")),
    ("lgpl-2.1-notice", _GNU_NOTICE.format(name="Lesser", version="2.1")),
    ("lgpl-3.0-notice", _GNU_NOTICE.format(name="Lesser", version="3")),
    ("agpl-3.0-notice", _GNU_NOTICE.format(name="Affero", version="3")),
    ("mpl-2.0-notice", _MPL_NOTICE),
]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


@dataclass
class Automaton:
    """step[s]: word to next state; wild[s]: next state of any word; skip[s]: states reached without
    a word; need[s]: mandatory words before the state; the last state accepts."""

    label: str
    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    wild: list[int | None] = field(default_factory=lambda: [None])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    need: list[int] = field(default_factory=lambda: [0])
    anchor: frozenset[bytes] = frozenset()

    def _add(self, need: int) -> int:
        self.step.append({})
        self.wild.append(None)
        self.skip.append([])
        self.need.append(need)
        return len(self.step) - 1

    def closure(self, states) -> set[int]:
        out, stack = set(states), list(states)
        while stack:
            for s in self.skip[stack.pop()]:
                if s not in out:
                    out.add(s)
                    stack.append(s)
        return out

    def first(self) -> frozenset[bytes]:
        """Words that can begin a match."""
        return frozenset(w for s in self.closure([0]) for w in self.step[s])

    def run(self, words: list[bytes], at: int) -> tuple[int | None, int]:
        """End of the longest match that begins at ``at`` (or None), and the most mandatory words met."""
        states, end, most = self.closure([0]), None, 0
        last = len(self.step) - 1
        for i in range(at, len(words) + 1):
            if last in states:
                end = i
            most = max(most, max(self.need[s] for s in states))
            if i == len(words):
                break
            w = words[i]
            onward = {t for s in states if (t := self.step[s].get(w)) is not None}
            onward |= {t for s in states if (t := self.wild[s]) is not None}
            if not onward:
                break
            states = self.closure(onward)
        return end, most


def compile_template(label: str, text: str) -> Automaton:
    """The automaton of a template; optional regions may be nested."""
    a = Automaton(label)
    now, need, depth, opened, mandatory = 0, 0, 0, [], []
    for part in re.split(r"(<<.*?>>)", text):
        if part == "<<optional>>":
            opened.append(now)
        elif part == "<</optional>>":
            start = opened.pop()
            into = a._add(need)
            a.skip[now].append(into)
            a.skip[start].append(into)
            now = into
        elif m := re.fullmatch(r"<<var words=(\d+)-(\d+)>>", part):
            least, most = int(m[1]), int(m[2])
            leave = []
            for k in range(most):
                if k >= least:
                    leave.append(now)
                onward = a._add(need)
                a.wild[now] = onward
                now = onward
            into = a._add(need)
            for s in [*leave, now]:
                a.skip[s].append(into)
            now = into
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part} in the template of {label}")
        else:
            for w in words_of(part):
                if not opened:
                    need += 1
                    mandatory.append(w)
                onward = a._add(need)
                a.step[now][w] = onward
                now = onward
    if opened or not mandatory:
        raise ValueError(f"the template of {label} has an open region or no mandatory word")
    a.anchor = frozenset(mandatory)
    return a


class Scanner:
    """Phrases and compiled templates over one text at a time."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.automata = [compile_template(*t) for t in templates]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first():
                self.starts.setdefault(w, []).append(a)
        # a text that lacks one of a template's two longest mandatory words can't match it
        self.rare = {id(a): sorted(a.anchor, key=lambda w: (-len(w), w))[:2] for a in self.automata}

    def matches(self, words: list[bytes], places: set[bytes]) -> tuple[list[tuple[str, int, int]], float]:
        """(label, begin, end) of every accepted place, and the largest share of mandatory words met."""
        alive = {id(a) for a in self.automata if all(w in places for w in self.rare[id(a)])}
        begins = {w: [a for a in of if id(a) in alive] for w, of in self.starts.items() if w in places}
        begins = {w: of for w, of in begins.items() if of}
        found, share = [], 0.0
        if begins:
            for i, w in enumerate(words):
                for a in begins.get(w, ()):
                    end, most = a.run(words, i)
                    share = max(share, most / a.need[-1])
                    if end is not None:
                        found.append((a.label, i, end))
        return found, share

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = line.find(phrase, at + 1)
        starts = [line.count(b" ", 0, at) for at in (min(places), max(places))] if places else [None, None]
        found, share = self.matches(words, set(words))
        labels = base | {label for label, _, _ in found}
        score = 1.0 if found else max(share, 0.5) if base else share * 0.5
        return len(words), len(places), starts[0], starts[1], ",".join(sorted(base)), ",".join(sorted(labels)), score, len(found)


@lru_cache(maxsize=1)
def standard() -> Scanner:
    return Scanner(PHRASES, TEMPLATES)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches.

    score: 1 where a template matches; else, where a phrase stands, at least a half, or the largest
    share of a template's mandatory words met from its beginning on; else half that share. Shares are
    taken of templates whose two longest mandatory words stand anywhere in the text: of others they count
    as none, as they can't match."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_matches"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]

    def make():
        scanner = standard() if phrases is None and templates is None else Scanner(phrases or PHRASES, templates or TEMPLATES)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*(scanner.scan(t) for t in strings(batch.column(1))), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["__id", *names])

        return one

    out = map_rows(docs.select(docs[id_col], filled(text_col).alias("t")), make, f"__id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_matches long")
    return out.withColumnRenamed("__id", id_col)
