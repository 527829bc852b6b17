"""Licence texts and notices, matched as templates with optional and replaceable regions.

Templates are whole texts, standard notices and opening words of public licences (licence_texts), and single sentences. One is words, ``[optional words]`` (may nest) and ``<n>`` or ``<m,n>``, a region that any m to n
words replace. It is compiled to an automaton over words; a text is accepted where the automaton's
mandatory words stand exactly, from any word on. Words are those of shared.FOLD, so case, punctuation
and line breaks between words don't matter.

Nulls and empty texts have no words, no labels, score 0 and null positions. Repeated rows give repeated
results; of matches with equal wording the earlier one, then the longer one wins. An empty table gives no row. Texts
of any length are scanned whole; other columns of the input aren't carried, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import licence_texts as published
from .shared import FOLD, Words, chunks, text_bytes

#: The phrases that always count, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Whole texts of public licences, with their replaceable names.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall <1,12> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <1,8> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <1,8> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_NAMES = "neither the name of <1,12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright <1,6> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

def template(text: str, **names: str) -> str:
    """A published text as a template: its words, and the marks of optional and replaceable regions."""
    for name, value in names.items():
        text = text.replace(f"{{{name}}}", value)
    return " ".join(re.findall(r"<\d+(?:,\d+)?>|[\[\]|]|[0-9a-z]+", text.lower()))


def _gnu() -> tuple[tuple[str, str], ...]:
    """Notices and opening words of the GNU licences."""
    kinds = (("gpl", "General Public License", ("2|1991|june 1991", "3|2007|29 june 2007")), ("lgpl", "Lesser General Public License", ("2 1|1991 1999|february 1999", "3|2007|29 june 2007")), ("agpl", "Affero General Public License", ("3|2007|19 november 2007",)))
    out = []
    for label, licence, versions in kinds:
        for version, years, date in (v.split("|") for v in versions):
            name = f"{label}-{version.replace(' ', '.')}" + (".0" if " " not in version else "")
            out.append((name, template(published.GNU_HEAD, licence=licence, version=version, years=years, date=date)))
            out.append((name, template(published.GNU_NOTICE, licence=licence, version=version if " " in version else f"{version} [0]")))
    return tuple(out)


#: Whole texts, standard notices and opening words, see licence_texts.
PUBLISHED = (
    ("apache-2.0", template(published.APACHE_2)), ("apache-2.0", template(published.APACHE_2_NOTICE)), ("unlicense", template(published.UNLICENSE)), ("zlib", template(published.ZLIB)), ("bsl-1.0", template(published.BOOST_1)), ("0bsd", template(published.ZERO_BSD)), ("wtfpl", template(published.WTFPL)),
    ("mpl-2.0", template(published.MPL_2_HEAD)), ("mpl-2.0", template(published.MPL_2_NOTICE)), ("epl-2.0", template(published.EPL_2_HEAD)),
    ("cc-by-4.0", template(published.CC_4_HEAD, name="Attribution")), ("cc-by-sa-4.0", template(published.CC_4_HEAD, name="Attribution-ShareAlike")), ("cc-by-nc-4.0", template(published.CC_4_HEAD, name="Attribution-NonCommercial")), ("cc-by-nd-4.0", template(published.CC_4_HEAD, name="Attribution-NoDerivatives")),
    *_gnu(),
)

#: Wording of public licences and of notices that point to them.
TEMPLATES = (
    *PUBLISHED,
    ("mit", f"[the] [mit] [license] [<0,2> copyright [c] <0,12> [all rights reserved]] {MIT}"),
    ("isc", f"[isc license] [copyright [c] <0,12>] {ISC}"),
    ("bsd-2-clause", f"[copyright [c] <0,12> [all rights reserved]] {BSD} {BSD_END}"),
    ("bsd-3-clause", f"[copyright [c] <0,12> [all rights reserved]] {BSD} [3] {BSD_NAMES} {BSD_END}"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "[this <0,4> is] [released|licensed|distributed|available] under the [terms of the] mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 [the license] [you may not use this file except in compliance with the license]"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "[released|licensed|distributed] under the [2 clause|3 clause|new|simplified] bsd [2 clause|3 clause] license"),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3.0", "[this <0,4> is] licensed under the [terms of the] gnu general public license version 3"),
    ("gpl-2.0", "[this <0,4> is] licensed under the [terms of the] gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "[this source code form is] subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "cc0 1 0 [universal]"),
    ("cc-by", "[<0,3> is] licensed under [a|the] [creative commons] cc by <2> [license]"),
    ("cc-by-nc", "[<0,3> is] licensed under [a|the] [creative commons] cc by nc <2> [license]"),
    ("cc-by-sa", "[<0,3> is] licensed under [a|the] [creative commons] cc by sa <2> [license]"),
    ("cc-by", "creative commons attribution <2> [international|unported] [public] license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright [c] <0,6> all rights reserved"),
)


@dataclass
class _State:
    """Moves on words; ``any``: moves on whatever word; ``free``: moves on nothing."""

    on: dict[bytes, list[int]] = field(default_factory=dict)
    any: list[int] = field(default_factory=list)
    free: list[int] = field(default_factory=list)


class Automaton:
    """A template's automaton. ``match`` gives the end of the longest acceptance from a word on."""

    def __init__(self, template: str):
        self.states = [_State()]
        tokens = re.findall(r"\[|\]|\||<\d+(?:,\d+)?>|[^\s\[\]|<>]+", template)
        self.mandatory = 0
        self.final, at = self._sequence(tokens, 0, 0, 0)
        if at != len(tokens):
            raise ValueError(f"unbalanced template: {template}")
        self.closure = [self._closed(i) for i in range(len(self.states))]
        self.first = {w for i in self.closure[0] for w in self.states[i].on}
        self.needed = max((t.encode() for t in self._required(tokens)), key=len)

    @staticmethod
    def _required(tokens: list[str]) -> list[str]:
        depth, out = 0, []
        for t in tokens:
            depth += (t == "[") - (t == "]")
            if not depth and t[0] not in "[]|<":
                out.append(t)
        return out

    def _new(self) -> int:
        self.states.append(_State())
        return len(self.states) - 1

    def _sequence(self, tokens: list[str], at: int, state: int, depth: int) -> tuple[int, int]:
        while at < len(tokens) and tokens[at] not in ("]", "|"):
            t = tokens[at]
            at += 1
            if t == "[":
                done = self._new()
                self.states[state].free.append(done)  # left out
                while True:
                    branch = self._new()
                    self.states[state].free.append(branch)
                    end, at = self._sequence(tokens, at, branch, depth + 1)
                    self.states[end].free.append(done)
                    at += 1
                    if tokens[at - 1] == "]":
                        break
                state = done
            elif t[0] == "<":
                low, _, high = t[1:-1].partition(",")
                for i in range(int(high or low)):
                    then = self._new()
                    self.states[state].any.append(then)
                    if high and i >= int(low):
                        self.states[state].free.append(then)
                    state = then
            else:
                then = self._new()
                self.states[state].on.setdefault(t.encode(), []).append(then)
                self.mandatory += depth == 0
                state = then
        return state, at

    def _closed(self, i: int) -> frozenset[int]:
        seen, todo = {i}, [i]
        while todo:
            for j in self.states[todo.pop()].free:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int:
        """The word after the longest match that begins at a word, or -1."""
        now, end = set(self.closure[0]), -1
        while now:
            if self.final in now:
                end = at
            if at >= len(words):
                break
            then: set[int] = set()
            for i in now:
                s = self.states[i]
                for j in (*s.on.get(words[at], ()), *s.any):
                    then |= self.closure[j]
            now, at = then, at + 1
        return end


class Spans:
    """Spans with known first places: whether one of those added holds another, each step in the logarithm of their number."""

    def __init__(self, firsts: list[int]):
        self.at = {x: k + 1 for k, x in enumerate(firsts)}
        self.last = [-1] * (len(firsts) + 1)  # a tree of maxima over the spans that begin at or before a place

    def add(self, first: int, last: int) -> None:
        k = self.at[first]
        while k < len(self.last):
            self.last[k] = max(self.last[k], last)
            k += k & -k

    def inside(self, first: int, last: int) -> bool:
        k = self.at[first]
        while k:
            if self.last[k] >= last:
                return True
            k -= k & -k
        return False


class Scanner:
    """All templates together, found by a word that each must have and then by their first words."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE):
        self.templates = [(label, Automaton(t)) for label, t in templates]
        self.base = [([w.encode() for w in phrase.split()], label) for phrase, label in base]
        self.hints = sorted({a.needed for _, a in self.templates} | {max(p, key=len) for p, _ in self.base})
        self.hint = re.compile(b"|".join(re.escape(h) for h in self.hints))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, their labels, all labels, and the score."""
        starts, base_labels, labels = [], set(), set()
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for phrase, label in self.base:
            for i in places.get(phrase[0], ()):
                if words[i : i + len(phrase)] == phrase:
                    starts.append(i)
                    base_labels.add(label)
        found = []
        for label, a in self.templates:
            if a.needed in places:
                for i in sorted({i for w in a.first for i in places.get(w, ())}):
                    if (end := a.match(words, i)) > i:
                        found.append((a.mandatory, -i, end, label))
        exact, taken = 0, Spans(sorted({-f[1] for f in found}))
        for mandatory, i, end, label in sorted(found, reverse=True):  # more wording wins over less within its span
            if not taken.inside(-i, end):
                taken.add(-i, end)
                labels.add(label)
                exact = max(exact, mandatory)
        score = 0.5 if base_labels else 0.0
        if labels:
            score = round(min(1.0, 0.6 + 0.04 * exact), 2)
        return starts, base_labels, base_labels | labels, score


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_texts(texts: list[bytes], scanner: Scanner) -> dict[str, list]:
    """The columns of SCHEMA for some texts."""
    out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
    t = Words(texts, FOLD, hashed=False)
    folded = t.folded.tobytes()
    out["n_words"] = t.counts.tolist()
    for i in range(len(texts)):
        found: tuple = ([], set(), set(), 0.0)
        if scanner.hint.search(folded, int(t.begins[i]), int(t.begins[i + 1])):
            found = scanner.scan([w for w in folded[int(t.begins[i]) : int(t.begins[i + 1])].split(b"\0") if w])
        starts, base, labels, score = found
        out["n_base"].append(len(starts))
        out["first_word"].append(min(starts, default=None))
        out["last_word"].append(max(starts, default=None))
        out["base_labels"].append(",".join(sorted(base)))
        out["labels"].append(",".join(sorted(labels)))
        out["score"].append(score)
    return out


def licence_labels(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row; one narrow pass."""

    def scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        names = [k.split()[0] for k in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for part in parts:
            texts = text_bytes(part.column(1))
            for a, b in chunks(texts):
                rows = scan_texts(texts[a:b], scanner)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), *(pa.array(rows[k], t) for k, t in zip(names, kinds, strict=True))], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, {SCHEMA}")
