"""License scans: template markup compiled into token automata.

A template is wording with two kinds of markup: <<opt>> ... <<end>> may be
left out, and <<var:n>> stands for 0 to n words of any kind. A text matches
where all the mandatory wording stands exactly, word for word. Of matches one
within the other the longest counts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Bytes that end a word (ASCII but for digits and letters) become spaces; A-Z become a-z.
TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

#: The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The wording that several public licenses share.
_AS_IS = """This software is provided by <<var:12>> "as is" and any express or implied warranties, including, but not limited to, the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall <<var:12>> be liable for any direct, indirect,
    incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use,
    data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort
    (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    <<opt>>1<<end>> <<opt>>a<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<opt>>2<<end>> <<opt>>b<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
_ISC = """the software is provided "as is" and <<var:8>> disclaims all warranties with regard to this software including all implied warranties of
    merchantability and fitness. In no event shall <<var:8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever
    resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection
    with the use or performance of this software."""
_GNU = """is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the
    Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_GNU_ONLY = """is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License
    <<opt>>as published by the Free Software Foundation<<end>> version {1}"""
_UNDER = "under <<opt>>the<<end>> <<opt>>terms of<<end>> <<opt>>the<<end>> <<opt>>a<<end>>"
_GNU_NAME = f"{_UNDER} GNU {{0}} General Public License <<opt>>version<<end>> {{1}}"
_GNU_SHORT = f"{_UNDER} GNU {{0}} General Public License v{{1}}"
_CC_CODE = f"{_UNDER} <<opt>>creative commons<<end>> cc {{0}} <<opt>>license<<end>> {{2}}"
_CC_NAME = f"{_UNDER} <<opt>>creative commons<<end>> attribution {{1}} {{2}} <<opt>>international<<end>> <<opt>>unported<<end>>"

#: Public license texts, notices and names as templates, by label; a label's templates are alternatives.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (f"licensed {_UNDER} Apache License, <<opt>>version<<end>> 2.0 <<opt>>the license<<end>>",),
    "apache-2.0-notice": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at <<var:12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    ),
    "bsd-2-clause": (f"{_BSD} {_AS_IS}",),
    "bsd-3-clause": (
        f"{_BSD} <<opt>>3<<end>> <<opt>>c<<end>> Neither the name of <<var:12>> nor the names of <<var:4>> contributors may be used to endorse or promote products "
        f"derived from this software without specific prior written permission. {_AS_IS}",
    ),
    "bsd-name": (f"{_UNDER} <<opt>>new<<end>> <<opt>>simplified<<end>> <<opt>>2 clause<<end>> <<opt>>3 clause<<end>> BSD <<opt>>2 clause<<end>> <<opt>>3 clause<<end>> license",),
    "boost-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
        and to permit third-parties to whom the Software is furnished to do so""",
    ),
    **{
        f"cc-{code.replace(' ', '-')}": tuple(form.format(code, name, version) for form in (_CC_CODE, _CC_NAME) for version in ("4 0", "3 0", "2 0"))
        for code, name in (("by", ""), ("by sa", "sharealike"), ("by nd", "noderivatives"), ("by nc", "noncommercial"), ("by nc sa", "noncommercial sharealike"), ("by nc nd", "noncommercial noderivatives"))
    },
    "cc0-1.0": (f"{_UNDER} <<opt>>creative commons<<end>> cc0 1 0 <<opt>>universal<<end>>", f"{_UNDER} creative commons zero <<opt>>v<<end>> 1 0 <<opt>>universal<<end>>"),
    **{
        f"{short}-{version}{tail}": tuple(form.format(name, version.removesuffix(".0")) for form in forms)
        for short, name, versions in (("gpl", "", ("2.0", "3.0")), ("lgpl", "lesser", ("2.1", "3.0")), ("agpl", "affero", ("3.0",)))
        for version in versions
        for tail, forms in (("", (_GNU_ONLY, _GNU_NAME, _GNU_SHORT)), ("-or-later", (_GNU, *(f"{form} or <<opt>>at your option<<end>> <<opt>>any<<end>> later" for form in (_GNU_NAME, _GNU_SHORT)))))
    },
    "isc": (
        f"""Permission to use, copy, modify, and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. {_ISC}""",
    ),
    "0bsd": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC}",),
    "mit-name": (f"{_UNDER} MIT license",),
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var:10>> to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>>
        shall be included in all copies or substantial portions of the Software. The software is provided "as is", without warranty of any kind, express or implied,
        including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall <<var:10>> be liable for
        any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use
        or other dealings in the software.""",
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at <<var:8>>""",
        f"{_UNDER} Mozilla Public License <<opt>>version<<end>> <<opt>>v<<end>> 2 0",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will <<var:8>> be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: <<opt>>1<<end>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<opt>>2<<end>> Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3<<end>> This notice may not be removed or altered from any
        source distribution.""",
    ),
}

_MARK = re.compile(r"<<(opt|end|var:\d+)>>")


class TokenAutomaton:
    """A nondeterministic automaton over words for several templates at once.

    edges[state] maps a word to states; loose[state] are states that any word
    reaches; empty[state] are those reached without a word; labels[state] names
    the template that ends there.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.edges: list[dict[bytes, list[int]]] = []
        self.loose: list[list[int]] = []
        self.empty: list[list[int]] = []
        self.labels: dict[int, str] = {}
        self.first: dict[bytes, list[int]] = {}
        for label, forms in sorted(templates.items()):
            for template in forms:
                self._add(label, template)
        self.closed = [self._closure(s) for s in range(len(self.edges))]

    def _state(self) -> int:
        self.edges.append({})
        self.loose.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _add(self, label: str, template: str) -> None:
        start = at = self._state()
        opened: list[int] = []
        for part in _MARK.split(template):
            if part == "opt":
                opened.append(at)
            elif part == "end":
                self.empty[opened.pop()].append(at)
            elif part.startswith("var:"):
                stops = [at]
                for _ in range(int(part[4:])):
                    new = self._state()
                    self.loose[at].append(new)
                    at = new
                    stops.append(at)
                end = self._state()
                for s in stops:
                    self.empty[s].append(end)
                at = end
            else:
                for w in part.encode().translate(TABLE).split():
                    new = self._state()
                    self.edges[at].setdefault(w, []).append(new)
                    at = new
        self.labels[at] = label
        for s in self._closure(start):
            for w, to in self.edges[s].items():
                self.first.setdefault(w, []).extend(to)

    def _closure(self, s: int) -> tuple[int, ...]:
        seen, left = {s}, [s]
        while left:
            for t in self.empty[left.pop()]:
                if t not in seen:
                    seen.add(t)
                    left.append(t)
        return tuple(sorted(seen))

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label) of each accepted place that is within no other, in order."""
        found = []
        for i, w in enumerate(words):
            if w not in self.first:
                continue
            now, j = {t for s in self.first[w] for t in self.closed[s]}, i + 1
            while now:
                found.extend((i, j, self.labels[s]) for s in now if s in self.labels)
                if j >= len(words):
                    break
                step = {t for s in now for t in (*self.edges[s].get(words[j], ()), *self.loose[s])}
                now = {t for s in step for t in self.closed[s]}
                j += 1
        kept, reached = [], -1
        for i, j, label in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
            if j > reached or kept and (i, j) == kept[-1][:2]:
                kept.append((i, j, label))
                reached = j
        return kept


def mandatory(template: str) -> str:
    """A template without its optional parts, however nested and however many lines they have, and without its marks."""
    inner = re.compile(r"<<opt>>((?!<<opt>>|<<end>>).)*<<end>>", re.DOTALL)
    before = None
    while before != template:
        before, template = template, inner.sub(" ", template)
    return re.sub(r"<<.*?>>", " ", template, flags=re.DOTALL)


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_words, the base phrases' places and labels, and the accepted template spans.

    Words are runs of 0-9, a-z and anything beyond ASCII, after A-Z are
    lower-cased. Null texts count as empty; a text without a place has null
    first_word and last_word, empty labels and score 0. Score is 1 where a
    template accepts, 0.5 where only a base phrase stands. Repeated rows are
    each scanned; other columns are not read.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def make():
        automaton = TokenAutomaton(templates)
        base = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        # texts without the last word of any phrase or a telling word of a template need no closer look
        last = {p[-1] for p, _ in base}
        must = [mandatory(t).encode().translate(TABLE).split() for forms in templates.values() for t in forms]
        tell = {max(words, key=len) for words in must if words}
        # a template without a mandatory word may stand in any text
        probe = re.compile(b"|".join(sorted(map(re.escape, last | tell))) if all(must) else b"")

        def rows(texts: list) -> list:
            out = []
            for text in texts:
                flat = (text or b"").translate(TABLE)
                words = flat.split()
                if not probe.search(flat):
                    out.append((len(words), 0, None, None, "", "", [], 0.0))
                    continue
                places = []
                for p, label in base:
                    k = len(p)
                    places += [(i, label) for i, w in enumerate(words) if w == p[0] and tuple(words[i : i + k]) == p]
                spans = automaton.matches(words)
                own, labels = {x for _, x in places}, {x for _, _, x in spans}
                starts = [i for i, _ in places]
                out.append((
                    len(words), len(places), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(own)), ",".join(sorted(own | labels)),
                    [{"first": a, "after": b, "label": x} for a, b, x in spans],
                    1.0 if spans else 0.5 if places else 0.0,
                ))
            return out

        return rows

    return map_texts(docs, make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans array<struct<first:long,after:long,label:string>>, score double", text_col, keep)
