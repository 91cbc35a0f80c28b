"""License scans: template markup compiled to token automata.

A template is license wording in which `<<beginOptional>> ... <<endOptional>>` marks
words that may be left out (nesting allowed) and `<<var;name=x;max=N>>` marks a place
that any 0 to N words may fill. A compiled template accepts a stretch of words only if
all its mandatory words stand there exactly, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.llm.common import small_batches

#: A word, in bytes that have been lower-cased: ASCII digits and letters, and all that is not ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of common license statements, with optional and replaceable regions.
TEMPLATES = {
    "mit-statement": "under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction",
    "apache-2.0-statement": "licensed under <<beginOptional>>the<<endOptional>> apache license version 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this "
    "<<var;name=what;max=2>> except in compliance with the license",
    "gpl-statement": "under the <<beginOptional>>terms of the<<endOptional>> gnu "
    "<<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license "
    "<<beginOptional>>as published by the free software foundation<<endOptional>> "
    "<<beginOptional>>either<<endOptional>> version <<var;name=version;max=1>>",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "isc-grant": "permission to use copy modify <<beginOptional>>and or<<endOptional>> distribute this software "
    "for any purpose with or without fee is hereby granted",
    "cc-by-statement": "under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
    "<<beginOptional>>creative commons<<endOptional>> cc by "
    "<<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>>",
    "mpl-2.0-notice": "subject to the terms of the mozilla public license v 2 0",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    # whole texts
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
    "this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall <<var;name=holder;max=12>> be liable for any claim damages or other liability whether in an action of "
    "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<var;name=bullet;max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<var;name=bullet;max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution <<beginOptional>><<var;name=bullet;max=1>> neither the name of <<var;name=holder;max=12>> nor the "
    "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>> "
    "this software is provided by <<var;name=holder;max=12>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name=holder;max=12>> be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
    "this software even if advised of the possibility of such damage",
    "isc-text": "permission to use copy modify <<beginOptional>>and or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted "
    "<<beginOptional>>provided that the above copyright notice and this permission notice appear in all copies<<endOptional>> the software is provided as is and "
    "<<var;name=holder;max=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
    "<<var;name=holder;max=8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will <<var;name=holder;max=8>> be held liable for any damages arising "
    "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions <<var;name=bullet;max=1>> the origin of this software must not be misrepresented you must not claim that "
    "you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "<<var;name=bullet;max=1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "<<var;name=bullet;max=1>> this notice may not be removed or altered from any source distribution",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this <<var;name=what;max=2>> except in compliance with the license you may "
    "obtain a copy of the license at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www apache org licenses license 2 0 unless required by applicable law "
    "or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> "
    "general public license as published by the free software foundation either version <<var;name=version;max=1>> of the license or at your option any later version "
    "<<var;name=program;max=4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
    "particular purpose see the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license for more details",
}
#: Words of wording that make half a certainty.
HALF = 8

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>|([^<]+)")


@dataclass
class Automaton:
    """States 0 .. n; n accepts. `steps` holds (word or None for any, next), `free` moves that take no word."""

    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    must: set[bytes] = field(default_factory=set)
    #: Mandatory words, repeats counted.
    size: int = 0

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def compile_template(markup: str) -> Automaton:
    """The automaton of one template. It must begin with a mandatory word."""
    a, at, opened = Automaton(), 0, []
    for mark, text in _MARK.findall(markup):
        if mark == "beginOptional":
            opened.append(at)
        elif mark == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            a.free[opened.pop()].append(at)
        elif mark:
            most = re.search(r"max=(\d+)", mark)
            begin, at = at, at
            for _ in range(int(most[1]) if most else 1):
                nxt = a.state()
                a.steps[at].append((None, nxt))
                at = nxt
            end = a.state()
            for x in [begin, *range(begin + 1, at + 1)]:
                a.free[x].append(end)
            at = end
        else:
            for word in WORD.findall(text.encode().lower()):
                nxt = a.state()
                a.steps[at].append((word, nxt))
                if not opened:
                    a.must.add(word)
                    a.size += 1
                at = nxt
    if opened:
        raise ValueError("beginOptional without endOptional")
    if any(w is None for w, _ in a.steps[0]) or len(a.closed({0})) > 1:
        raise ValueError("a template must begin with a mandatory word")
    return a


class Scanner:
    """All templates and phrases; `scan` returns what one text holds."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {k: compile_template(v) for k, v in templates.items()}
        self.phrases = [(WORD.findall(k.encode().lower()), v) for k, v in phrases.items()]
        self.starts: dict[bytes, list[str]] = {}
        for k, a in self.automata.items():
            for word, _ in a.steps[0]:
                self.starts.setdefault(word, []).append(k)
        # a text without the longest mandatory word of a template or phrase can't hold it
        self.anchors = {max(a.must, key=len) for a in self.automata.values()} | {max(p, key=len) for p, _ in self.phrases}

    def score(self, places: list[tuple[int, str]], found: set[str]) -> float:
        """How sure it is that the text states a license: each accepted template, and each label's longest phrase, is a piece of evidence that leaves
        a doubt of HALF / (HALF + its mandatory words); the doubts multiply. 0 without any."""
        sizes = [self.automata[k].size for k in found] + [max(len(p) for p, x in self.phrases if x == label) for label in {x for _, x in places}]
        doubt = 1.0
        for n in sorted(sizes):
            doubt *= HALF / (HALF + n)
        return 1.0 - doubt

    def accepts(self, name: str, tokens: list[bytes], at: int) -> bool:
        """Whether the template accepts a stretch that begins at word `at`."""
        a = self.automata[name]
        last, now = len(a.steps) - 1, a.closed({0})
        while last not in now:
            if at >= len(tokens) or not now:
                return False
            now = a.closed({y for x in now for word, y in a.steps[x] if word is None or word == tokens[at]})
            at += 1
        return True

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], set[str]]:
        """Number of words; (first word, label) of each phrase's place; names of accepted templates."""
        text = text.lower()
        tokens = WORD.findall(text)
        if not any(x in text for x in self.anchors):
            return len(tokens), [], set()
        places, found = [], set()
        for i, word in enumerate(tokens):
            for phrase, label in self.phrases:
                if word == phrase[0] and tokens[i : i + len(phrase)] == phrase:
                    places.append((i, label))
            for name in self.starts.get(word, ()):
                if name not in found and self.accepts(name, tokens, i):
                    found.add(name)
        return len(tokens), places, found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, templates array<string>, score double"
)


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """One row per document: words, places of phrases, labels, accepted templates and a score.

    A null text counts as empty: no words, no places, null first and last word, empty
    labels, score 0. The score grows with the wording found, see Scanner.score. Repeated rows each give a row; a null doc_id stays null;
    columns other than doc_id and text are ignored. One pass over the scan, no shuffle.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                n, places, found = scanner.scan(text or b"")
                base, at = {x for _, x in places}, [i for i, _ in places]
                rows.append((doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | found)), sorted(found), scanner.score(places, found)))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.string()), pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
