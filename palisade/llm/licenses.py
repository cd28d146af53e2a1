"""License scans by template markup.

A template is wording with two kinds of markup: ``[optional words]`` and
``{n}``, up to n replaceable words. It is compiled into a token automaton whose
states are the places between its words; all states of a template are bits of
one integer, optional and replaceable regions are skips and loops. A text is
accepted where all mandatory words stand, in order and exactly, with nothing
between them that the markup does not allow; the longest such run is its span.

Words are runs of letters, digits and non-ASCII characters after lower-casing
A-Z. Base labels come from three phrases; templates add labels of their own:
notices of one line, headers, and whole license texts. ``score`` is 1 where a
template accepts, 0.5 where only a phrase stands, else 0.

Defined cases: null and empty texts have no words, labels are empty strings,
first_word and last_word null; repeated rows are scanned alike; texts are
scanned whole, whatever their length; an empty table gives an empty result;
markup at a template's begin is optional like any other; of a label's equally long
spans the first counts; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The words of public license texts, in lower case and without punctuation.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
    "to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be "
    "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {6} be liable for any claim damages or other liability whether in an action "
    "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC = (
    "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies the software is provided as is and {8} all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
    "event shall {8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
    "contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {1} redistributions of source code must "
    "retain the above copyright notice this list of conditions and the following disclaimer {1} redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = "{2} neither the name of {12} nor the names of {3} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = (
    "this software is provided by {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
    "purpose are disclaimed in no event shall {8} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
    "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [{1} www apache org "
    "licenses license 2 0] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
    "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
)
_GPL = (
    "{4} is free software you can redistribute it and or modify it under the terms of the gnu [lesser] [affero] general public license as published by the free software foundation either "
    "version {2} of the license or at your option any later version {4} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
    "merchantability or fitness for a particular purpose see the gnu [lesser] [affero] general public license for more details"
)
#: label, template
TEMPLATES = (
    ("mit-notice", "released under the [terms of the] mit license"),
    ("mit-notice", "licensed under the [terms of the] mit license"),
    ("apache-2.0-notice", "licensed under the apache license [version] 2 [0]"),
    ("gpl-notice", "licensed under the [terms of the] gnu [{1}] general public license [as published by the free software foundation] [either] [version] [{1}]"),
    ("cc-by-nc-notice", "licensed under [a] cc by nc"),
    ("cc-by-nc-notice", "licensed under [a] creative commons attribution non commercial"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this {4} and associated documentation files {6} to deal in the {4} without restriction"),
    ("bsd-text", "redistribution and use [of this software] in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu {1} general public license"),
    ("mit-whole", _MIT),
    ("isc-whole", _ISC),
    ("bsd-2-clause-whole", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("bsd-3-clause-whole", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("apache-2.0-header-whole", _APACHE),
    ("gpl-header-whole", _GPL),
)
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Template:
    """Token automaton: bit i is set when the first i places are matched. ``words[w]``: bits from which w leads one on."""

    def __init__(self, wording: str):
        self.words, self.skips, self.any, self.size, self.mandatory = {}, [], 0, 0, set()
        for part in re.findall(r"\[[^\]]*\]|\{\d+\}|[^\s\[\]{}]+", wording):
            begin = self.size
            for token in part.strip("[]").split():
                if token[0] == "{":
                    for _ in range(int(token.strip("{}"))):
                        self.any |= 1 << self.size
                        self.skips.append((self.size, self.size + 1))
                        self.size += 1
                else:
                    word = token.encode()
                    self.words[word] = self.words.get(word, 0) | 1 << self.size
                    if part[0] != "[":
                        self.mandatory.add(word)
                    self.size += 1
            if part[0] == "[":
                self.skips.append((begin, self.size))
        self.skips.sort()
        if not self.mandatory:
            raise ValueError("a template needs a mandatory word")
        self.start = self.closed(1)
        # a run that begins with a replaceable word also stands without it, so only words begin one
        self.heads = {w for w, bits in self.words.items() if bits & self.start}

    def closed(self, bits: int) -> int:
        for a, b in self.skips:
            if bits >> a & 1:
                bits |= 1 << b
        return bits

    def end(self, words: list[bytes], at: int) -> int | None:
        """The place after the longest run from place ``at`` on that the template covers."""
        bits, found = self.start, None
        for place in range(at, len(words)):
            bits = self.closed((bits & (self.words.get(words[place], 0) | self.any)) << 1)
            if not bits:
                break
            if bits >> self.size & 1:
                found = place + 1
        return found

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template covers words from place ``at`` on."""
        return self.end(words, at) is not None


class Scanner:
    """Compiled templates by the words that begin them, and the words of which every text with a hit has one."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.heads: dict[bytes, list[tuple[str, Template]]] = {}
        self.marks = {b" license "}  # all phrases have it
        for label, wording in templates:
            template = Template(wording)
            own = {b" " + w + b" " for w in template.mandatory}
            if not self.marks & own:
                self.marks.add(max(own, key=lambda w: (len(w), w)))
            for word in template.heads:
                self.heads.setdefault(word, []).append((label, template))

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_TABLE).split()
        flat = b" " + b" ".join(words) + b" "
        if not any(m in flat for m in self.marks):
            return len(words), 0, None, None, "", "", 0.0, []
        found, first, last, labels = 0, None, None, set()
        for phrase, label in PHRASES:
            key, at, place, counted = b" " + phrase.encode() + b" ", -1, 0, 0
            while (at := flat.find(key, at + 1)) >= 0:
                place, counted = place + flat.count(b" ", counted, at), at  # blanks since the place before
                found, labels = found + 1, labels | {label}
                first, last = place if first is None else min(first, place), place if last is None else max(last, place)
        spans: dict[str, tuple[int, int]] = {}
        for i, word in enumerate(words):
            for label, template in self.heads.get(word, ()):
                end = template.end(words, i)
                if end and (label not in spans or end - i > spans[label][1] - spans[label][0]):
                    spans[label] = (i, end)
        score = 1.0 if spans else 0.5 if labels else 0.0
        rows = [{"label": k, "first": a, "stop": b} for k, (a, b) in sorted(spans.items())]
        return len(words), found, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | set(spans))), score, rows


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, stop long>>"
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64())])
_KINDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]


def _scans(templates: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for whole in batches:
            for i in range(0, len(whole), 1000):
                b = whole.slice(i, 1000)
                rows = [scanner.scan(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
                columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *[n for n, _ in _KINDS]])

    return run


def scanned(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs`` with its words, phrases, labels, score and, for each template label, its longest span of words."""
    return docs.select("doc_id", "text").mapInArrow(_scans(templates), _OUT)
