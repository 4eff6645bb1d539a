"""License scans by template-markup matching.

A template is license wording with markup: <<opt>> … <</opt>> may be left out, <<var:N>> stands for
up to N words of any kind, and {a|b} is one of several words. It is compiled into a token automaton;
a text is accepted where the automaton runs from start to end over consecutive words, so all of the
mandatory wording has to match exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

#: Phrases and their labels as the contract fixes them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license notices and texts (fixed values), by label, with markup.
_AS_IS = (
    "including but not limited to the <<opt>>implied<</opt>> warranties of merchantability <<opt>>and<</opt>> fitness for a particular purpose"
)
_BSD_1_2 = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_END = (
    "this software is provided by <<var:10>> as is and any express or implied warranties " + _AS_IS + " are disclaimed in no event shall "
    "<<var:10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
    "possibility of such damage"
)
_GNU = (
    "<<var:6>> is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation "
    "either version <<var:2>> of the license or at your option any later version <<opt>><<var:8>> is distributed in the hope that it will be useful but "
    "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details<</opt>>"
)
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
TEMPLATES = {
    "mit-notice": "{released|licensed|distributed|available|provided} under the <<opt>>terms of the<</opt>> mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions"
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be "
        "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or "
        "implied " + _AS_IS + " and {noninfringement|non} <<opt>>infringement<</opt>> in no event shall <<var:8>> be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software"
    ),
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use {this|these} {file|files} except in compliance with the license "
        "you may obtain a copy of the license at {http|https} www apache org licenses license 2 0 <<opt>>{txt|html}<</opt>> unless required by applicable "
        "law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "apache-2.0-text": (
        "apache license version 2 0 january 2004 {http|https} www apache org licenses terms and conditions for use reproduction and distribution "
        "1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"
    ),
    "gpl-2.0-notice": "{licensed|released|distributed} under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>gpl<</opt>> version 2",
    "gpl-3.0-notice": "{licensed|released|distributed} under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>gpl<</opt>> version 3",
    "gpl-header": _GNU.format("general public license"),
    "lgpl-header": _GNU.format("lesser general public license"),
    "agpl-header": _GNU.format("affero general public license"),
    "gpl-2.0-text": (
        "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc <<var:16>> " + _VERBATIM + " preamble the "
        "licenses for most software are designed to take away your freedom to share and change it"
    ),
    "gpl-3.0-text": (
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc <<opt>>{http|https} fsf org<</opt>> " + _VERBATIM
        + " preamble the gnu general public license is a free copyleft license for software and other kinds of works"
    ),
    "lgpl-3.0-text": "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc <<opt>>{http|https} fsf org<</opt>> " + _VERBATIM,
    "agpl-3.0-text": "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc <<opt>>{http|https} fsf org<</opt>> " + _VERBATIM,
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at {http|https} mozilla org mpl 2 0"
    ),
    "epl-2.0-header": "are made available under the terms of the eclipse public license <<opt>>{v|version}<</opt>> {2|v2} 0 which is available at",
    "cc-by-notice": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by <<opt>>international<</opt>> {1|2|3|4} {0|5}",
    "cc-by-sa-notice": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by sa {1|2|3|4} {0|5}",
    "cc-by-nc-notice": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc {1|2|3|4} {0|5}",
    "cc-by-nd-notice": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nd {1|2|3|4} {0|5}",
    "cc-by-long-notice": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons attribution <<opt>>{noncommercial|non}<</opt>> <<opt>>commercial<</opt>> "
    "<<opt>>{sharealike|share|noderivatives|no}<</opt>> <<opt>>{alike|derivatives|derivs}<</opt>> {1|2|3|4} {0|5} <<opt>>{international|unported|generic}<</opt>> license",
    "cc0-notice": "to the extent possible under law <<var:12>> waived all copyright and related or neighboring rights to",
    "bsd-2-text": _BSD_1_2 + _BSD_END,
    "bsd-3-text": _BSD_1_2 + (
        "<<opt>>3<</opt>> neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission "
    ) + _BSD_END,
    "isc-text": (
        "permission to use copy modify <<opt>>and<</opt>> <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:8>> "
        "{disclaims|disclaim} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall <<var:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
        "or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance "
        "of this software"
    ),
    "zlib-text": (
        "this software is provided as is without any express or implied warranty in no event {will|shall} the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
        "and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<</opt>> the origin of this software must not be "
        "misrepresented you must not claim that you wrote the original software if you use this software in a product an "
        "{acknowledgment|acknowledgement} in the product documentation would be appreciated but is not required <<opt>>2<</opt>> altered source versions "
        "must be plainly marked as such and must not be misrepresented as being the original software <<opt>>3<</opt>> this notice may not be removed or "
        "altered from any source distribution"
    ),
    "unlicense-text": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "bsl-1.0-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works "
        "of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ),
}
#: Words of mandatory wording from which on a template is a license's text and not a notice of it, and of a run that tells of a text that was changed.
TEXT_WORDS, RUN_WORDS = 24, 8

_NOT_WORD = set(range(0x00, 0x30)) | set(range(0x3A, 0x61)) | set(range(0x7B, 0x80))
_BLANK = bytes(32 if b in _NOT_WORD else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text after lower-casing A-Z: runs of ASCII letters, digits and non-ASCII characters."""
    return (text or b"").lower().translate(_BLANK).split()


class Automaton:
    """Token automaton of a template. State k is before item k; the last state accepts."""

    def __init__(self, template: str) -> None:
        self.steps: list[tuple[frozenset[bytes] | None, int]] = []  # (words it takes, None: any; next state)
        self.skips: list[tuple[int, int]] = []
        opened: list[int] = []
        runs: list[list[bytes]] = [[]]  # mandatory consecutive wording
        for item in re.findall(r"<<[^>]*>>|\{[^}]*\}|[^\s<{]+", template):
            if item == "<<opt>>":
                opened.append(len(self.steps))
                runs.append([])
            elif item == "<</opt>>":
                self.skips.append((opened.pop(), len(self.steps)))
                runs.append([])
            elif item.startswith("<<var:"):
                end = len(self.steps) + int(item[6:-2])
                self.skips += [(k, end) for k in range(len(self.steps), end)]
                self.steps += [(None, k + 1) for k in range(len(self.steps), end)]
                runs.append([])
            else:
                taken = frozenset(w.encode() for w in item.strip("{}").split("|"))
                self.steps.append((taken, len(self.steps) + 1))
                if opened or len(taken) > 1:
                    runs.append([])
                else:
                    runs[-1].append(*taken)
        self.end = len(self.steps)
        self.anchor = max(runs, key=lambda r: sum(map(len, r)))
        self.mandatory = sum(map(len, runs))
        self._closure = {k: self._reach(k) for k in range(self.end + 1)}

    def _reach(self, state: int) -> frozenset[int]:
        found, left = {state}, [state]
        while left:
            s = left.pop()
            for a, b in self.skips:
                if a == s and b not in found:
                    found.add(b)
                    left.append(b)
        return frozenset(found)

    def accepts(self, tokens: list[bytes]) -> tuple[int, int] | None:
        """The first place (start, end) where the template matches consecutive tokens."""
        live: dict[int, int] = {}  # state: where its run began
        for i, token in enumerate(tokens):
            for s in self._closure[0]:
                live.setdefault(s, i)
            after: dict[int, int] = {}
            for s, began in live.items():
                if s < self.end and (self.steps[s][0] is None or token in self.steps[s][0]):
                    for t in self._closure[self.steps[s][1]]:
                        after[t] = min(began, after.get(t, began))
            if self.end in after:
                return after[self.end], i + 1
            live = after
        return None


def compile_templates(templates: dict[str, str]) -> list[tuple[str, bytes, int, Automaton]]:
    """Label, anchor phrase (between blanks), its words, and automaton of each template."""
    out = []
    for label, template in templates.items():
        automaton = Automaton(template)
        out.append((label, b" " + b" ".join(automaton.anchor) + b" ", len(automaton.anchor), automaton))
    return out


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which a phrase (between blanks) stands in joined words (between blanks)."""
    at, number, seen = joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        yield number
        at = joined.find(phrase, at + 1)


def scan(text: bytes | None, compiled: list[tuple[str, bytes, int, Automaton]]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score, spans of accepted templates (in words).

    The score is 1 where a license's text or header is accepted, 0.75 for a notice, 0.5 for a base phrase alone, 0.25 where
    only the longest mandatory run of a template stands, and else 0.
    """
    found = words(text)
    joined = b" " + b" ".join(found) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        if hits := list(_places(joined, b" " + phrase.encode() + b" ")):
            places += hits
            base.add(label)
    spans, score = [], 0.5 if places else 0.0
    for label, anchor, size, automaton in compiled:
        reach, done = automaton.end, -1
        for at in _places(joined, anchor):
            if size >= RUN_WORDS:
                score = max(score, 0.25)
            if at + size <= done:
                continue  # within what was searched already
            low, high = max(0, at - reach), at + size + reach
            if hit := automaton.accepts(found[low:high]):
                spans.append((label, low + hit[0], low + hit[1]))
                score = max(score, 1.0 if automaton.mandatory >= TEXT_WORDS else 0.75)
                break
            done = at + size
    labels = base | {s[0] for s in spans}
    return (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,end:long>>"
)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text), with the spans of accepted templates.

    Null texts are empty; empty texts have no words, no labels and score 0; texts of any length are read whole,
    and automata run around the places of their longest mandatory run only; of the places at which a template is
    accepted the first is told; repeated rows each get their row; columns beside doc_id and text are ignored; an empty table gives an empty result.
    """
    chosen = TEMPLATES if templates is None else templates

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_templates(chosen)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [scan(row[1], compiled) for row in rows_of(batch)]
            columns = list(zip(*rows)) if rows else [()] * 8
            spans = pa.array([[{"label": a, "first": b, "end": c} for a, b, c in s] for s in columns[7]], span)
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types)), spans]
            yield pa.RecordBatch.from_arrays(arrays, names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(scanned, SCHEMA)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
