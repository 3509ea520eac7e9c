"""License labels by matching texts against templates with optional and replaceable regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] [[a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] [[b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTISING = "[[3]] [[c]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{1,20}}"
_BSD_NAMES = "[[3]] [[4]] [[c]] [[d]] neither the name of {{1,12}} nor the names of {{0,8}} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = "this software is provided by {{1,12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1,12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

_NO_WARRANTY = "{{1,8}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"

#: Public license wording. [[ ]] encloses what may be missing; {{a,b}} stands
#: for a to b words of any kind (names of holders); all else is mandatory. Texts are whole,
#: with conditions and disclaimer; a label's short notices are templates of their own, whose
#: keys go on after a slash. A template ends with a mandatory word: what follows is not read.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1,12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit/notice": "under the mit license",
    "apache-2": "licensed under the apache license version 2",
    "apache-2/header": "licensed under the apache license version 2 0 the license you may not use [[this file]] {{0,6}} except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "cc-by-nc": "licensed under [[a]] [[the]] [[creative commons]] cc by nc",
    "gpl-3": "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-2": "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    "gpl-3/header": f"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [[at your option]] any later version {_NO_WARRANTY}",
    "gpl-2/header": f"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [[at your option]] any later version {_NO_WARRANTY}",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsd-2": f"{_BSD} {_BSD_DISCLAIMER}",
    "bsd-3": f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-4": f"{_BSD} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "bsd-2/notice": "under the bsd 2 clause [[simplified]] license",
    "bsd-3/notice": "under the bsd 3 clause [[new]] [[or]] [[revised]] license",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{1,12}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1,12}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc/notice": "under the isc license",
    "all-rights-reserved": "all rights reserved",
}

#: Bytes as words are cut: A-Z in lower case, other ASCII that is no digit or letter as a blank.
BYTES = bytes((b | 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass
class Automaton:
    """States 0..n-1; state n accepts. A state reads its word (None: any word) and goes on by one."""

    words: list[bytes | None] = field(default_factory=list)
    #: From a state also the states reached without reading.
    skips: dict[int, set[int]] = field(default_factory=dict)
    #: Mandatory words read before each state.
    done: list[int] = field(default_factory=list)
    anchor: bytes = b""

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skips.get(s, ())
        return out


def compile_template(text: str) -> Automaton:
    """The automaton of a template. It must begin with a mandatory word: optional leading wording never decides acceptance."""
    out, open_at, mandatory = Automaton(), [], 0
    for part in re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", text):
        at = len(out.words)
        if part == "[[":
            open_at.append(at)
        elif part == "]]":
            out.skips.setdefault(open_at.pop(), set()).add(at)
        elif part[0] == "{":
            low, high = map(int, part[2:-2].split(","))
            for i in range(high):
                if i >= low:
                    out.skips.setdefault(at + i, set()).add(at + high)
                out.words.append(None)
                out.done.append(mandatory)
        else:
            out.done.append(mandatory)
            out.words.append(part.encode())
            mandatory += not open_at
    out.done.append(mandatory)
    first = []
    for i, word in enumerate(out.words):
        if word is None or len(first) == 4 or any(i in (a, *b) for a, b in out.skips.items()):
            break
        first.append(word)
    if not first:
        raise ValueError(f"template begins with an optional or replaceable region: {text[:40]}")
    out.anchor = b" " + b" ".join(first) + b" "
    return out


def run(automaton: Automaton, words: list[bytes], at: int) -> float:
    """Share of the mandatory words read from words[at] on before the automaton stops; 1.0 exactly when it accepts."""
    final = len(automaton.words)
    states, best = automaton.closed({0}), 0
    while True:
        if final in states:
            return 1.0
        best = max(best, max((automaton.done[s] for s in states), default=0))
        if at == len(words) or not states:
            return min(best / max(automaton.done[-1], 1), 0.99)
        word = words[at]
        states = automaton.closed({s + 1 for s in states if automaton.words[s] in (None, word)})
        at += 1


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Numbers of the words at which phrase (blank on both sides) stands in line."""
    at, word, counted = line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", counted, at)
        counted = at
        yield word
        at = line.find(phrase, at + 1)


def scan(text: bytes, phrases: list[tuple[bytes, str]], automata: list[tuple[str, bool, Automaton]]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text.

    automata: (label, whether it is a short notice, automaton). The score is the largest
    share of a whole license text's mandatory words that was read; a notice or a base
    phrase alone is worth half.
    """
    words = text.translate(BYTES).split()
    line = b" " + b" ".join(words) + b" "
    base, starts = set(), []
    for phrase, label in phrases:
        if found := list(places(line, phrase)):
            starts += found
            base.add(label)
    labels, score = set(base), NOTICE_SCORE if base else 0.0
    for label, notice, automaton in automata:
        for at in places(line, automaton.anchor):
            got = run(automaton, words, at)
            score = max(score, got * NOTICE_SCORE if notice else got)
            if got == 1.0:
                labels.add(label)
                break
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def compiled(templates: dict[str, str]) -> list[tuple[str, bool, Automaton]]:
    """Label, whether the template is a short notice (under NOTICE_WORDS mandatory words), and automaton."""
    found = [(key.partition("/")[0], compile_template(t)) for key, t in templates.items()]
    return [(label, a.done[-1] < NOTICE_WORDS, a) for label, a in found]


#: Mandatory words from which a template is a whole license text or header, and what a full match of a shorter one scores.
NOTICE_WORDS, NOTICE_SCORE = 30, 0.5
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    automata = compiled(templates)
    for batch in batches:
        texts = pc.cast(batch.column(1), pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
        rows = [scan(t.as_py(), needles, automata) for t in texts]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows else [pa.array([], t) for t in TYPES]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *NAMES])


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License phrases and templates found in each text, a row for each row of docs.

    phrases give the base labels, templates those of the method (a key up to any slash): a template is compiled
    to a word automaton that is run from each place of its leading words and accepts when
    all mandatory wording was read, with optional regions taken or left out and
    replaceable ones of any words. score is 1 where a whole license text or header was
    accepted, and else the largest share of one's mandatory words that was read, or half
    for a full match of a short notice or a base phrase.

    Null and empty texts have 0 words, no labels ('') and null first_word and last_word;
    null ids pass through; repeated rows give a row each; very long texts are read whole;
    other columns are ignored; an empty table gives an empty result. One narrow stage, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(partial(_scan, phrases=dict(phrases), templates=dict(templates)), f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    return out.withColumnRenamed("id", id_col)
