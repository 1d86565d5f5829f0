"""License scans by template markup.

A template is text with two kinds of markup: ``[[words]]`` may be absent, ``<<a-b>>`` stands for
any a to b words. It compiles to an automaton over words whose mandatory words must come exactly and
in order. Automata start only where a template's leading mandatory words stand, so a text without
them costs one search for each distinct lead.

Beside the automata, plain phrases (the base labels) are searched at all places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Templates and their labels. One-sentence notices first, then whole texts, in which every word outside the markup is mandatory.
TEMPLATES = [
    ("mit-notice", "released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("gpl-3.0", "licensed under the gnu general public license [[as published by the free software foundation]] version 3 [[or any later version]]"),
    ("gpl-2.0", "licensed under the gnu general public license [[as published by the free software foundation]] version 2 [[or any later version]]"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version <<1-2>> [[of the license]] or at your option any later version"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<1-8>> and associated documentation files the <<1-4>> to deal in the <<1-4>> without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<1-4>> and to permit persons to whom the <<1-4>> is furnished to do so "
            "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the <<1-4>> "
            "the <<1-4>> is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<1-2>> "
            "in no event shall <<1-10>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the <<1-4>> or the use or other dealings in the"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and <<1-10>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<1-10>> be liable for any special direct indirect "
            "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
            "this software is provided by <<1-10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
            "in no event shall <<1-10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
            "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
            "[[3]] neither the name of <<1-10>> nor the names of <<1-4>> may be used to endorse or promote products derived from this software without specific prior written permission "
            "this software is provided by <<1-10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
            "in no event shall <<1-10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
            "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache-2.0-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 "
            "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
            "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version "
            "<<1-8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
            "<<1-8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl-2.1-or-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version "
            "<<1-8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("lgpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version "
            "<<1-8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version "
            "<<1-8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] [[www]] mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will <<1-10>> be held liable for any damages arising from the use of this software "
            "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
            "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
            "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
            "for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
            "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity "
            "of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
            "fitness for a particular purpose and <<1-2>> in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
]

_SEPARATORS = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


@dataclass
class Automaton:
    """States are numbers; ``on`` has words, ``any_word`` has wildcards, ``free`` moves without a word."""

    label: str
    lead: bytes
    on: dict[tuple[int, bytes], list[int]] = field(default_factory=dict)
    any_word: dict[int, list[int]] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)
    last: int = 0

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts_at(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words that begins at ``start``, or None."""
        states, end, k = self.closure({0}), None, start
        while states:
            if self.last in states:
                end = k
            if k == len(words):
                break
            states = self.closure({t for s in states for t in (*self.on.get((s, words[k]), ()), *self.any_word.get(s, ()))})
            k += 1
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """The automaton of one template; a template has to begin with a mandatory word."""
    parts = [p for p in re.split(r"(\[\[.*?\]\]|<<\d+-\d+>>)", markup) if p.strip()]
    if not parts or parts[0].startswith(("[[", "<<")):
        raise ValueError("a template begins with mandatory words")
    a = Automaton(label, b" ".join(words_of(parts[0])))
    at = 0
    for p in parts:
        if p.startswith("<<"):
            low, high = map(int, p[2:-2].split("-"))
            ends = []
            for k in range(high):
                if k >= low:
                    ends.append(at)
                a.any_word.setdefault(at, []).append(at + 1)
                at += 1
            for s in ends:
                a.free.setdefault(s, []).append(at)
            continue
        begin = at
        for w in words_of(p.strip("[]")):
            a.on.setdefault((at, w), []).append(at + 1)
            at += 1
        if p.startswith("[["):
            a.free.setdefault(begin, []).append(at)
    a.last = at
    return a


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Byte offsets in ``joined`` (words with single spaces around) where the phrase's words stand."""
    found, probe = [], b" " + phrase + b" "
    at = joined.find(probe)
    while at >= 0:
        found.append(at)
        at = joined.find(probe, at + 1)
    return found


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        self.base = {p.encode(): label for p, label in base.items()}
        self.by_lead: dict[bytes, list[Automaton]] = {}
        for label, markup in templates:
            a = compile_template(label, markup)
            self.by_lead.setdefault(a.lead, []).append(a)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words, base places and accepted templates as (first word, end word, label)."""
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        found = {phrase: at for phrase in {*self.base, *self.by_lead} if (at := places(joined, phrase))}
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if found else None
        starts = {phrase: np.searchsorted(gaps, at).tolist() for phrase, at in found.items()}
        base, own = [], []
        for phrase, label in self.base.items():
            n = phrase.count(b" ") + 1
            base += [(k, k + n, label) for k in starts.get(phrase, ())]
        for lead, automata in self.by_lead.items():
            for k in starts.get(lead, ()):
                own += [(k, end, a.label) for a in automata if (end := a.accepts_at(words, k)) is not None]
        return len(words), base, own


SPANS = "array<struct<first_word:int,end_word:int,label:string>>"


def scan_licenses(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_words, base (spans), matches (spans of accepted templates).

    Spans give the first word and the word after the last, counted from 0, and a label, in order of
    place and label. Null text is empty: no words, empty lists. Rows are independent of each other, so
    repeated or null keys keep their rows, and an empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    ship(docs.sparkSession)
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        as_dicts = lambda spans: [dict(zip(("first_word", "end_word", "label"), s, strict=True)) for s in sorted(set(spans))]
        for batch in sliced(batches, "t"):
            n, b, m = zip(*(scanner.scan(t) for t in batch.column(1).to_pylist()), strict=True)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(map(as_dicts, b), span), pa.array(map(as_dicts, m), span)], ["k", "n_words", "base", "matches"])

    out = src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, n_words long, base {SPANS}, matches {SPANS}")
    return out.withColumnRenamed("k", key)


def license_digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan as flat columns: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
    """
    labels = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.col(s)["label"] for s in spans)))), ",")
    starts = F.col("base")["first_word"].cast("array<bigint>")
    return scan_licenses(docs, key=key, text=text).select(
        key, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "matches").alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def digest_sql(table: str = "documents") -> str:
    """``license_digest`` of a table in SQL: phrases by comparing words, templates as regular expressions."""
    phrases = {p.split(" ")[0] + str(k): (p.split(" "), label) for k, (p, label) in enumerate(BASE.items())}
    places = ", ".join(
        f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words)) + f"), lambda i: i - 1) AS h{k}"
        for k, (words, _) in enumerate(phrases.values())
    )
    pattern = lambda markup: "".join(
        f"(?: [^ ]+){{{p[2:-2].replace('-', ',')}}}" if p.startswith("<<") else f"(?: {' '.join(p[2:-2].split())})?" if p.startswith("[[") else " " + " ".join(p.split())
        for p in re.split(r"(\[\[.*?\]\]|<<\d+-\d+>>)", markup) if p.strip()
    )
    base = [f"CASE WHEN len(h{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases.values())]
    own = [f"CASE WHEN regexp_matches(t, '{pattern(markup)} ') THEN '{label}' END" for label, markup in TEMPLATES]
    every = "list_concat(" * (len(phrases) - 1) + "h0" + "".join(f", h{k})" for k in range(1, len(phrases)))
    joined = lambda parts: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
    WITH words AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {table}
    ), found AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS t, {places} FROM words
    ), named AS (SELECT doc_id, n_words, {every} AS h, {joined(base)} AS base_labels, {joined([*base, *own])} AS labels, {joined(own)} AS own FROM found)
    SELECT doc_id, n_words, len(h) AS n_base, list_min(h) AS first_word, list_max(h) AS last_word, base_labels, labels,
      CASE WHEN own <> '' THEN 1.0::DOUBLE WHEN len(h) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM named
    """
