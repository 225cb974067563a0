"""License scans by sentence rules.

A text is cut into sentences; each is normalised to its lower-case words and looked up among
the known licence sentences. The identifiers found, in text order, are matched against the
licence rules, ordered sequences of identifiers: the longest rule that begins at a place wins,
and scanning goes on behind it. Sentences between two identifiers of a rule must be few.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Sentences of public licences, by identifier.
SENTENCES = {
    "apache2-name": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-name": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Licence, how it is stated, identifiers in order.
RULES = (
    ("Apache-2.0", "notice", ("apache2-grant", "apache2-copy", "apache2-warranty", "apache2-see")),
    ("Apache-2.0", "notice", ("apache2-grant",)),
    ("Apache-2.0", "reference", ("apache2-name",)),
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", "reference", ("mit-name",)),
    ("MIT", "reference", ("mit-licensed",)),
    ("GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", "notice", ("gpl-free",)),
    ("GPL-3.0-only", "reference", ("gpl3-name",)),
    ("GPL-2.0-or-later", "notice", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", "notice", ("gpl2-free",)),
    ("GPL-2.0-only", "notice", ("gpl2-only", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", "notice", ("gpl2-only",)),
    ("LGPL-2.1-or-later", "notice", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", "notice", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", "notice", ("agpl3-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", "notice", ("agpl3-free",)),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant", "isc-asis")),
    ("ISC", "text", ("isc-grant",)),
    ("Zlib", "text", ("zlib-asis", "zlib-grant")),
    ("EPL-2.0", "notice", ("epl2-available",)),
    ("CC0-1.0", "notice", ("cc0-dedicated",)),
    ("CC-BY-NC-4.0", "reference", ("cc-by-nc-4",)),
    ("CC-BY-4.0", "reference", ("cc-by-4",)),
    ("CC-BY-4.0", "reference", ("cc-by-4-long",)),
    ("CC-BY-SA-4.0", "reference", ("cc-by-sa-4",)),
    ("MPL-2.0", "notice", ("mpl2-subject",)),
    ("Unlicense", "notice", ("unlicense",)),
)
#: Sentences, known or not, that may stand between two identifiers of a rule.
MOST_BETWEEN = 6

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: A sentence ends at . ! ? : or ; with its closing marks before white space, or at an empty line.
END = re.compile(r"[.!?:;][\"')\]]*(?=\s)|\n[ \t]*\n")
BULLET = re.compile(r"^(?:\(?[0-9a-z]\)|[0-9]+\.|[*#/;>-]+)\s+")


def normalised(sentence: str) -> str:
    return " ".join(WORD.findall(sentence.lower()))


class Scanner:
    def __init__(self, sentences=None, rules=RULES, most_between: int = MOST_BETWEEN):
        # a known sentence is cut as texts are, so one may take several pieces
        self.ids, self.most_between = {}, most_between
        self.pieces: dict[str, tuple[str, ...]] = {}
        for name, text in (SENTENCES if sentences is None else sentences).items():
            parts = [words for a, b in cuts(text) if (words := normalised(text[a:b]))]
            if not parts:
                raise ValueError(f"sentence {name!r} has no word")
            for i, words in enumerate(parts):  # a piece that several sentences have is one identifier
                self.ids.setdefault(words, name if len(parts) == 1 else f"{name}/{i}")
            self.pieces[name] = tuple(self.ids[words] for words in parts)
        self.rules: dict[str, list] = {}
        for licence, how, seq in rules:
            flat = tuple(p for s in seq for p in self.pieces[s])
            self.rules.setdefault(flat[0], []).append((flat, licence, how))
        for found in self.rules.values():
            found.sort(key=lambda r: -len(r[0]))

    def sentences(self, text: str) -> list[tuple[int, int, int, str]]:
        """(ordinal, start, end, identifier) of the known sentences: the ordinal counts all
        sentences of the text. A line by itself may be a sentence, and so may one that runs over
        several lines; a line's ordinal is that of the sentence it ends in."""
        found, ends = {}, []
        for lines in (False, True):
            for a, b in cuts(text, lines):
                if not lines:
                    ends.append(b)
                if name := self.ids.get(normalised(BULLET.sub("", text[a:b].strip()))):
                    found.setdefault((b, name), a)
        return [(bisect.bisect_left(ends, b), found[b, name], b, name) for b, name in sorted(found)]

    def matches(self, text: str) -> list[tuple[str, str, int, int]]:
        """(licence, how, start, end), in text order, not overlapping."""
        seen, out, i = self.sentences(text), [], 0
        while i < len(seen):
            for seq, licence, how in self.rules.get(seen[i][3], ()):
                at, ok = i, True
                for want in seq[1:]:
                    most = seen[at][0] + 1 + self.most_between
                    near = itertools.takewhile(lambda j: seen[j][0] <= most, range(at + 1, len(seen)))  # noqa: B023
                    nxt = next((j for j in near if seen[j][3] == want), None)
                    if nxt is None:
                        ok = False
                        break
                    at = nxt
                if ok:
                    out.append((licence, how, seen[i][1], seen[at][2]))
                    i = at
                    break
            i += 1
        return out


def cuts(text: str, lines: bool = False) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences, without outer white space; with lines, each line's own."""
    at = 0
    for part in text.split("\n") if lines else (text,):
        begin = at
        for m in END.finditer(text, at, at + len(part)):
            a, b = begin, m.end()
            if text[a:b].strip():
                yield a + len(text[a:b]) - len(text[a:b].lstrip()), b
            begin = b
        if tail := text[begin : at + len(part)].strip():
            a = text.index(tail, begin)
            yield a, a + len(tail)
        at += len(part) + 1


FIELDS = pa.list_(pa.struct([("license", pa.string()), ("how", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(sentences, rules, most_between):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules, most_between)
        # the rarest test first: a text with none of the sentences' rarest words has no match
        rare = re.compile("|".join(sorted({max(s.split(), key=len) for s in scanner.ids}, key=len)), re.I)
        for b in batches:
            found = []
            for x in b.column("text"):
                t = x.as_py() or ""
                found.append([{"license": a, "how": h, "start": s, "end": e} for a, h, s, e in (scanner.matches(t) if rare.search(t) else [])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, FIELDS)], ["doc_id", "found"])

    return scan


def scan_licenses(documents: DataFrame, sentences: dict[str, str] | None = None, rules=RULES, most_between: int = MOST_BETWEEN) -> DataFrame:
    """One row per document: doc_id, found (license, how, start, end in characters), licenses
    (distinct, sorted, comma-joined; empty if none), n_found.

    Whole texts are scanned. Null or empty texts have no finding. Of rules that begin at one
    sentence the longest wins, of equally long ones the first given. Rows repeat as in the input,
    null doc_ids stay, an empty table gives an empty result; only doc_id and text are read.
    Sentences are known word for word: names or years in them aren't variable.
    """
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(sentences, rules, most_between), "doc_id long, found array<struct<license: string, how: string, start: long, end: long>>")
    return out.select("doc_id", "found", F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"), F.size("found").cast("long").alias("n_found"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its licences, their number, and each finding's place."""
    spans = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["license"], f["how"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "licenses", "n_found", spans.alias("spans"))
