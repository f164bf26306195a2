"""Licence scans by sentence rules.

Comment leaders are blanked and texts cut into sentences, by lines and by paragraphs; each is normalised and
looked up in a table of known licence sentences.  The identifiers, in order of
position, are matched against ordered rules: a rule holds where its identifiers
occur in order with no more than ``gap`` known sentences of other kinds between
two of them.  The longest rules are tried first and use up what they match.

The tables are constants of this module, so each task carries them; there is no
shuffle, and each document is judged where it lies.

Defined results
---------------
* null or empty text: no sentence and no licence.
* sentences that name a licence but are not known are counted in ``n_unknown``.
* each row is judged by itself; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Licence identifiers, forms and their public wording, in its usual layout.
LICENCE_TEXTS: tuple[tuple[str, str, str], ...] = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("MIT", "project", "This project is licensed under the MIT License."),
    (
        "MIT",
        "text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    ),
    (
        "ISC",
        "text",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        "text",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS.""",
    ),
    (
        "BSD-2-Clause",
        "text",
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    ),
    (
        "BSD-3-Clause",
        "text",
        """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    ),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "header",
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    ("GPL-2.0-only", "notice", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0-or-later",
        "header",
        """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "header",
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    (
        "LGPL-2.1-or-later",
        "header",
        """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    ),
    (
        "LGPL-3.0-or-later",
        "header",
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    ),
    (
        "AGPL-3.0-or-later",
        "header",
        """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    ),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "header",
        """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "EPL-2.0",
        "header",
        """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    ),
    (
        "Unlicense",
        "text",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    ),
    (
        "Zlib",
        "text",
        """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.""",
    ),
    (
        "BSL-1.0",
        "text",
        """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:""",
    ),
    (
        "PostgreSQL",
        "text",
        """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement
is hereby granted, provided that the above copyright notice and this
paragraph and the following two paragraphs appear in all copies.""",
    ),
    ("WTFPL", "text", "You just DO WHAT THE FUCK YOU WANT TO."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "work", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "work", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright to this work."),
)
#: A sentence ends at its mark, on either side of an address, and at a blank line or, in the cut by lines, at any.
SENTENCE = r"[.!?:;]+[\"')\]]*(?=\s|$)|(?i:https?)://\S+|\s(?=(?i:https?)://)"
LINE_END = re.compile(SENTENCE + r"|\n")
PARAGRAPH_END = re.compile(SENTENCE + r"|\n[ \t\r]*\n")
#: What stands before a line of a comment, a quotation or a numbered list.
LEADER = re.compile(r"^[ \t]*(?:(?://+|/?\*+/?|#+|;+|--+|%+|>+|<!--|\bdnl\b|\brem\b)[ \t]*)?(?:(?:\d{1,2}[.)]|[(]?[a-z][)])(?=[ \t]))?", re.MULTILINE | re.IGNORECASE)
NOISE = re.compile(r"[\W_]+")
MENTION = re.compile(r"licen[cs]e|licen[cs]ed|licen[zc]i?a\b|lizenz", re.IGNORECASE)
HINT = re.compile(r"licen|copyright|warrant|redistribut|permission|lizenz|\bCC BY|public domain|do what the", re.IGNORECASE)


def normalise(sentence: str) -> str:
    return NOISE.sub(" ", sentence).strip().lower()


def _cut(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    start = 0
    for end in ends.finditer(text):
        yield start, end.end()
        start = end.end()
    yield start, len(text)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end and normal form of every sentence, by lines and, where it spans lines, by paragraphs."""
    # Leaders become blanks, so that places stay and an empty comment line ends a paragraph.
    text = LEADER.sub(lambda m: " " * len(m[0]), text)
    spans = {s for s in _cut(text, LINE_END)} | {s for s in _cut(text, PARAGRAPH_END) if "\n" in text[slice(*s)].strip()}
    out = []
    for start, end in sorted(spans):
        form = normalise(text[start:end])
        if form:
            out.append((start + len(text[start:end]) - len(text[start:end].lstrip()), end, form))
    return out


def build_rules() -> tuple[dict[str, int], list[tuple[str, str, tuple[int, ...]]]]:
    """Sentence identifiers by normal form, and the rules as licence, form and identifiers, longest first."""
    ids: dict[str, int] = {}
    rules = []
    for licence, form, text in LICENCE_TEXTS:
        # The cut of the whole text in one line is the one that any layout gives.
        flat = " ".join(LEADER.sub("", text).split())
        sequence = tuple(ids.setdefault(f, len(ids)) for _, _, f in sentences(flat))
        rules.append((licence, form, sequence))
    return ids, sorted(rules, key=lambda r: (-len(r[2]), r[0], r[1]))


IDS, RULES = build_rules()


def match_rules(found: list[tuple[int, int, int]], gap: int = 3) -> list[tuple[str, str, int, int]]:
    """Licence, form, start and end of each rule that holds; ``found`` has start, end and identifier in order."""
    free, out = [True] * len(found), []
    places: dict[int, list[int]] = {}
    for k, (_, _, known) in enumerate(found):
        places.setdefault(known, []).append(k)
    for licence, form, sequence in RULES:
        for first in places.get(sequence[0], ()):
            if not free[first]:
                continue
            used, at = [first], first
            for wanted in sequence[1:]:
                reach = range(at + 1, min(at + 2 + gap, len(found)))
                at = next((k for k in reach if free[k] and found[k][2] == wanted), -1)
                if at < 0:
                    break
                used.append(at)
            if len(used) == len(sequence):
                for k in used:
                    free[k] = False
                out.append((licence, form, found[used[0]][0], found[used[-1]][1]))
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def scan_text(text: str | None, gap: int = 3) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, int, int]], int]:
    """The licences, the known sentences and the number of unknown sentences that name a licence."""
    if not text or not HINT.search(text):
        return [], [], 0
    cuts = sentences(text)
    found = [(s, e, IDS[form]) for s, e, form in cuts if form in IDS]
    # Of the known sentences that begin before a cut ends, the farthest end.
    unknown, ends = 0, list(accumulate((e for _, e, _ in found), max))
    for s, e, form in cuts:
        if form not in IDS and MENTION.search(form):
            at = bisect_left(found, (e,))
            unknown += not (at and ends[at - 1] > s)
    return match_rules(found, gap), found, unknown


def scan_licences(docs: DataFrame, gap: int = 3) -> DataFrame:
    """Per document row: ``licences`` (sorted), ``spans`` as licence:form:start:end, ``sentence_ids`` and ``n_unknown``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py(), gap) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([sorted({m[0] for m in r[0]}) for r in rows], pa.list_(pa.string())),
                    pa.array([",".join(f"{a}:{b}:{s}:{e}" for a, b, s, e in r[0]) for r in rows], pa.string()),
                    pa.array([[f[2] for f in r[1]] for r in rows], pa.list_(pa.int32())),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                ["doc_id", "licences", "spans", "sentence_ids", "n_unknown"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, licences array<string>, spans string, sentence_ids array<int>, n_unknown long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
