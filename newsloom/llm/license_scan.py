"""License scans by sentence rules.

Texts are cut into sentences (at line ends too), sentences are normalised to lower-case
words, and those known get an identifier from the table of sentences; a known sentence may
be broken over any number of lines, and holds full stops where the table's sentence has them.
The identifiers of a text, in order, are then matched against the
rules, which are ordered: a rule takes the identifiers it matches, and later rules see the
rest. So the long form of a licence goes before its parts.

Both tables are parameters. Built in are ``NOTICES`` and ``NOTICE_RULES``: sentences of licences and of
the headers that name them, "Licensed under the ..." and "Released under the ..." for each name, and SPDX
tags of one licence (not of expressions). They are broadcast; their size is checked against RULE_LIMIT. The
scan is one map over the documents.

Defined results: a null or empty text, and one without known sentences, gives no rows; known
sentences that fit no rule give a row without a licence; a null doc_id is carried; repeated
rows each give their rows; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textbuf as T
from .common import table

RULE_LIMIT = 100_000
WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?;:]+(?=\s|$)|\n|$")

# Sentences of public licences, by identifier.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    3: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    4: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    5: "Licensed under the Apache License, Version 2.0",
    6: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    7: "you may not use this file except in compliance with the License",
    8: "You may obtain a copy of the License at",
    9: "This work is licensed under the GNU General Public License, version 3",
    10: "This program is free software",
    11: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    12: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    13: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    14: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    15: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    16: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    17: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    18: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    19: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
# Rules in order; a negative identifier may be left out.
RULES = (
    ("MIT", (2, 3, -4)),
    ("MIT", (1,)),
    ("BSD-3-Clause", (13, 14, 15, 16)),
    ("BSD-2-Clause", (13, 14, 15)),
    ("Apache-2.0", (6, -7, -8)),
    ("Apache-2.0", (5, -7, -8)),
    ("GPL-3.0-or-later", (10, 11)),
    ("GPL-2.0-or-later", (10, 12)),
    ("GPL-3.0", (9,)),
    ("CC-BY-4.0", (17,)),
    ("CC-BY-SA-4.0", (18,)),
    ("MPL-2.0", (19,)),
)
GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version"
# Creative Commons licences, short and long.
COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
# More sentences, of which some have stops inside.
NOTICES = SENTENCES | {
    12: GNU.format("General Public License", ";", "2"),
    20: "Licensed under the MIT License",
    21: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    22: "This library is free software",
    23: GNU.format("Lesser General Public License", ";", "2.1"),
    24: GNU.format("Lesser General Public License", ",", "3"),
    25: GNU.format("Affero General Public License", ",", "3"),
    26: "This work is licensed under the GNU Lesser General Public License, version 3",
    27: "This work is licensed under the GNU Affero General Public License, version 3",
    28: "This work is licensed under the GNU General Public License, version 2",
    29: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    30: "Licensed under CC0 1.0",
    31: "This is free and unencumbered software released into the public domain",
    32: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    33: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    34: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    35: "This software is provided 'as-is', without any express or implied warranty",
    36: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    37: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    38: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    39: "Distributed under the Boost Software License, Version 1.0",
    40: "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
    41: "The Software shall be used for Good, not Evil",
    42: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
}
# Names of licences in headers.
NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "MPL-2.0": "Mozilla Public License 2.0",
    "EPL-2.0": "Eclipse Public License 2.0",
    "BSL-1.0": "Boost Software License 1.0",
    "Zlib": "zlib License",
    "Unlicense": "Unlicense",
    "GPL-2.0": "GNU General Public License v2.0",
    "GPL-3.0": "GNU General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License v2.1",
    "LGPL-3.0": "GNU Lesser General Public License v3.0",
    "AGPL-3.0": "GNU Affero General Public License v3.0",
}
NOTICE_RULES = (
    ("JSON", (2, 3, 41, -4)),
    ("BSD-4-Clause", (13, 14, 15, 42, -16)),
    *(rule for rule in RULES if rule[0] not in ("Apache-2.0", "MPL-2.0")),
    ("Apache-2.0", (6, -7, -8, -33)),
    ("Apache-2.0", (5, -7, -8, -33)),
    ("MPL-2.0", (19, -34)),
    ("Zlib", (-35, 36)),
    ("0BSD", (37, -4)),
    ("EPL-2.0", (38,)),
    ("BSL-1.0", (39,)),
    ("GPL-2.0-only", (10, 32)),
    ("MIT", (20,)),
    ("ISC", (21, -4)),
    ("LGPL-2.1-or-later", (22, 23)),
    ("LGPL-2.1-or-later", (10, 23)),
    ("LGPL-3.0-or-later", (10, 24)),
    ("LGPL-3.0-or-later", (22, 24)),
    ("AGPL-3.0-or-later", (10, 25)),
    ("LGPL-3.0", (26,)),
    ("AGPL-3.0", (27,)),
    ("GPL-2.0", (28,)),
    ("CC0-1.0", (29,)),
    ("CC0-1.0", (30,)),
    ("Unlicense", (31,)),
)
for _kind, _name in COMMONS.items():
    for _form in (
        "Licensed under CC {0} 4.0", "This work is licensed under CC {0} 4.0",
        "This work is licensed under a Creative Commons {1} 4.0 International License",
        "Licensed under a Creative Commons {1} 4.0 International License"
    ):
        if (_text := _form.format(_kind, _name)) not in NOTICES.values():
            NOTICES[max(NOTICES) + 1] = _text
            NOTICE_RULES += ((f"CC-{_kind}-4.0", (max(NOTICES),)),)
for _name, _full in NAMES.items():
    for _form in ("Licensed under the {}", "Released under the {}", "This project is licensed under the {}"):
        if (_text := _form.format(_full)) not in NOTICES.values():
            NOTICES[max(NOTICES) + 1] = _text
            NOTICE_RULES += ((_name, (max(NOTICES),)),)
for _name in ("AGPL-3.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", *dict.fromkeys(name for name, _ in NOTICE_RULES)):
    NOTICES[max(NOTICES) + 1] = f"SPDX-License-Identifier: {_name}"
    NOTICE_RULES += ((_name, (max(NOTICES),)),)
FOUND = "doc_id long, license string, rule int, sentences array<int>, start long, end long"


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower())).replace("licenc", "licens")


def stops_in(text: str) -> set[int]:
    """The numbers of words after which a sentence has a stop of its own."""
    return {len(WORD.findall(text[: m.start()])) for m in END.finditer(text) if m.group().strip("\n:") and WORD.search(text, m.end())}


class Scanner:
    def __init__(self, sentences: dict[int, str], rules):
        self.known = {normal(t): (i, stops_in(t)) for i, t in sentences.items()}
        self.heads = {s.split(" ", 1)[0] for s in self.known}
        self.sorted = sorted(self.known)
        # a rule is a pattern over identifiers written as ",3,7,"
        self.rules = [(name, re.compile("".join(f"(?:{-i},)?" if i < 0 else f"{i}," for i in ids))) for name, ids in rules]

    def goes_on(self, words: str) -> bool:
        """Does a known sentence begin with the words and have more."""
        at = bisect_left(self.sorted, words + " ")
        return at < len(self.sorted) and self.sorted[at].startswith(words + " ")

    def recognised(self, text: str) -> list[tuple[int, int, int]]:
        """Identifier, start and end of the known sentences, in order; the longest from each place."""
        parts, at, ended = [], 0, "\n"  # of a part: start, end and what ends it, "" for an empty line or the text's end
        for m in END.finditer(text):
            if m.start() > at or m.group() == "":
                parts.append((at, m.start(), m.group()))
            elif parts and m.group() == "\n" and ended == "\n":
                parts.append((at, at, ""))  # an empty line ends a sentence
            at, ended = m.end(), m.group()
        found, i = [], 0
        while i < len(parts):
            a = parts[i][0]
            head = WORD.search(text, a, parts[i][1])
            best = None
            if head and normal(head.group()) in self.heads:
                words, stops = "", set()
                for j in range(i, len(parts)):
                    if more := normal(text[parts[j][0] : parts[j][1]]):
                        words = f"{words} {more}" if words else more
                        sentence, own = self.known.get(words, (None, ()))
                        if sentence is not None and stops <= own:
                            best = (sentence, head.start(), parts[j][1], j)
                        if not self.goes_on(words):
                            break
                    if not parts[j][2]:
                        break
                    if parts[j][2].strip("\n:"):
                        stops.add(words.count(" ") + 1)
            if best:
                found.append(best[:3])
                i = best[3]
            i += 1
        return found

    def scan(self, text: str | None) -> list[tuple]:
        """License, rule, identifiers, start and end of each match, and of what no rule matches."""
        seen = self.recognised(text or "")
        if not seen:
            return []
        taken, out = [False] * len(seen), []
        for number, (name, pattern) in enumerate(self.rules):
            free = "".join(f"{0 if t else s[0]}," for s, t in zip(seen, taken, strict=True))
            for m in pattern.finditer(free):
                if m.start() and free[m.start() - 1] != ",":
                    continue
                a, n = free[: m.start()].count(","), m.group().count(",")
                taken[a : a + n] = [True] * n
                out.append((name, number, [s[0] for s in seen[a : a + n]], seen[a][1], seen[a + n - 1][2]))
        out += [(None, None, [s[0]], s[1], s[2]) for s, t in zip(seen, taken, strict=True) if not t]
        return sorted(out, key=lambda x: x[3])


def license_matches(docs: DataFrame, sentences: dict[int, str] = NOTICES, rules=NOTICE_RULES) -> DataFrame:
    if len(sentences) + len(rules) > RULE_LIMIT:
        raise ValueError(f"at most {RULE_LIMIT} sentences and rules are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((sentences, rules))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("rule", pa.int32()), ("sentences", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        scanner = Scanner(*shared.value)
        for batch in T.batches_of(batches):
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in scanner.scan(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            ) if rows else pa.RecordBatch.from_pylist([], schema)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(scan, FOUND)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))
