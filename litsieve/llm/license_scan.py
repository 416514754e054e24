"""License scans by conditional compression.

Words of licences are looked for, at least one of each template's, and what is within reach
of them, over lines and paragraphs, is a candidate block (those that meet are one). Every template whose words can be there is confirmed by wording: the block's and the
template's words are aligned, and a template holds if nearly all its words occur in order
and all the words that tell it from its relatives (name, version, clause) do. The aligned
stretch is compressed by itself and with the template as a raw zstandard dictionary;
the template that makes it smaller by most bytes is a match, its stretch is taken out, and
the rest of the block is looked at again. What differs is returned as text.

Defined cases: null and empty texts have no blocks; a text of any length is scanned
whole, whatever its lines; equal gains go to the template first in order; repeated rows each get a row; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

WORDING = 0.8
#: Words that are looked at together; a notice of up to half of them, with whatever words
#: are put between, is whole in one.
WINDOW = 512
#: Between the words of a phrase: also a line's end and the next one's comment mark.
GAP = r"[\W_]{1,16}"
COMMON = ["licen[sc]", "copyright", r"\bspdx\b", f"public{GAP}domain", f"permission{GAP}is{GAP}hereby", f"redistribution{GAP}and{GAP}use", f"without{GAP}warrant", rf"\bas{GAP}is\b", f"creative(?:{GAP})?commons", rf"\bcc{GAP}(?:by|0)", r"\bl?gpl\b", f"all{GAP}rights{GAP}reserved", f"free{GAP}software"]
WORD = re.compile(r"\w+(?:\.\w+)*")
CONJUNCTION = re.compile(r"[\s,;(]*(?:(?:and/or|and|or)\b|[/+&])", re.IGNORECASE)

#: Public licence notices: id, the words that must occur, the notice.
TEMPLATES = [
    ("MIT", ("mit",), "Released under the MIT License."),
    ("MIT", ("mit",), "This project is licensed under the terms of the MIT license. See the LICENSE file for details."),
    ("MIT", ("sublicense", "merge"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", ("isc",), "Released under the ISC License."),
    ("ISC", ("purpose", "fee", "hereby"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", ("apache", "2.0"), "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", ("apache", "2.0"), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", ("bsd", "2"), "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", ("bsd", "3"), "Licensed under the BSD 3-Clause License."),
    ("BSD", ("redistributions", "binary", "source"), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("GPL-2.0", ("gnu", "general", "2"), "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", ("gnu", "general", "3"), "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", ("gnu", "general", "3", "later"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", ("gnu", "general", "2", "later"), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", ("gnu", "lesser", "2.1"), "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", ("gnu", "lesser", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", ("gnu", "affero", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", ("mozilla", "2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", ("eclipse", "2.0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", ("unencumbered",), "This is free and unencumbered software released into the public domain."),
    ("Zlib", ("commercial", "altered"), "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: altered source versions must be plainly marked as such"),
    ("CC0-1.0", ("cc0",), "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", ("cc", "by", "4.0"), "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", ("cc", "by", "sa", "4.0"), "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", ("cc", "by", "nc", "4.0"), "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", ("cc", "by", "nd", "4.0"), "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", ("cc", "by", "nc", "sa", "4.0"), "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", ("commons", "attribution", "4.0"), "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", ("commons", "sharealike", "4.0"), "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", ("commons", "noncommercial", "4.0"), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", ("all", "rights", "reserved"), "Copyright (c) the authors. All rights reserved."),
]
#: Tags of files, and the headings of whole licence texts.
TAGS = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]
TEMPLATES += [(n, ("spdx", *WORD.findall(n.lower())), f"SPDX-License-Identifier: {n}") for n in TAGS]
TAGGED = range(len(TEMPLATES) - len(TAGS), len(TEMPLATES))
TEMPLATES += [
    ("Apache-2.0", ("apache", "2.0", "january"), "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", ("gnu", "general", "2", "1991"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", ("gnu", "general", "3", "2007", "29"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", ("gnu", "affero", "3", "19"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSL-1.0", ("boost", "1.0", "august"), "Boost Software License - Version 1.0 - August 17th, 2003"),
]
#: The common triggers, and the first three words of templates that have none of them.
TRIGGER = re.compile("|".join([*COMMON, *(GAP.join(t.lower().split()[:3]) for _, _, t in TEMPLATES if not re.search("|".join(COMMON), t, re.IGNORECASE))]), re.IGNORECASE)
#: Characters on either side of a trigger that belong to its block: a notice of the longest
#: template's length with as much again for what is put between.
REACH = 2 * max(len(t) for _, _, t in TEMPLATES)
#: Words that mark another licence than a template that lacks them.
TELLING = {"mit", "isc", "apache", "bsd", "lesser", "affero", "mozilla", "eclipse", "cc0", "nc", "nd", "sa", "noncommercial", "sharealike", "noderivatives", "later"}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@cache
def compressors() -> list:
    import zstandard

    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": 19}
    each = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain) for _, _, t in TEMPLATES]
    return [zstandard.ZstdCompressor(**plain), *each]


@cache
def template_words() -> list[list[str]]:
    return [words(t) for _, _, t in TEMPLATES]


@cache
def template_counts() -> list[Counter]:
    return [Counter(t) for t in template_words()]


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words within reach of triggers; where these meet they are one
    block."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while 0 < a < m.start() and not text[a - 1].isspace():
            a += 1
        while m.end() < b < len(text) and not text[b].isspace():
            b -= 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def compare(matches: list, block: list[str], template: list[str]) -> tuple[float, list[str], list[str]]:
    """(share of the template's words in order, words it lacks, block words between)."""
    kept = {k for m in matches for k in range(m.a, m.a + m.size)}
    used = {k for m in matches for k in range(m.b, m.b + m.size)}
    lacking = [w for k, w in enumerate(template) if k not in kept]
    return len(kept) / len(template), lacking, [block[k] for k in range(matches[0].b, matches[-1].b + matches[-1].size) if k not in used]


def dense(matches: list) -> list:
    """The neighbouring matches with the most words, less half the words between them."""
    best, total, first = (0.0, 0, 0), 0.0, 0
    for k, m in enumerate(matches):
        gap = (m.b - matches[k - 1].b - matches[k - 1].size) / 2 if k else 0
        if total <= gap:
            total, first = 0.0, k
        else:
            total -= gap
        total += m.size
        if total > best[0]:
            best = (total, first, k + 1)
    return matches[best[1] : best[2]]


def stretch(block: list[str], have: Counter, k: int) -> tuple[int, int, float, list[str], list[str]] | None:
    """(first word, word after the last, wording, words lacking, words between) where
    template k holds. Every notice holds all needed words, so the surroundings of each
    place of the rarest are aligned, then the whole block."""
    needed, template = TEMPLATES[k][1], template_words()[k]
    if any(w not in have for w in needed) or sum(min(n, have[w]) for w, n in template_counts()[k].items()) < WORDING * len(template):
        return None
    rarest, near = min(needed, key=lambda w: have[w]), 2 * len(template) + 40
    places = [(max(0, x - near), x + near) for x, w in enumerate(block) if w == rarest]
    for a, b in [*places, (0, len(block))]:
        part = block[a:b]
        matches = [m for m in SequenceMatcher(None, template, part, autojunk=False).get_matching_blocks() if m.size]
        for chosen in (dense(matches), matches) if matches else ():
            share, lacking, more = compare(chosen, part, template)
            if more and k in TAGGED:  # a tag is one stretch of words
                continue
            if share >= WORDING and not set(needed) & set(lacking) and not TELLING & set(more):
                return a + chosen[0].b, a + chosen[-1].b + chosen[-1].size, share, lacking, more
    return None


def notices(text: str) -> list[tuple[int, int, str, float, float, str]]:
    """(start, end, licence, relative gain, wording, differences) of all notices in a
    block. The one that its template makes smaller by most bytes is taken out, and the rest
    is looked at again until none holds. Before a conjunction its opening words stay, for
    the licence named next."""
    plain, *each = compressors()
    rest = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    while at < len(rest):
        part = rest[at : at + WINDOW]
        block = [w for w, _, _ in part]
        have, best = Counter(block), None
        for k in range(len(TEMPLATES)):
            if found := stretch(block, have, k):
                raw = text[part[found[0]][1] : part[found[1] - 1][2]].encode()
                alone = len(plain.compress(raw))
                saved = alone - len(each[k].compress(raw))
                if saved > (best[0] if best else 0):
                    best = (saved, saved / alone, k, *found)
        if best is None:
            if at + WINDOW >= len(rest):
                break
            at += WINDOW // 2
            continue
        _, gain, k, a, b, share, lacking, more = best
        name, needed, _ = TEMPLATES[k]
        changes = " ".join([*("-" + w for w in lacking), *("+" + w for w in more)])
        out.append((part[a][1], part[b - 1][2], name, gain, share, changes))
        if CONJUNCTION.match(text, part[b - 1][2]):
            a = next(x for x in range(a, b) if block[x] in needed)
        del rest[at + a : at + b]
    return out


def classify(text: str) -> tuple[str, float, float, str] | None:
    """(licence, relative gain, wording, differences) of a block's first notice taken."""
    found = notices(text)
    return found[0][2:] if found else None


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_blocks, n_licenses, licenses (comma-joined, sorted), matches
    (array of start, end, license, gain, wording, differences; the aligned stretch)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, matches = [], []
            for text in batch.column(1).to_pylist():
                cut = blocks(text) if text else []
                found = sorted((a + x, a + y, *f) for a, b in cut for x, y, *f in notices(text[a:b]))
                number.append(len(cut))
                matches.append([dict(zip(("start", "end", "license", "gain", "wording", "differences"), f, strict=True)) for f in found])
            names = [sorted({m["license"] for m in x}) for x in matches]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("gain", pa.float64()), ("wording", pa.float64()), ("differences", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([",".join(x) for x in names]), pa.array(matches, kind)],
                names=["doc_id", "n_blocks", "n_licenses", "licenses", "matches"],
            )

    schema = "doc_id long, n_blocks long, n_licenses long, licenses string, matches array<struct<start: long, end: long, license: string, gain: double, wording: double, differences: string>>"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, schema)
