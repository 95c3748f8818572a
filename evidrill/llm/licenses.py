"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_BSD_TWO = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_THIRD = '3. {Neither} the {name} of the copyright holder {nor} the names of its contributors may be used to {endorse} or {promote} products derived from this software without specific prior written permission.'
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."


def _templates() -> tuple[tuple[str, str], ...]:
    """(name, text): short notices with the names and versions of each family spelled out, headers, and whole licences.

    Words in braces have to match: they are what tells a licence from its relatives.
    """
    out = [("all-rights-reserved", "All rights reserved.")]
    out += [(f"{name.lower()}-short", f"Released under the {{{name}}} License.") for name in ("MIT", "BSD", "ISC", "zlib")]
    out += [(f"apache-{a}.{b}-short", f"Licensed under the {{Apache}} License, Version {{{a}}}.{{{b}}}.") for a, b in ((2, 0), (1, 1), (1, 0))]
    for kind, words in (("gpl", ""), ("lgpl", "{Lesser} "), ("agpl", "{Affero} ")):
        for version in ("2", "2.1", "3"):
            number = ".".join(f"{{{x}}}" for x in version.split("."))
            full = version if "." in version else f"{version}.0"
            out.append((f"{kind}-{full}-short", f"This work is licensed under the GNU {words}General Public License, version {number}."))
            out.append((f"{kind}-{full}-header", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {words}General Public License as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version."))
    kinds = {"by": "Attribution", "by-sa": "Attribution-{ShareAlike}", "by-nd": "Attribution-{NoDerivatives}", "by-nc": "Attribution-{NonCommercial}", "by-nc-sa": "Attribution-{NonCommercial}-{ShareAlike}", "by-nc-nd": "Attribution-{NonCommercial}-{NoDerivatives}"}
    for kind, full in kinds.items():
        short = "BY" + "".join(f"-{{{x.upper()}}}" for x in kind.split("-")[1:])
        for a in (3, 4):
            out.append((f"cc-{kind}-{a}.0-short", f"Licensed under {{CC}} {short} {{{a}}}.0."))
            out.append((f"cc-{kind}-{a}.0", f"This work is licensed under a Creative Commons {full} {{{a}}}.0 International License."))
    out += [
        ("apache-2.0-header", 'Licensed under the Apache License, Version {2}.{0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
        ("mpl-2.0-header", "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2}.{0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
        ("mit-permission", _MIT),
        ("mit", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}"),
        ("bsd-redistribution", _BSD_TWO.split(" met:")[0] + " met"),
        ("bsd-2-clause", f"{_BSD_TWO} {_BSD_WARRANTY}"),
        ("bsd-3-clause", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
        ("isc-permission", _ISC),
        ("isc", f"{_ISC} {_ISC_WARRANTY}"),
        ("zlib", _ZLIB),
        ("unlicense", _UNLICENSE),
    ]
    return tuple(out)


TEMPLATES = _templates()
#: Words in a gram, and grams in a winnowing window: any shared run of GRAM + WINNOW - 1 words shares a fingerprint.
GRAM, WINNOW = 3, 3
#: Words of a template up to which all of its grams are kept: a change in the middle of a notice leaves no longer run.
NOTICE = 20
#: Half the width of the alignment's band, in words.
BAND = 4
#: Share of a template that has to match.
MIN_COVERAGE = 0.8

WORD = re.compile(r"[^\W_]+")

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("license", T.StringType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def winnow(grams: list[tuple], window: int = WINNOW) -> list[int]:
    """Positions of the fingerprints: in every window of grams the smallest, the last of equal ones."""
    window = min(window, len(grams))
    picked: list[int] = []
    for at in range(len(grams) - window + 1):
        best = min(range(at, at + window), key=lambda i: (grams[i], -i))
        if not picked or picked[-1] != best:
            picked.append(best)
    return picked


#: (matched words, required ones among them, first, end) of an alignment.
Place = tuple[int, int, int, int]
NOWHERE: Place = (0, 0, -1, -1)


class LicenseIndex:
    """An inverted index from winnowed grams of the templates to (template, position)."""

    def __init__(self, templates: tuple[tuple[str, str], ...], gram: int = GRAM, window: int = WINNOW, band: int = BAND) -> None:
        self.names = [n for n, _ in templates]
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(m[0].lower(), len(self.vocabulary) + 1) for m in WORD.finditer(t)] for _, t in templates]
        self.required = [[t[m.start() - 1 : m.start()] == "{" for m in WORD.finditer(t)] for _, t in templates]
        self.gram, self.band = gram, band
        self.index: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            n = min(gram, len(w))
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            for at in winnow(grams, 1 if len(w) <= NOTICE else window):
                self.index[grams[at]].append((t, at))
        self.lengths = sorted({len(g) for g in self.index})
        self.base = len(self.vocabulary) + 1
        self.codes = {n: np.array(sorted(sum(x * self.base**k for k, x in enumerate(reversed(g))) for g in self.index if len(g) == n), np.int64) for n in self.lengths}

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(template, diagonal) pairs of the text's words. All grams of the text are looked up, so none is missed."""
        found = set()
        for n in self.lengths:
            if len(ids) < n:
                continue
            code = np.zeros(len(ids) - n + 1, np.int64)
            for k in range(n):
                code = code * self.base + ids[k : len(ids) - n + 1 + k]
            for at in np.flatnonzero(np.isin(code, self.codes[n])):
                for t, place in self.index[tuple(int(x) for x in ids[at : at + n])]:
                    found.add((t, int(at) - place))
        return found

    def align(self, t: int, ids: list[int], diagonal: int) -> Place:
        """The longest common subsequence of the template and the text within the band; of those with most of the required words."""
        w, need, band = self.words[t], self.required[t], self.band
        # most required words, then most words; then the start nearest to the candidate's, and the earliest end
        rank = lambda o: (o[1], o[0], -abs(o[2] - diagonal), -o[3])
        best: dict[int, Place] = {}
        for i, x in enumerate(w):
            row: dict[int, Place] = {}
            for j in range(max(0, i + diagonal - band), min(len(ids), i + diagonal + band + 1)):
                options = [best.get(j, NOWHERE), row.get(j - 1, NOWHERE)]
                if ids[j] == x:
                    n, r, first, _ = best.get(j - 1, NOWHERE)
                    options.append((n + 1, r + need[i], first if first >= 0 else j, j + 1))
                row[j] = max(options, key=rank)
            best = row
        return max(best.values(), key=rank, default=NOWHERE)

    def places(self, candidates: set[tuple[int, int]], words: list[int], min_coverage: float) -> list[tuple[int, int, int, int]]:
        """(template, matched, first, end) of the candidates that hold: all required words, and the share of the template.

        A place inside another one of more matched words goes, so that of a family's templates the one that says most stays.
        """
        found: dict[tuple[int, int], Place] = {}
        for t, diagonal in candidates:
            n, r, first, end = self.align(t, words, diagonal)
            if n and n >= min_coverage * len(self.words[t]) and r == sum(self.required[t]):
                old = found.get((t, first))
                if old is None or (n, -end) > (old[0], -old[3]):
                    found[t, first] = (n, r, first, end)
        out: list[tuple[int, int, int, int]] = []
        for t in range(len(self.names)):
            taken = -1
            for n, _, first, end in sorted((v for (k, _), v in found.items() if k == t), key=lambda v: (v[2], -v[0], v[3])):
                if first >= taken:
                    out.append((t, n, first, end))
                    taken = end
        # of equal ones the template named first stays
        return [p for p in out if not any(o[2] <= p[2] and p[3] <= o[3] and (o[1], -o[0]) > (p[1], -p[0]) for o in out)]

    def scan(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, float, int, int]]:
        """(name, matched words, coverage, start, end) of each place of a template; start and end count characters."""
        if not text:
            return []
        known = self.vocabulary
        # lower-casing may change a text's length, so the words are taken first
        ids = np.array([known.get(w.lower(), 0) for w in WORD.findall(text)], np.int64)
        candidates = self.candidates(ids)
        if not candidates:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        return [(self.names[t], n, n / len(self.words[t]), spans[first][0], spans[end - 1][1]) for t, n, first, end in self.places(candidates, ids.tolist(), min_coverage)]


def _scan(templates, gram, window, band, min_coverage):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates, gram, window, band)
        for batch in batches:
            rows = [(d, *r) for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in index.scan(x.as_py(), min_coverage)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=RESULT.names)

    return run


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, gram: int = GRAM, window: int = WINNOW, band: int = BAND, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, matched, coverage, start, end), one row for each place of a template in a text.

    Words are runs of letters and digits, compared in lower case. matched counts the template's words that the alignment finds in
    order, coverage is their share of the template, start and end are the span in characters, end exclusive. Words that a template puts in braces
    (its name and version) have to match. Places of one template don't overlap; a place inside one of another template that matches more words is left out. Null and empty texts have none. Each row of docs is scanned on its own:
    repeated rows give repeated results. A null doc_id comes back null; extra columns are ignored. The index goes to the workers with the
    code: its size is that of the templates.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(templates, gram, window, band, min_coverage), RESULT)
