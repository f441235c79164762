"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A text is read around every word that hints at a licence (`_HINT`; a text without one has no licence of its own, unless
it is a licence file, which is compared whole as well). Compared are the hint's line and its paragraph (lines without a
word end one), of any length, and for each template the run of words that lies about the hint as it does in the template,
whatever the lines, comment marks or length of what surrounds it. Words are weighted by how few templates have them; the
measure is the cosine of the sparse vectors. A template whose words present about the hint cannot reach the threshold,
by the inequality of Cauchy and Schwarz, is passed over, which loses nothing. The best template at THRESHOLD or more
names the licence; one that is longer by a quarter and scores nearly as high (NEARLY) comes before it, as a licence may
hold the words of another and more. Templates are notices, first lines or whole texts of licences, and SPDX lines.

A file without a licence inherits that of the nearest ancestor directory that has a licence file (by name: LICENSE,
COPYING, ...): directories, not files, are joined with their ancestors, and files with the result.

Null and empty texts have no licence of their own. A null path inherits nothing. Ties go to the longer template, then
to the name that comes first; of several licence files in a directory the best score, then the first path decides.
Repeated rows get equal results, rows with a null id are scanned like others. An empty table gives no rows. Other
columns, whatever their names, are ignored; texts are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.common import materialise, ship

#: Common texts of licences, parts of the templates below.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction"
)
_MIT = (
    _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_3 = (
    _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."
)
_ISC_END = (
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)

#: Notices, first lines and whole texts of common licences, under their SPDX names.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _GRANT),
    ("MIT", _MIT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ " + _VERBATIM),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _VERBATIM),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA " + _VERBATIM),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _VERBATIM),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000,2001,2002 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA " + _VERBATIM),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. http://fsf.org/ " + _VERBATIM),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. Commercial Use means distribution or otherwise making the Covered Code available to a third party."),
    ("Artistic-1.0", "The Artistic License Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ " + _VERBATIM),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA " + _VERBATIM),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ " + _VERBATIM),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License, Simplified BSD License."),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License, New BSD License."),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", _BSD_3 + _BSD_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_END),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Unlicense", _UNLICENSE),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal Public Domain Dedication."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
]
#: One SPDX line for each name.
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in NOTICES)]
THRESHOLD, NEARLY, LONGER = 0.7, 0.1, 1.25
_HINT = re.compile(r"licen[sc]e|copyright|spdx|creative\W{1,16}commons|permission\W{1,16}(?:is\W{1,16}hereby|to\W{1,16}use)|redistribution\W{1,16}and\W{1,16}use|public\W{1,16}domain", re.IGNORECASE)
#: The end of a line before one without a word: empty, of white space, or of comment marks alone.
_BREAK = re.compile(r"\n(?=[^\w\n]*\n)")
#: Notices may have their sentences apart, with other text between: how many times a template's rest is read.
STRETCH = (1, 2, 4)
_WORD = re.compile(r"\w+")
#: Names of licence files.
FILE_NAME = r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(^|/)copying[^/]*$"
Found = tuple[float, int]  # score, number of the template (-1: none)


class Templates:
    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        counts = [Counter(_WORD.findall(t.lower())) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        self.threshold = threshold
        self.idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
        self.unknown = math.log(1 + len(counts)) + 1  # words that no template has
        self.names = [n for n, _ in templates]
        self.vectors = [self._vector(c) for c in counts]
        self.sizes = [sum(c.values()) for c in counts]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, v in enumerate(self.vectors):
            for w, x in v.items():
                self.postings.setdefault(w, []).append((k, x))
        # for each template the words before and from its hints
        self.reaches = [sorted({(before, rest * s) for before, rest in self._hints(t) for s in STRETCH}) for _, t in templates]
        self.before = max((b for r in self.reaches for b, _ in r), default=0)
        self.rest = max((a for r in self.reaches for _, a in r), default=0)

    @staticmethod
    def _hints(text: str) -> list[tuple[int, int]]:
        starts = [m.start() for m in _WORD.finditer(text)]
        places = [bisect_right(starts, m.start()) - 1 for m in _HINT.finditer(text)]
        return [(k, len(starts) - k) for k in places]

    def _vector(self, counts: Counter) -> dict[str, float]:
        raw = {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    def cosines(self, words: list[str]) -> dict[int, float]:
        """By template, where any word is shared."""
        dots: dict[int, float] = {}
        if words:
            for w, x in self._vector(Counter(words)).items():
                for k, y in self.postings.get(w, ()):
                    dots[k] = dots.get(k, 0.0) + x * y
        return dots

    def _cosine(self, words: list[str], k: int) -> float:
        own = self.vectors[k]
        return sum(x * own.get(w, 0.0) for w, x in self._vector(Counter(words)).items())

    def within_reach(self, words: set[str]) -> list[int]:
        """The templates that some choice of these words may bring to the threshold: a cosine is at most the length of the template's part on them."""
        square: dict[int, float] = {}
        for w in words:
            for k, y in self.postings.get(w, ()):
                square[k] = square.get(k, 0.0) + y * y
        return [k for k, v in square.items() if v >= self.threshold**2 - 1e-9]

    def choose(self, best: dict[int, float]) -> tuple[float, str | None]:
        """Of the best score of each template: the highest, or a longer template's that is nearly as high."""
        rank = lambda k: (-round(best[k], 9), -self.sizes[k], self.names[k])
        if not best:
            return 0.0, None
        k = min(best, key=rank)
        while True:
            longer = [j for j in best if best[j] >= max(self.threshold, best[k] - NEARLY) and self.sizes[j] >= LONGER * self.sizes[k]]
            if not longer:
                return best[k], self.names[k]
            k = min(longer, key=rank)

    def scan(self, text: str, whole_file: bool) -> tuple[float, str | None]:
        """The licence of a text and its score."""
        hints = [(m.start(), m.end()) for m in _HINT.finditer(text)]
        if not hints and not whole_file:
            return 0.0, None
        best: dict[int, float] = {}

        def seen(k: int, score: float) -> None:
            if score > best.get(k, 0.0):
                best[k] = score

        starts, words = [], []
        for w in _WORD.finditer(text):
            starts.append(w.start())
            words.append(w.group().lower())
        if whole_file:
            for k, score in self.cosines(words).items():
                seen(k, score)
        breaks = [b.start() for b in _BREAK.finditer(text)] if hints else []
        spans, runs = set(), set()
        for begin, end in hints:
            at = bisect_right(starts, begin) - 1
            around = set(words[max(0, at - self.before) : at + self.rest])
            for k in self.within_reach(around):
                runs.update((k, max(0, at - before), min(len(words), at + rest)) for before, rest in self.reaches[k])
            line = text.rfind("\n", 0, begin) + 1, text.find("\n", end)
            above, below = bisect_left(breaks, begin), bisect_left(breaks, end)
            spans.add((line[0], line[1] if line[1] >= 0 else len(text)))
            spans.add((breaks[above - 1] + 1 if above else 0, breaks[below] if below < len(breaks) else len(text)))
            if len(runs) > 10_000:
                self._read(words, runs, seen)
        self._read(words, runs, seen)
        for a, b in spans:
            for k, score in self.cosines(words[bisect_left(starts, a) : bisect_left(starts, b)]).items():
                seen(k, score)
        return self.choose(best)

    def _read(self, words: list[str], runs: set[tuple[int, int, int]], seen) -> None:
        for k, a, b in runs:
            seen(k, self._cosine(words[a:b], k))
        runs.clear()


def _scan(templates: list[tuple[str, str]], threshold: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates, threshold)
        for b in batches:
            found = []
            for text, is_file in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                score, name = t.scan(text, bool(is_file)) if text else (0.0, None)
                found.append((name, score) if name and score >= threshold else (None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "path", "is_file", "license", "score"])

    return run


def _parent(path: Column) -> Column:
    """The directory of a path, without its last slash; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, origin, license_dir) for each file; origin is own, inherited or none."""
    ship(files.sparkSession)
    path = F.col("path") if path is None else path
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text")).withColumn("is_file", F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    own = materialise(rows.mapInArrow(_scan(templates, threshold), f"doc_id {kind}, path string, is_file boolean, license string, score double").withColumn("dir", _parent(F.col("path"))), "own-licences")
    granted = own.where("is_file and license is not null").groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct(-F.round("score", 9), "path")).alias("g")).select(F.col("dir").alias("ancestor"), "g")
    parts = F.split("dir", "/")
    n = F.size(parts)
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    needy = own.where("license is null and dir is not null").select("dir").distinct()
    nearest = needy.select("dir", F.explode(F.array_distinct(ancestors)).alias("ancestor")).join(granted, "ancestor")
    nearest = materialise(nearest.groupBy("dir").agg(F.max_by(F.struct("ancestor", "g.license", "g.score"), F.length("ancestor")).alias("i")).withColumnRenamed("dir", "__dir"), "inherited")
    both = own.join(nearest, (own["dir"] == nearest["__dir"]) & own["license"].isNull(), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("i").isNotNull(), "inherited").otherwise("none")
    return both.select("doc_id", "path", F.coalesce("license", "i.license").alias("license"), F.coalesce("score", "i.score").alias("score"), origin.alias("origin"), F.col("i.ancestor").alias("license_dir"))
