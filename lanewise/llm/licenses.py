"""License scans: TF-IDF cosine to templates, then inheritance by directory.

Every line and every paragraph of a whole text that names a license word, and the
whole of such a text, is compared with license notices, whole license texts and
identifier lines: sparse TF-IDF vectors of words and word pairs, with document
frequencies counted over all texts. A text that consists mostly of matching
paragraphs, or whose file name says so, is a license file. A text with no license
of its own takes that of the license file in the nearest directory above it,
found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, map_rows

# SPDX identifiers and notices that stand for them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met; neither the name of the copyright holder may be used to endorse."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# The published texts of short licenses, without the copyright line.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = (
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
     "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
     'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
     "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
     "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License. " + _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License. " + _BSD + _BSD_3 + _BSD_AS_IS),
)
# SPDX identifiers by the license that they name.
IDENTIFIERS = (
    ("MIT", ("MIT",)), ("Apache-2.0", ("Apache-2.0",)), ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")), ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("LGPL-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")), ("AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")), ("BSD-3-Clause", ("BSD-3-Clause",)),
    ("BSD-2-Clause", ("BSD-2-Clause",)), ("MPL-2.0", ("MPL-2.0",)), ("ISC", ("ISC",)), ("CC-BY-4.0", ("CC-BY-4.0",)), ("CC-BY-SA-4.0", ("CC-BY-SA-4.0",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4.0",)), ("CC-BY-ND-4.0", ("CC-BY-ND-4.0",)), ("CC0-1.0", ("CC0-1.0",)), ("Unlicense", ("Unlicense",)),
)
TEMPLATES = (*NOTICES, *TEXTS, *((name, f"SPDX-License-Identifier: {i}") for name, ids in IDENTIFIERS for i in ids))
_ANCHOR = re.compile(r"licen[cs]e|permission|redistribut|public domain|creative commons|spdx|free software", re.I | re.A)
_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_MARKS = "#/*-;!%\"'<>|: \t"
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
LEAST = 0.6
#: Identifier lines share all words but the identifier itself.
LEAST_IDENTIFIER = 0.95
_IDENTIFIER = re.compile(r"SPDX-License-Identifier:", re.I | re.A)


def terms(text: str) -> Counter:
    """Words and pairs of neighbouring words, lower-cased."""
    words = _TERM.findall(text.lower())
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})


def paragraphs(text: str) -> Iterator[tuple[list[str], str | None]]:
    """Per paragraph with a license word: its lines with one, without comment
    marks, and all of its lines as one (None: it has one line). Each term of an
    expression of identifiers is a line of its own. An identifier names a license
    and is no text of one."""
    if not _ANCHOR.search(text):
        return
    for part in re.split(r"\n[ \t]*\n", text):
        if not _ANCHOR.search(part):
            continue
        lines, marked = [x.strip(_MARKS) for x in part.split("\n")], []
        for x in lines:
            if m := _IDENTIFIER.search(x):
                marked += [f"SPDX-License-Identifier: {i}" for i in re.split(r"[\s()]+|(?<=\s)(?:AND|OR)(?=\s)", x[m.end() :]) if i not in ("", "AND", "OR", "*/", "-->")]
            elif _ANCHOR.search(x):
                marked.append(x)
        yield marked, " ".join(lines) if len(lines) > 1 else None


def segments(text: str) -> Iterator[str]:
    """Whatever of a text is compared with the templates."""
    every = list(paragraphs(text))
    for lines, whole in every:
        yield from lines
        if whole is not None:
            yield whole
    if every and "\n" in text and not _IDENTIFIER.search(text):
        yield " ".join(text.split())


def reaches(segment: str, score: float, least: float = LEAST) -> bool:
    return score >= (max(least, LEAST_IDENTIFIER) if _IDENTIFIER.search(segment) else least)


class Matcher:
    """Cosine of TF-IDF vectors; ``df`` counts texts by vocabulary term."""

    def __init__(self, df: dict[str, int], texts: int):
        self.top = math.log(1 + texts) + 1
        self.idf = {t: math.log((1 + texts) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(TEMPLATES):
            v = self.vector(text)
            for t, w in v.items():
                self.index.setdefault(t, []).append((k, w))

    def vector(self, text: str) -> dict[str, float]:
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.top) for t, n in terms(text).items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return {t: w / norm for t, w in v.items()}

    def best(self, segment: str) -> tuple[str | None, float]:
        """The nearest template's license; ties go to the earlier template."""
        dots = [0.0] * len(TEMPLATES)
        for t, w in self.vector(segment).items():
            for k, x in self.index.get(t, ()):
                dots[k] += w * x
        k = max(range(len(dots)), key=lambda i: (dots[i], -i))
        return (TEMPLATES[k][0], dots[k]) if dots[k] > 0 else (None, 0.0)


def document_frequencies(files: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """Counts over all texts for the fixed vocabulary (a few hundred rows)."""
    words = frozenset(t for t in VOCABULARY if " " not in t)
    pairs = frozenset(t for t in VOCABULARY if " " in t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[""] += 1
                found = _TERM.findall((text or "").lower())
                df.update(words.intersection(found))
                df.update({p for a, b in zip(found, found[1:]) if a in words and (p := f"{a} {b}") in pairs})
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    found = map_rows(files.select(F.col(text_col).cast("string").alias("text")), run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in found}
    return df, df.pop("", 0)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def scan_licenses(
    files: DataFrame, id_col: str, path: Column, text_col: str = "text", least: float = LEAST, most_of: float = 0.5
) -> DataFrame:
    """One row per row of ``files``: ``(id, path, license, score, licenses,
    is_license_file, effective, inherited_from)``.

    ``license`` is the best match of at least ``least`` (null: none), ``licenses``
    all that reach it. ``effective`` is that license, else the one of the license
    file in the nearest directory above (of several in one directory the smallest
    path's), with that file in ``inherited_from``. Null and empty texts match
    nothing but inherit; a null path stands outside every directory; repeated
    rows are kept; empty tables are fine.
    """
    matcher = files.sparkSession.sparkContext.broadcast(document_frequencies(files, text_col))
    picked = files.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text"))

    def make():
        m = Matcher(*matcher.value)
        memo: dict[str, tuple[str | None, float]] = {}

        def best(segment: str) -> tuple[str | None, float]:
            if segment not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[segment] = m.best(segment)
            return memo[segment]

        def one(text: str):
            top, hits, covered = (None, 0.0), set(), 0

            def matches(segment: str, keep: bool = True) -> bool:
                nonlocal top
                name, score = best(segment) if keep else m.best(segment)
                if not name or not reaches(segment, score, least):
                    return False
                hits.add(name)
                if score > top[1] + 1e-12:
                    top = (name, score)
                return True

            every = list(paragraphs(text))
            for lines, whole in every:
                some = sum(len(x) for x in lines if matches(x) and not _IDENTIFIER.search(x))
                covered += len(whole) if whole is not None and matches(whole) and not _IDENTIFIER.search(whole) else some
            if every and "\n" in text and not _IDENTIFIER.search(text) and matches(" ".join(text.split()), False):
                covered = len(text)
            return top[0], top[1] if top[0] else None, sorted(hits), covered >= most_of * len(text) > 0

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, s, a, w = zip(*[one(t or "") for t in batch.column(2).to_pylist()]) if batch.num_rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.string()), pa.array(s, pa.float64()), pa.array(a, pa.list_(pa.string())), pa.array(w, pa.bool_())],
                ["id", "path", "license", "score", "licenses", "whole"],
            )

        return apply

    kind = picked.schema["id"].dataType.simpleString()
    own = map_batches(picked, make, f"id {kind}, path string, license string, score double, licenses array<string>, whole boolean").withColumn(
        "is_license_file",
        F.col("license").isNotNull() & (F.col("whole") | F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAMES), F.lit(False))),
    ).drop("whole").withColumn("dir", _directory(F.col("path")))
    own = cut(own)
    holders = own.where("is_license_file").groupBy("dir").agg(F.min(F.struct("path", "license")).alias("holder")).withColumnRenamed("dir", "above")
    # directories, not files, are joined with what lies above them
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ancestors = own.where("dir IS NOT NULL").select("dir").distinct().withColumn("above", F.explode(F.array_distinct(above)))
    nearest = ancestors.join(holders, "above").groupBy("dir").agg(F.max_by("holder", F.length("above")).alias("holder"))
    inherits = F.col("license").isNull() & F.col("holder").isNotNull()
    return own.join(nearest, "dir", "left").select(
        "id", "path", "license", "score", "licenses", "is_license_file",
        F.coalesce("license", "holder.license").alias("effective"),
        F.when(inherits, F.col("holder.path")).alias("inherited_from"),
    )
