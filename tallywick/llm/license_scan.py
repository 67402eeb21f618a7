"""Licence scan: segments of a text against licence templates by Dice over word bigrams.

Segments are the lines, the sentences (also those that run over lines), the paragraphs (between lines
that are blank or bare comment marks) and the whole text. Both sides are
normalised to lower-cased words of letters and digits. Dice = 2 |A and B| / (|A| + |B|) over sets of
word bigrams; at a threshold t a template of n bigrams can only match segments of between
n t / (2 - t) and n (2 - t) / t bigrams, and a match must hold one of the template's anchor words, a
set so chosen that the bigrams without any of them cannot reach t alone. Both bounds are exact: they
prune templates and segments that cannot match, never one that can. All of it is column expressions.

Defined results: null and empty texts, and segments of fewer than two words, match nothing; repeated
rows add to the counts of their id; a segment counts for the best template, ties for the first name,
and equal segments of a text count once;
other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices, paragraphs and whole texts of short licences, as published.
_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_UNLICENSE = "This is free and unencumbered software released into the public domain."
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{_BSD_TWO} {_WARRANTY}",
    "bsd-3-clause": f"{_BSD_TWO} {_BSD_THREE} {_WARRANTY}",
    "bsd-3-clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-conditions": _BSD_TWO,
    "bsd-disclaimer": _WARRANTY,
    "bsd-endorsement": _BSD_THREE,
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": _ISC,
    "isc-whole": f"{_ISC} {_ISC_WARRANTY}",
    "mit": f"{_MIT} {_MIT_NOTICE} {_MIT_WARRANTY}",
    "mit-disclaimer": _MIT_WARRANTY,
    "mit-licensed-line": "Licensed under the MIT License.",
    "mit-line": "Released under the MIT License.",
    "mit-notice": _MIT_NOTICE,
    "mit-permission": _MIT,
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": _UNLICENSE,
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Words that ordinary texts hold; anchors are taken from the others as far as those reach.
COMMON = frozenset("a an and any be by can free following for from in is may not of on or provided source subject that the this to under use with work you".split())

#: What parts paragraphs: a line without text, be it empty or a bare comment mark.
PARTED = r"\n[ \t\r]*(?:#+|\*+/?|/\*+|//+|;+|%+|--+|<!--+|--+>|\(\*|\*\)|rem|REM)?[ \t\r]*\n"

WORDS = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchor_words(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words, long and telling ones first, of which every possible match holds at least one."""
    chosen: set[str] = set()
    for grams in templates.values():
        for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in COMMON, w.isdigit(), -len(w), w)):
            if sum(not chosen & set(g.split(" ")) for g in grams) < threshold / (2 - threshold) * len(grams) - 1e-9:
                break
            chosen.add(word)
    return sorted(chosen)


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a segment that can match a template of n bigrams."""
    return -int(-(n * threshold / (2 - threshold) - 1e-9) // 1), int(n * (2 - threshold) / threshold + 1e-9)


def _segments(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.split(text, PARTED)
    sentences = F.split(F.regexp_replace(F.regexp_replace(text, "[ \t\r\n]+", " "), "([.;:!?]) ", "$1\n"), "\n")
    return F.array_distinct(F.concat(lines, sentences, paragraphs, F.array(text)))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), WORDS, " "))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """id, template, n_segments that match it best, best_dice."""
    grams = {name: template_bigrams(t) for name, t in sorted((templates or TEMPLATES).items())}
    grams = {name: g for name, g in grams.items() if g}
    most = max(bounds(len(g), threshold)[1] for g in grams.values())
    words_of = anchor_words(grams, threshold)

    def held(text: Column) -> Column:
        # the array holds the lower-cased text once for all tests
        return F.exists(F.array(F.lower(text)), lambda t: reduce(or_, (F.contains(t, F.lit(w)) if len(w) > 3 else t.rlike(rf"\b{w}\b") for w in words_of)))

    # plain substring tests first: most texts and segments hold no anchor and go no further
    anchored = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(held(F.col("text")))
    segments = anchored.select(id_col, F.explode(_segments(F.col("text"))).alias("segment")).filter(held(F.col("segment")))
    whole_word = rf"(?:^| )(?:{'|'.join(words_of)})(?: |$)"
    normal = segments.select(id_col, _normal(F.col("segment")).alias("s")).filter(F.col("s").rlike(whole_word))
    words = normal.select(id_col, F.split("s", " ").alias("w")).filter(F.size("w") >= 2)
    pairs = F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    sized = words.select(id_col, pairs.alias("b")).filter(F.size("b") <= most)

    def dice(name: str, g: list[str]) -> Column:
        low, high = bounds(len(g), threshold)
        score = 2.0 * F.size(F.array_intersect("b", F.array(*map(F.lit, g)))) / (F.size("b") + len(g))
        return F.when(F.size("b").between(low, high), F.struct((-score).alias("d"), F.lit(name).alias("template")))

    best = sized.select(id_col, F.array_min(F.array(*(dice(n, g) for n, g in grams.items()))).alias("x")).filter(-F.col("x.d") >= threshold)
    return best.groupBy(id_col, F.col("x.template").alias("template")).agg(F.count("*").alias("n_segments"), F.max(-F.col("x.d")).alias("best_dice"))
