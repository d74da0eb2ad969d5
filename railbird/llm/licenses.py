"""License scans by MinHash bands over overlapping text windows, in native expressions.

Texts and templates are cut into words and three-word shingles, and these into overlapping
windows.  Long templates have windows of eight shingles, one at each word, of which bands
of two minima are taken: windows of similarity s collide in one of sixteen bands with
probability 1 - (1 - s^2)^16, 0.9999 for 0.8 and 0.99 for 0.5; a text's windows are taken
every four words, so that some window of a copied passage is a template's own.  Short ones
have windows of three shingles (five words) and four bands of one minimum: sure to collide
if equal, with probability 1 - (1 - s)^4 else.  A window that collides calls for the
template, which matches if the stretch of text around, three times as long as itself,
contains at least 0.8 of its shingles.

Most texts are never hashed: whatever contains that many of a template's shingles has one
of the words that more than a fifth of them are spread over.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.stage import materialize

SHINGLE, CONTAINED = 3, 0.8
#: shingles in a window, words from one window of a text to the next, bands, minima in a band
SHORT, LONG = (3, 1, 4, 1), (8, 4, 16, 2)
# Usual statements, notices and whole texts of licenses, as their stewards publish them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
        Software Foundation""",
    "AGPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
        Software Foundation""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and not again for each element of a loop in it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _range(n: Column, step: int = 1) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _permutation(k: int) -> Column:
    x = 0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)
    return F.lit(x - (1 << 64) if x >> 63 else x)


def _shingle_hashes(words: Column) -> Column:
    return _let(words, lambda w: F.transform(_range(F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(*(w[i + k] for k in range(SHINGLE)))))


def _bands(hashes: Column, i: Column, kind: tuple[int, int, int, int]) -> Column:
    """The keys of the bands of the window at shingle ``i``: hashes of minima, each under another permutation."""
    window, _, bands, rows = kind
    least = [F.least(*(hashes[i + k].bitwiseXOR(_permutation(p)) for k in range(window))) for p in range(bands * rows)]
    return F.array(*(F.xxhash64(F.lit(window), F.lit(b), *least[b * rows : (b + 1) * rows]) for b in range(bands)))


def _windows(hashes: Column, kind: tuple[int, int, int, int], step: int) -> Column:
    """(at, keys) of each window."""
    return F.transform(_range(F.size(hashes) - kind[0] + 1, step), lambda i: F.struct(i.alias("at"), _bands(hashes, i, kind).alias("keys")))


def _shingles(words: Column) -> Column:
    return F.array_distinct(_let(words, lambda w: F.transform(_range(F.size(w) - SHINGLE + 1), lambda i: F.concat_ws(" ", *(w[i + k] for k in range(SHINGLE))))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, words, shingles, windows): a template is long if it has a window's worth of shingles."""
    raw = spark.createDataFrame(sorted(templates.items()), "template string, text string").select("template", _words(F.col("text")).alias("words"))
    windows = _let(_shingle_hashes(F.col("words")), lambda h: F.when(F.size(h) >= LONG[0], _windows(h, LONG, 1)).otherwise(_windows(h, SHORT, 1)))
    return raw.select("template", "words", _shingles(F.col("words")).alias("shingles"), windows.alias("windows"))


def signal_words(templates: dict[str, str]) -> list[str]:
    """Words of which each text has one that contains ``CONTAINED`` of a template's shingles.

    For each template, its words that most templates share, longer ones first, until more
    shingles have one of them than may be missing.
    """
    split = {t: re.findall(r"[^\W_]+", text.lower()) for t, text in templates.items()}
    shared = Counter(w for words in split.values() for w in set(words))
    chosen: set[str] = set()
    for words in split.values():
        sets = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        for w in sorted(set(words), key=lambda w: (w not in chosen, len(w) < 6, -shared[w], w)):
            if sum(1 for s in sets if chosen & set(s)) > (1 - CONTAINED) * len(sets):
                break
            chosen.add(w)
    return sorted(chosen)


def signal_pattern(templates: dict[str, str]) -> str:
    """Finds any signal word, or a longer one with it; most characters are passed by one look at what words begin with."""
    chosen = signal_words(templates)
    least = [w for w in chosen if not any(v in w and v != w for v in chosen)]
    folded = lambda w: re.escape(w).replace("k", "[k\u212a]")  # noqa: E731  the one other letter that lower-cases to an ASCII one
    firsts = "".join(sorted({w[0] for w in least})).replace("k", "k\u212a")
    return f"(?i)(?=[{firsts}])(?:{'|'.join(map(folded, least))})" if least else r"\A\Z."


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: id, n_licenses, licenses (sorted names, comma-joined), containment (the best, null without any).

    Templates need five words or more; there may be any number.  Null, empty and shorter texts
    match nothing; whole texts are read, very long ones too; repeated rows each return a row;
    null ids are rows like any other.  Other columns are left out, so none can clash.  An empty
    table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    if any(len(re.findall(r"[^\W_]+", t)) < SHINGLE + SHORT[0] - 1 for t in templates.values()):
        raise ValueError("a template has fewer than five words")
    # Written, so that Spark knows the sizes: templates' bands are broadcast if they are few, else joined by shuffles.
    known = materialize(template_table(docs.sparkSession, templates), "templates")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    signal = F.col("text").rlike(signal_pattern(templates))
    told = plain.where(signal).select("key", _shingle_hashes(_words(F.col("text"))).alias("hashes"))
    windows = told.select("key", F.explode(_let(F.col("hashes"), lambda h: F.concat(_windows(h, SHORT, SHORT[1]), _windows(h, LONG, LONG[1])))).alias("w"))
    asked = windows.select("key", "w.at", F.explode("w.keys").alias("band"))
    keys = materialize(known.select("template", F.size("words").alias("long"), F.explode("windows").alias("w")).select("template", "long", F.explode("w.keys").alias("band")).distinct(), "template-bands")
    called = materialize(asked.join(keys, "band").select("key", "template", F.floor(F.col("at") / F.col("long")).cast("int").alias("stretch")).distinct(), "called")
    texts = plain.where(signal).join(called.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", _words(F.col("text")).alias("words"))
    size = F.size("words")  # the template's
    near = F.slice("said", F.greatest((F.col("stretch") - 1) * size, F.lit(0)) + 1, 3 * size + SHINGLE)
    share = F.size(F.array_intersect(_shingles(near), F.col("shingles"))) / F.size("shingles")
    matched = (
        called.join(texts.withColumnRenamed("words", "said"), "key")
        .join(known.select("template", "words", "shingles"), "template")
        .select("key", "template", share.alias("share"))
        .where(F.col("share") >= CONTAINED)
        .groupBy("key", "template")
        .agg(F.max("share").alias("share"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("template")), ",").alias("licenses"), F.max("share").alias("containment"))
    )
    # Written: a row per text that matches, so that rows with one text meet it in a join that can be split.
    return plain.select("id", "key").join(materialize(matched, "matched"), "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), "containment"
    )
