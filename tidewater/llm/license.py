"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from
the nearest ancestor directory, in DataFrame functions.

Vectors live on words of the templates; any other word counts towards a segment's length with the
weight of a word that no file has. Document frequencies of template words are counted over all
files. Segments are the paragraphs of a file, their lines and their sentences (which may run over lines),
so a notice is found alone in a line, within one, or wrapped in a comment; the whole text is one more in
files with a licence file's name. Templates are short notices and, where a licence is short, its text.

Only what can reach the threshold is compared: by Cauchy's inequality a segment must have one of the
words that are left out last when a template's words are dropped from the most frequent on until
those dropped would weigh as much as the threshold. So the filter loses nothing, and rare words decide.
The best template of a file is its licence.

A licence file gives its licence to its directory. A file without a licence of its own takes that of
the nearest ancestor directory that has one: directories are expanded to their ancestors, joined to
licensed directories by path, and the deepest match wins; files then join their directory.

Edge cases: a null text has no segments and can still inherit; a null path is scanned but inherits
nothing; of equally good templates the smaller name wins; two licence files in a directory give the
better match, of equal ones the smaller name; equal texts get equal licences of their own; very long
texts are scanned whole; rows may repeat; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import storage

# Notices by which licences are named in files, and texts of short licences
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{either}"
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", _GNU.format(colon=":", kind="Affero ", either=", either version 3 of the License, or (at your option) any later version.")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", f"{_BSD_HEAD} {_BSD_TAIL}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", _GNU.format(colon=";", kind="", either="; either version 2 of the License, or (at your option) any later version.")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", _GNU.format(colon=":", kind="", either=""), _GNU.format(colon=":", kind="", either=", either version 3 of the License, or (at your option) any later version.")],
    "ISC": ["Licensed under the ISC License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", _GNU.format(colon=":", kind="Lesser ", either=", either version 3 of the License, or (at your option) any later version.")],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([-._].*)?$"
THRESHOLD = 0.75


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1)


def _weights(templates: dict[str, list[str]], idf: dict[str, float]) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, number, unit vector) of each template."""
    out = []
    for name in sorted(templates):
        for k, text in enumerate(templates[name]):
            tf = Counter(re.findall(_WORD, text.lower()))
            raw = {w: n * idf[w] for w, n in tf.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            out.append((name, k, {w: v / norm for w, v in raw.items()}))
    return out


def needed_words(vectors: list[tuple[str, int, dict[str, float]]], df: dict[str, int], threshold: float) -> list[str]:
    """Words such that a segment without any of them is under the threshold for every template, rare ones
    first."""
    found = set()
    for _, _, vector in vectors:
        rest = 1.0
        for w, v in sorted(vector.items(), key=lambda x: (df.get(x[0], 0), -x[1], x[0])):
            if math.sqrt(max(rest, 0)) < threshold - 1e-9:
                break
            found.add(w)
            rest -= v * v
    return sorted(found)


def segments(text: Column, whole: Column) -> Column:
    """Paragraphs, lines and sentences, and the whole text if ``whole``; each once."""
    paragraphs = F.split(text, r"\n[^\p{Alnum}\n]*\n")
    # the mark of a comment that goes on isn't part of a sentence
    flowing = F.transform(paragraphs, lambda p: F.regexp_replace(p, r"\n[^\p{Alnum}\n(\"']*", " "))
    sentences = F.flatten(F.transform(flowing, lambda p: F.split(p, r"(?<=[.;!?])\s+")))
    parts = F.concat(paragraphs, F.split(text, "\n"), sentences)
    return F.array_distinct(F.when(whole, F.array_append(parts, text)).otherwise(parts))


def scan(files: DataFrame, *, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``id_col``, path, license, cosine, origin (``own``, ``inherited`` or null), licensed_dir."""
    spark, templates = files.sparkSession, templates or TEMPLATES
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").cast("string").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with storage.scratch(spark) as keep:
        return _scan(spark, rows, templates, threshold, id_col, keep)


def _scan(spark: SparkSession, rows: DataFrame, templates: dict[str, list[str]], threshold: float, id_col: str, keep) -> DataFrame:
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in re.findall(_WORD, t.lower())})
    # one row for each template word, and one for the number of files
    known = F.array(*map(F.lit, vocabulary))
    seen = rows.select(F.explode(F.array_append(F.array_intersect(_words(F.col("text")), known), "")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    df = {r.w: r.n for r in seen}
    n_files = df.get("", 0)
    idf = {w: math.log((n_files + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    other = math.log(n_files + 1) + 1
    vectors = _weights(templates, idf)
    needed = F.array(*map(F.lit, needed_words(vectors, df, threshold)))

    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    # whole rows, ids included, may repeat: segments are scored once for each distinct text, known by 128 bits
    wanted = rows.filter(F.arrays_overlap(_words(F.col("text")), needed)).select(F.md5("text").alias("t"), is_file.alias("whole"), "text").dropDuplicates(["t", "whole"])
    parts = wanted.select("t", "whole", F.posexplode(segments(F.col("text"), F.col("whole"))).alias("at", "segment"))
    worded = parts.select("t", F.struct("whole", "at").alias("seg"), _words(F.col("segment")).alias("words")).filter(F.arrays_overlap("words", needed))
    counts = worded.select("t", "seg", F.explode("words").alias("w")).groupBy("t", "seg", "w").agg(F.count("*").alias("tf"))
    weight = spark.createDataFrame([(w, float(v)) for w, v in idf.items()], "w string, idf double")
    vector = spark.createDataFrame([(w, n, k, v) for n, k, x in vectors for w, v in x.items()], "w string, license string, k int, v double")
    weighted = counts.join(F.broadcast(weight), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = weighted.groupBy("t", "seg").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.join(F.broadcast(vector), "w").groupBy("t", "seg", "license", "k").agg(F.sum(F.col("x") * F.col("v")).alias("dot"))
    scored = dots.join(norms, ["t", "seg"]).select("t", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).filter(F.col("cosine") >= threshold)
    best = scored.groupBy("t", "license").agg(F.max("cosine").alias("cosine")).groupBy("t").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("b"))
    best = storage.materialize(best.select("t", F.col("b.license").alias("own"), (-F.col("b.minus")).alias("cosine")), "license-own")
    matched = keep(rows.select("id", "path", is_file.alias("is_file"), F.md5("text").alias("t")).join(best, "t", "left").drop("t"), "license-matched")

    folder = F.when(F.col("path").isNotNull(), F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("path", "^/+", ""), "/*[^/]*$", "")))
    placed = matched.withColumn("dir", folder)
    given = placed.filter("is_file AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "own")).alias("g"))
    given = keep(given.select(F.col("dir").alias("licensed_dir"), F.col("g.own").alias("given"), (-F.col("g.minus")).alias("given_cosine")), "license-dirs")
    pieces = F.filter(F.split("dir", "/"), lambda x: x != "")
    ups = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda n: F.struct(n.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(pieces, F.lit(1), n), "/")).alias("licensed_dir")))
    ancestors = placed.select("dir").filter("dir IS NOT NULL").distinct().select("dir", F.inline(ups))
    nearest = ancestors.join(given, "licensed_dir").groupBy("dir").agg(F.max(F.struct("depth", "licensed_dir", "given", "given_cosine")).alias("n")).select("dir", "n.licensed_dir", "n.given", "n.given_cosine")
    out = placed.join(keep(nearest, "license-nearest"), "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.coalesce("own", "given").alias("license"), F.when(own, F.col("cosine")).otherwise(F.col("given_cosine")).alias("cosine"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"), F.when(~own, F.col("licensed_dir")).alias("licensed_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as a source tree: a folder for each source, folders of a thousand and of a
    hundred ids below it; twenty of each hundred ids bear the name of a licence file."""
    i = F.col("doc_id")
    name = F.when(F.pmod(i, F.lit(100)) < 20, F.concat(F.lit("LICENSE-"), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), F.floor(i / 100).cast("string"), name).alias("path"), "text")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
