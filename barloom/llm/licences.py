"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are, of each licence, the sentence that declares it, its title and SPDX line, paragraphs of its text and of
the header that files carry, and its paragraphs as one text. Units are the lines and sentences of a text, the text as a
whole (a licence file), and windows of as many terms as a template has, placed so that an anchor stands where it stands
in the template, across line ends: a template is found in whatever it is wrapped into. Terms are runs
of letters and digits, weighed by their count and their rarity among the templates; a term that no template has
weighs most. A text's licence is the one with a template of the highest cosine, if that is ``least`` or more. Licences share
paragraphs: where several have that cosine, the one whose own wording comes nearest counts.

Only texts that may reach ``least`` are taken apart. A unit's cosine to a template is at most the length of the part of
the template whose terms the unit has; a text whose terms cover too little of a template is no candidate for it. The
common words are taken as covered, so that other texts leave no row. Windows stand at anchors: of each template words until
the rest is too short for the cosine, whatever else the unit holds (``anchors`` computes this from the templates).
Equal units and equal texts are scored once. A file without a licence of its own takes that of the licence files in the
nearest directory above it; directories, not files, are expanded into their ancestors and joined.

DataFrame functions only. Defined cases: a null or empty text has no licence of its own; a null path has no directory
and inherits nothing; of equal cosines the first name in order counts, of several licence files in a directory the one of
the highest cosine, then of the first name; repeated rows keep their rows; empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import few, kept, lower_ascii, text_of

# Licence names and the wording that declares them.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Artistic-2.0": "Released under the Artistic License 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# The title lines of licence files.
TITLES = {
    "AGPL-3.0": "GNU Affero General Public License Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "Artistic-2.0": "The Artistic License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International Public License",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "CC0-1.0": "CC0 1.0 Universal",
    "GPL-2.0": "GNU General Public License Version 2, June 1991",
    "GPL-3.0": "GNU General Public License Version 3, 29 June 2007",
    "ISC": "ISC License",
    "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "Unlicense": "The Unlicense",
}
# Paragraphs of licence texts and of the headers that files carry. Some belong to more than one licence.
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, "
    "or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory "
    "of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {} for more details."
_CREATIVE = "This work is licensed under a Creative Commons {} 4.0 International License."
PARAGRAPHS = {
    "AGPL-3.0": (_GNU.format("Affero General Public License", "3"), _GNU_WARRANTY.format("Affero General Public License")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (_GRANT, _SOURCE, _BINARY, _BSD_WARRANTY),
    "BSD-3-Clause": (
        _GRANT, _SOURCE, _BINARY,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _BSD_WARRANTY,
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:",
    ),
    "CC-BY-4.0": (_CREATIVE.format("Attribution"),),
    "CC-BY-NC-4.0": (_CREATIVE.format("Attribution-NonCommercial"),),
    "CC-BY-SA-4.0": (_CREATIVE.format("Attribution-ShareAlike"),),
    "GPL-2.0": (_GNU.format("General Public License", "2"), _GNU_WARRANTY.format("General Public License")),
    "GPL-3.0": (_GNU.format("General Public License", "3"), _GNU_WARRANTY.format("General Public License")),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": (_GNU.format("Lesser General Public License", "3"), _GNU_WARRANTY.format("Lesser General Public License")),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to "
        "do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and "
        "noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or "
        "in connection with the Software or the use or other dealings in the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def wordings() -> dict[str, str]:
    """All templates: declarations, titles, SPDX lines, paragraphs, and the paragraphs of a licence as one text.

    A key is the licence's name, then a blank and the form. SPDX lines follow from the name. A paragraph of several
    licences is there for each of them, marked ``SHARED``.
    """
    out = {**TEMPLATES, **{f"{n} title": t for n, t in TITLES.items()}}
    for n in TITLES:
        kinds = ("", "-only", "-or-later") if "GPL" in n else ("",)
        out |= {f"{n} spdx{k}": f"SPDX-License-Identifier: {n}{k}" for k in kinds}
    owners = Counter(text for texts in PARAGRAPHS.values() for text in texts)
    for n, texts in PARAGRAPHS.items():
        out |= {f"{n} {SHARED if owners[text] > 1 else 'paragraph'}{i}": text for i, text in enumerate(texts)}
        if len(texts) > 1:
            out[f"{n} text"] = "\n".join(texts)
    return out


SHARED = "shared"
WORDINGS = wordings()
# Words of any English text, the last choice for an anchor.
COMMON = (
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "do", "for", "from", "in", "into", "is", "it", "may", "not", "of", "on", "or", "other", "out", "that", "the", "this", "to",
    "under", "use", "was", "with", "without", "you",
)
TERM = r"[\p{L}\p{N}]+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"


def _term_list(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def _terms(text: str) -> Counter:
    return Counter(re.findall(r"[^\W_]+", text.lower()))


def rarity(templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """The weight of each template term, and of any other term."""
    n, has = len(templates), Counter(t for x in templates.values() for t in _terms(x))
    return {t: math.log((1 + n) / (1 + k)) + 1 for t, k in has.items()}, math.log(1 + n) + 1


def vectors(templates: dict[str, str]) -> dict[str, dict[str, float]]:
    """The templates' terms weighed and scaled to length 1."""
    idf, _ = rarity(templates)
    out = {}
    for name, text in templates.items():
        v = {t: k * idf[t] for t, k in _terms(text).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        out[name] = {t: x / length for t, x in v.items()}
    return out


def _own_anchors(templates: dict[str, str], least: float) -> dict[str, list[str]]:
    """Of each template, terms of which a unit has at least one if its cosine to the template is ``least``.

    Without them it has at most the length of the other terms as its cosine. Rare words are taken before common ones, so
    that few texts have an anchor, and words that stand once before others, so that a copy has one window.
    """
    out = {}
    for name, v in vectors(templates).items():
        times, rest, out[name] = _terms(templates[name]), sum(x * x for x in v.values()), []
        for t, x in sorted(v.items(), key=lambda p: (p[0] in COMMON, times[p[0]] > 1, -p[1], p[0])):
            if rest < least * least - 1e-9:
                break
            out[name].append(t)
            rest -= x * x
    return out


def anchors(templates: dict[str, str], least: float) -> list[str]:
    """Terms of which a unit has at least one if its cosine to any template is ``least``."""
    return sorted({t for found in _own_anchors(templates, least).values() for t in found})


def places(templates: dict[str, str], least: float) -> dict[str, list[tuple[int, int, str]]]:
    """Of each anchor where it stands among the terms of its templates, how many terms those have, and their names."""
    out: dict[str, set[tuple[int, int, str]]] = {a: set() for a in anchors(templates, least)}
    for name, own in _own_anchors(templates, least).items():
        terms = re.findall(r"[^\W_]+", templates[name].lower())
        for at, t in enumerate(terms):
            if t in own:
                out[t].add((at, len(terms), name))
    return {a: sorted(p) for a, p in out.items()}


def _windows(terms: Column, names: Column, templates: dict[str, str], least: float) -> Column:
    """The windows of a list of terms for the templates with the numbers ``names``, clipped to it."""
    number = {name: i for i, name in enumerate(templates)}
    stand = F.create_map(*[
        c for a, p in places(templates, least).items()
        for c in (F.lit(a), F.array(*[F.struct(F.lit(q).alias("q"), F.lit(n).alias("n"), F.lit(number[k]).alias("name")) for q, n, k in p]))
    ])
    found = F.transform(terms, lambda t, i: F.struct(i.alias("i"), F.filter(F.element_at(stand, t), lambda p: F.array_contains(names, p["name"])).alias("p")))
    found = F.filter(found, lambda x: F.size(x["p"]) > 0)

    def at(i: Column, p: Column) -> Column:
        start = i - p["q"]
        return F.array_join(F.slice(terms, F.greatest(start, F.lit(0)) + 1, p["n"] + F.least(start, F.lit(0))), " ")

    return F.flatten(F.transform(found, lambda x: F.transform(x["p"], lambda p: at(x["i"], p))))


def candidates(texts: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """address, names: the numbers of the templates that a unit of the text may reach, by what the text's terms cover of them."""
    covered, need = [], []
    for name, v in enumerate(vectors(templates).values()):
        rare = {t: x for t, x in v.items() if t not in COMMON}
        left = least * least - sum(x * x for t, x in v.items() if t in COMMON)
        rare, left = (rare, left) if left > 0 else (v, least * least)
        covered += [(t, name, x * x) for t, x in rare.items()]
        need.append((name, left - 1e-9))
    spark = texts.sparkSession
    posting = F.broadcast(spark.createDataFrame(covered, "term string, name int, part double"))  # as many rows as the templates have terms
    needed = F.broadcast(spark.createDataFrame(need, "name int, need double"))
    terms = _term_list(F.col("text"))
    has = F.array_intersect(terms, F.array(*[F.lit(t) for t in sorted({c[0] for c in covered})]))
    marked = texts.select(F.md5("text").alias("address"), has.alias("has")).where(F.arrays_overlap("has", F.array(*[F.lit(a) for a in anchors(templates, least)])))
    marked = marked.dropDuplicates(["address"]).select("address", F.explode("has").alias("term"))
    parts = marked.join(posting, "term").groupBy("address", "name").agg(F.sum("part").alias("part")).join(needed, "name").where("part >= need")
    return parts.groupBy("address").agg(F.collect_set("name").alias("names"))  # as many as there are templates


def by_unit(units: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """id, licence, similarity, own (by wording of this licence alone) of the ``units`` (id and unit, one row an id) that reach ``least``.

    A unit's text is left behind as soon as it is cut into terms.
    """
    spark = units.sparkSession
    idf, other = rarity(templates)
    posting = spark.createDataFrame([(t, n, x, idf[t]) for n, v in vectors(templates).items() for t, x in v.items()], "term string, name string, x double, idf double")
    weights = F.broadcast(posting.select("term", "idf").distinct())  # as many rows as the templates have terms
    terms = units.select("id", F.explode(_term_list(F.col("unit"))).alias("term"))
    terms = terms.groupBy("id", "term").agg(F.count("*").alias("tf")).join(weights, "term", "left")
    terms = terms.withColumn("y", F.col("tf") * F.coalesce("idf", F.lit(other)))
    length = terms.groupBy("id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    dots = terms.where("idf is not null").join(F.broadcast(posting.drop("idf")), "term").groupBy("id", "name").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = dots.join(length, "id").select("id", "name", F.round(F.col("dot") / F.col("length"), 6).alias("similarity"))
    cosine = cosine.where(F.col("similarity") >= least)
    own = F.when(~F.contains("name", F.lit(f" {SHARED}")), F.col("similarity")).otherwise(0.0)
    return cosine.groupBy("id", F.substring_index("name", " ", 1).alias("licence")).agg(F.max("similarity").alias("similarity"), F.max(own).alias("own"))


def _best(*more: Column) -> Column:
    return F.min(F.struct((-F.col("similarity")).alias("s"), *more, "licence")).alias("b")


def declared(texts: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """address (MD5 of the text), licence and similarity of the texts (a column ``text``) that declare one themselves."""
    anchor = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchors(templates, least))})(?![\p{{L}}\p{{N}}])"
    some = kept(candidates(texts, templates, least), "candidates")
    texts = texts.select(F.md5("text").alias("address"), "text").join(few(some), "address")  # a row holds a number for each template at most
    texts = texts.dropDuplicates(["address"]).withColumn("terms", _term_list(F.col("text")))
    parts = F.filter(F.concat(F.split("text", r"[\r\n]+"), F.split("text", r"(?<=[.!?])\s+")), lambda x: x.rlike(anchor))
    parts = F.concat(parts, F.array("text"), _windows(F.col("terms"), F.col("names"), templates, least))
    units = texts.select("address", F.explode(F.array_distinct(parts)).alias("unit")).select("address", F.md5("unit").alias("id"), "unit")
    units = kept(units, "units")
    scored = kept(by_unit(units.select("id", "unit").dropDuplicates(["id"]), templates, least), "scored")
    best = units.select("address", "id").join(few(scored), "id")
    best = best.groupBy("address", "licence").agg(F.max("similarity").alias("similarity"), F.max("own").alias("own"))
    best = best.groupBy("address").agg(_best((-F.col("own")).alias("o")))
    return best.select("address", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity"))


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def folder_of(path: Column) -> Column:
    """The directory of a path, "" for a file at the top; a leading / and empty parts do not count."""
    return F.array_join(F.slice(_parts(path), 1, F.greatest(F.size(_parts(path)) - 1, F.lit(0))), "/")


def scan(files: DataFrame, templates: dict[str, str] = WORDINGS, least: float = 0.8, doc_id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """doc_id, path, licence, similarity, origin (own, inherited or null) and folder (of an inherited one) of every row."""
    rows = files.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), text_of(text).alias("text"))
    own = kept(declared(rows.select("text"), templates, least), "declared")
    rows = rows.select("doc_id", "path", F.md5("text").alias("address")).join(few(own), "address", "left").drop("address")
    rows = kept(rows.withColumn("folder", folder_of(F.col("path"))), "files")
    named = F.substring_index("path", "/", -1).rlike(LICENCE_FILE)
    given = rows.where(named & F.col("licence").isNotNull()).groupBy("folder").agg(_best())
    given = given.select(F.col("folder").alias("above"), F.struct(F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity")).alias("theirs"))
    folders = rows.where("folder is not null").select("folder").distinct()
    parts = _parts(F.col("folder"))
    depth = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = depth.select("folder", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above"))
    near = above.join(given, "above").groupBy("folder").agg(F.max_by(F.struct("above", "theirs.licence", "theirs.similarity"), "depth").alias("near"))
    joined = rows.join(few(kept(near, "near")), "folder", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited")
    return joined.select(
        "doc_id", "path", F.coalesce("licence", "near.licence").alias("licence"), F.coalesce("similarity", "near.similarity").alias("similarity"),
        origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("near.above")).alias("folder"),
    )
