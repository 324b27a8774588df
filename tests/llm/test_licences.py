import math
import random
import re
from collections import Counter

from barloom.llm.licences import COMMON, PARAGRAPHS, TEMPLATES, TITLES, WORDINGS, anchors, declared, rarity, scan, vectors
from barloom.llm.queries import file_of


def cosine(text):
    idf, other = rarity(TEMPLATES)
    v = {t: n * idf.get(t, other) for t, n in Counter(re.findall(r"[^\W_]+", text.translate({c: c + 32 for c in range(65, 91)}))).items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    return {n: round(sum(x * v.get(t, 0) for t, x in w.items()) / length, 6) for n, w in vectors(TEMPLATES).items()} if v else {}


def brute(text, least=0.8):
    units = [text, *re.split(r"[\r\n]+", text)] if text else []
    found = [(-c, n) for u in units for n, c in cosine(u).items() if c >= least]
    return (min(found)[1], -min(found)[0]) if found else None


TEXTS = [
    "Body text of a file.\nLicensed under the Apache License, Version 2.0.\nMore.", "MIT\nReleased under the MIT License.", "# licensed under the APACHE license version 2.0", None, "", "nothing at all",
    "All rights reserved.", "all rights are reserved by all", "Licensed under CC BY-NC 4.0.", "the license\nof the\nwork " * 200, "This work is licensed under the GNU General Public License, version 3.\r\nx",
    "This work is\nlicensed under the GNU\nGeneral Public License,\nversion 2.", "é licensed", *TEMPLATES.values(),
]


def test_every_template_names_itself():
    for name, text in TEMPLATES.items():
        assert brute(text) == (name, 1.0)


def test_declared(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string")
    got = {r.address: (r.licence, r.similarity) for r in declared(docs).collect()}
    from hashlib import md5

    want = {md5(t.encode()).hexdigest(): brute(t) for t in TEXTS if t is not None and brute(t)}
    assert got == want


def test_a_unit_without_anchor_is_below():
    rng, found = random.Random(1), set(anchors(TEMPLATES, 0.8))
    terms = sorted({t for v in vectors(TEMPLATES).values() for t in v} - found)
    for _ in range(2000):
        assert max(cosine(" ".join(rng.choices(terms, k=rng.randint(1, 8)))).values()) < 0.8
    for v in vectors(TEMPLATES).values():
        assert max(cosine(" ".join(t for t in v if t not in found) or "none").values()) < 0.8


def test_nearest_ancestor(spark):
    mit, bsd, gpl = TEMPLATES["MIT"], TEMPLATES["BSD-2-Clause"], TEMPLATES["GPL-3.0"]
    rows = [
        (1, "/a/LICENSE", mit), (2, "/a/b/c/x.py", "code"), (3, "/a/b/COPYING", bsd), (4, "/d/x.py", "code"), (5, "/a/y.py", gpl), (6, None, "code"), (7, "x.py", "code"), (8, "/a/b/README", bsd),
        (9, "/ab/x.py", "code"), (10, "/a/LICENSE.txt", TEMPLATES["Apache-2.0"]), (11, "/a/NOTICE", "no licence"), (12, "/e/x.py", mit), (12, "/a/b/c/x.py", "code"), (13, "LICENSE", TEMPLATES["ISC"]), (14, "", None),
    ]
    got = {(r.doc_id, r.path): r for r in scan(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, path string, text string, folder string")).collect()}
    assert len(got) == len(rows)
    licence = {k[0]: (r.licence, r.origin) for k, r in got.items()}
    assert licence[1] == ("MIT", "own") and licence[2] == ("BSD-2-Clause", "inherited") and licence[4] == ("ISC", "inherited")
    assert licence[5] == ("GPL-3.0", "own") and licence[6] == (None, None) and licence[9] == ("ISC", "inherited")
    assert got[2, "/a/b/c/x.py"].folder == "a/b" and got[12, "/a/b/c/x.py"].licence == "BSD-2-Clause"
    assert licence[11] == ("Apache-2.0", "inherited")  # of two in the folder with equal cosine the first name
    assert licence[7] == ("ISC", "inherited")


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_declarations_that_share_or_break_their_line(spark):
    body = "nothing but other words stand here and go on for long " * 20
    texts = {
        "This work is licensed under the GNU General Public\nLicense, version 3.": "GPL-3.0",
        "Copyright 2020 Acme Inc. Released under the MIT License.": "MIT",
        "Copyright (c) 2021 Jane Doe. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        body + "Licensed under CC BY-NC 4.0. " + body: "CC-BY-NC-4.0",
        body + "it was (Released under\n# the ISC License) " + body: "ISC",
        body: None,
    } | {body + t.replace(" ", "\n", 2) + " " + body: n for n, t in TEMPLATES.items()}
    rows = [(i, f"{i}/x", t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.licence for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(texts.values())


def found(spark, texts):
    rows = [(i, f"{i}/x", t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.licence for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_titles_spdx_lines_headers_and_files(spark):
    body = "nothing but other words stand here and go on for long " * 20
    mit, bsd2, bsd3, gpl = (PARAGRAPHS[n] for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0"))
    renamed = [p.replace("the copyright holder nor", "Acme Inc. nor") for p in bsd3]
    texts = {
        "MIT License": "MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: Apache-2.0\nint main() { return 0; }": "Apache-2.0",
        "Mozilla Public License Version 2.0\n\n" + body: "MPL-2.0",
        mit[0]: "MIT",
        body + "\n" + gpl[0]: "GPL-3.0",
        bsd2[0]: "BSD-2-Clause",  # of both, so the first name
        "MIT License\n\nCopyright (c) 2021 Jane Doe\n\n" + "\n\n".join(mit): "MIT",
        "Copyright 2020 Acme Inc.\n" + "\n".join(bsd2): "BSD-2-Clause",
        "Copyright 2020 Acme Inc.\n" + "\n".join(bsd3): "BSD-3-Clause",
        "Copyright 2019 Acme Inc.\n" + "\n".join(renamed): "BSD-3-Clause",
        "# " + "\n# ".join(" ".join(gpl).split(" ")[i] for i in range(len(" ".join(gpl).split(" ")))): "GPL-3.0",
        "/*\n * " + PARAGRAPHS["Apache-2.0"][0].replace(" the ", "\n * the ") + "\n */\n" + body: "Apache-2.0",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + body: "GPL-3.0",
        body + "software may be copied and used by any person without permission. the License ": None,
        body: None,
    } | {f"{body}\n{t}\n{body}": n for n, t in TITLES.items()}
    got = found(spark, texts)
    assert dict(zip(texts, got, strict=True)) == texts


def test_every_wording_is_found_inside_other_text(spark):
    body = "many other words go before and after it here " * 9
    names = [n for n in WORDINGS if " shared" not in n and "spdx-" not in n]
    texts = [body + WORDINGS[n].replace(" ", "\n  ", 3) + " " + body for n in names]
    assert found(spark, texts) == [n.split(" ")[0] for n in names]


def test_a_text_that_covers_too_little_is_below():
    rng, idf = random.Random(2), rarity(WORDINGS)
    terms = sorted({t for v in vectors(WORDINGS).values() for t in v})
    for v in list(vectors(WORDINGS).values())[::7]:
        for _ in range(200):
            pick = Counter(rng.choices(terms, k=rng.randint(1, 30)) + rng.choices(sorted(v), k=rng.randint(1, 30)))
            w = {t: n * idf[0][t] for t, n in pick.items()}
            cosine = sum(x * v.get(t, 0) for t, x in w.items()) / math.sqrt(sum(x * x for x in w.values()))
            covered = sum(x * x for t, x in v.items() if t in pick or t in COMMON)
            assert cosine <= math.sqrt(covered) + 1e-9


def test_files_of_rows_with_nulls(spark):
    rows = [(None, None, None, None), (1, None, "en", "MIT License"), (2, "web", None, ""), *[(i, "web", "en", "x") for i in range(3, 400)]]
    paths = [r.path for r in file_of(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).collect()]
    assert all(p.startswith("/") and 4 <= len(p.split("/")) <= 7 and "" not in p.split("/")[1:] for p in paths)
    assert paths[1].startswith("/none/en/") and paths[2].startswith("/web/none/")
    assert 60 < sum("/LICENSE-" in p for p in paths) < 140 and {len(p.split("/")) for p in paths} == {4, 5, 6, 7}
