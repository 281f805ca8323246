"""Licenses in wordings that the given tables do not hold."""

import random

from pyspark.sql import functions as F

from cohortkit.llm import licenses

WORDINGS = {
    "Licensed under the MIT License.": "MIT",
    "Licensed under the GNU General Public License, version 2": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 2": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 1": "GPL",
    "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "it under the terms of the GNU Lesser General Public License version 2.1 as published": "LGPL-2.1",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "This text is available under CC BY-SA 3.0": "CC-BY-SA-3.0",
    "This program is made available under the terms of the Eclipse Public License 2.0": "EPL-2.0",
    "released under CC0 1.0 Universal": "CC0-1.0",
    "Distributed under the Apache License, Version 1.1": "",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions": "Zlib",
    "the mit of license and the general public": "",
}


def test_wordings(spark):
    rows = [(100 * i + n, "word other " * n + t + " tail words follow") for i, t in enumerate(WORDINGS) for n in range(4)]
    got = licenses.scan_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = list(WORDINGS.values())
    assert {r.doc_id: r.licenses for r in got} == {i: want[i // 100] for i, _ in rows}


def contained(words, template, held):
    """Best containment of a template's shingles in a stretch of words around it, by trying every place."""
    grams = {tuple(template[i:i + 3]) for i in range(len(template) - 2)}
    found, best = [tuple(words[i:i + 3]) for i in range(len(words) - 2)], 0.0
    if held and not any(words[i:i + len(held)] == held for i in range(len(words))):
        return 0.0
    for i in range(len(found)):
        best = max(best, len(grams & set(found[i:i + len(template)])) / len(grams))
    return best


def test_every_template_is_retrieved_by_its_bands(spark):
    """Recall over word edits against brute force containment: every text of the table, whole and with edits."""
    import re
    r = random.Random(4)
    rows, want = [], set()
    texts = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts]
    for n, (k, t) in enumerate(texts):
        held = re.search(r"\{(.*?)\}", t)
        held = licenses._words(held.group(1)) if held else []
        for edits in (0, 1, 2):
            w = licenses._words(t)
            for _ in range(edits):
                w[r.randrange(len(w))] = "other"
            doc = ["pad"] * r.randrange(12) + w + ["end"] * r.randrange(1, 12)
            rows.append((3 * n + edits, " ".join(doc)))
            if contained(doc, licenses._words(t), held) >= licenses.CONTAIN:
                want.add((3 * n + edits, k))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(x.doc_id, x.license) for x in found.select("doc_id", "license").distinct().collect()}
    assert len(want) > len(texts) and len(want & got) == len(want)  # recall 1.0, asked for: 0.9
    bands = licenses.template_bands(licenses.template_table(spark))
    assert bands.select("id").distinct().count() == len(texts) and bands.where(F.col("band") < 0).count() == 0


def test_large_template_tables_go_in_blocks(spark, monkeypatch):
    blocks = licenses.blocks_of(licenses.TEMPLATES, 200)
    assert len(blocks) > 3 and sum(len(v) for b in blocks for v in b.values()) == sum(len(v) for v in licenses.TEMPLATES.values())
    some = {k: licenses.TEMPLATES[k] for k in ("MIT", "BSD", "GPL-3.0", "GPL")}
    df = spark.createDataFrame([(1, "x under the MIT License and GNU General Public License, version 3 y")], "doc_id bigint, text string")
    whole = licenses.scan_documents(df, some).collect()
    monkeypatch.setattr(licenses, "blocks_of", lambda t, cut=licenses.blocks_of: cut(t, 60))
    assert licenses.scan_documents(df, some).collect() == whole and whole[0].licenses == "GPL-3.0,MIT"
