"""License scans by MinHash bands over overlapping windows, in DataFrame operations only.

Texts become lower-cased words of letters and digits, and 3-word shingles.
Windows start every few words, in two scales: long ones (8 words, every 4) for
templates of more than ``FEW`` shingles, short ones (6 words, every 2) for the
others, so a run of five words lies whole inside a window of either.  A window's
signature is the minimum of its shingle hashes under ``BANDS`` seeded permutations,
one row per band; a template has a signature for its window at every word.
Every template is retrieved by its bands alone: with 32 bands of one row, windows
that share one of four shingles (a three-word name) collide with probability
1 - 0.75**32 = 0.9999, two of four or more with 1 - 2e-10.

A window can only collide where it holds a shingle that is the minimum of
some template band, so signatures are computed for windows with such a
shingle and no others; the result is the same.  Windows that collide retrieve
their template, and the share of the template's shingles found around the
window decides: containment of at least ``CONTAIN``, by exact shingles.  Words
that a template holds in braces (versions) must also stand there unchanged,
which is part of this check.  A template table of more than ``MAX_SHINGLES``
words is scanned block by block.

Edge cases: null and empty texts and texts under three words match nothing;
repeated rows get the same result each; very long texts are scanned whole;
further columns are ignored, whatever their names; templates under three words are
refused; an empty document table gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
SCALES = ((8, 4), (6, 2))  # words of a window, and from one start to the next
FEW = 4                    # templates of more shingles use the first scale
BANDS = 32
CONTAIN = 0.8
MAX_SHINGLES = 50_000      # words of the templates of one block, which plans carry as literals

# Notices and clauses of public licenses, several per license.  Words in braces must stand in the
# text as they are, next to each other, so that versions and variants are told apart.
_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"),
        "AGPL-3.0": ("Affero ", "3")}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
       "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES = {
    "Apache-2.0": ("{Apache License, Version 2.0}", "{Apache License 2.0}", "{the Apache 2.0 license}", "{Apache License v2.0}"),
    "Apache-2.0-notice": ("you may not use this file except in compliance with the License",),
    "MIT": ("{under the MIT License}", "{under MIT License}", "{under the terms of the MIT license}", "{the MIT License MIT}",
            "{under an MIT license}", "{is MIT licensed}"),
    "MIT-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                 "and associated documentation files",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", "{under the BSD license}", "{under a BSD style license}"),
    "BSD-2-Clause": ("{BSD 2 Clause License}", "{2 clause BSD license}"),
    "BSD-3-Clause": ("{BSD 3 Clause License}", "{3 clause BSD license}",
                     "may be used to endorse or promote products derived from this software without specific prior "
                     "written permission"),
    "ISC": ("{under the ISC License}", "{the ISC License}", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, {provided that the above copyright notice}"),
    "GPL": ("{under the GNU General Public License}", "{under the GNU GPL}", "{under the GPL}"),
    "GPL-text": ("This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU General Public License as published by the Free Software Foundation",),
    "LGPL": ("{under the terms of the GNU Lesser General Public License}", "{under the GNU Lesser General Public License}"),
    "AGPL": ("{under the terms of the GNU Affero General Public License}", "{under the GNU Affero General Public License}"),
    **{k: (f"{{GNU {kind}General Public License, version {v}}}", f"{{GNU {kind}General Public License v{v}}}",
           f"{{GNU {kind}General Public License {v}}}", f"{{GNU {k[:-4]} v{v}}}", f"{{GNU {k[:-4]} version {v}}}",
           f"{{under the {k[:-4]}v{v}}}", f"{{under {k[:-4]} {v}}}", f"{{under the {k[:-4]} {v}}}", f"{{under the {k[:-4]} version {v}}}",
           f"{{version {v} of the GNU {kind}General Public License}}",
           f"{{GNU {kind}General Public License as published by the Free Software Foundation, either version {v}}} of the License",
           f"{{GNU {kind}General Public License as published by the Free Software Foundation, version {v}}}",
           f"{{GNU {kind}General Public License as published by the Free Software Foundation; version {v}}} of the License",
           f"{{GNU {kind}General Public License Version {v}}}, Everyone is permitted to copy and distribute verbatim copies of "
           "this license document") for k, (kind, v) in _GNU.items()},
    "GPL-2.0-text": ("This License applies to any program or other work which contains a notice placed by the copyright holder "
                     "saying it may be distributed under the terms of this General Public License",),
    "GPL-3.0-text": ("The GNU General Public License is a free, copyleft license for software and other kinds of works",),
    "AGPL-3.0-text": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
                      "{specifically designed to ensure cooperation}",),
    "MPL-2.0": ("subject to the terms of the {Mozilla Public License, v. 2.0}", "{Mozilla Public License, v. 2.0}",
                "{Mozilla Public License Version 2.0}", "{Mozilla Public License 2.0}"),
    "EPL-1.0": ("{Eclipse Public License v1.0}", "{Eclipse Public License 1.0}", "{Eclipse Public License v 1.0}",
                "{Eclipse Public License version 1.0}"),
    "EPL-2.0": ("{Eclipse Public License v2.0}", "{Eclipse Public License 2.0}", "{Eclipse Public License v 2.0}",
                "{Eclipse Public License version 2.0}"),
    "Zlib": ("{under the zlib License}", "{the zlib libpng License}",
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely"),
    "CC0-1.0": ("{CC0 1.0}", "{under the CC0 license}", "{Creative Commons Zero}", "{Creative Commons CC0}",
                "waived all copyright and related or neighboring rights to"),
    **{f"CC-{k}-{v}": (f"{{CC {k} {v}}}", f"{{Creative Commons {name} {v}}}", f"{{Creative Commons {name} license {v}}}",
                       f"{{creativecommons org licenses {k} {v}}}")
       for k, name in _CC.items() for v in ("2.0", "2.5", "3.0", "4.0")},
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "BSL-1.0": ("{Boost Software License Version 1.0}", "{Boost Software License 1.0}"),
}
# SPDX lines of the licenses above, without the names that stand for clauses or families
_NO_SPDX = ("Apache-2.0-notice", "MIT-text", "BSD", "GPL", "GPL-text", "LGPL", "AGPL", "GPL-2.0-text", "GPL-3.0-text", "AGPL-3.0-text")
TEMPLATES = {k: (*v, *(() if k in _NO_SPDX else (f"{{SPDX-License-Identifier: {k}}}",))) for k, v in TEMPLATES.items()}
# A family's name is reported where none of its versions is found in the document.
FAMILIES = {"GPL": ("GPL-2.0", "GPL-3.0"), "LGPL": ("LGPL-2.1", "LGPL-3.0"), "AGPL": ("AGPL-3.0",)}

WORDS = r"[\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingle_hashes(w: Column, n: int = GRAM) -> Column:
    """64-bit hashes of the ``n``-word shingles of a word array, in order."""
    many = F.size(w) >= n
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
    return F.when(many, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))).otherwise(
        F.array().cast("array<bigint>"))


def signature(shingles: Column, bands: int = BANDS) -> Column:
    """The minimum shingle hash under each permutation."""
    return F.array(*[F.array_min(F.transform(shingles, _permute(b))) for b in range(bands)])


def _permute(band: int):
    return lambda h: F.xxhash64(h, F.lit(band))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """(id, license, size, shingles, exact): one row per template of a block.

    ``templates`` gives a text or several per license; ``exact`` holds the
    shingles of the words in braces.
    """
    rows = []
    for k, texts in templates.items():
        for t in (texts,) if isinstance(texts, str) else texts:
            held = re.search(r"\{(.*?)\}", t)
            rows.append((len(rows), k, _words(t), _words(held.group(1)) if held else []))
    if any(len(w) < GRAM or 0 < len(held) < GRAM for _, _, w, held in rows):
        raise ValueError("a template, and what it holds in braces, needs three words")
    df = spark.createDataFrame(rows, "id int, license string, words array<string>, held array<string>")
    return df.select("id", "license", F.size("words").alias("size"), shingle_hashes(F.col("words")).alias("shingles"),
                     shingle_hashes(F.col("held")).alias("exact"))


def blocks_of(templates, most: int = MAX_SHINGLES) -> list[dict]:
    """The templates in blocks of at most ``most`` words (one text at least)."""
    out, size = [{}], 0
    for k, texts in templates.items():
        for t in (texts,) if isinstance(texts, str) else texts:
            n = len(_words(t))
            if size and size + n > most:
                out.append({})
                size = 0
            out[-1].setdefault(k, []).append(t)
            size += n
    return out


def template_bands(templates: DataFrame, bands: int = BANDS) -> DataFrame:
    """(id, scale, band, value, shingle): minima of the template windows at every word, with the shingle that gives them."""
    made = []
    for scale, (span, _) in enumerate(SCALES):
        per = span - GRAM + 1
        many = F.size("shingles") > FEW
        starts = F.sequence(F.lit(1), F.greatest(F.size("shingles") - per + 1, F.lit(1)))
        wins = templates.where(many if scale == 0 else ~many).select("id", F.explode(F.transform(starts, _slice_of(per))).alias("win"))
        least = [F.array_min(F.transform("win", _pair(b))) for b in range(bands)]
        made.append(wins.select("id", F.lit(scale).alias("scale"), F.posexplode(F.array(*least)).alias("band", "m"))
                    .select("id", "scale", "band", F.col("m.value").alias("value"), F.col("m.shingle").alias("shingle")))
    return made[0].unionByName(made[1]).distinct()


def _slice_of(per: int):
    return lambda i: F.slice("shingles", i, per)


def _pair(band: int):
    return lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("value"), h.alias("shingle"))


def scan(docs: DataFrame, templates=TEMPLATES, contain: float = CONTAIN) -> DataFrame:
    """Matches: doc_id, text_hash, license, start (word), containment; one row per license and place."""
    return reduce(DataFrame.unionAll, [_scan_block(docs, block, contain) for block in blocks_of(templates)])


def _scan_block(docs: DataFrame, templates: dict, contain: float) -> DataFrame:
    spark = docs.sparkSession
    table = template_table(spark, templates)
    bands = template_bands(table).persist()
    minima = [r.shingle for r in bands.select("shingle").distinct().collect()]  # bounded by MAX_SHINGLES
    longest = table.agg(F.max("size")).first()[0]
    per, reach = SCALES[0][0] - GRAM + 1, int(longest)
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0)).alias("w"))
    # the row number also keeps filters above from being evaluated below, where the shingles would be computed again
    rows = rows.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), shingle_hashes(F.col("w")).alias("s"))
    at = F.filter(F.transform("s", lambda h, i: F.when(h.isin(minima), i)), lambda i: i.isNotNull())
    hit = rows.select("row", "doc_id", "text_hash", "s", F.explode(at).alias("p"))

    def starts(scale: int):
        """Starts of the windows of a scale that hold shingle p."""
        span, stride = SCALES[scale]
        first = F.greatest(F.lit(0), F.ceil((F.col("p") - (span - GRAM)) / stride) * stride).cast("int")
        last = (F.floor(F.col("p") / stride) * stride).cast("int")
        return F.transform(F.sequence(first, last, F.lit(stride)), lambda x: F.struct(F.lit(scale).alias("scale"), x.alias("start")))

    size = F.element_at(F.array(*[F.lit(span - GRAM + 1) for span, _ in SCALES]), F.col("scale") + 1)
    wins = (hit.select("row", "doc_id", "text_hash", "s", F.explode(F.concat(*[starts(i) for i in range(len(SCALES))])).alias("x"))
            .select("row", "doc_id", "text_hash", "s", "x.scale", "x.start")
            .select("row", "doc_id", "text_hash", "scale", "start", F.slice("s", F.col("start") + 1, size).alias("win"),
                    F.slice("s", F.greatest(F.lit(1), F.col("start") + 1 - reach), F.lit(2 * reach + per)).alias("around"))
            .dropDuplicates(["row", "scale", "start"]))
    keys = F.transform(signature(F.col("win")), lambda v, i: F.struct(i.alias("band"), v.alias("value")))
    signed = wins.select("row", "doc_id", "text_hash", "scale", "start", "around", F.explode(keys).alias("k")).select(
        "row", "doc_id", "text_hash", "scale", "start", "around", "k.band", "k.value")
    found = (signed.join(F.broadcast(bands.select("id", "scale", "band", "value").distinct()), ["scale", "band", "value"])
             .groupBy("row", "doc_id", "text_hash", "start", "id").agg(F.first("around").alias("around")))
    # the part of the surroundings that a template of this size can reach from the window
    near = F.slice("around", F.greatest(F.lit(1), F.least("start", F.lit(reach)) + 1 - F.col("size")), 2 * F.col("size") + per)
    share = F.size(F.array_intersect("shingles", "near")) / F.size(F.array_distinct("shingles"))
    stands = (F.size("exact") == 0) | F.exists(F.sequence(F.lit(1), F.greatest(F.size("near"), F.lit(1))),
                                               lambda i: F.slice("near", i, F.size("exact")) == F.col("exact"))
    return (found.join(F.broadcast(table), "id").withColumn("near", near)
            .select("doc_id", "text_hash", "row", "license", "start", share.alias("containment"), stands.alias("stands"))
            .where((F.col("containment") >= contain) & F.col("stands"))
            .groupBy("row", "doc_id", "text_hash", "license", "start").agg(F.max("containment").alias("containment"))
            .select("doc_id", "text_hash", "license", "start", "containment"))


def _without_families(found: Column) -> Column:
    """The license names of a document, without a family's name where a version of it is among them."""
    for family, versions in FAMILIES.items():
        of = F.array(*[F.lit(v) for v in versions])
        found = F.when(F.arrays_overlap(found, of), F.array_remove(found, family)).otherwise(found)
    return found


def scan_documents(docs: DataFrame, templates=TEMPLATES, contain: float = CONTAIN) -> DataFrame:
    """Per document: doc_id, n_licenses, licenses (sorted, comma-joined), best containment (null: none)."""
    found = (scan(docs, templates, contain).groupBy("doc_id", "text_hash")
             .agg(F.array_sort(F.collect_set("license")).alias("_l"), F.max("containment").alias("containment"))
             .withColumn("_l", _without_families(F.col("_l")))
             .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "_l", "containment"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    return (rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
            .select("doc_id", F.coalesce(F.size("_l"), F.lit(0)).cast("long").alias("n_licenses"),
                    F.coalesce(F.array_join("_l", ","), F.lit("")).alias("licenses"), "containment"))
