"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are lower-cased words of letters and digits; a shingle is five words. Templates are put into length
classes by powers of two. A class has windows of one and a half times its length, at steps of half of it, so that every
stretch as long as a template of the class lies whole in some window, and that window has with the template a Jaccard
similarity of 0.25 at least when the stretch holds four fifths of the template. With 40 bands of one row each, a window
of similarity 0.25 collides with the template in some band with probability 1 - 0.75 ^ 40 > 0.99999. What is retrieved
is then compared exactly: the share of the template's shingles that the window contains. Wordings of two licenses may
differ in a version or one word only, so that a text of one contains four fifths of the other's: for each such template
of another license, the window must also have one of the shingles that tell the two apart.

A band collides only if the window contains the template's own minimal shingle of that band. These shingles (at most 40
a template) are known beforehand, so only windows around one of them can collide, and only those are hashed. Nothing is
lost by that. All steps are SQL functions; there is no shuffle but that of the matches.

Defined results
---------------
* Null text and text of fewer than five words have no shingle and match nothing. An empty table gives an empty result.
* Rows that share a ``doc_id`` count as one document; a null one is a document too.
* Other columns of ``docs`` are not carried. Long texts are scanned whole, as one row.
* A template of fewer than five words raises; templates with equal ids count as one license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtshop.llm.common import let

SHINGLE = 5
BANDS = 40
CONTAINMENT = 0.8

# How a license is named after words such as "licensed under".
NAMES = [
    ("MIT", "the MIT License"), ("MIT", "the terms of the MIT license"),
    ("ISC", "the ISC License"), ("Zlib", "the zlib License"), ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-2-Clause", "the 2-Clause BSD License"),
    ("BSD-2-Clause", "the Simplified BSD License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"), ("BSD-3-Clause", "the 3-Clause BSD License"),
    ("BSD-3-Clause", "the New BSD License"),
    ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"),
    ("Apache-2.0", "the Apache 2.0 License"),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0"), ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("EPL-1.0", "the Eclipse Public License 1.0"), ("EPL-2.0", "the Eclipse Public License 2.0"),
    ("EPL-2.0", "the terms of the Eclipse Public License v. 2.0"),
    ("Artistic-2.0", "the Artistic License 2.0"), ("OFL-1.1", "the SIL Open Font License, Version 1.1"),
    ("GFDL-1.3", "the GNU Free Documentation License, Version 1.3"),
    ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "Creative Commons Zero 1.0"), ("Unlicense", "the terms of the Unlicense"),
]
# Licenses of the GNU family, with the versions that are told apart.
GNU = [("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")),
       ("AGPL", "Affero General Public License", ("3",))]
# Kinds of Creative Commons licenses, and how their versions are written.
CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
      ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
CC_VERSIONS = [("4.0", "4.0 International"), ("3.0", "3.0 Unported")]
LEADS = ("Licensed under", "Released under", "Distributed under", "Published under", "Available under")
# Notices and opening passages of public licenses.
PASSAGES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
                "software and accompanying documentation covered by this license"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v1.0"),
    ("EPL-2.0", "The accompanying program is provided under the terms of this Eclipse Public License"),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing "
                     "it is not allowed. Preamble This license establishes the terms under which a given free software "
                     "Package may be copied, modified, distributed, and/or redistributed."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
                "and related or neighboring rights to this work."),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                 "Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, "
                "the GNU General Public License is intended to guarantee your freedom to share and change free software"),
]


def templates_known() -> list[tuple[str, str]]:
    """(license, wording) of all templates: passages, and names after each of ``LEADS``."""
    names = list(NAMES)
    passages = list(PASSAGES)
    for short, name, versions in GNU:
        for version in versions:
            license_id = f"{short}-{version}" if "." in version else f"{short}-{version}.0"
            names += [(license_id, f"the GNU {name} {text}") for text in (
                f"version {version}", f"v{version}", f"v{version}.0" if "." not in version else f"version {version} only")]
            names += [(license_id, f"the GNU {short} v{version}"), (license_id, f"the GNU {short} version {version}")]
            passages.append((license_id, "you can redistribute it and/or modify it under the terms of the "
                                         f"GNU {name} as published by the Free Software Foundation, either version {version} "
                                         "of the License, or (at your option) any later version."))
    for kind, long in CC:
        for version, text in CC_VERSIONS:
            names.append((f"CC-{kind}-{version}", f"CC {kind} {version}"))
            passages.append((f"CC-{kind}-{version}",
                             f"This work is licensed under a Creative Commons {long} {text} License."))
            passages.append((f"CC-{kind}-{version}", f"licensed under the Creative Commons {long} {text} License"))
            names.append((f"CC-{kind}-{version}", f"a Creative Commons {long} {version} license"))
    return passages + [(license_id, f"{lead} {name}") for license_id, name in names for lead in LEADS]


TEMPLATES = templates_known()


def text_shingles() -> Column:
    """64-bit hashes of the five-word shingles of ``text``, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def joined(hashes: Column) -> Column:
        at = F.when(F.size(hashes) >= SHINGLE, F.sequence(F.lit(0), F.size(hashes) - SHINGLE)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), joined)


def min_hashes(shingles: Column, bands: int) -> Column:
    """The smallest hash of each band, with the shingle that has it."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(
        F.transform(shingles, lambda x: F.struct(F.xxhash64(x, j).alias("low"), x.alias("of")))))


class Templates:
    """What the scan needs of the templates: a few numbers each, the same for every corpus."""

    def __init__(self, spark: SparkSession, templates=None, bands: int = BANDS, containment: float = CONTAINMENT):
        self.bands, self.containment = bands, containment
        rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates or TEMPLATES)],
                                     "template int, license string, text string")
        made = (rows.withColumn("shingles", text_shingles()).withColumn("length", F.size("shingles"))
                .withColumn("shingles", F.array_distinct("shingles"))
                .withColumn("low", min_hashes(F.col("shingles"), bands)).collect())
        if any(not r["length"] for r in made):
            raise ValueError(f"a template needs {SHINGLE} words")
        self.rows = [(r["template"], r["license"], r["shingles"], self.apart(r, made)) for r in made]
        self.classes: dict[int, list] = {}
        for r in made:
            self.classes.setdefault((r["length"] - 1).bit_length(), []).append(r)

    def apart(self, own, made) -> list[list[int]]:
        """What tells a template from each template of another license that contains so much of it, but not all."""
        wanted = set(own["shingles"])
        kept = (wanted - set(r["shingles"]) for r in made if r["license"] != own["license"])
        return [sorted(d) for d in {frozenset(d) for d in kept} if 0 < len(d) <= (1 - self.containment) * len(wanted) + 1e-9]

    def window(self, kind: int) -> tuple[int, int]:
        """Length and step of the windows of a class, in shingles."""
        return max(1, 3 * 2 ** kind // 2), max(1, 2 ** kind // 2)

    def pivots(self, kind: int) -> list[int]:
        return sorted({low["of"] for r in self.classes[kind] for low in r["low"]})

    def keys(self, kind: int) -> list[tuple[int, int, int]]:
        """(band, smallest hash, template)."""
        return [(j, low["low"], r["template"]) for r in self.classes[kind] for j, low in enumerate(r["low"])]


def scan(docs: DataFrame, templates=None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word, n_windows``: the licenses that each document contains.

    ``containment`` is the largest of the windows that match, ``first_word`` the word at which the first of these
    windows begins, ``n_windows`` their number.
    """
    spark = docs.sparkSession
    known = Templates(spark, templates, bands, containment)
    every = sorted({p for kind in known.classes for p in known.pivots(kind)})

    def windows(shingles: Column, kind: int) -> Column:
        """The windows of a class that hold one of its pivots: class, start, shingles."""
        length, step = known.window(kind)
        pivots = known.pivots(kind)
        places = F.array_compact(F.transform(shingles, lambda x, i: F.when(x.isin(pivots), i)))
        first = lambda i: F.greatest(F.lit(0), F.floor((i - length) / step).cast("int") + 1)
        around = F.flatten(F.transform(places, lambda i: F.sequence(first(i), F.floor(i / step).cast("int"))))
        return F.transform(F.array_distinct(around), lambda k: F.struct(
            F.lit(kind).alias("kind"), (k * step).alias("at"),
            F.array_distinct(F.slice(shingles, k * step + 1, length)).alias("has")))

    # Texts without any pivot, nearly all, are done after one look at each shingle.
    found = let(text_shingles(), lambda shingles: F.when(
        F.exists(shingles, lambda x: x.isin(every)),
        F.concat(*[windows(shingles, kind) for kind in sorted(known.classes)])))
    placed = docs.select("doc_id", F.explode(found).alias("w")).select("doc_id", "w.*")
    # The tables below have a row for each band and each template.
    keys = spark.createDataFrame([(kind, *key) for kind in known.classes for key in known.keys(kind)],
                                 "kind int, band int, low long, template int")
    texts = spark.createDataFrame(known.rows, "template int, license string, wanted array<long>, apart array<array<long>>")
    collided = (placed.withColumn("bands", min_hashes(F.col("has"), bands))
                .withColumn("id", F.struct("doc_id", "kind", "at"))
                .select("id", "has", F.posexplode("bands").alias("band", "b"))
                .select("id", "has", F.col("id.kind").alias("kind"), "band", F.col("b.low").alias("low")))
    retrieved = (collided.join(F.broadcast(keys), ["kind", "band", "low"])
                 .select("id", "has", "template").join(F.broadcast(texts), "template"))
    share = F.size(F.array_intersect("wanted", "has")) / F.size("wanted")
    told = F.forall("apart", lambda d: F.arrays_overlap(d, F.col("has")))
    matched = retrieved.withColumn("share", share).filter((F.col("share") >= containment) & told)
    # A window meets its template in many bands: counted once.
    once = matched.groupBy(F.col("id.doc_id").alias("doc_id"), "license", F.col("id.kind").alias("kind"),
                           F.col("id.at").alias("at")).agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"),
        F.count(F.lit(1)).alias("n_windows"))
