"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

For a template of L words, windows of L + stride - 1 words at every stride-th word (stride L / 4) cover any
place it can stand. A window that holds 0.8 of a template's shingles is then at least 0.5 similar to it, and
24 bands of one MinHash each bring such a pair together with probability 1 - 2**-24; containment is then
counted on the shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 24
CONTAINMENT = 0.8

# Notices by license, as they are written in public texts.
TEMPLATES = {
    "agpl-header": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-header": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
COMMON = frozenset("a an and any are at by in is it may not of or that the this to under use with without you".split())


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def anchors(templates: dict[str, str], shingle: int = SHINGLE, containment: float = CONTAINMENT) -> list[str]:
    """Words of which every text that holds `containment` of any template's shingles must hold one.

    They stand in more than 1 - containment of each template's shingles, so leaving all of them out is leaving
    out too much.
    """
    chosen: list[str] = []
    for text in templates.values():
        words = words_of(text)
        grams = [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
        if not grams:
            raise ValueError(f"a template needs {shingle} words: {text}")
        hit = lambda w: sum(w in g for g in grams)
        share = lambda: sum(any(c in g for c in chosen) for g in grams) / len(grams)  # noqa: B023, E731
        rare = sorted(set(words) - COMMON, key=lambda w: (w not in chosen, -len(w) * hit(w), w))
        while share() <= 1 - containment + 1e-9:
            chosen.append(next(w for w in rare + sorted(COMMON & set(words)) if w not in chosen))
    return sorted(set(chosen))


def _shingled(words: str, shingle: int) -> str:
    return f"array_distinct(transform(sequence(1, size({words}) - {shingle - 1}), i -> xxhash64(concat_ws(' ', slice({words}, i, {shingle})))))"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, shingle: int = SHINGLE, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row per (key, license_id) found: containment (largest over windows), first_word (of that window).

    Words are runs of a-z and 0-9 after lower-casing, counted from 0. Null and empty texts hold nothing; rows
    with null keys are reported with a null key, as one; rows repeated with one key are one. Ties between windows
    go to the first. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    rows, shapes = [], {}
    for name, t in sorted(templates.items()):
        words = words_of(t)
        rows.append((name, len(words), words))
        shapes[len(words)] = max(1, len(words) // 4)
    known = spark.createDataFrame(rows, "license_id string, length int, words array<string>").withColumn("want", F.expr(_shingled("words", shingle)))
    need = anchors(templates, shingle, containment)

    t = F.col(f"`{text}`").cast("string")
    some = docs.filter(t.rlike("(?i)" + "|".join(need))).select(F.col(f"`{key}`").alias("key"), F.split(F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")), " ").alias("all"))
    shape = F.array(*[F.struct(F.lit(n).alias("length"), F.lit(s).alias("stride")) for n, s in sorted(shapes.items())])
    some = some.select("key", "all", F.inline(shape)).filter(f"size(all) >= {shingle}")
    some = some.select("key", "length", "all", "stride", F.explode(F.expr("sequence(0, size(all) - 1, stride)")).alias("at"))
    cut = some.select("key", "length", "at", F.expr("slice(all, at + 1, length + stride - 1)").alias("w"))
    cut = cut.filter(F.arrays_overlap("w", F.array(*map(F.lit, need)))).filter(F.size("w") >= shingle)
    cut = cut.withColumn("have", F.expr(_shingled("w", shingle))).drop("w")

    def banded(df: DataFrame, shingles: str) -> DataFrame:
        signature = F.array(*[F.expr(f"array_min(transform({shingles}, h -> xxhash64(h, {b})))") for b in range(bands)])
        return df.select("*", F.posexplode(signature).alias("band", "least"))

    met = banded(cut, "have").join(F.broadcast(banded(known.drop("words"), "want")), ["length", "band", "least"])
    met = met.withColumn("containment", F.expr("size(array_intersect(have, want)) / size(want)")).filter(F.col("containment") >= containment)
    best = met.groupBy("key", "license_id").agg(F.max(F.struct("containment", (-F.col("at")).alias("at"))).alias("b"))
    return best.select(F.col("key").alias(key), "license_id", F.col("b.containment").alias("containment"), (-F.col("b.at")).cast("long").alias("first_word"))
