"""License scans (native): MinHash bands of text windows retrieve templates, exact containment decides.

Tokens are runs of letters and digits, lower case; shingles are five tokens.
Templates of 7 to 12 tokens, of 13 to 24 and so on form length classes; a class
has windows of 1.5 times its greatest length, which start so often that any run of
that length lies whole in one of them. 64 bands of one minimum each: a window that
holds four fifths of a template's shingles has a similarity of at least 0.2 to it,
and shares a band with probability over 1 - 0.8**64, that is 1 - 7e-7.

Most windows are left out before that without loss: every template has a few
words, chosen so that over a fifth of its shingles hold one of them; a window
without any of these cannot hold four fifths of the template.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Well-known license statements by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Words that tell a license from other prose; anchors are taken from these first.
TELLING = ("licensed", "license", "licence", "redistribute", "redistribution", "permission", "copyright", "unencumbered", "attribution")
SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
#: Greatest number of tokens of a template in each length class.
LENGTHS = (6, 12, 24, 48, 96, 192, 384)
#: The most templates that are broadcast.
MOST_BROADCAST = 2000


def window_size(most: int) -> int:
    return most * 3 // 2


def stride(most: int) -> int:
    return window_size(most) - most + 1


def tokens_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def anchors(templates: tuple[tuple[str, str], ...], containment: float = CONTAINMENT) -> list[str]:
    """Words of which each window that matches a template holds at least one: for
    each template telling words, then long ones, until the shingles without
    them are fewer than a match needs."""
    split = [tokens_of(t) for _, t in templates]
    often = Counter(w for t in split for w in t)
    out: set[str] = set()
    for t in split:
        left = {tuple(t[i : i + SHINGLE]) for i in range(len(t) - SHINGLE + 1)}
        need = containment * len(left)
        for w in sorted(set(t), key=lambda w: (w not in TELLING, -len(w), often[w], w)):
            if len(left) < need:
                break
            left = {s for s in left if w not in s}
            out.add(w)
    return sorted(out)


def words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def shingles(tokens: Column) -> Column:
    at = F.when(F.size(tokens) >= SHINGLE, F.sequence(F.lit(1), F.size(tokens) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(tokens, i, SHINGLE), " ")))


def bands(shingle: Column) -> Column:
    """(band, least): the minimum of each hash function over the shingles."""
    hashed = lambda j: F.array_min(F.transform(shingle, lambda s: F.xxhash64(s, j)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.struct(j.alias("band"), hashed(j).alias("least")))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, license, most, wanted): a row for each template of 5 to 384 tokens."""
    rows = []
    for i, (name, text) in enumerate(templates):
        n = len(tokens_of(text))
        if not SHINGLE <= n <= LENGTHS[-1]:
            raise ValueError(f"a template has {SHINGLE} to {LENGTHS[-1]} tokens, not {n}: {text[:60]}")
        rows.append((i, name, next(m for m in LENGTHS if n <= m), text))
    return spark.createDataFrame(rows, "template int, license string, most int, text string").select("template", "license", "most", shingles(words(F.col("text"))).alias("wanted"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id_col, license, n_matched, n_shingles): a row for each document and license
    of which some window holds at least `containment` of a template's shingles;
    the template of which most is held stands for the license.

    Rows without id go; null, empty and wordless texts match nothing; repeated rows
    give one result; ties between templates go to the first; an empty table gives
    an empty result, and so do no templates; other columns are ignored; texts may have any length."""
    spark = docs.sparkSession
    if not templates:
        return docs.limit(0).select(id_col, F.lit("").alias("license"), F.lit(0).cast("long").alias("n_matched"), F.lit(0).cast("long").alias("n_shingles"))
    table = template_table(spark, templates)
    table = F.broadcast(table) if len(templates) <= MOST_BROADCAST else table
    keys = table.select("template", "most", F.explode(bands(F.col("wanted"))).alias("b")).select("template", "most", "b.band", "b.least")
    keys = F.broadcast(keys) if len(templates) <= MOST_BROADCAST else keys

    names = anchors(templates, containment)
    near = F.lower(F.col(text_col)).rlike("|".join(re.escape(w) for w in names))
    source = docs.where(F.col(id_col).isNotNull() & near).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("words", words(F.col("text"))).select("id", "words")
    # A generated column keeps the split from being repeated inside the windows.
    source = source.select("id", F.explode(F.array("words")).alias("words"))
    anchored = F.array(*(F.lit(w) for w in names))
    sizes = sorted({next(m for m in LENGTHS if len(tokens_of(t)) <= m) for _, t in templates})

    def of_class(m: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride(m)))
        return F.transform(starts, lambda s: F.struct(F.lit(m).alias("most"), s.alias("start"), F.slice(F.col("words"), s + 1, window_size(m)).alias("own")))

    grid = F.flatten(F.array(*(of_class(m) for m in sizes)))
    windows = source.where(F.size("words") >= SHINGLE).select("id", F.explode(F.filter(grid, lambda w: F.arrays_overlap(w["own"], anchored))).alias("w"))
    windows = windows.select("id", F.col("w.most").alias("most"), F.col("w.start").alias("start"), shingles(F.col("w.own")).alias("held")).where(F.size("held") > 0)
    found = windows.select("id", "most", "start", "held", F.explode(bands(F.col("held"))).alias("b")).select("id", "most", "start", "held", "b.band", "b.least")
    pairs = found.join(keys, ["most", "band", "least"]).join(table.select("template", "license", "wanted"), "template")
    # A pair that shares several bands is verified as often; the aggregate below folds it.
    matched = pairs.select("id", "license", "template", F.size(F.array_intersect("held", "wanted")).alias("n"), F.size("wanted").alias("of"))
    matched = matched.where(F.col("n") >= containment * F.col("of"))
    best = F.max(F.struct((F.col("n") / F.col("of")).alias("share"), (-F.col("template")).alias("by"), "n", "of")).alias("best")
    return matched.groupBy("id", "license").agg(best).select(F.col("id").alias(id_col), "license", F.col("best.n").cast("long").alias("n_matched"), F.col("best.of").cast("long").alias("n_shingles"))

