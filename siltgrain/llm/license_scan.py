"""Operator 7, license scans, in DataFrame functions only.

Texts become words (runs of ASCII letters and digits in lower case) and 3-word shingles. Texts that share no shingle with any template can't match and
go no further. The others are cut into overlapping windows, twice as long as the templates of a size class and half a window apart, so that each
passage as long as a template lies whole in some window. MinHash bands of one row over a window's shingles retrieve templates; the number of bands of a
size class is the least that retrieves a passage at the containment threshold with probability ``SURE``. Then the exact share of a template's shingles
that the window contains verifies the match.

The templates and their bands are parameters of fixed size and are broadcast; documents are never dealt out, only verified matches are (by doc_id).

Defined results: a null or empty text, or one of less than three words, matches nothing; a null doc_id stays null; repeated rows give one match; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, LEAST, SURE = 3, 0.8, 0.999
SIZES = (8, 16, 32, 64, 128, 256)
# Notices by which licences are commonly given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def bands_of(n_shingles: int, size: int) -> int:
    """Bands so that a window with LEAST of n_shingles is retrieved with probability SURE: each agrees with the Jaccard similarity's probability."""
    window = 2 * size - SHINGLE + 1
    shared = LEAST * n_shingles
    return math.ceil(math.log(1 - SURE) / math.log(1 - shared / (window + n_shingles - shared)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each document and template found in it: doc_id, license, containment (its greatest), first_word (of the first such window)."""
    spark = docs.sparkSession
    rows = []
    for name, text in templates.items():
        words = words_of(text)
        if len(words) < SHINGLE or len(words) > SIZES[-1]:
            raise ValueError(f"{name}: a template has {SHINGLE} to {SIZES[-1]} words")
        rows.append((next(s for s in SIZES if s >= len(words)), name, words))
    bands = {size: max(bands_of(len(w) - SHINGLE + 1, size) for s, _, w in rows if s == size) for size, _, _ in rows}

    def once(value, function):
        """function(value), with value worked out once, wherever the optimizer moves the expression."""
        return F.get(F.transform(F.array(value), function), F.lit(0))

    def shingles(words):
        return F.when(F.size(words) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))

    def minima(found, n):
        return F.transform(F.sequence(F.lit(1), n), lambda band: F.array_min(F.transform(found, lambda x: F.xxhash64(x, band))))

    known = spark.createDataFrame(rows, "size int, license string, words array<string>").select("size", "license", F.array_distinct(shingles(F.col("words"))).alias("wanted"))
    known = spark.createDataFrame([(*r, bands[r["size"]]) for r in known.collect()], "size int, license string, wanted array<bigint>, n_bands int")
    all_wanted = F.array(*(F.lit(x) for x in sorted({x for r in known.select("wanted").collect() for x in r.wanted})))
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    hashed = once(F.filter(F.split(text, " "), lambda w: w != ""), shingles)
    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.filter(F.array(hashed), lambda x: F.arrays_overlap(x, all_wanted))).alias("shingles"))
    classes = F.array(*(F.struct(F.lit(s).alias("size"), F.lit(n).alias("n_bands")) for s, n in sorted(bands.items())))
    by_class = hashed.select("doc_id", "shingles", F.explode(classes).alias("c")).select("doc_id", "shingles", "c.size", "c.n_bands")
    starts = by_class.select("*", F.explode(F.sequence(F.lit(0), F.size("shingles") - 1, F.col("size"))).alias("first_word"))
    window = F.slice("shingles", F.col("first_word") + 1, 2 * F.col("size") - SHINGLE + 1)
    windows = starts.select("doc_id", "size", "n_bands", "first_word", F.explode(F.filter(F.array(window), lambda x: F.arrays_overlap(x, all_wanted))).alias("window"))
    banded = windows.select("doc_id", "size", "first_word", "window", F.posexplode(minima(F.col("window"), F.col("n_bands"))).alias("band", "value"))
    wanted = known.select("size", "license", "wanted", F.posexplode(minima(F.col("wanted"), F.col("n_bands"))).alias("band", "value"))
    share = F.size(F.array_intersect("wanted", "window")) / F.size("wanted")
    pairs = banded.join(F.broadcast(wanted), ["size", "band", "value"]).select("doc_id", "license", share.alias("containment"), "first_word").filter(F.col("containment") >= LEAST)
    return pairs.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
