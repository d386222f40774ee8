"""License scan with DataFrame functions alone: MinHash bands over overlapping windows of words retrieve templates, exact
containment of shingles verifies them.

Templates are put into classes by length (a class holds those above half its length, up to its length). For each class a
text is cut into windows of twice the length, each starting one length after the last, so a passage as long as
a template lies whole in some window. A template contained to a share c has a Jaccard similarity with its window of
about c / (4 + 1 - c) or more (window: four times the template at worst). With bands of one row the chance to miss it is
(1 - that) ** BANDS: for c = 0.8 and 64 bands, 2 in 100,000.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINED, BANDS, SHORTEST = 5, 0.8, 64, 8
#: Templates are joined by a broadcast; more bytes of them than this are refused, not cut.
TEMPLATE_BYTES = 1 << 20

#: Notices by which licenses are told (public texts).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def templates(spark: SparkSession) -> DataFrame:
    """template_id, license, text."""
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id long, license string, text string")


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct runs of k words, or all of them as one if there are fewer; none without words."""
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " ")
    )
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def minhashes(shingle_hashes: Column, bands: int = BANDS) -> Column:
    """array<long>: the least hash for each of so many seeds (bands of one row)."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda s: F.array_min(F.transform(shingle_hashes, lambda h: F.xxhash64(h, s))))


def anchors(texts: list[str], k: int = SHINGLE, contained: float = CONTAINED) -> list[str]:
    """Words without one of which no text contains enough of any template: the shingles that hold none of them are too
    few. Long words are taken first, as they are rare elsewhere."""
    chosen: set[str] = set()
    for text in texts:
        w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
        runs = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        need = contained * len(runs)
        for word, _ in sorted(Counter(w).items(), key=lambda x: (x[0] not in chosen, -len(x[0]), x[0])):
            if sum(not chosen & set(r) for r in runs) < need:
                break
            if sum(word in r for r in runs):
                chosen.add(word)
    return sorted(chosen)


def scan(docs: DataFrame, known: DataFrame, k: int = SHINGLE, contained: float = CONTAINED, bands: int = BANDS) -> DataFrame:
    """doc_id, license, template_id, start, containment for each document and template found in it.

    containment is the share of the template's k-word shingles that one window of the text holds, at least
    ``contained``; start is the window's first word. Of several windows the one with the most, then the first is told.
    Rows that repeat a doc_id and its text give one row; a null doc_id stays null. Null and empty texts or templates
    match nothing. known: template_id, license, text; it is read by the driver for its lengths and anchors.
    """
    rows = known.where("text is not null").select("template_id", "license", "text").collect()
    if sum(len(r["text"].encode()) for r in rows) > TEMPLATE_BYTES:
        raise ValueError(f"templates hold more than {TEMPLATE_BYTES} bytes, which are sent to all tasks")
    lengths, longest = [], max([SHORTEST, *(len(re.split(r"[\W_]+", r["text"])) for r in rows)])
    while not lengths or lengths[-1] < longest:
        lengths.append(2 * lengths[-1] if lengths else SHORTEST)
    of_length = F.array_min(F.filter(F.array(*map(F.lit, lengths)), lambda n: n >= F.size("words")))
    own = known.where("text is not null").withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0).select(
        "template_id", "license", shingles(F.col("words"), k).alias("template"), of_length.alias("length")
    )
    own_bands = own.select("template_id", "license", "template", "length", F.posexplode(minhashes(F.transform("template", lambda s: F.xxhash64(s)), bands)).alias("band", "value"))

    marks = anchors([r["text"] for r in rows], k, contained)
    marked = F.col("text").rlike("(?iu)" + "|".join(map(re.escape, marks))) if marks else F.lit(False)
    texts = docs.where(marked).select("doc_id", F.xxhash64("text").alias("of"), words_of(F.col("text")).alias("words"))
    windows = (
        texts.select("doc_id", "of", "words", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
        .select("doc_id", "of", "words", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.col("length"))).alias("start"))
        .select("doc_id", "of", "length", "start", F.slice("words", F.col("start") + 1, 2 * F.col("length")).alias("words"))
        .where(F.arrays_overlap("words", F.array(*map(F.lit, marks or [""]))))
        .select("doc_id", "of", "length", "start", shingles(F.col("words"), k).alias("window"))
    )
    found = windows.select(
        "doc_id", "of", "length", "start", "window", F.posexplode(minhashes(F.transform("window", lambda s: F.xxhash64(s)), bands)).alias("band", "value")
    ).join(F.broadcast(own_bands), ["length", "band", "value"])
    share = F.size(F.array_intersect("window", "template")) / F.size("template")
    return (
        found.groupBy("doc_id", "of", "template_id", "start").agg(F.first("license").alias("license"), F.max(share).alias("containment"))
        .where(F.col("containment") >= contained)
        .groupBy("doc_id", "of", "template_id").agg(
            F.first("license").alias("license"), F.min(F.struct(-F.col("containment"), F.col("start"))).alias("best")
        ).select("doc_id", "license", "template_id", F.col("best.start").alias("start"), (-F.col("best.col1")).alias("containment"))
    )
