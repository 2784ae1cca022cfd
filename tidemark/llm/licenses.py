"""Licence scans: MinHash bands over overlapping windows retrieve templates.

Everything runs in DataFrame expressions.  A template of n words is looked for
in windows a quarter longer than itself, beginning at every quarter of it, so
each verbatim occurrence lies whole inside a window and at least half of the
window's shingles are the template's.  A window's signature is BANDS MinHash
values, each a band of one row: at a similarity of 0.5 or more the chance that
no band agrees is below 2 ** -BANDS.  Windows and templates are joined on their
bands, and the share of the template's shingles that the window holds decides.

Only windows around anchors are cut.  A template's anchors are a few of its
words, chosen so that fewer than 20 % of its shingles are free of them: a window
that holds 80 % of the shingles holds an anchor, so nothing is missed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import Workspace, prepare

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 16
PART = 8192  #: words of a part of a long text

#: Short notices as their publishers word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-short", "Licensed under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def anchors(words: list[str], known: tuple[str, ...] = ()) -> list[str]:
    """Words that leave fewer than 1 - CONTAINMENT of the template's shingles without any of them, long words first."""
    count = max(1, len(words) - SHINGLE + 1)
    spans = [set(words[i : i + SHINGLE]) for i in range(count)]
    chosen: list[str] = []
    while spans and len([s for s in spans if not s & set(chosen)]) >= (1 - CONTAINMENT) * count - 1e-9:
        free = [s for s in spans if not s & set(chosen)]
        best = max(sorted({w for s in free for w in s}), key=lambda w: (sum(w in s for s in free) * min(len(w), 8) * (2 if w in known else 1), w))
        chosen.append(best)
    return chosen


def _words(column):
    return F.filter(F.split(F.regexp_replace(F.lower(column), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")


def _shingles(words):
    count = F.greatest(F.size(words) - (SHINGLE - 1), F.when(F.size(words) > 0, 1).otherwise(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def _bands(shingles):
    """The least of each hash function over the shingles."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def scan(spark: SparkSession, docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, name: str = "licenses") -> DataFrame:
    """(doc_id, license_id, containment, first_word, windows): licences that documents of ``docs`` (doc_id, text, ...) hold.

    One row a document row's id and template: the best containment (0.8 at
    least), the first word of the first window that reaches it and how many
    windows reach 0.8.  Words are runs of letters and digits, lower-cased.
    Defined cases: null and empty texts hold nothing; templates of fewer than
    five words are matched as one shingle in full windows; rows that repeat a
    doc_id count together; an empty table gives no rows; further columns are
    ignored.
    """
    prepare(spark)
    rows = []
    marks: dict[int, set[str]] = {}
    for license_id, text in templates:
        words = template_words(text)
        own = anchors(words, ("licensed", "license", "permission", "redistribution"))
        rows.append((license_id, len(words), " ".join(words)))
        marks.setdefault(len(words), set()).update(own)
    table = spark.createDataFrame(rows, "license_id string, width int, words string")
    table = table.withColumn("words", F.split("words", " ")).withColumn("theirs", _shingles(F.col("words")))
    table = table.select("license_id", "width", "theirs", F.posexplode(_bands(F.col("theirs"))).alias("band", "value"))

    every = sorted({w for own in marks.values() for w in own})
    steps = {width: max(1, (width - SHINGLE + 1) // 4) for width in marks}
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    likely = source.where(_any([F.contains("text", F.lit(w)) for w in every]))
    # written, so that no later expression computes the words again; a long text becomes parts, each with what its last window needs
    ws = Workspace(spark, name)
    overlap = max(width + step for width, step in steps.items())
    words = likely.select("doc_id", _words(F.col("text")).alias("words"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PART))
    parts = words.select("doc_id", F.explode(F.transform(begins, lambda s: F.struct(s.alias("base"), F.slice("words", s + 1, PART + overlap).alias("words")))).alias("p"))
    likely = ws.save(parts.select("doc_id", "p.base", "p.words"), "likely")
    likely = likely.withColumn("at", F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: F.coalesce(F.get("words", i).isin(*every), F.lit(False))))
    likely = likely.where(F.size("at") > 0)

    def windows(width: int, own: set[str]):
        step = steps[width]
        hit = F.filter("at", lambda i: F.get("words", i).isin(*sorted(own)))
        # a window beginning at s holds words s to s + width + step - 1; those that begin beyond the part are the next part's
        starts = F.array_distinct(F.flatten(F.transform(hit, lambda i: F.transform(F.sequence(F.floor(F.greatest(i - width - step + 1, F.lit(0)) / step), F.floor(i / step)), lambda k: (k * step).cast("int")))))
        return F.transform(F.filter(starts, lambda s: s < PART), lambda s: F.struct(F.lit(width).alias("width"), s.alias("start"), F.slice("words", s + 1, width + step).alias("words")))

    cut = likely.select("doc_id", "base", F.explode(F.flatten(F.array(*[windows(width, own) for width, own in sorted(marks.items())]))).alias("w"))
    cut = ws.save(cut, "windows").select("doc_id", "w.width", (F.col("base") + F.col("w.start")).alias("start"), _shingles(F.col("w.words")).alias("own"))
    cut = ws.save(cut, "shingles")
    banded = cut.select("doc_id", "width", "start", "own", F.posexplode(_bands(F.col("own"))).alias("band", "value"))
    # the templates are constants of this module or of the caller: a few rows
    met = banded.join(F.broadcast(table), ["width", "band", "value"])
    held = F.size(F.array_intersect("own", "theirs")) / F.size("theirs")
    verified = met.select("doc_id", "license_id", "start", held.alias("held")).where(F.col("held") >= CONTAINMENT)
    best = verified.groupBy("doc_id", "license_id").agg(F.max(F.struct("held", (-F.col("start")).alias("before"))).alias("b"), F.count_distinct("start").alias("windows"))
    return best.select("doc_id", "license_id", F.round("b.held", 6).alias("containment"), (-F.col("b.before")).cast("long").alias("first_word"), F.col("windows"))


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
