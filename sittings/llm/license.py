"""License notices found by MinHash bands over overlapping text windows.

Templates are notices, cut into shingles of five words. For every template length a
document is cut into windows a quarter longer than the template that overlap so far that some
window holds any notice whole. A window has a MinHash signature of `BANDS` values, each a band of
its own, and retrieves the templates it shares a band with. A window that holds four fifths
of a template's shingles has a similarity of at least 0.4 with it, so it is retrieved with
a probability of 1 - 0.6 ** BANDS (1 - 8e-8 for 32). The template's shingles are then counted in the
window itself: the exact containment decides.

Only windows with a signal word are signed. Every template is so made of signal words that
more than a fifth of its shingles hold one (`signals_suffice` checks it), so a window without any
cannot contain four fifths of it.

Everything is DataFrame functions; the template tables are parameters of fixed size and are
broadcast.

Results for odd rows: NULL or empty texts and texts shorter than a shingle have no license;
repeated rows give equal rows; an empty table gives an empty table. Columns beyond doc_id and
text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sittings.llm.tables import lowered_words
from sittings.runtime import settle

SHINGLE_WORDS = 5
CONTAINED_PERCENT = 80
BANDS = 32

# Wordings of published license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
    "OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SIGNALS = [
    "license", "licenses", "licensed", "software", "permission", "copyright", "redistribution",
    "redistributions", "warranties", "public", "conditions", "gnu",
]

IN_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def signals_suffice(text: str, percent: int = CONTAINED_PERCENT) -> bool:
    """Whether every part of a template that is large enough holds a signal word."""
    words = template_words(text)
    grams = {tuple(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)}
    signed = sum(any(w in SIGNALS for w in g) for g in grams)
    return bool(grams) and 100 * (len(grams) - signed) < percent * len(grams)


def _shingles(words: Column) -> Column:
    last = F.size(words) - SHINGLE_WORDS
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE_WORDS)])
    )


def _signature(shingles: Column) -> Column:
    return F.array(*[F.array_min(F.transform(shingles, _seeded(b))) for b in range(BANDS)])


def _seeded(band: int):
    def image(shingle: Column) -> Column:
        return F.xxhash64(shingle, F.lit(band))

    return image


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, words (their number) and distinct shingles of every template."""
    if not all(signals_suffice(t) for t in texts.values()):
        raise ValueError("a template has too few signal words")
    rows = [(name, template_words(text)) for name, text in texts.items()]
    table = F.array(
        *[F.struct(F.lit(n).alias("license"), F.split(F.lit(" ".join(w)), " ").alias("w")) for n, w in rows]
    )
    out = spark.range(1).select(F.explode(table).alias("t")).select("t.license", "t.w")
    shingles = F.array_distinct(_shingles(F.col("w"))).alias("parts")
    return out.select("license", F.size("w").alias("words"), shingles)


def windows(texts: dict[str, str]) -> list[tuple[int, int, int]]:
    """(template words, window words, step) for every template length."""
    lengths = sorted({len(template_words(t)) for t in texts.values()})
    return [(n, n + max(1, n // 4), max(1, n // 4)) for n in lengths]


def _window_starts(positions: Column, words: int, step: int, total: Column) -> Column:
    """Starts (multiples of the step) of the windows that hold a signal word."""
    last = F.greatest(total - words, F.lit(0))
    last = F.ceil(last / step).cast("int")  # the last window may end behind the text
    first = lambda p: F.greatest(F.ceil((p - words + 1) / step).cast("int"), F.lit(0))
    end = lambda p: F.least(F.floor(p / step).cast("int"), last)
    of = F.transform(
        positions,
        lambda p: F.when(first(p) <= end(p), F.sequence(first(p), end(p))).otherwise(F.array().cast("array<int>")),
    )
    return F.transform(F.array_distinct(F.flatten(of)), lambda i: i * step)


def scan(
    docs: DataFrame, texts: dict[str, str] | None = None, percent: int = CONTAINED_PERCENT
) -> DataFrame:
    """key, license, words, start and common (template shingles in the window) of every match."""
    texts = texts or TEMPLATES
    table = settle(templates(docs.sparkSession, texts), "templates")
    band = F.posexplode(_signature(F.col("parts"))).alias("band", "value")
    bands = table.select("license", "words", band)
    # Words end where the tokenizer ends them: '_' is no part of one.
    signal = rf"(?i)(?<!{IN_WORD})(?:{'|'.join(SIGNALS)})(?!{IN_WORD})"
    words = docs.filter(F.col("text").rlike(signal)).dropDuplicates(["key"])
    words = words.select("key", lowered_words(F.col("text")).alias("w"))
    signals = F.array(*[F.lit(s) for s in SIGNALS])
    numbered = F.transform(F.col("w"), lambda x, i: F.when(F.array_contains(signals, x), i))
    words = settle(words.select(
        "key", F.size("w").alias("total"), _shingles(F.col("w")).alias("shingles"),
        F.filter(numbered, lambda i: i.isNotNull()).alias("positions"),
    ), "signal-words")
    kinds = F.array(
        *[
            F.struct(
                F.lit(n).alias("words"),
                F.lit(w).alias("window"),
                _window_starts(F.col("positions"), w, step, F.col("total")).alias("starts"),
            )
            for n, w, step in windows(texts)
        ]
    )
    cut = words.select("key", "shingles", F.explode(kinds).alias("kind"))
    start = F.explode("kind.starts").alias("start")
    cut = cut.select("key", "shingles", "kind.words", "kind.window", start)
    part = F.slice("shingles", F.col("start") + 1, F.col("window") - (SHINGLE_WORDS - 1))
    cut = cut.select("key", "words", "start", part.alias("part")).filter(F.size("part") > 0)
    signed = cut.withColumn("signature", _signature(F.col("part")))
    band = F.posexplode("signature").alias("band", "value")
    signed = signed.select("key", "words", "start", "part", band)
    retrieved = signed.join(F.broadcast(bands), ["words", "band", "value"])
    retrieved = retrieved.groupBy("key", "license", "start").agg(F.first("part").alias("part"))
    exact = retrieved.join(F.broadcast(table), "license")
    common = F.size(F.array_intersect("parts", "part"))
    return exact.withColumn("common", common).filter(
        100 * F.col("common") >= percent * F.size("parts")
    ).select("key", "license", "words", "start", "common")


def licenses(
    docs: DataFrame, texts: dict[str, str] | None = None, percent: int = CONTAINED_PERCENT
) -> DataFrame:
    """doc_id and the licenses found (sorted), with the best match of each (shingles in one window).

    Templates of one length can be variants of a notice (its version, say): a match gives way
    to a better one of its length in the same or an overlapping window, but not elsewhere.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    widths = [F.when(F.col("words") == n, w) for n, w, _ in windows(texts or TEMPLATES)]
    # In units of a window's width, so that one frame holds what overlaps, whatever the length.
    unit = 1_000_000_000
    place = F.expr(f"start * {unit}L DIV width")
    near = Window.partitionBy("key", "words").orderBy("place").rangeBetween(1 - unit, unit - 1)
    matches = scan(docs, texts, percent).withColumn("width", F.coalesce(*widths)).withColumn("place", place)
    matches = matches.withColumn("top", F.max("common").over(near)).filter("common = top")
    best = matches.groupBy("key", "license").agg(F.max("common").alias("common"))
    found = F.array_sort(F.collect_list(F.struct("license", "common")))
    found = settle(best.groupBy("key").agg(found.alias("found")), "licenses")
    none = F.array().cast("array<struct<license:string,common:int>>")
    return docs.join(found, "key", "left").select(
        "doc_id", F.coalesce("found", none).alias("found")
    )
