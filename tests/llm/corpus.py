"""A small table of documents with every odd case, and plain definitions to compare with."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "key string, row int, band int, place int, words string, length double, slot string, hit boolean"
)
#: Columns that share names with what operators use inside.
CLASHING = (None, 7, 8, 9, "w", 1.5, "s", True)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = prose(90), prose(9)
    out = []
    for i in range(n):
        text = prose(rng.randint(3, 220))
        if i % 5 == 0:
            text = f"{prose(30)} {passage} {prose(20)}"
        if i % 7 == 0:
            text = f"{line}\n{text}\n{line.upper()}\n"
        if i % 11 == 0 and out:
            kept = rng.choice(out).split(" ")
            for _ in range(max(1, len(kept) // 60)):
                kept[rng.randrange(len(kept))] = rng.choice(words)
            text = " ".join(kept)
        out.append(text)
    out += [out[3], out[3], out[5] + " tail", "same " * 400, "same " * 401, "ab" * 900, "\t\n \r"]
    out += ["one", "one two three", "one two three", "ONE Two three", "", None, None, prose(9000)]
    out += [passage, passage + " " + passage, " " + passage, "漢字 " * 30, "#" * 60 + " | a $b"]
    return out


def rows(seed=1, n=60):
    out = [
        (i, t, "en", None if i % 9 == 4 else f"host{i % 3}", len(t or ""), *CLASHING)
        for i, t in enumerate(texts(seed, n))
    ]
    nameless = (None, out[1][1], None, None, None, *[None] * len(CLASHING))
    return [*out, out[2], out[8], nameless]


def docs(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
