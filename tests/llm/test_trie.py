"""The trie of conversations against one that is built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sittings.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, h1 double, block boolean, saved int"
CLASHING = ("d", 1.5, True, 3)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            digest = hashlib.sha256((text or "").encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, role or "", digest, text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members, ended = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
        ended[paths[c]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ids) - 1) * (len(p[-1][1].encode()) if p else 0)
    return Counter(
        (
            ids[0], len(p), members[p[:-1]][0] if p else None, len(ids), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, ended[p])).encode()).hexdigest(),
        )
        for p, ids in members.items()
    )


def conversations(seed=2):
    rng = random.Random(seed)
    words = ["hello", "héllo wörld", "", None, "x" * 50, "what?", "日本"]
    rows = []
    for c in [*range(0, 60), *range(101, 140, 2), -7, -5, -3, 10**12, 10**12 + 3]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", None, ""]) if c % 7 == 0 else "user"
            rows.append((c, turn if turn or c % 3 else None, role, rng.choice(words[: 1 + c % 7]), *CLASHING))
    rows += [(62, 1, "user", "tie b", *CLASHING), (62, 1, "user", "tie a", *CLASHING), (62, None, "z", "n", *CLASHING)]
    rows += [(None, 0, "user", "no conversation", *CLASHING), rows[3], rows[3], rows[-1]]
    rows += [(200 + i, t, "user", f"copy {t}", *CLASHING) for i in range(120) for t in range(7)]
    rows += [(70, t, "user", f"long {t // 3}", *CLASHING) for t in range(500)]
    rows += [(75, t, "user", f"long {t // 3}", *CLASHING) for t in range(300)] + [(77, 0, "user", "y" * 200_000, *CLASHING)]
    # Each conversation shares one turn more with the one before: chains that hang on chains.
    rows += [(400 + 5 * i, t, "s", "step" if t < i else f"own {i} {t}", *CLASHING) for i in range(30) for t in range(i + 3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,span", [(4, 4096), (1, 7), (3, 16)])
def test_trie(spark, monkeypatch, block, span):
    monkeypatch.setattr(trie, "SPAN", span)
    rows = conversations()
    got = trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), block)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_places_of_a_hot_conversation(spark):
    """One conversation lies over all ranges, and its turns are numbered on."""
    rows = [(5, t % 2000, f"r{t}") for t in range(6000)] + [(c, 0, "a") for c in (1, 9)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string").repartition(4)
    got = trie.places(docs)
    want = sorted(rows)
    numbers = Counter()
    for row in want:
        numbers[(*row, sum(r[0] == row[0] for r in want[: want.index(row)]) if row[0] != 5 else want.index(row) - 1)] += 1
    assert Counter(tuple(r) for r in got.collect()) == numbers


def test_ids_that_end_alike_are_streamed(spark, monkeypatch):
    rows = [(i, 0, "user", "hi", *CLASHING) for i in range(3000)]
    got = trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_nothing(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.trie(spark.createDataFrame([(None, 1, "u", "t", *CLASHING)], SCHEMA)).collect() == []
