"""Exact duplicates and their filters against plain counting."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest

from sittings.llm import exact


@pytest.mark.parametrize("bits", [3, 10, 33, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_filter_packs_without_loss(bits, n):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False)
    prints = np.concatenate((prints, prints[: n // 3], prints[: n // 5]))
    f = exact.Filter.unpack(exact.Filter.of(bits, prints).pack())
    assert dict(zip(f.prints.tolist(), f.counts.tolist(), strict=True)) == Counter(prints.tolist())


def test_filters_of_any_size_merge_without_loss():
    rng = np.random.default_rng(7)
    parts = [rng.integers(0, 5000, n, dtype=np.uint64) for n in (3000, 1, 40, 0, 900)]
    packed = [exact.Filter.of(40, p).pack() for p in parts]
    f = exact.Filter.merge([exact.Filter.unpack(raw) for raw in packed])
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(f.prints.tolist(), f.counts.tolist(), strict=True)) == want
    assert (np.diff(f.prints.astype(np.int64)) > 0).all()
    # A quotient costs no room: 5000 possible values of 40 bits in well under 5 bytes each.
    assert len(f.pack()) < 6 * len(f.prints) + 12 * int((f.counts > 1).sum()) + 20


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        for at, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out[i, keep, len(ids), at == 0, sha] += 1
    return out


@pytest.mark.parametrize("bits", [64, 5, 1])
def test_documents(spark, bits):
    rows = corpus.rows()
    rows += [(None, "only without id", *rows[0][2:])] * 3 + [(70 + i, "hot", *rows[0][2:]) for i in range(300)]
    rows += [(5000, rows[4][1] + "\0", *rows[0][2:]), (5001, "x" * 300_000, *rows[0][2:])] * 2
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(5)
    got = exact.exact_duplicates(docs, bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_empty_table(spark):
    assert exact.exact_duplicates(corpus.empty(spark)).collect() == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_ROWS", 2)
    rows = corpus.rows()
    got = exact.exact_duplicates(corpus.docs(spark))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_filters_of_another_day_join_in(spark):
    """Merged filters are filters: merging them with others counts both."""
    days = [spark.range(0, 900, 1, 3), spark.range(600, 2000, 1, 2)]
    prints = [d.selectExpr("xxhash64(id % 700) AS print") for d in days]
    whole = exact.partition_filters(prints[0].union(prints[1]), 64, 3)
    apart = [exact.merged(exact.partition_filters(p, 64, 3)) for p in prints]
    want, got = (
        {r.block: bytes(r.filter) for r in exact.merged(f).collect()}
        for f in (whole, apart[0].union(apart[1]))
    )
    assert got == want and len(got) == 8
