"""Near-duplicates and repeated passages against their definitions."""

from __future__ import annotations

import random
from collections import Counter

import corpus
import pytest

from sittings.llm import graph
from sittings.llm.graph import components
from sittings.llm.minhash import near_duplicates
from sittings.llm.substring import remove_repeats
from sittings.llm.suffix import remove_repeated_bytes


def shingles(text):
    w = corpus.blank_words((text or "").translate(corpus.LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = corpus.rows()
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = linked(sets, percent)
    got = near_duplicates(corpus.docs(spark), percent).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
            assert r.kept == (r.doc_id == want[r.doc_id])


def test_cloud_of_near_copies(spark):
    """Copies that drifted apart: many are linked only through others, or not at all."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        text = list(rng.choice(texts) if texts and rng.random() < 0.7 else base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(9999)}"
        texts.append(text)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = linked({i: shingles(t) for i, t in rows}, 85)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 1 < len(set(want.values())) < len(want)


def test_texts_of_one_doc_id_link_only_what_they_hold(spark):
    rng = random.Random(11)
    a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(2))
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (None, a), (4, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = sorted(((r.doc_id, r.component_id) for r in got), key=str)
    # Documents 2 and 3 hold nothing in common; each is linked with the text of document 1 that it equals.
    assert found == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (None, 1), (4, 4)], key=str)
    rows = [(5, a), (5, b), (2, b), (3, a)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (5, 2), (5, 3)]


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (50, 50), (7, 3)]
    got = components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert len(got) == len({r.doc_id for r in got}) == 44
    assert {r.doc_id: r.component_id for r in got} == {
        **dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100,
    }


def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "settle", lambda df, name, f=graph.settle: written.append(name) or f(df, name))
    stars = [(1, n) for n in range(2, 30)] + [(n, 40) for n in range(41, 50)] + [(1, 2), (3, 3)]
    got = components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()
    assert {r.doc_id: r.component_id for r in got} == {**dict.fromkeys(range(1, 30), 1), **dict.fromkeys(range(40, 50), 40)}
    assert len(got) == 39 and len(written) == 1
    written.clear()
    got = components(spark.createDataFrame([(3, 1), (3, 2), (9, 8)], "a bigint, b bigint")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert len(written) == 2


def words_left(rows):
    owner = {}
    for doc_id, text in rows:
        w = corpus.blank_words(text)
        for i in range(len(w) - 12):
            if doc_id is not None:
                k = tuple(w[i : i + 13])
                owner[k] = min(owner.get(k, doc_id), doc_id)
    out = Counter()
    for doc_id, text in rows:
        w = corpus.blank_words(text)
        gone = set()
        for i in range(len(w) - 12):
            if doc_id is not None and owner[tuple(w[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id, len(w), len(gone), kept] += 1
    return out


def test_seed_and_extend(spark):
    want = words_left([r[:2] for r in corpus.rows()])
    got = remove_repeats(corpus.docs(spark)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    for r in got:
        spans = list(zip(r.repeats[0::2], r.repeats[1::2], strict=True))
        assert sum(b - a for a, b in spans) == r.n_removed
        assert all(b - a >= 13 for a, b in spans)


def test_windows_repeated_in_one_document(spark):
    """The first document keeps its own repeats, wherever a later one has them."""
    rng = random.Random(4)
    part = [" ".join(f"{c}{rng.randrange(99)}" for _ in range(14)) for c in "abcdef"]
    rows = [
        (3, " ".join([part[0], part[1], part[0], part[2], part[0]])),
        (1, " ".join([part[1], part[0]])),
        (9, " ".join([part[2], part[0], part[3], part[3]])),
        (9, " ".join([part[3], part[2]])),
        (4, " ".join([part[5], part[0], part[1]])),
    ]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == words_left(rows)


def bytes_left(rows, depth):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[i : i + depth] for i in range(len(b) - depth + 1))
    out = Counter()
    for doc_id, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        runs = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out[doc_id, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return out


@pytest.mark.parametrize("depth", [400, 60])
def test_suffix_sort(spark, depth):
    want = bytes_left([r[:2] for r in corpus.rows()], depth)
    got = remove_repeated_bytes(corpus.docs(spark), depth, block=depth // 8).collect()
    assert want == Counter(
        (r.doc_id, r.n_bytes, r.n_removed, len(r.repeats) // 2, bytes(r.kept)) for r in got
    )


def test_shorter_repeats_are_counted_beside(spark):
    rows = [r[:2] for r in corpus.rows()]
    got = remove_repeated_bytes(corpus.docs(spark), 64, block=8, shorter=40).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.repeats) // 2, bytes(r.kept)) for r in got)
    assert found == bytes_left(rows, 64)
    shorter = Counter((k[0], k[2]) for k, n in bytes_left(rows, 40).items() for _ in range(n))
    assert Counter((r.doc_id, r.n_repeated) for r in got) == shorter


@pytest.mark.parametrize("operator", [near_duplicates, remove_repeats, remove_repeated_bytes])
def test_empty_table(spark, operator):
    assert operator(corpus.empty(spark)).count() == 0
