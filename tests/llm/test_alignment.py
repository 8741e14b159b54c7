"""Alignment of two tokenizers against whole encodings and plain overlaps of byte ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sittings.llm import alignment, spans

A = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))

SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
LETTERS = {chr(b): b for b in SHOWN}
LETTERS |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in SHOWN)}

ODD = [
    "<|endoftext|> <s> </s>", "a  b   c", "  lead", "tail  ", " ", "\n", "a\nb\n\nc\n d", "a\r\nb\tc",
    "x\u00a0y z\u3000w", "e\u0301 \u00c5 \ufb01", "it's I'll we 've '", "a\u2581b", "\u2581", "\0 a", "caf\u00e9 \u00a0b",
    "\u65e5\u672c \u8a9e \u3042 \u3044", "\U0001f600 \U0001f601\n\U0001f602", "$1,000.00 #", "wo rd", "a" * 3000, "\u1680 b \u2003c",
    "\u0085 d", "\x1c e", "1 2\n3", "<0x0A> <unk>", "\u200b f", "\u0430 \u0431\u0432\n\u0433", "\x7f g \x7f",
]


def tokens(text):
    """Ids and byte ranges of both tokenizations, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = A.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("\u2581", " ").encode()))
    if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
        return None
    out = []
    for side in (a, b):
        at, placed = 0, []
        for i, t in side:
            placed.append((i, at, at + len(t)))
            at += len(t)
        out.append(placed)
    return out


def brute(rows):
    found, counts = [], Counter()
    for doc_id, text, *_ in rows:
        both = tokens(text)
        if both is None:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = both
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in ends:
            inside = [[str(i) for i, s, e in side if low <= s and e <= high] for side in both]
            groups.append("|".join(",".join(ids) for ids in inside))
            low = high
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        counts.update(set(links))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        found.append((doc_id, len(a), len(b), len(groups), links, sha))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = Counter()
    for doc_id, n_a, n_b, n_groups, links, sha in found:
        best = sum(counts[link] == most[link[0]] for link in links)
        out[doc_id, n_a, n_b, n_groups, len(links), best, sum(counts[x] for x in links), sha] += 1
    return out, counts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def small_rows():
    rng = random.Random(5)
    rows = [r for r in corpus.rows(n=30) if len(r[1] or "") < 2500]
    rows += [(1000 + i, t, *rows[0][2:]) for i, t in enumerate(ODD)]
    mixed = [*ODD, "the", " of", "\n", "Stra\u00dfe", ".", "\u00e9t\u00e9", "  ", "\u4e2d"]
    rows += [(2000 + i, "".join(rng.choice(mixed[:19] + mixed[20:]) for _ in range(12)), *rows[0][2:]) for i in range(60)]
    return rows


def test_documents(spark, monkeypatch):
    rows = small_rows()
    want, _ = brute(rows)
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(4)
    got = alignment.align(docs).select(*COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_printed_groups_and_counts(spark):
    rows = small_rows()[:40]
    docs = spark.createDataFrame(rows, corpus.SCHEMA).repartition(2)
    want, counts = brute(rows)
    got = alignment.printed_groups(docs).collect()
    shas = Counter((r.doc_id, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert shas == Counter((k[0], k[-1]) for k, n in want.items() for _ in range(n))
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(docs).collect()} == counts


@pytest.mark.parametrize("cached", [1, 50, 10**6])
def test_units_small_cache_and_many_chunks(cached, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_UNITS", cached)
    monkeypatch.setattr(alignment, "LEARNED_AT_ONCE", 7)
    units = alignment.Units(
        str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
    )
    rows = small_rows()
    for part in range(0, len(rows), 9):
        some = [r[1] for r in rows[part : part + 9]]
        for piece in spans.slices(pa.array(some, pa.string()), 700):
            for row, numbers, _, pairs, times in alignment._documents(units, piece):
                both = tokens(some[piece.first + row])
                assert (numbers is None) == (both is None)
                if both:
                    assert numbers[:2] == [len(both[0]), len(both[1])]
                    back, again = alignment._unpacked(alignment._packed(pairs, times))
                    assert (back == pairs).all() and (again == times).all()
                    assert int(times.sum()) == numbers[3]


def test_slices_and_links_of_ends():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (sorted({*rng.integers(1, n + 1, 9).tolist(), n}) for _ in range(2))
        a_upto, b_upto = alignment.common_slices(a, b)
        assert [a[i - 1] for i in a_upto] == sorted(set(a) & set(b)) == [b[i - 1] for i in b_upto]
        links, a0, b0 = [], 0, 0
        for a1, b1 in zip(a_upto, b_upto, strict=True):
            links += alignment.slice_links(a, b, (a0, a1), (b0, b1))
            a0, b0 = a1, b1
        starts = [[0, *e[:-1]] for e in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
        assert links == want


def test_empty_table(spark):
    assert alignment.align(corpus.empty(spark)).collect() == []
