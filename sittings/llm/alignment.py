"""Alignment of two tokenizers' tokens over the same texts, and which ids stand for each other.

Both tokenizations of a text end tokens at byte offsets. A dictionary from end to index per
tokenizer is made, the keys of both are intersected as hash sets, and the sorted common ends
slice both id lists into groups: between two common ends, the tokens of one side cover the same bytes
as those of the other. Links, pairs of tokens whose bytes overlap, are expanded within each slice.

Texts repeat their words, so the work is done per *unit*, a stretch of text at whose borders both
tokenizers are known to end a token: before a single space or line break between two
characters that are no white space. Neither tokenizer joins across such a place (one splits there before
it merges, the other has no piece with a break or an inner space), so the tokens of a text are
those of its units, and every border is a common end. Units are kept between batches, and a
text takes theirs by array lookups.

How many documents hold a pair of ids linked is counted over the corpus in two steps. Documents are
written in chunks of bounded text. A chunk's distinct pairs, each with its number of documents, are summed
by Spark; then each chunk gets the totals of its own pairs back by a join, and its documents
are scored against them. No table of pairs is broadcast or passes the driver.

Results for odd rows: a text that is NULL or empty, or whose tokens do not give its bytes back (one with
the character that stands for a space in pieces), has no tokens: zeros and an empty string. A row
without doc_id is a document like any other, and so is a repeated row. An empty table gives an
empty table. Long texts are cut at units while they are worked on, never dropped; one row of
links of a text is held at a time. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.llm import spans
from sittings.runtime import settle

CACHED_UNITS = 400_000
CHUNK_BYTES = 16 << 20
LEARNED_AT_ONCE = 2048

# Fixed value: how A splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 1 << 20  # a pair of ids is one number: A's id times this plus B's

# What may stand beside a border: bytes of printable ASCII, and bytes that begin or close longer
# characters. White space beyond ASCII begins with C2, E1, E2 or E3; beside those no border is set.
PRINTED = np.zeros(256, dtype=bool)
PRINTED[0x21:0x7F] = True
BEGINS = PRINTED.copy()
BEGINS[0xC3:0xF5] = True
BEGINS[[0xE1, 0xE2, 0xE3]] = False


def common_slices(a_ends: Sequence[int], b_ends: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each common end, in order, how many tokens of A and of B end there or before."""
    a_index = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b_index = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    return [a_index[end] for end in common], [b_index[end] for end in common]


def slice_links(
    a_ends: Sequence[int], b_ends: Sequence[int], a: tuple[int, int], b: tuple[int, int]
) -> list[tuple[int, int]]:
    """Pairs of tokens of one slice (A's [a0, a1), B's [b0, b1)) whose bytes overlap."""
    i, (j, b1) = a[0], b
    out = []
    while i < a[1] and j < b1:
        out.append((i, j))
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    return out


class ByteTokens:
    """A: byte-level BPE. Special tokens' strings are plain text to it.

    The file's tokens are merged in the order of their ids, which is that of its merges, so they are given as
    ranks to the faster of two public encoders.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        # Bytes that print stand for themselves, the others in order for the characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        ranks = {}
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes[i] = bytes(letters[c] for c in token)
                ranks[self.bytes[i]] = i
        self.encoding = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.array([len(t) for t in self.bytes])
        self.shown = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


class PieceTokens:
    """B: pieces with byte fallback; puts a space before what it is given."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.processor.id_to_piece(i)) for i in range(n))
        ]
        self.sizes = np.array([len(t) for t in self.bytes])
        self.shown = [str(i) for i in range(n)]

    def encode(self, text: str) -> list[int]:
        """The text begins with a space, which is the one put there, or with a line break."""
        if text[0] == " ":
            return self.processor.encode(text[1:], num_threads=1)
        return self.processor.encode(text, num_threads=1)[1:]


class Units:
    """Tokens, groups and links of units, kept between batches of a worker.

    Beyond `CACHED_UNITS` only the units of the slice at hand are kept, the frequent ones among them.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.slots: dict[int, int] = {}
        self.numbers = np.zeros((0, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, broken
        self.groups: list[bytes] = []
        self.links = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)  # where each unit's links begin

    def keep(self, hashes: list[int]) -> None:
        stay = [h for h in hashes if h in self.slots]
        slots = np.array([self.slots[h] for h in stay], dtype=np.int64)
        self.links = self.links[self._links_at(slots)]
        self.numbers = self.numbers[slots]
        self.groups = [self.groups[s] for s in slots.tolist()]
        self.first = np.concatenate(([0], np.cumsum(self.numbers[:, 3])))
        self.slots = {h: i for i, h in enumerate(stay)}

    def _links_at(self, slots: np.ndarray) -> np.ndarray:
        counts = self.numbers[slots, 3]
        ends = np.cumsum(counts)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[slots] - ends + counts, counts)

    def learn(self, hashes: list[int], units: list[str]) -> None:
        numbers, groups, links = [self.numbers], self.groups, [self.links]
        for part in range(0, len(units), LEARNED_AT_ONCE):
            some = units[part : part + LEARNED_AT_ONCE]
            number, text, pairs = self._aligned(some)
            numbers.append(number)
            groups += text
            links.append(pairs)
        for i, h in enumerate(hashes):
            self.slots[h] = len(self.numbers) + i
        self.numbers, self.links = np.concatenate(numbers), np.concatenate(links)
        self.first = np.concatenate(([0], np.cumsum(self.numbers[:, 3])))

    def _both(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both for a text, none where its bytes do not come back."""
        a, b, own = self.a.encode(text), self.b.encode(text), text.encode()
        if b"".join([self.a.bytes[t] for t in a]) == own == b"".join([self.b.bytes[t] for t in b]):
            return a, b
        return [], []

    def _aligned(self, units: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Numbers, printed groups and linked pairs of units, which are laid end to end."""
        sizes = np.array([len(u.encode()) for u in units])
        # Units that end in no white space may be read as one text.
        plain = all(u[-1] > " " and not u[-1].isspace() for u in units)
        a_ids, b_ids = self._both("".join(units)) if plain else ([], [])
        broken = np.zeros(len(units), dtype=bool)
        if not a_ids:
            both = [self._both(u) for u in units]
            broken = np.array([not a for a, _ in both])
            sizes[broken] = 0
            a_ids, b_ids = ([t for ids in side for t in ids] for side in zip(*both, strict=True))
        a_ends, b_ends = self.a.sizes[a_ids].cumsum(), self.b.sizes[b_ids].cumsum()
        a_upto, b_upto = common_slices(a_ends.tolist(), b_ends.tolist())
        shown_a = [self.a.shown[t] for t in a_ids]
        shown_b = [self.b.shown[t] for t in b_ids]
        slices = list(zip([0, *a_upto[:-1]], a_upto, [0, *b_upto[:-1]], b_upto, strict=True)) if a_upto else []
        printed = [
            (shown_a[a0] if a1 - a0 == 1 else ",".join(shown_a[a0:a1]))
            + "|"
            + (shown_b[b0] if b1 - b0 == 1 else ",".join(shown_b[b0:b1]))
            for a0, a1, b0, b1 in slices
        ]
        # Where one side of a slice is one token it is linked to all of the other.
        bounds = np.array(slices, dtype=np.int64).reshape(-1, 4)
        n_a, n_b = bounds[:, 1] - bounds[:, 0], bounds[:, 3] - bounds[:, 2]
        single = (n_a == 1) | (n_b == 1)
        counts = np.where(single, np.maximum(n_a, n_b), 0)
        of = np.repeat(np.arange(len(slices)), counts)
        step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        a_at = bounds[of, 0] + np.where(n_a[of] > 1, step, 0)
        b_at = bounds[of, 2] + np.where(n_b[of] > 1, step, 0)
        several = [
            (i, x, y)
            for i in np.flatnonzero(~single).tolist()
            for x, y in slice_links(a_ends, b_ends, slices[i][:2], slices[i][2:])
        ]
        more = np.array(several, dtype=np.int64).reshape(-1, 3)
        of, a_at, b_at = (np.concatenate(p) for p in zip((of, a_at, b_at), more.T, strict=True))
        pairs = np.asarray(a_ids, dtype=np.int64)[a_at] * SHIFT + np.asarray(b_ids, dtype=np.int64)[b_at]
        # Units end at common ends.
        ends = np.cumsum(sizes)
        numbers = np.zeros((len(units), 5), dtype=np.int64)
        upto = [np.searchsorted(e, ends, side="right") for e in (a_ends, b_ends)]
        groups = np.searchsorted(bounds[:, 1], upto[0], side="right")
        unit_of = np.searchsorted(groups, of, side="right")
        numbers[:, 0], numbers[:, 1], numbers[:, 2] = (np.diff(u, prepend=0) for u in (*upto, groups))
        numbers[:, 3] = np.bincount(unit_of, minlength=len(units))
        numbers[:, 4] = broken
        edges = [0, *groups.tolist()]
        texts = [";".join(printed[g0:g1]).encode() for g0, g1 in zip(edges, edges[1:], strict=False)]
        return numbers, texts, pairs[np.argsort(unit_of, kind="stable")]

    def slots_of(self, piece: spans.Slice, start: np.ndarray) -> np.ndarray:
        """Slots of the units that begin at `start`, one after the other, each up to the next."""
        end = np.append(start[1:], len(piece.data))
        hashes = spans.span_hash(spans.prefix(piece.data), start, end)
        distinct, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.slots) + len(distinct) > CACHED_UNITS:
            self.keep(keys)
        new = [i for i, h in enumerate(keys) if h not in self.slots]
        if new:
            raw = memoryview(piece.data)
            units = [bytes(raw[start[j] : end[j]]).decode() for j in at[new].tolist()]
            self.learn([keys[i] for i in new], units)
        return np.array([self.slots[h] for h in keys], dtype=np.int64)[of]


def spaced(piece: spans.Slice) -> spans.Slice:
    """The slice with a space before each text, and without the breaks behind them."""
    data = np.roll(piece.data, 1)  # the break behind a text comes before the next
    data[piece.starts[:-1]] = 0x20
    return spans.Slice(piece.first, piece.last, data, piece.starts)


def borders(piece: spans.Slice) -> np.ndarray:
    """Where the units of a spaced slice begin."""
    data = piece.data
    begins = np.zeros(len(data), dtype=bool)
    if len(data) > 4:
        one, two, three = data[3:-1], data[2:-2], data[1:-3]  # bytes before data[4:]
        wide = (two == 0xC2) | (three == 0xE1) | (three == 0xE2) | (three == 0xE3)
        before = PRINTED[one] | ((one >= 0x80) & ~wide)
        after = np.append(BEGINS[data[5:]], False)
        begins[4:] = ((data[4:] == 0x20) | (data[4:] == 0x0A)) & before & after
    begins[piece.starts[:-1]] = True
    return np.flatnonzero(begins)


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs, by their steps and in planes of bytes, and how often each occurs."""
    steps = np.diff(pairs, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return zstandard.compress(steps.T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    n = len(planes) // 9
    steps, times = np.zeros((n, 8), np.uint8), np.zeros((n, 4), np.uint8)
    steps[:, :5] = planes[: 5 * n].reshape(5, n).T
    times[:] = planes[5 * n :].reshape(4, n).T
    return np.cumsum(steps.view("<u8").reshape(n).astype(np.int64)), times.view("<u4").reshape(n)


_units: dict[tuple[str, str], Units] = {}

PER_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
WRITTEN = f"chunk long, {PER_DOCUMENT}, pairs binary, held array<struct<pair: long, n: long>>"


def _tokenizer_paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path = a_path or str(public_tokenizers.path("byte_bpe_50k.json"))
        b_path = b_path or str(public_tokenizers.path("piece_bpe_32k.model"))
    return a_path, b_path


def _documents(units: Units, piece: spans.Slice) -> Iterator[tuple]:
    """Row, numbers, groups as text, and the sorted distinct pairs with their counts."""
    some = spaced(piece)
    start = borders(some)
    slots = units.slots_of(some, start)
    edges = np.searchsorted(start, some.starts).tolist()
    empty = np.diff(piece.starts) == 1
    for row in range(piece.last - piece.first):
        own = slots[edges[row] : edges[row + 1]]
        numbers = units.numbers[own]
        if empty[row] or numbers[:, 4].any():
            yield row, None, b"", None, None
            continue
        groups = b";".join([units.groups[s] for s in own.tolist()])
        pairs, times = np.unique(units.links[units._links_at(own)], return_counts=True)
        yield row, numbers[:, :4].sum(axis=0).tolist(), groups, pairs, times


def _aligned_chunks(docs: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """A row per document, and a row per chunk that lists its distinct pairs and their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _tokenizer_paths(a_path, b_path)
        if paths not in _units:
            _units[paths] = Units(*paths)
        units = _units[paths]
        schema = pa.schema(
            [
                ("chunk", pa.int64()),
                *[(c.split()[0], pa.string() if "sha" in c else pa.int64()) for c in PER_DOCUMENT.split(", ")],
                ("pairs", pa.binary()),
                ("held", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))),
            ]
        )
        chunk, size = TaskContext.get().partitionId() << 32, 0
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, of = np.unique(np.concatenate([p for p, _ in seen]), return_inverse=True)
            return pairs, np.bincount(of, np.concatenate([n for _, n in seen])).astype(np.int64)

        def chunk_row() -> pa.RecordBatch:
            pairs, n = summed()
            held = pa.StructArray.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])
            held = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), held)
            columns = [pa.array([chunk]), *[pa.nulls(1, f.type) for f in list(schema)[1:-1]], held]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                out = {f.name: [] for f in schema}
                mine = []
                for row, numbers, groups, pairs, times in _documents(units, piece):
                    out["chunk"].append(chunk)
                    out["doc_id"].append(batch.column(0)[piece.first + row].as_py())
                    for name, n in zip(("n_a", "n_b", "n_groups", "n_links"), numbers or [0] * 4, strict=True):
                        out[name].append(n)
                    out["groups_sha256"].append(hashlib.sha256(groups).hexdigest() if numbers else "")
                    out["pairs"].append(_packed(pairs, times) if numbers else None)
                    out["held"].append(None)
                    if numbers:
                        mine.append(pairs)
                yield pa.RecordBatch.from_pydict(out, schema=schema)
                if mine:
                    seen.append(np.unique(np.concatenate(mine), return_counts=True))
                if len(seen) > 8:
                    seen = [summed()]
                size += len(piece.data)
                if size >= CHUNK_BYTES:
                    if seen:
                        yield chunk_row()
                    chunk, size, seen = chunk + 1, 0, []
        if seen:
            yield chunk_row()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, WRITTEN)


def _counted(chunks: DataFrame) -> DataFrame:
    """Chunk (as `part`), pair, its documents in the whole corpus, and whether no pair of its A id has more."""
    held = chunks.filter("held IS NOT NULL").select(F.col("chunk").alias("part"), F.inline("held"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", 20))
    counts = settle(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return held.drop("n").join(counts, "pair")


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b and n: in how many documents tokens of these ids are linked."""
    chunks = _aligned_chunks(docs, a_path, b_path).filter("held IS NOT NULL").select(F.inline("held"))
    counts = chunks.groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND(SHIFT - 1)
    return counts.select(F.shiftright("pair", 20).alias("a"), b.alias("b"), "n")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    chunks = settle(_aligned_chunks(docs, a_path, b_path), "aligned")
    rows = chunks.filter("held IS NULL").drop("held")

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(right["pair"]))
        known, n = np.asarray(right["pair"])[order], np.asarray(right["n"])[order]
        best = np.asarray(right["best"]).astype(np.int64)[order]
        n_best, count_sum = [], []
        for raw in left["pairs"]:
            if not raw.is_valid:
                n_best.append(0)
                count_sum.append(0)
                continue
            pairs, times = _unpacked(raw.as_py())
            at = np.searchsorted(known, pairs)
            n_best.append(int((best[at] * times).sum()))
            count_sum.append(int((n[at] * times).sum()))
        columns = [c.split()[0] for c in PER_DOCUMENT.split(", ")]
        out = left.select(columns).append_column("n_best", pa.array(n_best, pa.int64()))
        return out.append_column("count_sum", pa.array(count_sum, pa.int64()))

    counted = _counted(chunks).groupBy("part")
    schema = f"{PER_DOCUMENT}, n_best long, count_sum long"
    return rows.groupBy("chunk").cogroup(counted).applyInArrow(scored, schema)


def printed_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and groups, as `a1,a2|b1;a3|b2,b3`: the ids of A and B between common ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _tokenizer_paths(a_path, b_path)
        units = _units.setdefault(paths, None) or Units(*paths)
        _units[paths] = units
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                groups = [g.decode() for _, _, g, _, _ in _documents(units, piece)]
                ids = batch.column(0).slice(piece.first, piece.last - piece.first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(groups, pa.string())], names=["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, groups string")
