"""Packing tokenized documents into sequences of a fixed length by bin completion.

Only documents longer than a sequence are cut. What matters for packing is how many pieces
there are of each length, and there are at most `capacity` lengths, so the search works on
that histogram (its size is bounded by the capacity, not by the corpus). It is bin completion by branch and
bound:

- incumbents are two best-fit packings: pieces from the longest to the shortest, each in the
  fullest sequence with room, and sequence after sequence, each around the longest piece left with the
  filling that wastes least. The better one is returned if it meets the lower bound, as it does
  wherever short pieces abound;
- else sequences are filled one after the other, each around the longest piece left, by every
  undominated filling, those of least waste first. A filling is dominated if a piece left out could take the
  place of shorter ones in it. A branch ends where the waste so far is more than a packing with one
  sequence less than the incumbent's could have; the bit set of sums that can be reached tells which
  fillings are within it, so none other is entered. A filling is used as often as the counts allow
  first, and once on the way back, so that all packings are covered.

The search ends at the lower bound, when all branches are done, or after `nodes` fillings: packing is hard, and then the
best packing found is returned (`fillings` says which it was). The fillings say which ranks of each length go
where; pieces are ranked within their length by salted counts, with more salts the more pieces there are, and
look their place up in that table, so no group of pieces is gathered anywhere.

Results for odd rows: a NULL or empty text is one piece holding only the closing id;
repeated rows are packed once each; an empty table gives an empty table. A very long text is encoded
whole by the task that reads it, like any other, and cut into pieces there. Columns beyond
doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sittings.llm import spans
from sittings.runtime import settle

CAPACITY = 2048
CLOSING_ID = 0
SALTED_PIECES = 512  # pieces of one length that share a salt, about
NODES = 5000
CACHED_WORDS = 400_000
SLICE_BYTES = 2 << 20


# The tokenizer parts letters from signs before it merges, but for apostrophes (contractions) and
# the signs of special tokens, which it knows in lower case only.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN = np.zeros(256, dtype=bool)
SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of a slice, cut where ASCII letters and signs meet."""
    start, end = spans.words(data)
    letter, sign = LETTER[data], SIGN[data]
    cut = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
    begins, ends = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
    begins[start] = begins[cut] = ends[end] = ends[cut] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, as the tokenizer has them, but not before a byte that might combine with them."""
    if b"<|" in data.tobytes():
        return data
    out = spans.LOWER[data]
    wide = np.flatnonzero(data >= 0x80)
    out[wide - 1] = data[wide - 1]
    return out


class WordIds:
    """Ids of words, kept between batches of a worker.

    Beyond `CACHED_WORDS` only the words of the text at hand are kept, the frequent ones among them.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids one after the other.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slots: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.offsets = np.zeros(1 << 18, dtype=np.int64)

    def _keep(self, hashes: list[int]) -> None:
        slots = np.array([self.slots[h] for h in hashes if h in self.slots], dtype=np.int64)
        first = self.offsets[slots]
        counts = self.offsets[slots + 1] - first
        ends = np.cumsum(counts)
        within = np.arange(counts.sum()) - np.repeat(ends - counts, counts)
        self.ids[: len(within)] = self.ids[within + np.repeat(first, counts)]
        self.offsets[1 : len(slots) + 1] = ends
        self.slots = {h: i for i, h in enumerate(h for h in hashes if h in self.slots)}

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        for part in range(0, len(words), 256):
            some = words[part : part + 256]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            at = np.array([a for a, _ in encoded.offsets], dtype=np.int64)
            counts = np.bincount(
                np.searchsorted(starts, at, side="right") - 1, minlength=len(some)
            )
            n = len(self.slots)
            while len(self.offsets) <= n + len(some):
                self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
            used = int(self.offsets[n])
            while len(self.ids) < used + len(at):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.ids[used : used + len(at)] = encoded.ids
            self.offsets[n + 1 : n + 1 + len(some)] = used + np.cumsum(counts)
            for i, h in enumerate(hashes[part : part + 256]):
                self.slots[h] = n + i

    def texts(self, piece: spans.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, each text's followed by the closing id, and where texts begin."""
        data = lowered(piece.data)
        start, end = units(data)
        hashes = spans.span_hash(spans.prefix(data), start, end)
        distinct, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.slots) + len(distinct) > CACHED_WORDS:
            self._keep(keys)
        known = self.slots
        new = [i for i, h in enumerate(keys) if h not in known]
        if new:
            raw = memoryview(data)
            words = [bytes(raw[start[j] : end[j]]).decode() for j in at[new].tolist()]
            self._learn([keys[i] for i in new], words)
        slots = np.array([known[h] for h in keys], dtype=np.int64)[of]
        first = self.offsets[slots]
        counts = self.offsets[slots + 1] - first
        before = np.cumsum(counts) - counts
        bounds = np.searchsorted(start, piece.starts)
        total = np.concatenate((before, [counts.sum()]))[bounds]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        out = np.full(total[-1] + len(bounds) - 1, CLOSING_ID, dtype=np.uint32)
        within = np.arange(total[-1]) - np.repeat(before, counts)
        target = within + np.repeat(before + row, counts)
        out[target] = self.ids[within + np.repeat(first, counts)]
        return out, total + np.arange(len(bounds))


_tokenizers: dict[str, WordIds] = {}


def cut_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and its ids if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("word_bpe_49k.json"))
        if path not in _tokenizers:
            _tokenizers[path] = WordIds(path)
        ids_of = _tokenizers[path]
        for batch in batches:
            # Ids that go out are held beside the slice they are of.
            for piece in spans.slices(batch.column(1), SLICE_BYTES // 4 if with_ids else SLICE_BYTES):
                ids, bounds = ids_of.texts(piece)
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = number * capacity
                length = np.minimum(capacity, sizes[row] - first)
                at = bounds[row] + first
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [
                    zlib.crc32(raw[4 * a : 4 * (a + n)])
                    for a, n in zip(at.tolist(), length.tolist(), strict=True)
                ]
                columns = [
                    batch.column(0).take(pa.array(row + piece.first)),
                    pa.array(number.astype(np.int32)),
                    pa.array(first),
                    pa.array(length),
                    pa.array(crc, type=pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.append(at, bounds[-1]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            spans.trim()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def reachable(sizes: list[int], counts: dict[int, int], space: int) -> list[int]:
    """The sums up to `space` that sizes from each place on can reach, as the bits of a number."""
    within = (1 << (space + 1)) - 1
    reach = [1] * (len(sizes) + 1)
    for at in range(len(sizes) - 1, -1, -1):
        sums, copies, step = reach[at + 1], min(counts[sizes[at]], space // sizes[at]), 1
        while copies:  # 1, 2, 4, ... copies, together any number up to all
            step = min(step, copies)
            sums |= (sums << (sizes[at] * step)) & within
            copies -= step
            step *= 2
        reach[at] = sums
    return reach


def complete(sizes: list[int], counts: dict[int, int], space: int) -> list[int]:
    """Sizes (longest first) that fill `space` with least waste, out of what `counts` has.

    Of the branches that lead to the least waste the one with most of the longest is taken.
    """
    reach = reachable(sizes, counts, space)
    left = reach[0].bit_length() - 1
    chosen: list[int] = []
    for at, s in enumerate(sizes):
        n = min(counts[s], left // s)
        while not reach[at + 1] >> (left - n * s) & 1:
            n -= 1
        chosen += [s] * n
        left -= n * s
    return chosen


Filling = list[int]
Packing = list[tuple[Filling, int]]  # fillings and how many sequences take each


def used(packing: Packing) -> int:
    return sum(times for _, times in packing)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by the pieces that go together with none."""
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for a in [0, *(s for s in counts if 2 * s <= capacity)]:
        alone = sum(n for s, n in counts.items() if s > capacity - a)
        over_half = {s: n for s, n in counts.items() if capacity < 2 * s and s <= capacity - a}
        rest = sum(s * n for s, n in counts.items() if a <= s and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in over_half.items())
        least = max(least, alone + sum(over_half.values()) + max(0, -(-(rest - room) // capacity)))
    return least


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Pieces from the longest on, each in the fullest sequence with room; equal sequences as one."""
    open_: dict[int, Packing] = {}  # sequences by the room left
    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in sorted(r for r in open_ if r >= s):
            groups, each = open_.pop(room), room // s
            while groups and left:
                filling, times = groups.pop()
                full = min(times, left // each)
                some = left - each * full if full < times else 0
                for n, copies in ((full, each), (1 if some else 0, some)):
                    if n:
                        open_.setdefault(room - copies * s, []).append(([*filling, *[s] * copies], n))
                left -= each * full + some
                if rest := times - full - (1 if some else 0):
                    groups.append((filling, rest))
            if groups:
                open_.setdefault(room, []).extend(groups)
            if not left:
                break
        each = capacity // s
        for n, copies in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                open_.setdefault(capacity - copies * s, []).append(([s] * copies, n))
    return [group for groups in open_.values() for group in groups]


def _take(counts: dict[int, int], filling: Filling, times: int) -> dict[int, int]:
    left = dict(counts)
    for s in filling:
        left[s] -= times
    return {s: n for s, n in left.items() if n}


def _most(counts: dict[int, int], filling: Filling) -> int:
    return min(counts[s] // filling.count(s) for s in set(filling))


def completed(counts: dict[int, int], capacity: int) -> Packing:
    """Around the longest piece left, the filling that wastes least, as often as the counts allow."""
    out: Packing = []
    while counts:
        longest = max(counts)
        rest = _take(counts, [longest], 1)
        filling = [longest, *complete(sorted(rest, reverse=True), rest, capacity - longest)]
        times = _most(counts, filling)
        out.append((filling, times))
        counts = _take(counts, filling, times)
    return out


def dominated(filling: Filling, counts: dict[int, int], waste: int) -> bool:
    """Whether a piece left out (`counts` are those left) fits in place of shorter ones of the filling."""
    shorter, included = 1, sorted(filling)
    for x in sorted(counts):
        while included and included[0] < x:
            shorter |= shorter << included.pop(0)
        low = max(0, x - waste)
        if shorter >> low & ((1 << (x - low + 1)) - 1):
            return True
    return False


def undominated(counts: dict[int, int], capacity: int, allowed: int) -> Iterator[tuple[Filling, int]]:
    """Fillings around the longest piece that waste at most `allowed`, and their waste, least first."""
    longest = max(counts)
    rest = _take(counts, [longest], 1)
    sizes, space = sorted(rest, reverse=True), capacity - longest
    reach = reachable(sizes, rest, space)
    for waste in range(min(allowed, space) + 1):
        if not reach[0] >> (space - waste) & 1:
            continue
        stack: list[tuple[int, int, Filling]] = [(0, space - waste, [])]
        while stack:
            at, left, chosen = stack.pop()
            if not left:
                filling = [longest, *chosen]
                if not dominated(chosen, _take(rest, chosen, 1), waste):
                    yield filling, waste
                continue
            s = sizes[at]
            for n in range(min(rest[s], left // s) + 1):  # the most copies are looked at first
                if reach[at + 1] >> (left - n * s) & 1:
                    stack.append((at + 1, left - n * s, chosen + [s] * n))


def search(counts: dict[int, int], capacity: int, incumbent: Packing, bound: int, nodes: int) -> tuple[Packing, bool]:
    """The best packing found, and whether no better one exists."""
    best, total = incumbent, sum(s * n for s, n in counts.items())

    def spare() -> int:
        """Waste of a packing with one sequence less than the best."""
        return (used(best) - 1) * capacity - total

    def options(left: dict[int, int], waste: int) -> Iterator[tuple[Filling, int, int]]:
        allowed = spare() - waste
        if allowed >= 0:
            for filling, wasted in undominated(left, capacity, allowed):
                most = _most(left, filling)
                for times in (most, 1) if most > 1 else (1,):
                    yield filling, times, wasted

    path: Packing = []
    stack = [(counts, 0, options(counts, 0))]
    while stack and nodes:
        left, waste, branches = stack[-1]
        branch = next(branches, None)
        if branch is None:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes -= 1
        filling, times, wasted = branch
        if waste + times * wasted > spare():
            continue
        rest = _take(left, filling, times)
        path.append((filling, times))
        if rest:
            stack.append((rest, waste + times * wasted, options(rest, waste + times * wasted)))
            continue
        if used(path) < used(best):
            best = list(path)
            if used(best) == bound:
                return best, True
        path.pop()
    return best, not stack


def packings(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[Packing, bool]:
    """Fillings of all pieces, and whether their number of sequences is known to be the least."""
    counts = {s: n for s, n in histogram.items() if n}
    if not counts:
        return [], True
    bound = lower_bound(counts, capacity)
    best = min(best_fit(counts, capacity), completed(counts, capacity), key=used)
    if used(best) == bound:
        return best, True
    return search(counts, capacity, best, bound, nodes)


def fillings(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> Packing:
    """Fillings (lengths of one sequence) and how many sequences take each."""
    return packings(histogram, capacity, nodes)[0]


def places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, uses in a sequence, offset) of each filling."""
    ranks = dict.fromkeys(histogram, 0)
    out, sequence = [], 0
    for chosen, times in fillings(histogram, capacity):
        offset = 0
        for s in sorted(set(chosen), reverse=True):
            uses = chosen.count(s)
            out.append((s, ranks[s], ranks[s] + uses * times, sequence, uses, offset))
            ranks[s] += uses * times
            offset += uses * s
        sequence += times
    return out


def _local(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Whole numbers as a table, by Arrow: lists of Python would start workers of a second kind, which live on."""
    values = np.array(rows, dtype=np.int64).reshape(-1, len(names))
    return spark.createDataFrame(pa.table(dict(zip(names, values.T.copy(), strict=True))))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. Reads `pieces` several times: settle it first."""
    spark = pieces.sparkSession
    # At most `capacity` rows.
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    table = places({r["length"]: r["n"] for r in lengths}, capacity)
    salts = [(r["length"], -(-r["n"] // SALTED_PIECES)) for r in lengths]
    salts = F.broadcast(_local(spark, salts, ["length", "salts"]))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    salted = pieces.join(salts, "length").withColumn("salt", salt)
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = Window.partitionBy("length").orderBy("salt")
    before = F.sum("n").over(by_length) - F.col("n")
    ahead = counted.select("length", "salt", before.alias("ahead"))
    table = F.broadcast(_local(spark, table, ["of", "lo", "hi", "first", "uses", "at"]))
    in_salt = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("number", F.row_number().over(in_salt) - 1)
        .join(ahead, ["length", "salt"])
        .withColumn("rank", F.col("ahead") + F.col("number"))
    )
    rank = F.col("rank") - F.col("lo")
    inside = (
        (F.col("length") == F.col("of"))
        & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("hi"))
    )
    return ranked.join(table, inside).select(
        *pieces.columns,
        (F.col("first") + F.floor(rank / F.col("uses"))).alias("sequence_id"),
        (F.col("at") + F.pmod(rank, F.col("uses")) * F.col("length")).alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    return pack(settle(cut_pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of every sequence, from pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"))
