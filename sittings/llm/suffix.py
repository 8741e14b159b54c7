"""Repeated byte strings anywhere in a corpus, by a depth-limited radix sort of suffixes.

Suffixes need ordering only through the threshold (400 bytes): two windows are equal exactly
when their suffixes are still in one group at that depth. The sort goes by passes from the
most significant digit, digits being blocks of bytes taken by their hash, and a group that is
down to one suffix leaves the sort:

1. Suffixes are taken at synchronised places only: of the 201 strings of 200 bytes in a window
   the one of least hash. Equal windows hold the same place, so a window whose leading digit of
   200 bytes there is unique is unique. About one suffix in a hundred enters.
2. Within a group, suffixes equal in everything a window around them can reach (200 bytes
   before, 400 after) are one class. Members of a class of two or more are repeats as
   a whole; this takes the inside of copies, however many, out of the sort. One of each class
   goes on, if its group has other classes.
3. The remaining suffixes start at every window of those places. Their next digit is
   351 bytes shared by 50 neighbouring windows.
4. Groups that are still together are ordered through all 400 bytes, each window for itself.

Every pass is a grouped count and a join back; no group is gathered in one task.

Results for odd rows: a NULL or empty text has no bytes, one shorter than the threshold loses
nothing; a row without doc_id takes part like any other; a repeated row is another document, so
its strings occur elsewhere; an empty table gives an empty table. Columns beyond doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.llm import spans
from sittings.llm.substring import keyed
from sittings.llm.tables import marked_only, with_marks
from sittings.runtime import discard, settle

THRESHOLD_BYTES = 400
BLOCK = 50

# Passages of some fifty words, which the threshold lets pass where words are short.
PASSAGE_BYTES = 256


class _Suffixes:
    """Suffixes of a slice by their leading digit."""

    def __init__(self, piece: spans.Slice, depth: int) -> None:
        self.lead = depth // 2
        self.width = depth - self.lead + 1
        self.starts, self.ends = piece.starts, piece.starts[1:] - 1
        self.sums = spans.prefix(piece.data)
        n = max(0, len(piece.data) - self.lead + 1)
        at = np.arange(n)
        self.digits = spans.span_hash(self.sums, at, at + self.lead)
        inside = np.zeros(len(piece.data) + 1, dtype=np.int8)
        windows = np.maximum(self.ends - depth + 1, self.starts[:-1])
        np.add.at(inside, self.starts[:-1], 1)
        np.add.at(inside, windows, -1)
        self.whole = np.cumsum(inside[:-1], dtype=np.int8) > 0


def _suffix_rows(docs: DataFrame, depth: int) -> DataFrame:
    """key, place, leading digit and surroundings of the suffixes of the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                s = _Suffixes(piece, depth)
                at = spans.anchors(s.digits, s.width, s.whole)
                row = piece.row_of(at)
                left = np.maximum(at - (s.width - 1), s.starts[row])
                right = np.minimum(at + depth, s.ends[row])
                around = spans.span_hash(s.sums, left, right)
                edge = ((at - left) * 65536 + (right - at)).astype(np.uint64)
                around = spans.mix(around ^ spans.mix(edge + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + piece.first)),
                        pa.array((at - s.starts[row]).astype(np.int32)),
                        spans.signed(s.digits[at]),
                        spans.signed(around),
                    ],
                    names=["key", "place", "digit", "around"],
                )

    return docs.mapInArrow(run, "key long, place int, digit long, around long")


def _served(s: _Suffixes, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window that each suffix serves, i.e. whose first least digit it is."""
    reach = s.width - 1
    row = np.searchsorted(s.starts, at, side="right") - 1
    first = np.maximum(at - reach, s.starts[row])
    last = np.minimum(at, s.ends[row] - depth)
    for part in range(0, len(at), 4096):
        p = at[part : part + 4096]
        steps = np.arange(1, reach + 1)
        before = np.maximum(p[:, None] - steps, 0)
        after = np.minimum(p[:, None] + steps, len(s.digits) - 1)
        own = s.digits[p][:, None]
        less = (s.digits[before] <= own) & (before < p[:, None])
        near = np.where(less.any(axis=1), less.argmax(axis=1), reach)
        first[part : part + 4096] = np.maximum(first[part : part + 4096], p - near)
        less = s.digits[after] < own
        near = np.where(less.any(axis=1), less.argmax(axis=1), reach)
        last[part : part + 4096] = np.minimum(last[part : part + 4096], p + near - reach)
    return first, last


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges [first, last], and the range it is of."""
    sizes = np.maximum(last - first + 1, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return first[of] + within, of


def _block_rows(marked: DataFrame, depth: int, block: int) -> DataFrame:
    """key, place, block and the digit shared by the block, for the windows marked suffixes serve.

    Windows of block g start between g * block and g * block + block - 1 bytes before the
    suffix; the bytes taken lie in each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                s = _Suffixes(piece, depth)
                marks = batch.column(2).slice(piece.first, piece.last - piece.first)
                at = spans.places(marks, s.starts)
                first, last = _served(s, at, depth)
                some = first <= last
                at, first, last = at[some], first[some], last[some]
                number, of = _ranges((at - last) // block, (at - first) // block)
                at = at[of]
                longest = np.minimum(number * block + block - 1, s.width - 1)
                digit = spans.span_hash(s.sums, at - number * block, at - longest + depth)
                row = piece.row_of(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + piece.first)),
                        pa.array((at - s.starts[row]).astype(np.int32)),
                        pa.array(number.astype(np.int32)),
                        spans.signed(digit),
                    ],
                    names=["key", "place", "block", "digit"],
                )

    return marked.mapInArrow(run, "key long, place int, block int, digit long")


def _window_rows(marked: DataFrame, depth: int, block: int) -> DataFrame:
    """key, place and whole hash of the windows in marked blocks (place * 1024 + block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                s = _Suffixes(piece, depth)
                lists = batch.column(2).slice(piece.first, piece.last - piece.first)
                coded = spans.places(lists, s.starts[:-1] * 1024)
                at, number = coded // 1024, coded % 1024
                first, last = _served(s, at, depth)
                first = np.maximum(first, at - number * block - (block - 1))
                last = np.minimum(last, at - number * block)
                at, _ = _ranges(first, last)
                row = piece.row_of(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + piece.first)),
                        pa.array((at - s.starts[row]).astype(np.int32)),
                        spans.signed(spans.span_hash(s.sums, at, at + depth)),
                    ],
                    names=["key", "place", "hash"],
                )

    return marked.mapInArrow(run, "key long, place int, hash long")


def _covered(piece: spans.Slice, around: pa.Array, windows: pa.Array, depth: int) -> np.ndarray:
    """Which bytes of a slice lie in repeats: the surroundings of places `around`, and single `windows`."""
    reach = depth - depth // 2
    first, last = [], []
    for lists, before, after in ((around, reach, depth), (windows, 0, depth)):
        at = spans.places(lists, piece.starts)
        row = piece.row_of(at)
        first.append(np.maximum(at - before, piece.starts[row]))
        last.append(np.minimum(at + after, piece.starts[row + 1] - 1))
    gone = spans.covered(len(piece.data), np.concatenate(first), np.concatenate(last))
    gone[piece.starts[1:] - 1] = False  # the break behind each text parts the runs of neighbours
    return gone


def _cut(marked: DataFrame, depth: int, shorter: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                rows = piece.last - piece.first
                marks = [batch.column(i).slice(piece.first, rows) for i in range(2, 6)]
                ends = piece.starts[1:] - 1
                gone = _covered(piece, marks[0], marks[1], depth)
                again = _covered(piece, marks[2], marks[3], shorter)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                cuts = np.searchsorted(edges, piece.starts)
                total, repeated = (np.concatenate(([0], np.cumsum(x))) for x in (gone, again))
                kept, repeats = [], []
                for i in range(rows):
                    a, b = piece.starts[i], ends[i]
                    kept.append(piece.data[a:b][~gone[a:b]].tobytes())
                    repeats.append(edges[cuts[i] : cuts[i + 1]] - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, rows),
                        pa.array(ends - piece.starts[:-1]),
                        pa.array(total[ends] - total[piece.starts[:-1]]),
                        pa.array(repeated[ends] - repeated[piece.starts[:-1]]),
                        spans.listed(repeats, pa.int32()),
                        pa.array(kept, type=pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_repeated", "repeats", "kept"],
                )

    schema = "doc_id long, n_bytes long, n_removed long, n_repeated long, repeats array<int>, kept binary"
    return marked.mapInArrow(run, schema)


def repeats(texts: DataFrame, depth: int, block: int = BLOCK) -> DataFrame:
    """Of `texts` (key, text): key, places whose surroundings are repeats (`around`) and single `windows`."""
    suffixes = settle(_suffix_rows(texts, depth), "all-suffixes")
    groups = suffixes.groupBy("digit").agg(F.count("*").alias("n")).filter("n > 1").select("digit")
    groups = settle(groups, "digits")
    sorted_ = settle(suffixes.join(groups, "digit"), "suffixes")
    discard(suffixes, groups)

    one = F.min(F.struct("key", "place"))
    classes = sorted_.groupBy("digit", "around").agg(F.count("*").alias("n"), one.alias("one"))
    classes = settle(classes, "classes")
    copies = sorted_.join(classes.filter("n > 1").select("digit", "around"), ["digit", "around"])
    copies = settle(copies.groupBy("key").agg(F.collect_set("place").alias("around")), "copies")
    discard(sorted_)

    # Counts are written before they are joined, so that joins can be split where a group is hot.
    several = classes.groupBy("digit").agg(F.count("*").alias("c")).filter("c > 1").select("digit")
    several = settle(several, "several")
    first = classes.join(several, "digit").select("one.key", "one.place").groupBy("key")
    first = settle(first.agg(F.collect_set("place").alias("marks")), "first")
    blocks = settle(_block_rows(marked_only(texts, first), depth, block), "blocks")
    together = blocks.groupBy("block", "digit").agg(F.count("*").alias("n")).filter("n > 1")
    together = settle(together, "together")
    coded = (F.col("place").cast("long") * 1024 + F.col("block")).alias("coded")
    second = blocks.join(together.drop("n"), ["block", "digit"]).select("key", coded)
    second = settle(second.groupBy("key").agg(F.collect_set("coded").alias("marks")), "second")
    windows = settle(_window_rows(marked_only(texts, second), depth, block), "windows")
    discard(classes, several, first, blocks, together, second)
    equal = windows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    equal = settle(equal, "equal")
    single = windows.join(equal, "hash").groupBy("key")
    single = single.agg(F.collect_set("place").alias("windows"))
    marks = settle(copies.join(single, "key", "full"), "marks")
    discard(copies, windows, equal)
    return marks


def remove_repeated_bytes(
    docs: DataFrame, depth: int = THRESHOLD_BYTES, block: int = BLOCK, shorter: int | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_repeated, repeats (start, end, start, end, ... in bytes) and kept bytes.

    Strings of `depth` bytes are removed. With `shorter`, n_repeated counts the bytes covered by
    strings of so many bytes that occur again, which stay; without, it is n_removed.
    """
    docs = keyed(docs)
    texts = docs.select("key", "text")
    marks = repeats(texts, depth, block)
    again = F.col("around").alias("around2"), F.col("windows").alias("windows2")
    if shorter is None:
        both = marks.select("*", *again)
        both = settle(both, "both")
    else:
        other = repeats(texts, shorter, block)
        both = settle(marks.join(other.select("key", *again), "key", "full"), "both")
        discard(other)
    discard(marks)
    marked = with_marks(docs, both).select("doc_id", "text", "around", "windows", "around2", "windows2")
    return _cut(marked, depth, shorter or depth)
