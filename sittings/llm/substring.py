"""Repeated passages of words across documents, by seed and extend.

A window of 13 words holds 9 seeds of 5 words; the least of them by hash is the window's
anchor (winnowing), so equal windows have equal anchors at equal places and only about one
place in five has to be compared. Documents are joined on anchors whose seed occurs in more
than one document. An anchor's match is then extended both ways, in two steps that need no
pairs: occurrences with the same words all around (every window the anchor can serve) form one
class with its least document, which settles copies however many there are; the occurrences in that least
document go on, with their windows, to be compared with the windows of the other
classes. What remains is merged to maximal repeats, each at least the threshold long.

A word goes if a window over it also starts in a document with a smaller doc_id, so
the first document keeps its passage.

Results for odd rows: NULL, empty or short texts lose nothing (NULL has no words); rows
without doc_id keep everything and make no other row lose words; rows of equal doc_id never cut
each other, repeated rows give equal rows; an empty table gives an empty table. Columns beyond
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.llm import spans
from sittings.llm.tables import marked_only, with_marks
from sittings.runtime import discard, settle

WINDOW_WORDS = 13
SEED_WORDS = 5


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both, by which rows are joined back."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


class _Words:
    """Words, seeds and windows of a slice."""

    def __init__(self, piece: spans.Slice, window: int, seed: int) -> None:
        self.start, self.end = spans.words(piece.data)
        self.row = piece.row_of(self.start)
        self.bounds = np.searchsorted(self.start, piece.starts)
        hashes = spans.span_hash(spans.prefix(piece.data), self.start, self.end)
        self.sums = spans.prefix_of(hashes)
        self.seeds = spans.grams(hashes, seed)
        n = max(0, len(hashes) - window + 1)
        self.whole = self.row[:n] == self.row[window - 1 :][:n]


def anchor_rows(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """key, doc_id, place, seed and surroundings of every anchor."""
    width = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(2)):
                w = _Words(piece, window, seed)
                at = spans.anchors(w.seeds, width, w.whole)
                row = w.row[at]
                left = np.maximum(at - (width - 1), w.bounds[row])
                right = np.minimum(at + window, w.bounds[row + 1])
                around = spans.span_hash(w.sums, left, right)
                edge = ((at - left) * 4096 + (right - at)).astype(np.uint64)
                around = spans.mix(around ^ spans.mix(edge + np.uint64(1)))
                take = pa.array(row + piece.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array((at - w.bounds[row]).astype(np.int32)),
                        spans.signed(w.seeds[at]),
                        spans.signed(around),
                    ],
                    names=["key", "doc_id", "place", "seed", "around"],
                )

    return docs.mapInArrow(run, "key long, doc_id long, place int, seed long, around long")


def window_rows(marked: DataFrame, window: int, seed: int) -> DataFrame:
    """key, doc_id, place and hash of the windows whose anchor is in `marks`."""
    width = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(2)):
                w = _Words(piece, window, seed)
                marks = batch.column(3).slice(piece.first, piece.last - piece.first)
                wanted = np.zeros(len(w.start) + 1, dtype=bool)
                wanted[spans.places(marks, w.bounds)] = True
                n = len(w.whole)
                anchor = spans.anchor_of_window(w.seeds, width)[:n]
                at = np.flatnonzero(w.whole & wanted[anchor])
                row = w.row[at]
                take = pa.array(row + piece.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        pa.array((at - w.bounds[row]).astype(np.int32)),
                        spans.signed(spans.span_hash(w.sums, at, at + window)),
                    ],
                    names=["key", "doc_id", "place", "hash"],
                )

    return marked.mapInArrow(run, "key long, doc_id long, place int, hash long")


def cut(marked: DataFrame, window: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_removed, the maximal repeats (in words) and the text without them.

    `around` lists anchors whose whole surroundings go, `windows` single windows.
    """
    reach = window - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                start, end = spans.words(piece.data)
                bounds = np.searchsorted(start, piece.starts)
                rows = piece.last - piece.first
                a = batch.column(2).slice(piece.first, rows)
                b = batch.column(3).slice(piece.first, rows)
                raw = memoryview(piece.data)
                n_removed, repeats, texts = [], [], []
                for i in range(rows):
                    n = int(bounds[i + 1] - bounds[i])
                    around = np.asarray(a[i].values, dtype=np.int64) if a[i].is_valid else []
                    single = np.asarray(b[i].values, dtype=np.int64) if b[i].is_valid else []
                    first = np.concatenate((around, single)).astype(np.int64)
                    gone = np.zeros(n, dtype=bool)
                    if len(first):
                        first[: len(around)] -= reach
                        last = np.minimum(first + window, n)
                        last[: len(around)] = np.minimum(first[: len(around)] + window + reach, n)
                        gone = spans.covered(n, np.maximum(first, 0), last)
                    runs = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                    repeats.append(runs)
                    n_removed.append(int(gone.sum()))
                    kept = (np.flatnonzero(~gone) + bounds[i]).tolist()
                    texts.append(b" ".join([raw[start[j] : end[j]] for j in kept]).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, rows),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(n_removed, type=pa.int64()),
                        spans.listed(repeats, pa.int32()),
                        pa.array(texts, type=pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "repeats", "text"],
                )

    schema = "doc_id long, n_words long, n_removed long, repeats array<int>, text string"
    return marked.mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS
) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (start, end, start, end, ... in words) and text.

    `text` is the kept words joined by one space.
    """
    docs = keyed(docs)
    anchors = anchor_rows(docs, window, seed)
    shared = anchors.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = settle(shared.filter("lo < hi").select("seed"), "seeds")
    joined = settle(anchors.join(shared, "seed"), "anchors")

    classes = joined.groupBy("seed", "around").agg(F.min("doc_id").alias("lo"))
    classes = settle(classes, "classes")
    # Counts are written before they are joined, so that joins can be split where a group is hot.
    several = classes.groupBy("seed").agg(F.count("*").alias("classes")).filter("classes > 1")
    several = settle(several, "several")
    places = joined.join(classes, ["seed", "around"])
    copies = places.filter("doc_id > lo").groupBy("key").agg(F.collect_set("place").alias("around"))

    first = places.filter("doc_id = lo").join(several, "seed")
    first = settle(first.groupBy("key").agg(F.collect_set("place").alias("marks")), "first")
    windows = settle(window_rows(marked_only(docs, first), window, seed), "windows")
    owners = windows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    owners = settle(owners.filter("lo < hi").select("hash", "lo"), "owners")
    single = windows.join(owners, "hash").filter("doc_id > lo")
    single = single.groupBy("key").agg(F.collect_set("place").alias("windows"))

    marks = settle(copies.join(single, "key", "full"), "marks")
    discard(shared, joined, classes, several, first, windows, owners)
    marked = with_marks(docs, marks).select("doc_id", "text", "around", "windows")
    return cut(marked, window, seed)
