"""Quality rules with cross-document line frequency.

Each document's lines are normalised (A-Z lower-cased, white space collapsed) and hashed. For
every host the distinct documents holding a line are counted (a document is a doc_id with a text, so
copies of a page count each); lines in more than `max_docs` of them are boilerplate and are removed, and a
document that loses more than `max_removed_percent` of its words is rejected as depleted.
Before that, each document must pass base rules of its own. `max_docs` is an absolute number, so a
line's fate depends on how often its host repeats it, not on how large the corpus is.

Results for odd rows: a NULL or empty text has no words and fails the base rules; a NULL host
is a host of its own; repeated rows give equal rows and count once; an empty table
gives an empty table. A very long text is counted whole by the task that reads it, like any other. Columns beyond doc_id, text and the host column are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sittings.llm import spans
from sittings.runtime import settle

MAX_DOCS = 20
MAX_REMOVED_PERCENT = 60
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One hash for each (row, hash)."""
    return spans.mix(hashes ^ spans.mix(rows.astype(np.uint64) + np.uint64(1)))


def count_base(docs: DataFrame) -> DataFrame:
    """Base counts of each document, with its distinct normalised lines and their words.

    Takes doc_id, text, host and digest and gives doc_id, host and digest back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in spans.slices(batch.column(1)):
                yield _counts(batch, piece)

    schema = """doc_id long, host string, digest long, n_words long, word_chars long,
        n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<int>"""
    return docs.mapInArrow(run, schema)


def _counts(batch: pa.RecordBatch, piece: spans.Slice) -> pa.RecordBatch:
    data, rows = piece.data, piece.last - piece.first
    sums = spans.prefix(data)
    start, end = spans.words(data)
    bounds = np.searchsorted(start, piece.starts)
    row = np.repeat(np.arange(rows), np.diff(bounds))

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks)))
        return np.diff(total[piece.starts])

    chars = per_text(((data & 0xC0) != 0x80) & ~spans.SPACE[data])
    symbols = per_text(SYMBOLS[data])

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    line_words = np.searchsorted(start, line_end) - np.searchsorted(start, line_start)
    filled = line_words > 0
    line_start, line_end, line_words = line_start[filled], line_end[filled], line_words[filled]
    line_row = piece.row_of(line_start)
    raw = spans.span_hash(sums, line_start, line_end)
    _, seen = np.unique(_distinct(line_row, raw), return_index=True)
    dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[seen], minlength=rows)

    hashes = spans.span_hash(sums, start, end)
    triples = spans.grams(hashes, 3)
    inside = np.flatnonzero(row[: len(triples)] == row[2:])
    _, of, times = np.unique(
        _distinct(row[inside], triples[inside]), return_inverse=True, return_counts=True
    )
    again = inside[times[of] > 1]
    repeated = np.zeros(len(start) + 1, dtype=bool)
    for j in range(3):
        repeated[again + j] = True
    repeats = np.diff(np.concatenate(([0], np.cumsum(repeated)))[bounds])

    lower = spans.LOWER[data]
    word_sums = spans.prefix_of(spans.span_hash(spans.prefix(lower), start, end))
    first = np.searchsorted(start, line_start)
    normal = spans.span_hash(word_sums, first, first + line_words)
    _, one = np.unique(_distinct(line_row, normal), return_index=True)
    order = one[np.argsort(line_row[one], kind="stable")]
    # A line repeated in its document counts with all its words.
    _, of = np.unique(_distinct(line_row, normal), return_inverse=True)
    words_of = np.bincount(of, weights=line_words)[of[order]]
    cuts = np.searchsorted(line_row[order], np.arange(rows + 1))
    offsets = pa.array(cuts.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).slice(piece.first, rows),
            batch.column(2).slice(piece.first, rows),
            batch.column(3).slice(piece.first, rows),
            pa.array(np.diff(bounds).astype(np.int64)),
            pa.array(chars.astype(np.int64)),
            pa.array(symbols.astype(np.int64)),
            pa.array(dup_lines.astype(np.int64)),
            pa.array(repeats.astype(np.int64)),
            pa.ListArray.from_arrays(offsets, spans.signed(normal[order])),
            pa.ListArray.from_arrays(offsets, pa.array(words_of.astype(np.int32))),
        ],
        names=[
            "doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "n_repeat_words", "lines", "sizes",
        ],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = MAX_DOCS,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
) -> DataFrame:
    """Base counts, base_failed, n_removed (words in boilerplate lines), kept, and the hashes
    of the lines to remove (`common_lines`, for `strip_lines`)."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        F.col(host).cast("string").alias("host"),
        F.xxhash64(text, F.col(host).cast("string")).alias("digest"),
    )
    counts = settle(count_base(rows), "line-counts")
    once = counts.select("host", "digest", "lines", "sizes").dropDuplicates(["digest"])
    # Equal texts of a host are worked on once and weigh as many documents as they are.
    weights = counts.select("digest", "doc_id").distinct().groupBy("digest").agg(F.count("*").alias("weight"))
    lines = once.join(weights, "digest").select(
        "host", "digest", "weight", F.explode(F.arrays_zip("lines", "sizes")).alias("of")
    ).select(F.xxhash64("host", "of.lines").alias("at"), "digest", "weight", "of.lines", "of.sizes")
    common = lines.groupBy("at").agg(F.sum("weight").alias("docs")).filter(F.col("docs") > max_docs)
    removed = (
        lines.join(common.select("at"), "at")
        .groupBy("digest")
        .agg(F.sum("sizes").alias("removed"), F.collect_list("lines").alias("common_lines"))
    )
    n_removed = F.coalesce("removed", F.lit(0).cast("long"))
    return (
        counts.drop("lines", "sizes")
        .join(removed, "digest", "left")
        .withColumn("n_removed", n_removed)
        .withColumn("base_failed", base_failed())
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (100 * F.col("n_removed") <= max_removed_percent * F.col("n_words")),
        )
        .drop("removed", "host")
    )


def strip_lines(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """doc_id and text of the kept documents without their boilerplate lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, common in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True
            ):
                texts.append("\n".join(_other_lines(text or "", set(common or ()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"]
            )

    text = F.col("text").cast("string")
    digest = F.xxhash64(text, F.col(host).cast("string")).alias("digest")
    wanted = verdicts.filter("kept").select("digest", "common_lines").dropDuplicates(["digest"])
    joined = docs.select(F.col("doc_id").cast("long"), text.alias("text"), digest)
    joined = joined.join(wanted, "digest").select("doc_id", "text", "common_lines")
    return joined.mapInArrow(run, "doc_id long, text string")


def _other_lines(text: str, common: set[int]) -> Iterator[str]:
    for line in text.split("\n"):
        data = np.frombuffer(line.encode() + b"\n", dtype=np.uint8)
        start, end = spans.words(data)
        if len(start) and common:
            sums = spans.prefix_of(spans.span_hash(spans.prefix(spans.LOWER[data]), start, end))
            whole = spans.span_hash(sums, np.array([0]), np.array([len(start)]))
            if int(whole.view(np.int64)[0]) in common:
                continue
        yield line
