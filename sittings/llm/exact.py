"""Exact duplicates found by counting quotient filters and settled by comparing bytes.

A fingerprint of a text is cut into a block, a quotient and a remainder. Every partition counts its
fingerprints in filters of its own, one a block. A filter keeps the remainders in order of
their quotients; a quotient itself is not stored, it follows from bits that count the
remainders of each (n remainders under q quotients take n + q bits). How many bits are
quotient depends on how many remainders there are, and as both together are the whole fingerprint,
filters of any sizes merge without loss: their sorted remainders are merged and equal ones'
counts added. A block holds a bounded share of the fingerprints, by a number of blocks that
follows from the number of documents, and of a hot fingerprint one entry a partition.

A fingerprint with count one is a text of its own. Texts with a count above one go on: they are grouped
by their bytes, combined before the shuffle, so a third of all rows may be one text. A
fingerprint whose texts are all equal settles its documents by itself; where different
texts share one, documents are told apart by their bytes again.

Results for odd rows: a NULL text is an empty one. A row without doc_id takes part, and stays
only if no row of its text has a doc_id. Of rows alike in doc_id and text one stays. An empty
table gives an empty table. Very long texts are never cut; they meet only as keys of a grouping.
Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sittings.llm.tables import compact, copies
from sittings.runtime import discard, settle

BITS = 64
BLOCK_ROWS = 4096
HELD_ROWS = 2_000_000


@dataclass
class Filter:
    """Fingerprints of `bits` bits, distinct and in order, and how often each was counted."""

    bits: int
    prints: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, bits: int, prints: np.ndarray, counts: np.ndarray | None = None) -> Filter:
        """Count fingerprints in any order, several times or not."""
        if counts is None:
            counts = np.ones(len(prints), dtype=np.int64)
        order = np.argsort(prints, kind="stable")  # merges the sorted runs it is given
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(prints)), bool), prints[1:] != prints[:-1])))
        return cls(bits, prints[first], np.add.reduceat(counts, first) if len(first) else counts)

    @classmethod
    def merge(cls, filters: list[Filter]) -> Filter:
        prints = np.concatenate([f.prints for f in filters])
        return cls.of(filters[0].bits, prints, np.concatenate([f.counts for f in filters]))

    def pack(self) -> bytes:
        n = len(self.prints)
        quotient_bits = min(self.bits, math.ceil(math.log2(n))) if n > 1 else 0
        left = self.bits - quotient_bits
        # A shift by all 64 bits is undefined in numpy.
        quotients = (self.prints >> np.uint64(left) if quotient_bits else self.prints * np.uint64(0)).astype(np.int64)
        held = np.bincount(quotients, minlength=1 << quotient_bits)
        runs = np.ones(n + len(held), dtype=np.uint8)
        runs[np.cumsum(held) + np.arange(len(held))] = 0
        width = (left + 7) // 8
        rest = self.prints & np.uint64((1 << left) - 1)
        rest = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        often = np.flatnonzero(self.counts > 1)
        head = np.array([self.bits, quotient_bits, n, len(often)], dtype="<u4")
        return b"".join(
            [
                head.tobytes(),
                np.packbits(runs).tobytes(),
                rest.tobytes(),
                often.astype("<u4").tobytes(),
                self.counts[often].astype("<u8").tobytes(),
            ]
        )

    @classmethod
    def unpack(cls, raw: bytes) -> Filter:
        bits, quotient_bits, n, often = np.frombuffer(raw, "<u4", 4).tolist()
        size, left, at = n + (1 << quotient_bits), bits - quotient_bits, 16
        runs = np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size)
        at += (size + 7) // 8
        ends = np.flatnonzero(runs == 0)
        quotients = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1) - 1)
        width = (left + 7) // 8
        rest = np.zeros((n, 8), dtype=np.uint8)
        rest[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        prints = rest.view("<u8").reshape(n)
        if quotient_bits:
            prints = prints | (quotients.astype(np.uint64) << np.uint64(left))
        counts = np.ones(n, dtype=np.int64)
        which = np.frombuffer(raw, "<u4", often, at)
        counts[which] = np.frombuffer(raw, "<u8", often, at + 4 * often)
        return cls(bits, prints, counts)


def _block_bits(rows: int, bits: int) -> int:
    return min(bits, 24, math.ceil(math.log2(max(1, rows / BLOCK_ROWS))))


def partition_filters(prints: DataFrame, bits: int, block_bits: int) -> DataFrame:
    """block and filter: what each partition counts of the column `print`."""
    inner = bits - block_bits

    def packed(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        blocks = prints >> np.uint64(inner) if block_bits else prints * np.uint64(0)
        numbers, first = np.unique(blocks, return_index=True)
        within = prints & np.uint64((1 << inner) - 1)
        edges = [*first.tolist(), len(prints)]
        filters = [
            Filter(inner, within[a:b], counts[a:b]).pack() for a, b in zip(edges, edges[1:], strict=False)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers.astype(np.int32)), pa.array(filters, pa.binary())], names=["block", "filter"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(bits, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            some = np.asarray(batch.column(0)).view(np.uint64)
            held = Filter.merge([held, Filter.of(bits, some)])
            if len(held.prints) >= HELD_ROWS:
                yield packed(held.prints, held.counts)
                held = Filter(bits, held.prints[:0], held.counts[:0])
        if len(held.prints):
            yield packed(held.prints, held.counts)

    return prints.select("print").mapInArrow(run, "block int, filter binary")


def merged(filters: DataFrame) -> DataFrame:
    """block and filter, one filter a block; filters of earlier runs may be among them."""

    def run(table: pa.Table) -> pa.Table:
        whole = Filter.merge([Filter.unpack(raw) for raw in table["filter"].to_pylist()])
        return pa.table({"block": table["block"][:1], "filter": pa.array([whole.pack()], pa.binary())})

    return filters.groupBy("block").applyInArrow(run, "block int, filter binary")


def repeated(filters: DataFrame, block_bits: int) -> DataFrame:
    """Fingerprints that merged filters count more than once, as `print`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = Filter.unpack(raw)
                prints = f.prints[f.counts > 1]
                if block_bits:
                    prints = prints | np.uint64(block << f.bits)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], names=["print"])

    return filters.select("block", "filter").mapInArrow(run, "print long")


def exact_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs`.

    Of equal texts the row with the largest doc_id stays. `bits` is the size of a fingerprint; fewer
    make more texts go to the comparison of bytes and change nothing else.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.shiftrightunsigned(F.xxhash64(text), BITS - bits) if bits < BITS else F.xxhash64(text)
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("print", cut)
    digests = texts.select("doc_id", "print", F.sha2("text", 256).alias("text_sha256"))
    digests = settle(digests, "digests")

    block_bits = _block_bits(digests.count(), bits)
    filters = settle(merged(partition_filters(digests, bits, block_bits)), "filters")
    often = compact(repeated(filters, block_bits), "repeated")

    # Byte verification: one row a text, combined before the shuffle.
    classes = texts.join(often, "print", "left_semi").groupBy("print", "text")
    classes = classes.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    each = settle(classes.select("print", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), "classes")
    clear = each.groupBy("print").agg(
        F.count("*").alias("n"),
        F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.max("sha").alias("text_sha256"),
    )
    clear = compact(clear.filter("n = 1").drop("n"), "clear")
    shared = each.join(clear, "print", "left_anti").select("print").distinct()
    shared = compact(shared, "shared")

    single = digests.join(often, "print", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    # Rows alike in doc_id and text travel as one.
    alike = digests.join(often, "print", "left_semi").groupBy("print", "doc_id")
    alike = alike.agg(F.count("*").alias("copies")).join(clear, "print")
    mixed = texts.join(shared, "print", "left_semi")
    verdict = mixed.groupBy("print", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    mixed = mixed.groupBy("print", "text", "doc_id").agg(F.count("*").alias("copies"))
    mixed = mixed.join(verdict, ["print", "text"]).withColumn("text_sha256", F.sha2("text", 256))
    rows = alike.unionByName(mixed.select(*alike.columns))
    grouped = copies(rows, ["print", "doc_id", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        "text_sha256",
    )
    discard(each, filters)
    return single.unionByName(grouped)
