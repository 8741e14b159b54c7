"""Words, lines, spans and their hashes over whole Arrow batches of texts, in numpy.

Texts are joined in slices of about a megabyte, each text followed by a line break, so that
one pass of array operations serves many documents. A hash of a span is a polynomial
over 64 bits, taken from prefix sums: any span of a slice costs two lookups. Hashes depend on
the bytes alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a one-to-one map)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers = {BASE: np.ones(1, dtype=np.uint64), INVERSE: np.ones(1, dtype=np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept for the next slice."""
    if len(_powers[base]) < n:
        out = np.full(n + n // 4, base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def trim() -> None:
    """Give freed memory back, which workers that live on would hold beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Slice:
    """Rows [first, last) of a batch: `data` holds their bytes, each text closed by a break."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray  # where each text begins; one more entry for the end

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch of texts (NULL as empty) into slices of whole texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset :][: n + 1]
    raw = memoryview(texts.buffers()[2] or b"")
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        parts = [raw[offsets[i] : offsets[i + 1]] for i in range(first, last)]
        data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        starts = offsets[first : last + 1] - offsets[first] + np.arange(last - first + 1)
        yield Slice(first, last, data, starts)
        first = last


def words(data: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no separators; `data` ends with one."""
    out = separator[data]
    edges = np.flatnonzero(out[1:] != out[:-1]) + 1
    if not out[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def prefix(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] from the prefix sums; of equal bytes alike wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, by their first."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + hashes[j : j + n]
    return mix(out)


def _sliding(values: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each w consecutive entries, by doubling."""
    width = 1
    out = values
    while width < w:
        step = min(width, w - width)
        out = op(out[:-step], out[step:])
        width += step
    return out


def anchors(seeds: np.ndarray, w: int, whole: np.ndarray) -> np.ndarray:
    """Winnowing: where a seed is the least of some w consecutive ones.

    `whole[i]` says whether the w seeds from i on belong to one document. What is chosen
    in a window depends on its content alone, so equal windows hold equal anchors.
    """
    if len(seeds) < w:
        return np.zeros(0, dtype=np.int64)
    least = np.where(whole[: len(seeds) - w + 1], _sliding(seeds, w, np.minimum), np.uint64(0))
    pad = np.zeros(w - 1, dtype=np.uint64)
    best = _sliding(np.concatenate((pad, least, pad)), w, np.maximum)
    return np.flatnonzero((best == seeds) & (seeds > 0))


def anchor_of_window(seeds: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive seeds, the place of the first least one."""
    n = len(seeds) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(seeds, w, np.minimum)
    # The next place at or after i where the seed equals a window's least: walk by doubling.
    out = np.full(n, -1, dtype=np.int64)
    for j in range(w):
        hit = (out < 0) & (seeds[j : j + n] == least)
        out[hit] = np.flatnonzero(hit) + j
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in a span [start, end)."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks[:n]) > 0


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def prefix_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums over hashes, for `span_hash` of runs of words."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def listed(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per row."""
    offsets = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def places(marks: pa.Array, starts: np.ndarray) -> np.ndarray:
    """Places in a slice that `marks` lists per text, counted there from its start."""
    marks = pc.fill_null(marks, pa.scalar([], marks.type))
    sizes = np.asarray(pc.list_value_length(marks))
    return np.repeat(starts[: len(sizes)], sizes) + np.asarray(marks.flatten()).astype(np.int64)
