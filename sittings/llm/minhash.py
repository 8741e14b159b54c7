"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the least and the greatest
image, so a signature of 2P values costs P evaluations. Either value agrees between two sets
with probability equal to their Jaccard similarity; least and greatest together vary less
than two values of separate permutations. The values are cut into bands (the least values
first, then the greatest, so that no band mixes the two values of one permutation); documents
that agree on a band are candidates, and a candidate pair is a link only after its full
shingle sets have been compared.

Equal sets are one class, whatever their number. In a bucket, classes are first compared with
one centre (the member that shares most buckets with others), which is linear in the
bucket. Where a bucket is then still in several components, its members are compared across
components, but only those pairs that share one of their rarest shingles early enough
to be a link at all; others cannot be links. So every candidate pair ends up within one component,
compared or excluded by a bound. Components go on through all links.

With 65 permutations, 26 bands of 5 values miss a pair of similarity 0.85 with probability
3e-7 and one of 0.8 with 4e-5.

Results for odd rows: a NULL, empty or blank text has no shingles, is linked with nothing and is
its own component; a document is a doc_id with a text, so repeated rows give equal rows and different texts
of one doc_id are linked only by what each of them holds; rows without doc_id give a row
with kept NULL and link nothing; an empty table gives an empty table. The shingles of a very long text
are one array while it is signed. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sittings.llm import spans
from sittings.llm.graph import components
from sittings.runtime import discard, settle

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
PERMUTATIONS = 65
BAND_VALUES = 5


def shingle_sets(texts: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    """Per slice of the batch, the sorted distinct shingle hashes of each text."""
    for piece in spans.slices(texts):
        data = spans.LOWER[piece.data]
        start, end = spans.words(data)
        hashes = spans.span_hash(spans.prefix(data), start, end)
        bounds = np.searchsorted(start, piece.starts)
        grams = spans.grams(hashes, k)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(grams[a : b - k + 1]))
            else:  # the whole sequence is one shingle
                sets.append(spans.grams(hashes[a:b], b - a) if b > a else hashes[:0])
        yield sets


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """One row of 2 x permutations values per set (sets must not be empty)."""
    joined = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = spans.mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(spans.BASE))
    out = np.empty((len(sets), 2 * permutations), dtype=np.uint64)
    for p in range(permutations):
        image = (joined ^ keys[2 * p]) * (keys[2 * p + 1] | np.uint64(1))
        out[:, p] = np.minimum.reduceat(image, at)
        out[:, permutations + p] = np.maximum.reduceat(image, at)
    return out


def sign(docs: DataFrame, k: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, node, n_shingles, key_a and key_b (a digest of the whole set) and bands of every document.

    A node is a doc_id with a text.
    """
    bands = 2 * permutations // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0), 0
            for sets in shingle_sets(batch.column(1), k):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                keys = np.array(
                    [[s.sum(dtype=np.uint64), spans.mix(s).sum(dtype=np.uint64)] for s in sets]
                )
                flat = np.zeros((len(sets), bands), dtype=np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    values = signatures([sets[i] for i in full], permutations)
                    values = values[:, : bands * rows].reshape(len(full), bands, rows)
                    band = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(spans.BASE)
                    for r in range(rows):
                        band = spans.mix(band ^ values[:, :, r])
                    flat[full] = band
                lengths = np.where(sizes > 0, bands, 0)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                key = keys.view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(sets)),
                        batch.column(2).slice(done, len(sets)),
                        pa.array(sizes),
                        pa.array(key[:, 0].copy()),
                        pa.array(key[:, 1].copy()),
                        pa.ListArray.from_arrays(
                            pa.array(offsets), spans.signed(flat[full].reshape(-1))
                        ),
                    ],
                    names=["doc_id", "node", "n_shingles", "key_a", "key_b", "bands"],
                )
                done += len(sets)
            spans.trim()

    schema = "doc_id long, node long, n_shingles long, key_a long, key_b long, bands array<long>"
    return _nodes(docs).mapInArrow(run, schema)


def _nodes(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("node"))


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column(1), k):
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = np.concatenate(sets)
                lists = pa.ListArray.from_arrays(pa.array(offsets), spans.signed(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(sets)), lists], names=["doc_id", "shingles"]
                )
                done += len(sets)
            spans.trim()

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _long_enough(percent: int) -> Column:
    """Sets of sizes na and nb can only be similar enough if they differ little in size."""
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("common", common)
        .filter(F.lit(100) * F.col("common") >= F.lit(percent) * union)
        .select("a", "b")
    )


def _prefixes(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of each set, as many as a link can do without, with their place.

    Shingles are ordered by how many of these sets hold them. Two sets that are similar enough
    share a shingle among the first ones of both.
    """
    shingles = docs.join(sets, docs["rep"] == sets["doc_id"]).select(
        "rep", "n", "c", F.explode("shingles").alias("shingle")
    )
    holders = shingles.groupBy("shingle").agg(F.count("*").alias("holders"))
    ordered = F.array_sort(F.collect_list(F.struct("holders", "shingle")))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return (
        shingles.join(holders, "shingle")
        .groupBy("rep", "n", "c")
        .agg(ordered.alias("ordered"))
        .withColumn("first", F.slice("ordered", 1, first.cast("int")))
        .select("rep", "n", "c", F.posexplode("first").alias("at", "of"))
        .filter("of.holders > 1")
        .select("rep", "n", "c", "at", "of.shingle")
    )


def _across(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be links.

    With sizes na and nb a link has at least `least` common shingles. A common shingle at
    place `at` of a set (from 0) leaves n - at of them to it and those behind it, and the first
    common shingle must leave `least`; pairs without such a shingle are no links.
    """
    left = prefixes.selectExpr("shingle", "rep AS a", "n AS na", "c AS ca", "at AS pa")
    right = prefixes.selectExpr("shingle", "rep AS b", "n AS nb", "c AS cb", "at AS pb")
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    return (
        left.join(right, "shingle")
        .filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _long_enough(percent))
        .filter((F.col("na") - F.col("pa") >= least) & (F.col("nb") - F.col("pb") >= least))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    k: int = SHINGLE_WORDS,
    permutations: int = PERMUTATIONS,
    rows: int = BAND_VALUES,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (one document of each component)."""
    signed = settle(sign(docs, k, permutations, rows), "signatures")
    equal = ["n_shingles", "key_a", "key_b"]
    classes = (
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*equal)
        .agg(
            F.min("node").alias("rep"), F.min_by("bands", "node").alias("bands"), F.min("doc_id").alias("least")
        )
    )
    classes = settle(classes, "classes")

    entries = classes.selectExpr("rep", "n_shingles AS n", "explode(bands) AS band")
    shared = entries.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = settle(entries.join(shared, "band"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("members").alias("degree"))
    best = F.struct(F.col("degree"), -F.col("rep"))
    centres = (
        buckets.join(degree, "rep")
        .groupBy("band")
        .agg(F.max_by(F.struct("rep", "n"), best).alias("centre"))
        .select("band", F.col("centre.rep").alias("a"), F.col("centre.n").alias("na"))
    )
    stars = (
        buckets.join(centres, "band")
        .select("a", "na", F.col("rep").alias("b"), F.col("n").alias("nb"))
        .filter((F.col("a") != F.col("b")) & _long_enough(percent))
        .select("a", "b")
        .distinct()
    )
    stars = settle(stars, "stars")

    candidates = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = _nodes(docs).select(F.col("node").alias("doc_id"), "text")
    texts = texts.join(candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = settle(full_sets(texts, k), "sets")
    links = settle(verified(stars, sets, percent), "links")
    found = components(links)

    # Members of buckets that are not one component yet are compared across components.
    placed = buckets.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "band", "rep", "n", F.coalesce("component_id", "rep").alias("c")
    )
    apart = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    open_ = placed.join(apart.filter("lo < hi").select("band"), "band").select("rep", "n", "c")
    prefixes = settle(_prefixes(settle(open_.distinct(), "open"), sets, percent), "prefixes")
    compared = stars.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    rest = _across(prefixes, percent).join(compared, ["a", "b"], "left_anti")
    more = settle(verified(rest, sets, percent), "links")
    if not more.isEmpty():
        found = components(found.selectExpr("doc_id AS a", "component_id AS b").unionAll(more))
    discard(buckets, stars, sets)

    members = classes.select(*equal, "rep", "least").join(
        found.withColumnRenamed("doc_id", "rep"), "rep", "left"
    )
    members = members.withColumn("c", F.coalesce("component_id", "rep"))
    smallest = members.groupBy("c").agg(F.min("least").alias("smallest"))
    members = members.join(smallest, "c").select(*equal, "smallest")
    own = F.coalesce("smallest", "doc_id")
    return (
        signed.join(members, equal, "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
