"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (document, place) of terms of the training texts. Of a benchmark
window (13 words of an item in a row) only the two rarest terms are looked up: their lists,
each moved back by the term's place in the item, are intersected, which leaves alignments of
an item with a document. At an alignment all words of the item are compared with the document's, and
every window that agrees is a phrase match. Term frequencies are counted over the whole
corpus, so common words are never listed unless a window has no others. Proximity
matches (the rarest terms of an item close to each other, in any order) come from the same index.

Texts are split into words twice: to count the terms, and to write the index, which also holds a row
for each document with its number of words. Beyond that only the texts of alignments are read.

Everything is DataFrame functions. Tables of benchmark terms are broadcast after a count, or
joined by shuffle beyond it.

Results for odd rows: NULL or empty texts and items have no words and match nothing; items
without id count as the item ''; repeated items are one item each per id and text; repeated
documents give equal rows; an empty benchmark hits nothing, an empty table gives an empty
table. The words of a very long text are one row's array while it is split. Columns beyond doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sittings.llm.tables import compact, lowered_words
from sittings.runtime import settle

WINDOW_WORDS = 13
NEAR_TERMS = 3
NEAR_WORDS = 30


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id and words of every benchmark text that has words."""
    item_id = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    items = benchmark.select(item_id, lowered_words(F.col("text")).alias("item_words"))
    items = items.filter(F.size("item_words") > 0).distinct()
    return items.select(F.xxhash64("item_id", "item_words").alias("item"), "*")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and its number of occurrences in all documents, for the given terms."""
    words = docs.select(F.explode(lowered_words(F.col("text"))).alias("term"))
    return words.join(terms, "term").groupBy("term").agg(F.count("*").alias("occurs"))


def indexed(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """key, doc_id, n_words, term and place of every occurrence of the given terms, and of every document
    itself, at place -1 under a term of its own that is no word."""
    words = docs.select("key", "doc_id", lowered_words(F.col("text")).alias("w"))
    own = F.concat(F.lit("\0"), F.col("key").cast("string"))
    places = F.posexplode(F.concat(F.array(own), F.col("w"))).alias("place", "term")
    words = words.select("key", "doc_id", F.size("w").cast("long").alias("n_words"), places)
    words = words.withColumn("place", F.col("place") - 1)
    found = words.join(terms.select("term", F.lit(True).alias("listed")), "term", "left")
    return found.filter("listed OR place = -1").drop("listed")


def postings(index: DataFrame) -> DataFrame:
    """term, key, doc_id and place of the occurrences of terms."""
    return index.filter("place >= 0").select("term", "key", "doc_id", "place")


def rarest_pairs(items: DataFrame, occurs: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of each window (one, where it has a single word), by place in the item.

    Windows with a word that no document has are left out.
    """
    size = F.size("item_words")
    length = F.least(size, F.lit(window))
    starts = F.sequence(F.lit(0), size - length)
    start = F.explode(starts).alias("start")
    windows = items.select("item", length.alias("length"), "item_words", start)
    words = windows.select(
        "item", "length", "start",
        F.posexplode(F.slice("item_words", F.col("start") + 1, F.col("length"))).alias("at", "term"),
    )
    ordered = F.array_sort(
        F.collect_list(F.struct("occurs", (F.col("start") + F.col("at")).alias("at"), "term"))
    )
    rare = words.join(occurs, "term").groupBy("item", "start", "length").agg(ordered.alias("rare"))
    rare = rare.filter(F.size("rare") == F.col("length"))
    second = F.when(F.size("rare") > 1, F.col("rare")[1]).otherwise(F.col("rare")[0])
    return rare.select(
        "item",
        F.col("rare")[0]["term"].alias("term"),
        F.col("rare")[0]["at"].alias("at"),
        second["term"].alias("term2"),
        second["at"].alias("at2"),
    ).distinct()


def _agreeing(window: int) -> Column:
    """Starts, in the compared stretch, of the windows in which all words agree."""
    length = F.least(F.size("item_words"), F.lit(window))
    last = F.size("same") - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        starts, lambda s: F.forall(F.slice(F.col("same"), s + 1, length), lambda same: same)
    )


def rarest_terms(items: DataFrame, occurs: DataFrame, terms: int) -> DataFrame:
    """item, item_id, term and needed (their number) of each item's rarest terms, of those that occur."""
    words = items.select("item", "item_id", F.explode(F.array_distinct("item_words")).alias("term"))
    by_item = Window.partitionBy("item").orderBy("occurs", "term")
    rare = words.join(occurs, "term").withColumn("n", F.row_number().over(by_item))
    rare = rare.filter(F.col("n") <= terms)
    needed = F.count("*").over(Window.partitionBy("item"))
    return rare.select("item", "item_id", "term", needed.alias("needed"))


def near_matches(index: DataFrame, rare: DataFrame, within: int) -> DataFrame:
    """key, doc_id, item_id and place where all of an item's rarest terms stand within `within` words."""
    near = Window.partitionBy("key", "item").orderBy("place").rangeBetween(-(within - 1), 0)
    found = index.join(rare, "term").withColumn("seen", F.size(F.collect_set("term").over(near)))
    return found.filter("seen = needed").select("key", "doc_id", "item_id", "place").distinct()


def phrase_matches(
    index: DataFrame, docs: DataFrame, items: DataFrame, pairs: DataFrame, window: int
) -> DataFrame:
    """key, item_id, start and length of every window of an item found in a document."""
    first = index.join(F.broadcast(pairs) if pairs.count() <= 200_000 else pairs, "term")
    first = first.selectExpr("key", "item", "place - at AS shift", "term2", "at2")
    second = index.selectExpr("key", "term AS term2", "place AS place2")
    aligned = (
        first.withColumn("place2", F.col("shift") + F.col("at2"))
        .join(second, ["key", "term2", "place2"], "left_semi")
        .select("key", "item", "shift")
        .distinct()
    )
    aligned = settle(aligned, "alignments")
    keys = compact(aligned.select("key").distinct(), "matched-keys", rows=1_000_000)
    texts = docs.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"])
    texts = texts.select("key", lowered_words(F.col("text")).alias("words"))
    by_item = items.select("item", "item_id", "item_words")
    low = F.greatest(-F.col("shift"), F.lit(0))
    high = F.least(F.size("item_words"), F.size("words") - F.col("shift"))
    compared = (
        aligned.join(texts, "key")
        .join(by_item, "item")
        .withColumn("low", low)
        .withColumn("n", high - F.col("low"))
        .filter("n > 0")
        .withColumn(
            "same",
            F.zip_with(
                F.slice("words", F.col("shift") + F.col("low") + 1, F.col("n")),
                F.slice("item_words", F.col("low") + 1, F.col("n")),
                lambda a, b: a == b,
            ),
        )
    )
    return compared.select(
        "key",
        "item_id",
        F.explode(_agreeing(window)).alias("s"),
        (F.col("shift") + F.col("low") + F.col("s")).alias("start"),
        F.least(F.size("item_words"), F.lit(window)).alias("length"),
    ).drop("s")


def _terms(docs: DataFrame, items: DataFrame) -> DataFrame:
    words = items.select(F.explode("item_words").alias("term")).distinct()
    return settle(frequencies(docs, compact(words, "terms")), "frequencies")


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, within: int = NEAR_WORDS
) -> DataFrame:
    """doc_id, item_id and place where the item's rarest `terms` stand within `within` words.

    Items of fewer distinct terms need all of theirs. A term that no document has does not
    count among the rarest.
    """
    docs = _keyed(docs)
    items = settle(item_words(benchmark), "items")
    rare = settle(rarest_terms(items, _terms(docs, items), terms), "rare")
    index = postings(indexed(docs, compact(rare.select("term").distinct(), "listed")))
    return near_matches(index, rare, within).drop("key").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    share: int = 20,
    near_terms: int = NEAR_TERMS,
    near_words: int = NEAR_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (of matched items, sorted), n_near_items and contaminated.

    A document is contaminated if share * n_hit >= n_words and something is hit, which only exact
    windows do. `n_near_items` counts the items whose rarest terms stand close to each other somewhere.
    """
    docs = _keyed(docs)
    items = settle(item_words(benchmark), "items")
    occurs = _terms(docs, items)
    pairs = settle(rarest_pairs(items, occurs, window), "pairs")
    rare = settle(rarest_terms(items, occurs, near_terms), "rare")
    listed = pairs.select("term").union(pairs.select("term2")).union(rare.select("term")).distinct()
    index = settle(indexed(docs, compact(listed, "listed")), "index")
    found = settle(phrase_matches(postings(index), docs, items, pairs, window), "matches")
    places = F.sequence("start", F.col("start") + F.col("length") - 1)
    hit = found.select("key", F.explode(places).alias("place")).distinct()
    hit = hit.groupBy("key").agg(F.count("*").alias("hit"))
    ids = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    near = near_matches(postings(index), rare, near_words).select("key", "item_id").distinct()
    near = near.groupBy("key").agg(F.count("*").alias("near"))
    marks = hit.join(ids, "key").join(near, "key", "full")
    counted = index.filter("place = -1").select("key", "doc_id", "n_words")
    none = F.lit(0).cast("long")
    return (
        counted.join(marks, "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("hit", none).alias("n_hit"),
            F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("near", none).alias("n_near_items"),
        )
        .withColumn(
            "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
        )
    )
