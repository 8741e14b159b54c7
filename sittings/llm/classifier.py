"""Quality classifier: a sparse ensemble of rules.

Every document gets a few statistics of its text. A forest of shallow trees is grown on
labelled rows; each path from a root to a node is a rule, a conjunction of thresholds on
statistics. A logistic regression with a lasso penalty weighs the rules and leaves few of them. What
is left compiles into one Spark column expression over the statistics, which scores any table
without Python.

The fit takes all labelled rows, or about `fit_rows` if there are more (those of small hash of doc_id), which
bounds the training data; statistics and scores cover all documents. Labels, language, source and doc_id
are no inputs of a score.

Results for odd rows: a NULL or empty text has all statistics 0 and is scored like any other;
repeated rows get equal scores; NULL labels are not learnt from; with no labels, or of one
kind only, the score is their share of 1 (0.5 without any); an empty table gives an empty table.
A very long text is counted whole by the task that reads it. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sittings.llm import spans
from sittings.llm.line_quality import _distinct
from sittings.runtime import settle

FIT_ROWS = 50_000
TREES = 24
DEPTH = 3
LASSO = 2e-4
THRESHOLD = 0.3
SLICE_BYTES = 1 << 18  # counting takes about a hundred bytes a byte of a slice

STATISTICS = [
    "log_words", "word_bytes", "upper", "digits", "symbols", "exclaims", "other_marks",
    "distinct_words", "repeat_words", "top_word", "line_words", "dup_lines", "open_lines",
    "bars", "word_spread",
]


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


UPPER = _table(bytes(range(65, 91)))
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
DIGIT = _table(bytes(range(48, 58)))
SYMBOL = _table(b"#*$%&<>~^@_=+{}[]\\/")
MARK = _table(b".,;:?'\"()-")
END = _table(b".!?\"':;")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one double column for each of STATISTICS."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _with_statistics(rows, "doc_id long")


def _with_statistics(rows: DataFrame, first: str, field: int | None = None) -> DataFrame:
    """The first column, described by `first`, and the statistics of the texts.

    Texts are the second column, or the given field of the first, which then goes out and back alone.
    """
    name = first.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, name, field)

    return rows.mapInArrow(run, first + "".join(f", {n} double" for n in STATISTICS))


def _counted(batches: Iterator[pa.RecordBatch], name: str, field: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1) if field is None else batch.column(0).field(field)
        for piece in spans.slices(texts, SLICE_BYTES):
            values = _statistics(piece)
            kept = batch.column(0).slice(piece.first, piece.last - piece.first)
            columns = [kept, *[pa.array(values[n].astype(float)) for n in STATISTICS]]
            yield pa.RecordBatch.from_arrays(columns, names=[name, *STATISTICS])
        spans.trim()


def _statistics(piece: spans.Slice) -> dict[str, np.ndarray]:
    data, rows = piece.data, piece.last - piece.first
    sums = spans.prefix(data)
    start, end = spans.words(data)
    bounds = np.searchsorted(start, piece.starts)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    n_words = np.diff(bounds)
    words = np.maximum(n_words, 1)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data])))
        return np.diff(total[piece.starts])

    def per_row(of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights=weights, minlength=rows)

    filled = np.maximum(count(~spans.SPACE), 1)
    letters = np.maximum(count(LETTER), 1)
    hashes = spans.span_hash(sums, start, end)
    _, one, times = np.unique(_distinct(row, hashes), return_index=True, return_counts=True)
    top = np.zeros(rows)
    np.maximum.at(top, row[one], times)
    triples = spans.grams(hashes, 3)
    inside = np.flatnonzero(row[: len(triples)] == row[2:])
    _, of, again = np.unique(
        _distinct(row[inside], triples[inside]), return_inverse=True, return_counts=True
    )
    repeats = per_row(row[inside], again[of] > 1)

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    some = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[some], line_end[some]
    line_row = piece.row_of(line_start)
    lines = np.maximum(per_row(line_row), 1)
    _, seen = np.unique(
        _distinct(line_row, spans.span_hash(sums, line_start, line_end)), return_index=True
    )
    length = (end - start).astype(float)
    mean = per_row(row, length) / words
    spread = np.sqrt(np.maximum(per_row(row, length * length) / words - mean * mean, 0))
    return {
        "log_words": np.log1p(n_words),
        "word_bytes": mean,
        "upper": count(UPPER) / letters,
        "digits": count(DIGIT) / filled,
        "symbols": count(SYMBOL) / filled,
        "exclaims": count(_table(b"!")) / filled,
        "other_marks": count(MARK) / filled,
        "distinct_words": per_row(row[one]) / words,
        "repeat_words": repeats / words,
        "top_word": top / words,
        "line_words": n_words / lines,
        "dup_lines": 1 - per_row(line_row[seen]) / lines,
        "open_lines": per_row(line_row, ~END[data[line_end - 1]]) / lines,
        "bars": count(_table(b"|")) / words,
        "word_spread": spread,
    }


Condition = tuple[str, str, float]


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(_holds(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, sign, value in conditions:
        out = out & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
    return out


def _paths(node, above: dict[tuple[str, str], float]) -> Iterator[tuple[Condition, ...]]:
    """The rule of each node below the root, redundant thresholds on its path left out."""
    if above:
        yield tuple(sorted((name, sign, value) for (name, sign), value in above.items()))
    if node.subtreeDepth() == 0:
        return
    name = STATISTICS[node.split().featureIndex()]
    value = round(float(node.split().threshold()), 6)
    low, high = dict(above), dict(above)
    low[name, "<="] = min(value, above.get((name, "<="), value))
    high[name, ">"] = max(value, above.get((name, ">"), value))
    yield from _paths(node.leftChild(), low)
    yield from _paths(node.rightChild(), high)


def sample(rows: DataFrame, most: int) -> DataFrame:
    """All rows if there are at most `most`, else about so many: those whose doc_id has a small hash.

    Every task drops its own rows, so nothing but the sample meets in one place.
    """
    n = rows.count()
    share = int((1 << 32) * min(1.0, most / max(1, n)))
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share)


def fit(
    labelled: DataFrame,
    fit_rows: int = FIT_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
    lasso: float = LASSO,
) -> RuleModel:
    """A model from STATISTICS and `label` (0 or 1); reads about `fit_rows` rows at most, in one order."""
    # Workers that only count statistics need none of this.
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = sample(labelled.filter("label IN (0, 1)"), fit_rows)
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", *STATISTICS)
    rows = settle(rows.select(*STATISTICS, F.col("label").cast("double")), "fit")
    kinds = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if kinds["n"] == 0 or kinds["share"] in (0.0, 1.0):
        share = 0.5 if kinds["n"] == 0 else min(max(kinds["share"], 0.001), 0.999)
        return RuleModel(float(np.log(share / (1 - share))), ())
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="0.5")
    grown = forest.fit(vectors)
    found: dict[tuple[Condition, ...], None] = {}
    for tree in grown.trees:
        found |= dict.fromkeys(_paths(tree._call_java("rootNode"), {}))
    rules = list(found)
    holds = [_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    flags = rows.select("label", *holds)
    names = [f"r{i}" for i in range(len(rules))]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(flags)
    vectors = settle(vectors.select("label", "features"), "rules")
    lasso_fit = LogisticRegression(
        elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False
    ).fit(vectors)
    weights = lasso_fit.coefficients.toArray()
    kept = [(r, round(float(w), 6)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]
    return RuleModel(float(lasso_fit.intercept), tuple(kept))


def remainder(doc_id: Column) -> Column:
    """Documents of remainder 0 are held out from learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def learnt_labels(labels: DataFrame, fit_rows: int = FIT_ROWS, label: str = "quality") -> DataFrame:
    """doc_id and label of the labelled documents that are not held out, or of a sample of them."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("long").alias("label"))
    marked = marked.filter((remainder(F.col("doc_id")) != 0) & F.col("label").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    return sample(marked.filter("label IN (0, 1)"), fit_rows)


def learn(numbers: DataFrame, labels: DataFrame, label: str = "quality", **options) -> RuleModel:
    """Fit on the labelled documents that are not held out, or a sample of them."""
    marked = learnt_labels(labels, options.get("fit_rows", FIT_ROWS), label)
    return fit(numbers.join(marked, "doc_id"), **options)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options
) -> DataFrame:
    """doc_id, the statistics, held_out, score and predicted of every document."""
    numbers = settle(statistics(docs), "statistics")
    model = learn(numbers, labels, **options)
    scored = numbers.withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)))
    scored = scored.withColumn("score", model.score())
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options
) -> DataFrame:
    """The rows of documents that score at least `threshold`, unshuffled.

    Statistics are taken of the documents that are learnt from, and then once of each to score it.
    """
    marked = settle(learnt_labels(labels, options.get("fit_rows", FIT_ROWS)), "learnt")
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = own.join(F.broadcast(marked) if marked.count() <= 2 * FIT_ROWS else marked, "doc_id")
    numbers = _with_statistics(own.select(F.struct("doc_id", "label").alias("of"), "text"), "of struct<doc_id: long, label: long>")
    numbers = settle(numbers.select("of.doc_id", "of.label", *STATISTICS), "statistics")
    model = fit(numbers, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string"))
    kind = rows.schema["row"].dataType
    # A text that is a string already is read out of its row.
    field = next((i for i, f in enumerate(kind) if f.name == "text" and f.dataType.typeName() == "string"), None)
    rows = rows if field is None else rows.select("row")
    scored = _with_statistics(rows, f"row {kind.simpleString()}", field)
    return scored.filter(model.score() >= threshold).select("row.*")
