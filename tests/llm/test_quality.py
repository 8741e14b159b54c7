"""Line frequencies, licenses and the learnt classifier."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus
import pyarrow as pa
import pytest

from sittings.llm import classifier, license, line_quality


def plain_line(line):
    return " ".join(corpus.blank_words(line.translate(corpus.LOWER)))


def line_rules(rows, limit, percent):
    holders = defaultdict(set)
    for doc_id, text, host in rows:
        for line in (text or "").split("\n"):
            holders[host, plain_line(line)].add((doc_id, text))
    out = Counter()
    for doc_id, text, host in rows:
        text = text or ""
        w = corpus.blank_words(text)
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if corpus.blank_words(x)]
        removed = sum(
            len(corpus.blank_words(x)) for x in lines if len(holders[host, plain_line(x)]) > limit
        )
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out[
            doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(again), removed, failed,
            not failed and 100 * removed <= percent * len(w),
        ] += 1
    return out


@pytest.mark.parametrize(("limit", "percent"), [(20, 60), (2, 5), (0, 60)])
def test_line_frequency(spark, limit, percent):
    rows = [(r[0], r[1], r[3]) for r in corpus.rows()]
    got = line_quality.quality(corpus.docs(spark), "source", limit, percent).collect()
    assert line_rules(rows, limit, percent) == Counter(
        (
            r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
            r.n_removed, r.base_failed, r.kept,
        )
        for r in got
    )


def test_copies_of_a_page_count_each(spark):
    page = "banner\n" + " ".join(f"w{i}" for i in range(60))
    rows = [(i, page, "h") for i in range(30)] + [(0, page, "h")] * 40 + [(50 + i, page, "g") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in line_quality.quality(docs).collect()}
    assert got == {**dict.fromkeys(range(30), (61, False)), **dict.fromkeys(range(50, 70), (0, True))}


def test_license_sql_lets_matches_give_way_only_where_they_overlap(spark):
    """The rows that tell the rule apart, through the SQL of the query itself."""
    import duckdb
    import pyarrow as pa

    from sittings.llm import oracle

    gpl2, gpl3 = license.TEMPLATES["GPL-2.0"], license.TEMPLATES["GPL-3.0"]
    changed = "That" + gpl2.removeprefix("This")
    texts = [f"{gpl3} {'word ' * 200} {changed}", f"{changed} {gpl3}", gpl3, changed, "nothing", None]
    documents = pa.table({"doc_id": list(range(len(texts))), "text": texts})  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(oracle.ORACLE["op6_license_bands"]).fetchall()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license.licenses(docs).collect():
        names = ",".join(x.license for x in r.found)
        assert want[r.doc_id] == (len(r.found), names, ",".join(str(x.common) for x in r.found))
    assert want[0][0] == 2


def test_strip_lines(spark):
    rng = random.Random(2)
    body = [" ".join(f"w{rng.randrange(999)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, f"Cookie  Notice\n{b}\nlast", "h" if i < 5 else "g") for i, b in enumerate(body)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    verdicts = line_quality.quality(docs, max_docs=3)
    got = {r.doc_id: r.text for r in line_quality.strip_lines(docs, verdicts).collect()}
    assert got == {i: b if i < 5 else rows[i][1] for i, b in enumerate(body)}


def test_every_template_is_found(spark):
    names = list(license.TEMPLATES)
    filler = "some words stand before and behind the notice " * 4
    texts = [f"{filler}{license.TEMPLATES[n].upper()} {filler}" for n in names]
    rows = [*enumerate(texts), (90, None), (91, ""), (92, "no license"), (93, filler), (93, filler)]
    rows += [(94, license.TEMPLATES["MIT"]), (None, license.TEMPLATES["MIT"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = license.licenses(docs).collect()
    found = {r.doc_id: [x.license for x in r.found] for r in got}
    assert len(got) == len(rows)
    for i, n in enumerate(names):
        assert n in found[i], n
    assert found[94] == found[None] == ["MIT"]
    assert not any(found[i] for i in (90, 91, 92, 93))


def test_signal_words_beside_underscores(spark):
    texts = ["_Released under the MIT License_", "_Licensed under CC BY 4.0_", "__Licensed under CC BY-SA 4.0__"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [x.license for x in r.found] for r in license.licenses(docs).collect()}
    assert got == {0: ["MIT"], 1: ["CC-BY-4.0"], 2: ["CC-BY-SA-4.0"]}


def test_matches_give_way_only_where_they_overlap(spark):
    gpl2, gpl3 = license.TEMPLATES["GPL-2.0"], license.TEMPLATES["GPL-3.0"]
    changed = "That" + gpl2.removeprefix("This")
    texts = [f"{gpl3} {'word ' * 40} {changed}", f"{changed} {'word ' * 40} {gpl3}", gpl3, changed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [tuple(x) for x in r.found] for r in license.licenses(docs).collect()}
    both = [("GPL-2.0", 7), ("GPL-3.0", 8)]
    assert got == {0: both, 1: both, 2: both[1:], 3: both[:1]}


def test_license_containment(spark):
    """Notices with words changed or left out, by the definition on the same windows."""
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        w = license.template_words(license.TEMPLATES[rng.choice(list(license.TEMPLATES))])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(["word"] * rng.randrange(30) + w + ["end"] * rng.randrange(9)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license.licenses(docs).collect():
        w = texts[r.doc_id].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        want = []
        for n, size, step in license.windows(license.TEMPLATES):
            best = {}
            for name, text in license.TEMPLATES.items():
                t = license.template_words(text)
                if len(t) == n:
                    parts = {tuple(t[i : i + 5]) for i in range(n - 4)}
                    for start in range(0, max(len(w) - size, 0) + step, step):
                        common = len(parts & set(grams[start : start + size - 4]))
                        if 100 * common >= 80 * len(parts):
                            best[name] = max(common, best.get(name, 0))
            want += [(k, c) for k, c in best.items() if c == max(best.values())]
        assert [(x.license, x.common) for x in r.found] == sorted(want)


def test_signal_words_suffice():
    assert all(license.signals_suffice(t) for t in license.TEMPLATES.values())


def labelled(spark, n=600):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randint(30, 90))]
        good = rng.random() < 0.6
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else words[:3] * 20
        rows.append((i, " ".join(words), "en", None, 5, *corpus.CLASHING))
        labels.append((i, int(good), None))
    rows += [(n, None, *rows[0][2:]), (n + 1, "", *rows[0][2:]), rows[0], (None, "x", *rows[0][2:])]
    labels += [(n + 5, None, None), (None, 1, 0), (3, labels[3][1], 1)]
    return (
        spark.createDataFrame(rows, corpus.SCHEMA),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        {i: q for i, q, _ in labels},
    )


def test_classifier_on_held_out(spark):
    docs, labels, truth = labelled(spark)
    got = classifier.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    assert right / len(held) > 0.97
    kept = classifier.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_texts_go_out_once_and_are_counted_in_little_memory(spark):
    docs, labels, _ = labelled(spark)
    sent = classifier.accepted(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    below = sent[sent.index("MapInArrow") :].split("\n")[1]
    assert "Project" in below and len(re.findall(r"\btext#\d+", below)) == 1, below
    # A text that is no string goes out as one, and comes back as it was.
    as_bytes = docs.select(*[docs[c].cast("binary") if c == "text" else docs[c] for c in docs.columns])
    kept = classifier.accepted(as_bytes, labels)
    assert kept.schema["text"].dataType.typeName() == "binary"
    key = lambda rows: sorted((str(r.doc_id), bytes(r.text or b"").decode()) for r in rows)
    strings = classifier.accepted(docs, labels).selectExpr("doc_id", "CAST(text AS binary) AS text")
    assert key(kept.collect()) == key(strings.collect())

    texts = ["some words of a text, and more of them. " * 100] * 2000
    rows = pa.StructArray.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    batch = pa.RecordBatch.from_arrays([rows], names=["row"])
    for _ in classifier._counted(iter([batch.slice(0, 10)]), "row", 1):
        pass
    tracemalloc.start()
    n = sum(out.num_rows for out in classifier._counted(iter([batch]), "row", 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and peak < 40 << 20, peak


def plain_statistics(text):
    """The statistics by their definitions, on words, lines and bytes."""
    raw = (text or "").encode()
    w = [x.encode() for x in corpus.blank_words(text)]
    n, spaces = max(len(w), 1), b" \t\n\v\f\r"
    filled = max(sum(b not in spaces for b in raw), 1)
    letters = max(sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw), 1)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    count = lambda marks: sum(b in marks for b in raw)
    lines = [x for x in raw.split(b"\n") if x.strip(spaces)]
    sizes = [len(x) for x in w]
    mean = sum(sizes) / n
    return {
        "log_words": math.log1p(len(w)),
        "word_bytes": mean,
        "upper": sum(65 <= b <= 90 for b in raw) / letters,
        "digits": sum(48 <= b <= 57 for b in raw) / filled,
        "symbols": count(b"#*$%&<>~^@_=+{}[]\\/") / filled,
        "exclaims": count(b"!") / filled,
        "other_marks": count(b".,;:?'\"()-") / filled,
        "distinct_words": len(set(w)) / n,
        "repeat_words": sum(c for c in triples.values() if c > 1) / n,
        "top_word": max(Counter(w).values(), default=0) / n,
        "line_words": len(w) / max(len(lines), 1),
        "dup_lines": 1 - len(set(lines)) / max(len(lines), 1) if lines else 1.0,
        "open_lines": sum(x[-1] not in b".!?\"':;" for x in lines) / max(len(lines), 1),
        "bars": count(b"|") / n,
        "word_spread": math.sqrt(max(sum(x * x for x in sizes) / n - mean * mean, 0)),
    }


def test_statistics_are_those_of_the_text(spark):
    rows = corpus.rows()
    texts = {r[0]: r[1] for r in rows}
    for r in classifier.statistics(corpus.docs(spark)).collect():
        if r.doc_id is not None:
            want = plain_statistics(texts[r.doc_id])
            got = {name: r[name] for name in classifier.STATISTICS}
            assert got == {name: pytest.approx(v, abs=1e-9) for name, v in want.items()}, r.doc_id


def test_paths_are_rules_of_the_trees():
    """Each node below the root is the conjunction of the tightest thresholds on its way."""

    class Node:
        def __init__(self, feature=0, threshold=0.0, left=None, right=None):
            self.feature, self.at, self.left, self.right = feature, threshold, left, right

        def subtreeDepth(self):
            return 0 if self.left is None else 1 + max(self.left.subtreeDepth(), self.right.subtreeDepth())

        def split(self):
            return self

        def featureIndex(self):
            return self.feature

        def threshold(self):
            return self.at

        def leftChild(self):
            return self.left

        def rightChild(self):
            return self.right

    tree = Node(0, 5.0, Node(0, 3.0, Node(), Node()), Node(2, 0.5, Node(), Node()))
    a, b = classifier.STATISTICS[0], classifier.STATISTICS[2]
    assert list(classifier._paths(tree, {})) == [
        ((a, "<=", 5.0),), ((a, "<=", 3.0),), ((a, "<=", 5.0), (a, ">", 3.0)),
        ((a, ">", 5.0),), ((a, ">", 5.0), (b, "<=", 0.5)), ((a, ">", 5.0), (b, ">", 0.5)),
    ]


def test_samples_are_bounded_and_the_same_each_time(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id")
    some = classifier.sample(rows, 2000)
    ids = {r.doc_id for r in some.collect()}
    assert 1800 < len(ids) < 2200 and ids == {r.doc_id for r in classifier.sample(rows.repartition(7), 2000).collect()}
    assert "TakeOrdered" not in some._jdf.queryExecution().executedPlan().toString()
    assert classifier.sample(rows, 20_000).count() == 20_000


def test_model_is_a_sum_of_rules(spark):
    docs, labels, _ = labelled(spark)
    numbers = classifier.statistics(docs)
    model = classifier.learn(numbers, labels)
    assert 0 < len(model.rules) < 100
    import math

    for r in numbers.withColumn("score", model.score()).limit(50).collect():
        total = model.intercept
        for conditions, weight in model.rules:
            if all(r[n] <= v if s == "<=" else r[n] > v for n, s, v in conditions):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = labelled(spark)
    turned = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(string(doc_id) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"
    )
    numbers = classifier.settle(classifier.statistics(docs), "numbers")
    assert classifier.learn(numbers, labels) == classifier.learn(numbers, turned)


def test_without_labels_or_documents(spark):
    docs, labels, _ = labelled(spark, 40)
    none = labels.limit(0)
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    ones = labels.filter("quality = 1")
    assert all(r.score > 0.99 for r in classifier.classify(docs, ones).collect())
    assert classifier.classify(corpus.empty(spark), labels).count() == 0
    assert line_quality.quality(corpus.empty(spark)).count() == 0
    assert license.licenses(corpus.empty(spark)).count() == 0
