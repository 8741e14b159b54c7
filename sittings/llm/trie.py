"""The trie of conversations by their leading turns, built from digests of blocks of turns.

Two conversations share a node of depth d if their first d turns are alike. A prefix is known
by the xor of a 128-bit hash of each of its turns with its place, so that prefixes are
sums: they combine before a shuffle, and a conversation with a third of all turns needs no task of its own.

1. Turns get their places by a sort over ranges of (conversation, turn): each task numbers
   what it holds, and of each range only the first conversation can have begun in an earlier one.
2. Conversations are grouped by successive digests of blocks of four turns: block by block, those that share
   everything before a block are siblings, and those of equal digests in it are one class, with
   a count and a smallest member. Copies of conversations are one row from here on.
3. Where siblings all have one class, its smallest member's turns are the nodes. Only where siblings
   diverge in a block are its turns compared one by one, one member for each class.
4. A node belongs to its smallest member, so the nodes that a conversation owns are a chain that
   hangs on a node of another. Sums over subtrees are taken by pointer jumping from chain to
   chain, in as many rounds as the height of that forest has binary digits, and then along each chain.

What is unbounded in a conversation is summed by spans of places first. The digest of the ids
that end at a node needs them in one row of bytes; they are sorted by range, joined to pieces in
parallel, and only the pieces of a node are streamed through one hash, holding one at a time.

Results for odd rows: turns are ordered by turn, NULL first, then role, then the digest of the text; NULL role or
text counts as empty, and repeated rows are turns like others. Rows without conv_id are no conversation and
are left out. An empty table gives no nodes. Very long texts are hashed where they are read and go
no further. Columns beyond conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sittings.llm.tables import compact
from sittings.runtime import discard, settle

BLOCK_TURNS = 4
SPAN = 4096  # places whose running sums are taken in one task
PIECE_IDS = 1024
HASH = ("h1", "h2")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def places(rows: DataFrame) -> DataFrame:
    """Turns with their place in their conversation, from 0.

    `rows` have conv_id, turn and the columns after which turns of one number are ordered.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *[F.col(c) for c in rows.columns[2:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, first = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            first = ids[0] if first is None else first
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            sizes = np.diff(np.append(starts, len(ids)))
            before = np.zeros(len(starts), dtype=np.int64)
            if ids[0] == last:
                before[0] = count
            at = np.arange(len(ids)) - np.repeat(starts - before, sizes)
            last, count = ids[-1], int(at[-1]) + 1
            columns = [pa.array(np.full(len(ids), part)), pa.array(ids == first), pa.array(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "leads", "at"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = settle(ranged.mapInArrow(run, f"{schema}, part long, leads boolean, at long"), "numbered")
    # At most one conversation a range can have begun before it, so these are as few as the ranges.
    leading = numbered.filter("leads").select("conv_id").distinct()
    held = numbered.join(F.broadcast(leading), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    shift = held.select("conv_id", "part", (F.sum("n").over(earlier) - F.col("n")).alias("shift"))
    shift = compact(shift.filter("shift > 0"), "shift")
    placed = numbered.join(shift, ["conv_id", "part"], "left")
    return placed.withColumn("at", F.col("at") + F.coalesce("shift", F.lit(0))).drop("part", "leads", "shift")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, a digest of two columns and the bytes of the text of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("sha"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return places(rows).select(
        "conv_id",
        "at",
        F.xxhash64("role", "sha").alias("d1"),
        F.xxhash64(F.lit("second"), "sha", "role").alias("d2"),
        "bytes",
    )


def inherited(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one of its group that comes first."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(9))


def _placed_hashes() -> list[Column]:
    return [F.xxhash64("at", "d1", "d2").alias("h1"), F.xxhash64("d2", "at", "d1").alias("h2")]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, at, h1, h2, bytes of rebuilt conversations, and the ids of all of them.

    A conversation takes the first turns of the first of its group of five, at most eight.
    """
    ids = turns.select("conv_id").distinct()
    ids = ids.select("conv_id", inherited(F.col("conv_id")).alias("h")).withColumn(
        "from", F.col("conv_id") - F.col("conv_id") % 5
    )
    turn = F.struct("at", "d1", "d2", "bytes")
    heads = turns.filter("at < 8 AND conv_id % 5 = 0").groupBy(F.col("conv_id").alias("from"))
    heads = heads.agg(F.array_sort(F.collect_list(turn)).alias("head"))
    taken = ids.join(heads, "from", "left").select(
        "conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array()).alias("head")
    )
    taken = settle(taken, "taken")
    # Only where the head is shorter than wanted do a conversation's own turns move up.
    moved = taken.select("conv_id", (F.col("h") - F.size("head")).alias("up")).filter("up > 0")
    own = turns.filter(F.col("at") >= inherited(F.col("conv_id"))).join(moved, "conv_id", "left")
    own = own.withColumn("at", F.col("at") - F.coalesce("up", F.lit(0)))
    rows = own.select("conv_id", "at", "d1", "d2", "bytes").unionByName(
        taken.select("conv_id", F.inline("head"))
    )
    return rows.select("conv_id", "at", *_placed_hashes(), "bytes"), taken.select("conv_id")


def running(rows: DataFrame, key: list[str], at: str, sums: dict[str, str]) -> DataFrame:
    """`rows` with running aggregates along `at` within `key`, both ends included.

    `sums` names columns and aggregates (`sum` or `bit_xor`) that replace them. Rows are summed in spans of places and
    the spans' sums brought along, so no task holds more of a key than a span and one row a span.
    """
    span = F.floor(F.col(at) / SPAN).alias("span")
    spanned = rows.withColumn("span", span)
    inside = Window.partitionBy(*key, "span").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = spanned.withColumns({c: F.expr(f"{agg}({c})").over(inside) for c, agg in sums.items()})
    # Keys of one span, nearly all, need no more; the others are told by their last places.
    far = compact(spanned.filter("span > 0").select(*key).distinct(), "far")
    if far.isEmpty():
        return out.drop("span")
    parts = spanned.join(far, key, "left_semi").groupBy(*key, "span")
    parts = parts.agg(*[F.expr(f"{agg}({c}) AS {c}") for c, agg in sums.items()])
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, "span", *[F.expr(f"{a}({c})").over(before).alias(f"{c}_") for c, a in sums.items()])
    parts = compact(parts.filter("span > 0"), "spans")
    out = out.join(parts, [*key, "span"], "left")
    joined = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    for c, agg in sums.items():
        out = out.withColumn(c, joined[agg](F.col(c), F.coalesce(F.col(f"{c}_"), F.lit(0).cast("long"))))
    return out.drop("span", *[f"{c}_" for c in sums])


def _xor(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.col(b))


def block_classes(rows: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """Conversations alike up to the end of a block: block, the prefixes before (s1, s2) and after
    it (h1, h2), its turns, n_convs and the smallest member conv_id."""
    at_block = F.floor(F.col("at") / block).alias("block")
    own = rows.groupBy("conv_id", at_block).agg(
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("turns")
    )
    own = own.withColumns({"o1": F.col("h1"), "o2": F.col("h2")})
    upto = running(own, ["conv_id"], "block", {"h1": "bit_xor", "h2": "bit_xor"})
    upto = upto.withColumns({"s1": _xor("h1", "o1"), "s2": _xor("h2", "o2")})
    return upto.groupBy("block", "s1", "s2", "h1", "h2", "turns").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )


def nodes(rows: DataFrame, ids: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """One row a node: prefix (h1, h2), its parent's (q1, q2), depth, conv_id, n_convs, bytes."""
    classes = settle(block_classes(rows, block), "classes")
    sibling = ["block", "s1", "s2"]
    alone = classes.groupBy(*sibling).agg(F.count("*").alias("k"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    alone = settle(alone.filter("k = 1").drop("k"), "alone")

    def turn_rows(classes: DataFrame) -> DataFrame:
        """The turns of each class's smallest member in its block, with prefixes."""
        in_block = rows.withColumn("block", F.floor(F.col("at") / block))
        found = in_block.join(classes.select(*sibling, "conv_id", "n_convs"), ["conv_id", "block"])
        along = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        upto = {p: F.bit_xor(h).over(along).bitwiseXOR(F.col(s)) for p, h, s in (("p1", "h1", "s1"), ("p2", "h2", "s2"))}
        return found.withColumns(upto).select(
            F.col("p1"), F.col("p2"), _xor("p1", "h1").alias("q1"), _xor("p2", "h2").alias("q2"),
            (F.col("at") + 1).alias("depth"), "bytes", "n_convs", "conv_id",
        )

    split = classes.join(alone.select(*sibling), sibling, "left_anti")
    refined = turn_rows(split).groupBy("p1", "p2", "q1", "q2", "depth", "bytes")
    refined = refined.agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(
        zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("depth"),
        zero.alias("bytes"), "n_convs", "conv_id",
    )
    return turn_rows(alone).unionByName(refined).unionByName(root)


def ends(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """p1, p2 and ends_sha256 of the nodes at which conversations end."""
    whole = rows.groupBy("conv_id").agg(F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    zero = F.lit(0).cast("long")
    whole = ids.join(whole, "conv_id", "left").select(
        F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), "conv_id"
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, ids = (np.asarray(c) for c in batch.columns)
            new = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
            begins = [at for a, b in zip(edges, edges[1:], strict=False) for at in range(a, b, PIECE_IDS)]
            numbers = ids.tolist()
            texts = [
                ",".join(map(str, numbers[a:b])) for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)
            ]
            columns = [pa.array(c[begins]) for c in (p1, p2, ids)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=["p1", "p2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["p1", "p2", "ends_sha256"])

        for batch in batches:
            p1, p2, _, texts = (c.to_pylist() for c in batch.columns)
            for *key, text in zip(p1, p2, texts, strict=True):
                if key != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            yield flush()
        if node:
            out.append((*node, sha.hexdigest()))
            yield flush()

    order = ["p1", "p2", "conv_id"]
    sorted_ = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    joined = sorted_.mapInArrow(pieces, "p1 long, p2 long, first long, ids string")
    by_node = joined.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return by_node.mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def subtree_sums(found: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of nodes (conv_id, depth, parent_conv_id, n_children, saved).

    A chain is what a conversation owns. Each round a chain passes what it has gathered to the chain at its
    pointer, and pointers move on to their pointer's pointer.
    """
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    kept = [c for c in found.columns if c != "saved"]
    found = found.select(*kept, leaf.alias("leaves"), "saved")
    chains = found.groupBy("conv_id").agg(
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
        F.max(F.when(~F.col("parent_conv_id").eqNullSafe(F.col("conv_id")), F.col("parent_conv_id"))).alias("up"),
        (F.min("depth") - 1).alias("hangs_at"),
    )
    chains = settle(chains.withColumn("hangs_on", F.col("up")), "chains")
    while True:
        given = chains.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"))
        given = given.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        given = compact(given, "given")
        if given.isEmpty():
            break
        pointers = chains.filter("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = chains.join(given, "conv_id", "left").join(pointers, "up", "left").select(
            "conv_id",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            F.col("next").alias("up"),
            "hangs_at",
            "hangs_on",
        )
        passed = settle(moved, "chains")
        discard(chains)
        chains = passed
    hung = chains.filter("hangs_on IS NOT NULL")
    hung = hung.groupBy(F.col("hangs_on").alias("conv_id"), F.col("hangs_at").alias("depth"))
    hung = hung.agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    own = found.join(hung, ["conv_id", "depth"], "left").select(
        *kept,
        (F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("hung_saved", F.lit(0))).alias("saved_tokens"),
    )
    # Along a chain, from its end up to each node. Places for `running` count from the chain's end.
    deepest = own.groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    own = own.join(deepest, "conv_id").withColumn("up", F.col("deepest") - F.col("depth"))
    sums = {"n_leaves": "sum", "saved_tokens": "sum"}
    return running(own, ["conv_id"], "up", sums).drop("up", "deepest")


def trie(conversations: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    original = settle(turns(conversations), "turns")
    rows, ids = rebuilt(original)
    rows = settle(rows, "rebuilt")
    found = settle(nodes(rows, ids, block), "nodes")
    children = found.filter("q1 IS NOT NULL").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    children = children.agg(F.count("*").alias("n_children"))
    owners = found.select(
        F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id")
    )
    known = found.join(children, ["p1", "p2"], "left").join(owners, ["q1", "q2"], "left")
    known = known.join(ends(rows, ids), ["p1", "p2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    summed = subtree_sums(settle(known, "trie"))
    return summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
